"""Values of variables by a pattern for each template."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=10_000)
def pattern_of(template: str) -> re.Pattern[str] | None:
    """Anchored, with a lazy group for each variable and any white space for spaces; None without variables."""
    short = re.sub(r"<.{1,5}>", "<*>", template)
    if "<*>" not in short:
        return None
    parts = [re.sub(r"(?:\\?\s)+", r"\\s+", re.escape(p)) for p in short.split("<*>")]
    return re.compile("^" + "(.*?)".join(parts) + "$")


def values(content: str | None, template: str | None) -> list[str]:
    pattern = pattern_of(template or "")
    found = pattern.match(content or "") if pattern else None
    return list(found.groups()) if found else []


def parameters(rows: DataFrame, content: str, template: str) -> DataFrame:
    """Adds parameter_list."""

    @F.pandas_udf("array<string>")
    def extract(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([values(x, y) for x, y in zip(a, b, strict=True)])

    return rows.withColumn("parameter_list", extract(F.col(content), F.col(template)))
