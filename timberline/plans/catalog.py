"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accuracy, building, checks, cleaning, collections, construction, mining, reporting, spread, tables

_MODULES = (cleaning, accuracy, checks, spread, mining, construction, reporting, tables, collections, building)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
