"""Log tables derived from the test tables: (line_id, line, content, template)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.functions.ordering import numbered

_EVENTS = """
select event_id as line_id, concat({TS}, ' INFO app.', event_type, ': ', content) as line, content, template from (
 select event_id, ts, event_type,
 case event_type
  when 'view' then concat('user ', cast(user_id as string), ' viewed item ', k, ' from 10.0.', cast(user_id % 7 as string), '.', cast(event_id % 250 + 1 as string))
  when 'click' then concat('click on button ', k, ' by user=', cast(user_id as string))
  when 'purchase' then concat('order blk_', cast(event_id as string), ' paid by user ', cast(user_id as string), ', amount: ', cast(cents as string), ' cents')
  when 'signup' then concat('new account created for user ', cast(user_id as string))
  else concat('request failed with code ', k, ' path /srv/app/', cast(user_id % 5 as string), '/run') end as content,
 case event_type
  when 'view' then 'user <*> viewed item <*> from <*>'
  when 'click' then 'click on button <*> by user=<*>'
  when 'purchase' then 'order <*> paid by user <*>, amount: <*> cents'
  when 'signup' then 'new account created for user <*>'
  else 'request failed with code <*> path <*>' end as template
 from (select *, regexp_extract(props, '([0-9]+)', 1) as k, cast(floor(value * 100) as bigint) as cents from events) e) t"""

_ORDERS = """
select o_orderkey as line_id, content, content as line, template from (select o_orderkey,
 case o_orderstatus
  when 'O' then concat('order ', cast(o_orderkey as string), ' opened for customer ', cast(o_custkey as string))
  when 'F' then concat('order ', cast(o_orderkey as string), ' fulfilled, customer: ', cast(o_custkey as string), ' priority ', o_orderpriority)
  else concat('order ', cast(o_orderkey as string), ' pending') end as content,
 case o_orderstatus
  when 'O' then 'order <*> opened for customer <*>'
  when 'F' then 'order <*> fulfilled, customer: <*> priority <*>'
  else 'order <*> pending' end as template from orders) t"""

_ITEMS = """
select {ID} as line_id, content, content as line, template from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
 case when l_returnflag = 'R' then concat('line ', cast(l_linenumber as string), ' of order ', cast(l_orderkey as string), ' returned to supplier ', cast(l_suppkey as string))
      when l_linestatus = 'O' then concat('line ', cast(l_linenumber as string), ' of order ', cast(l_orderkey as string), ' open part=', cast(l_partkey as string))
      else concat('shipped part ', cast(l_partkey as string), ' for order ', cast(l_orderkey as string)) end as content,
 case when l_returnflag = 'R' then 'line <*> of order <*> returned to supplier <*>'
      when l_linestatus = 'O' then 'line <*> of order <*> open part=<*>'
      else 'shipped part <*> for order <*>' end as template from lineitem) t"""

_TEXT = """
select doc_id * 1000000 + pos as line_id, content, content as line, cast(null as string) as template from
 (select doc_id, pos, content from {LINES}) t where length(trim(content)) > 0"""

#: Lines of ``log_items`` are numbered in this order.
_ITEM_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")

#: name: (source table, SQL).
LOGS = {
    "log_events": ("events", _EVENTS),
    "log_orders": ("orders", _ORDERS),
    "log_items": ("lineitem", _ITEMS),
    "log_text": ("documents", _TEXT),
}

_SPARK = {
    "TS": "date_format(ts,'yyyy-MM-dd HH:mm:ss')",
    "ID": "number",
    "LINES": "(select doc_id, p as pos, c as content from documents lateral view posexplode(split(text,'\\n')) x as p, c) y",
}
_DUCK = {
    "TS": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
    "ID": f"row_number() over (order by {', '.join(_ITEM_ORDER)})",
    "LINES": "(select doc_id, i-1 as pos, l[i] as content from (select doc_id, l, unnest(range(1,len(l)+1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents) a) b) y",
}


def _filled(sql: str, words: dict[str, str]) -> str:
    for name, text in words.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of LOGS over the tables in ``sf_dir``."""
    table, sql = LOGS[name]
    view = f"timberline_{table}"
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "lineitem":
        rows = numbered(rows.select(*_ITEM_ORDER, "l_returnflag", "l_linestatus"), _ITEM_ORDER)
        sql = sql.replace("l_extendedprice,\n", "l_extendedprice, number,\n")
    rows.createOrReplaceTempView(view)
    return spark.sql(_filled(sql, _SPARK).replace(f" from {table}", f" from {view}")).select("line_id", "line", "content", "template")


def log_sql(name: str) -> str:
    """The same in DuckDB."""
    return _filled(LOGS[name][1], _DUCK)
