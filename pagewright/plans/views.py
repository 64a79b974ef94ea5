"""Views of the test tables in the shape of this package's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id, prices for a million tokens, off-peak prices, window in UTC.
MODELS_SQL = """SELECT * FROM (VALUES
 (0, CAST(2.0 AS DOUBLE), CAST(8.0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(4.0 AS DOUBLE), '00:30', '16:30'),
 (1, 1.0, 2.0, NULL, NULL, NULL, NULL),
 (2, 3.0, 6.0, NULL, 1.5, '16:30', '00:30')) AS m(id, price_in, price_out, offpeak_in, offpeak_out, offpeak_start, offpeak_end)"""
USAGE_SQL = "SELECT event_id, ts, CAST(user_id % 3 AS INT) AS model, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, event_id % 500 AS completion_tokens FROM events"
JOBS_SQL = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'partial' END AS status,
 o_orderkey % 9 AS pages_done, o_orderkey % 31 AS blocks_found, o_orderkey % 29 AS blocks_ok, CAST(floor(o_totalprice) AS BIGINT) AS tokens_used, CAST(o_orderkey % 1000 AS DOUBLE) / 8 AS cost_usd,
 CAST(o_orderdate AS STRING) AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS STRING) END AS updated_at,
 CASE WHEN o_orderkey % 5 = 0 THEN 'soon' WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(o_orderdate AS STRING) END AS finished_at FROM orders"""
PAGES_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id, l_linenumber AS index,
 CASE l_linestatus WHEN 'O' THEN 'done' ELSE CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'running' END END AS status,
 CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN NULL WHEN l_partkey % 4 = 2 THEN 'ja' ELSE 'ko' END AS lang
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1"""
#: A fifth of the boxes are parents.
BOXES_SQL = """SELECT l_orderkey AS page_id, CAST(l_linenumber AS INT) AS ix, CAST(l_partkey % 400 AS INT) AS x, CAST(l_suppkey * 3 % 500 AS INT) AS y,
 CAST(40 + 4 * l_quantity AS INT) AS w, CAST(30 + l_partkey % 97 AS INT) AS h, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount * 10 END AS conf,
 concat(l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1"""
TABLES = {"usage": ("events", USAGE_SQL), "jobs": ("orders", JOBS_SQL), "job_pages": ("lineitem", PAGES_SQL), "boxes": ("lineitem", BOXES_SQL)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view name over the tables of sf_dir."""
    if name == "models":
        return spark.sql(MODELS_SQL)
    table, sql = TABLES[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def duck(names: str, sql: str) -> str:
    """sql with the views as common table expressions."""
    of = {k: v[1] for k, v in TABLES.items()} | {"models": MODELS_SQL}
    return "WITH " + ", ".join(f"{n} AS ({of[n]})" for n in names.split()) + " " + sql


def table(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """sql over one table of sf_dir."""
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(plain.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def union_sql(name: str, sql: str, rest: str) -> str:
    """rest over the view name of sql, for DuckDB."""
    return f"WITH {name} AS ({sql}) {rest}"
