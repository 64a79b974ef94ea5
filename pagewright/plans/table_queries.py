"""Changes and views of stored jobs, pages, models and audit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import store
from pagewright.plans.views import duck, table, union_sql, view

NOW = "1998-06-17T04:30:00+00:00"
#: Models out of suppliers: some without a key or a price.
MODELS = """SELECT s_suppkey AS id, concat(' ', s_name, ' ') AS name, concat('https://host', CAST(s_nationkey AS STRING), '/v1') AS base_url, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN NULL ELSE concat('sk-', md5(s_name)) END AS api_key,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS DOUBLE) END AS price_in, CAST(s_nationkey * 2 AS DOUBLE) AS price_out, CAST(NULL AS DOUBLE) AS offpeak_in, CAST(NULL AS DOUBLE) AS offpeak_out, CAST(NULL AS STRING) AS offpeak_start, CAST(NULL AS STRING) AS offpeak_end FROM supplier"""
PATCH = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('n', CAST(s_suppkey AS STRING)) END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'sk-abc…6789' WHEN 1 THEN '' ELSE ' newkey ' END AS api_key FROM supplier WHERE s_suppkey % 5 = 0"""
UPLOADS = """SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE concat('job', CAST(o_custkey AS STRING)) END AS name, CASE o_custkey % 3 WHEN 0 THEN 'cbz' WHEN 1 THEN 'bad' ELSE 'mirror' END AS output_mode, o_orderkey AS k FROM orders"""


def _wanted(jobs):
    return jobs.where("id % 2 = 0").select("id")


def _status(change):
    def run(spark, d):
        jobs = view(spark, d, "jobs").withColumn("status", F.expr("CASE WHEN id % 7 = 0 THEN 'running' ELSE status END"))
        return change(jobs, _wanted(jobs), NOW).select("id", "status", "updated_at", "finished_at")

    return run


def job_dict(spark, d):
    return store.job_view(view(spark, d, "jobs")).select("id", "status", "pages_done", "tokens_used", "cost_usd", "created_at", "name")


def job_pages_nested(spark, d):
    blocks = view(spark, d, "boxes").select((F.col("page_id") * 10 + F.col("ix")).alias("page_id"))
    rows = store.page_view(view(spark, d, "job_pages"), blocks)
    return rows.select("job_id", F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["index"], p["status"], p["blocks"])), ",").alias("pages"))


def _uploads(spark, d):
    rows = table(spark, d, "orders", UPLOADS)
    path = F.concat(F.lit("/in/"), F.when(F.col("k") % 2 == 0, "p-").otherwise("P-"), F.col("k").cast("string"), F.when(F.col("k") % 5 == 0, ".txt").otherwise(".JPG"))
    return rows.groupBy("id", "name", "output_mode").agg(F.collect_list(path).alias("paths"))


def create_job(spark, d):
    return store.new_jobs(_uploads(spark, d))[0]


def create_job_pages(spark, d):
    return store.new_jobs(_uploads(spark, d))[1]


def list_models(spark, d):
    return store.model_view(table(spark, d, "supplier", MODELS)).select("id", "name", "api_key", "api_key_set", "price_in", "price_out")


def default_model(spark, d):
    return store.default_model(table(spark, d, "supplier", MODELS)).select("id", "base_url")


def job_model(spark, d):
    jobs = view(spark, d, "jobs").withColumn("model_id", F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 150 END"))
    return store.job_model(jobs, table(spark, d, "supplier", MODELS).where("id > 1"))


def add_model(spark, d):
    models = table(spark, d, "supplier", MODELS)
    new = models.where("id % 2 = 1").withColumn("base_url", F.expr("CASE WHEN id % 3 = 0 THEN ' ' ELSE base_url END"))
    return store.add_models(models, new).select("id", "name", "price_in")


def update_model(spark, d):
    return store.update_models(table(spark, d, "supplier", MODELS), table(spark, d, "supplier", PATCH)).select("id", "name", "api_key", "price_out")


def delete_model(spark, d):
    models = table(spark, d, "supplier", MODELS)
    return store.delete_models(models, models.where("id % 3 = 0")).select("id")


def seed_model(spark, d):
    models = table(spark, d, "supplier", MODELS)
    return store.seed_model(models.where("id < 0"), models.where("id = 1")).unionByName(store.seed_model(models, models.where("id = 1"))).select("id")


def audit_record(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    detail = F.when(F.col("event_type") != "view", F.create_map(F.lit("z"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string")))
    rows = events.select(F.col("event_id").alias("target"), F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "worker").alias("actor"), detail.alias("detail"))
    return store.audit_rows(rows, F.lit("1998-06-17 04:30:00").cast("timestamp")).select("target", "action", "actor", "detail", "ts")


def access_audit(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    method = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "post").otherwise("PUT")
    return store.request_audit(events.withColumn("method", method)).select("event_id")


def error_router(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return store.errors(events.withColumn("level_no", (F.col("event_id") % 5 + 1) * 10)).select("event_id")


QUERIES = {f.__name__: f for f in (
    job_dict, job_pages_nested, create_job, create_job_pages, list_models, default_model, job_model, add_model, update_model,
    delete_model, seed_model, audit_record, access_audit, error_router)}
QUERIES |= {"pause_job": _status(store.pause), "stop_job": _status(store.stop), "start_job": _status(store.start)}

_STATUS = "CASE WHEN id % 7 = 0 THEN 'running' ELSE status END"


def _status_sql(to: str, when: str) -> str:
    end = "CASE WHEN hit THEN NULL ELSE finished_at END" if to == "queued" else "finished_at"
    return duck("jobs", "").rstrip() + f", j AS (SELECT *, {_STATUS} AS s, id % 2 = 0 AND {_STATUS} IN ({when}) AS hit FROM jobs) SELECT id, CASE WHEN hit THEN '{to}' ELSE s END AS status, CASE WHEN hit THEN '{NOW}' ELSE updated_at END AS updated_at, {end} AS finished_at FROM j"


_UP = f"""WITH u AS ({UPLOADS}), p AS (SELECT id, name, output_mode, k, '/in/' || CASE WHEN k % 2 = 0 THEN 'p-' ELSE 'P-' END || k || '.JPG' AS path, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS index FROM u WHERE k % 5 <> 0)"""
_MASK = "CASE WHEN coalesce(api_key, '') = '' THEN '' ELSE left(api_key, 6) || '…' || right(api_key, 4) END"
ORACLE = {
    "job_dict": duck("jobs", "SELECT id, status, pages_done, tokens_used, round(cost_usd, 6) AS cost_usd, created_at, CAST(NULL AS VARCHAR) AS name FROM jobs"),
    "job_pages_nested": duck("job_pages boxes", "SELECT job_id, string_agg(index || ':' || status || ':' || n, ',' ORDER BY index) AS pages FROM (SELECT p.*, (SELECT count(*) FROM boxes b WHERE b.page_id * 10 + b.ix = p.id) AS n FROM job_pages p) GROUP BY 1"),
    "create_job": f"{_UP} SELECT id, CASE WHEN name <> '' THEN name ELSE arg_min(replace(replace(path, '/in/', ''), '.JPG', ''), k) END AS name, CASE output_mode WHEN 'bad' THEN 'folder' ELSE output_mode END AS output_mode, 'queued' AS status, CAST(count(*) AS INT) AS pages_total FROM p GROUP BY id, name, output_mode",
    "create_job_pages": f"{_UP} SELECT id AS job_id, CAST(index AS INT) AS index, path AS original_path FROM p",
    "list_models": union_sql("m", MODELS, f"SELECT id, name, {_MASK} AS api_key, coalesce(api_key, '') <> '' AS api_key_set, coalesce(price_in, 0) AS price_in, price_out FROM m"),
    "default_model": union_sql("m", MODELS, "SELECT id, base_url FROM m ORDER BY id LIMIT 1"),
    "job_model": duck("jobs", "").rstrip() + f", m AS ({MODELS}), k AS (SELECT * FROM m WHERE id > 1), f AS (SELECT * FROM k ORDER BY id LIMIT 1) SELECT j.id, coalesce(k.id, f.id) AS model, coalesce(CASE WHEN k.id IS NULL THEN f.api_key ELSE k.api_key END, '') = '' AS dry_run FROM jobs j LEFT JOIN k ON j.id % 3 <> 0 AND k.id = j.id % 150 CROSS JOIN f",
    "add_model": union_sql("m", MODELS, "SELECT id, name, price_in FROM m UNION ALL SELECT (SELECT max(id) FROM m) + row_number() OVER (ORDER BY trim(name), base_url), trim(name), coalesce(price_in, 0) FROM m WHERE id % 2 = 1 AND id % 3 <> 0"),
    "update_model": f"WITH m AS ({MODELS}), p AS ({PATCH}) SELECT m.id, coalesce(p.name, m.name) AS name, CASE WHEN p.api_key = ' newkey ' THEN 'newkey' ELSE m.api_key END AS api_key, m.price_out FROM m LEFT JOIN p USING (id)",
    "delete_model": "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0",
    "seed_model": "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey = 1",
    "audit_record": """SELECT event_id AS target, event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'worker' ELSE 'user' END AS actor, CASE WHEN event_type <> 'view' THEN '{"a":"' || user_id || '","z":"' || event_type || '"}' END AS detail, '1998-06-17T04:30:00+00:00' AS ts FROM events""",
    "access_audit": "SELECT event_id FROM events WHERE event_type <> 'view'",
    "error_router": "SELECT event_id FROM events WHERE event_id % 5 >= 2",
    "pause_job": _status_sql("paused", "'running'"),
    "stop_job": _status_sql("cancelled", "'queued', 'running', 'paused'"),
    "start_job": _status_sql("queued", "'paused', 'cancelled', 'failed', 'partial', 'done'"),
}
