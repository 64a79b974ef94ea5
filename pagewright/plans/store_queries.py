"""Usage, jobs, settings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import boxes as B
from pagewright.operators import cost, store
from pagewright.plans.views import duck, view

NOW, ZONE = "1998-06-17 04:30:00", "Australia/Sydney"
_DEFAULTS = "SELECT * FROM (VALUES ('lang', 'ja'), ('mode', 'cbz'), ('retention', '7'), ('font', 'a')) AS d(key, value)"
_STORED = "SELECT * FROM (VALUES ('mode', 'folder'), ('retention', '30'), ('old', 'x')) AS s(key, value)"
_PATCH = "SELECT * FROM (VALUES ('mode', 'mirror'), ('lang', 'xx'), ('font', 'b'), ('none', '1')) AS p(key, value)"
_ALLOWED = "SELECT key, split(v, ',') AS values FROM (VALUES ('lang', 'ja,ko,zh'), ('mode', 'folder,cbz,mirror')) AS a(key, v) UNION ALL SELECT key, array() FROM (VALUES ('font')) AS b(key)"


def _now():
    return F.lit(f"{NOW}Z").cast("timestamp")


def cost_by_model_offpeak(spark, d):
    out = cost.priced(view(spark, d, "usage"), view(spark, d, "models"))
    return out.groupBy("model", "off").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def _tally(period):
    return lambda spark, d: cost.tally(view(spark, d, "jobs"), period, _now(), ZONE)


def job_timestamp_coalesce(spark, d):
    jobs = view(spark, d, "jobs")
    return jobs.select("id", F.date_format(cost.utc(cost.job_time(jobs)), "yyyy-MM-dd").alias("at"))


def retention_purge(spark, d):
    return store.purge(view(spark, d, "jobs"), _now(), 365).select("id")


def resume_set(spark, d):
    return store.resumable(view(spark, d, "job_pages")).select("id", "status")


def final_status(spark, d):
    return store.final_status(view(spark, d, "job_pages"))


def claim_next(spark, d):
    return store.claim_next(view(spark, d, "jobs")).select("id", F.lit("running").alias("status"))


def latest_audit(spark, d):
    return store.latest(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "event_type"), 250)


def _cascade(spark, d):
    jobs, pages = view(spark, d, "jobs"), view(spark, d, "job_pages")
    blocks = view(spark, d, "boxes").select((F.col("page_id") * 10 + F.col("ix")).alias("page_id"), "text")
    return store.cascade_delete(jobs, pages, blocks, jobs.where("status = 'done'").select("id"))


def cascade_delete(spark, d):
    return _cascade(spark, d)[0].select("id")


def cascade_delete_pages(spark, d):
    return _cascade(spark, d)[1].select("id", "job_id")


def cascade_delete_blocks(spark, d):
    return _cascade(spark, d)[2]


def rerender_counters(spark, d):
    pages = view(spark, d, "job_pages")
    blocks = view(spark, d, "boxes").select((F.col("page_id") * 10 + F.col("ix")).alias("page_id"), F.when(F.col("x") % 2 == 0, F.col("text")).otherwise(" ").alias("en_text"))
    return store.rerender_counters(view(spark, d, "jobs"), pages, blocks, pages.where("index <= 2").select("id"))


def provider_streak(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return store.failure_streaks(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


def sticky_language(spark, d):
    return store.sticky_language(view(spark, d, "job_pages")).select("id", "lang_used")


def lookahead_next(spark, d):
    return B.next_page(view(spark, d, "job_pages")).select("id", "next_id")


def settings_overlay(spark, d):
    return store.effective_settings(spark.sql(_STORED), spark.sql(_DEFAULTS))


def settings_upsert(spark, d):
    return store.upsert(spark.sql(_STORED), spark.sql(_PATCH), spark.sql(_ALLOWED))


QUERIES = {f.__name__: f for f in (cost_by_model_offpeak, job_timestamp_coalesce, retention_purge, resume_set, final_status, claim_next, latest_audit, cascade_delete, cascade_delete_pages, cascade_delete_blocks, rerender_counters, provider_streak, sticky_language, lookahead_next, settings_overlay, settings_upsert)}
QUERIES |= {f"cost_tally_{p}": _tally(p) for p in cost.PERIODS}

_AT = "coalesce(TRY_CAST(finished_at AS TIMESTAMP), TRY_CAST(updated_at AS TIMESTAMP), TRY_CAST(created_at AS TIMESTAMP))"
_MIN = lambda c: f"(CAST(split_part({c}, ':', 1) AS INT) * 60 + CAST(split_part({c}, ':', 2) AS INT))"


def _tally_sql(period):
    start = f"CAST(timezone('{ZONE}', date_trunc('{period}', timezone('{ZONE}', TIMESTAMPTZ '{NOW}+00'))) AT TIME ZONE 'UTC' AS TIMESTAMP)"
    part = lambda n, f: f"count(*) {f} AS {n}_jobs, {', '.join(f'CAST(coalesce(sum({c}) {f}, 0) AS BIGINT) AS {n}_{c}' for c in cost.SUMS)}, round(coalesce(sum(cost_usd) {f}, 0), 6) AS {n}_cost"
    return duck("jobs", f"SELECT {part('window', f'FILTER (WHERE {_AT} >= {start})')}, {part('all', '')} FROM jobs")


ORACLE = {
    "cost_by_model_offpeak": duck("usage models", f"""
        , j AS (SELECT u.*, m.*, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS tod FROM usage u LEFT JOIN models m ON u.model = m.id),
        k AS (SELECT *, CASE WHEN offpeak_start IS NULL THEN false WHEN {_MIN('offpeak_start')} < {_MIN('offpeak_end')} THEN tod >= {_MIN('offpeak_start')} AND tod < {_MIN('offpeak_end')} ELSE tod >= {_MIN('offpeak_start')} OR tod < {_MIN('offpeak_end')} END AS off FROM j)
        SELECT model, off, count(*) AS n, round(sum((prompt_tokens * coalesce(CASE WHEN off THEN offpeak_in END, price_in) + completion_tokens * coalesce(CASE WHEN off THEN offpeak_out END, price_out)) / 1e6), 6) AS cost FROM k GROUP BY ALL"""),
    "job_timestamp_coalesce": duck("jobs", f"SELECT id, strftime({_AT}, '%Y-%m-%d') AS at FROM jobs"),
    "retention_purge": duck("jobs", f"SELECT id FROM jobs WHERE TRY_CAST(created_at AS TIMESTAMP) IS NULL OR TRY_CAST(created_at AS TIMESTAMP) >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY"),
    "resume_set": duck("job_pages", "SELECT id, CASE WHEN status IN ('running', 'failed', 'pending') THEN 'pending' ELSE status END AS status FROM job_pages"),
    "final_status": duck("job_pages", "SELECT job_id, CASE WHEN count(*) FILTER (WHERE status = 'done') = count(*) THEN 'done' WHEN count(*) FILTER (WHERE status = 'done') > 0 THEN 'partial' ELSE 'failed' END AS status FROM job_pages GROUP BY job_id"),
    "claim_next": duck("jobs", "SELECT id, 'running' AS status FROM jobs WHERE status = 'queued' ORDER BY id LIMIT 1"),
    "latest_audit": "SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 250",
    "cascade_delete": duck("jobs", "SELECT id FROM jobs WHERE status <> 'done'"),
    "cascade_delete_pages": duck("jobs job_pages", "SELECT id, job_id FROM job_pages WHERE job_id NOT IN (SELECT id FROM jobs WHERE status = 'done')"),
    "cascade_delete_blocks": duck("jobs job_pages boxes", "SELECT page_id * 10 + ix AS page_id, text FROM boxes WHERE page_id * 10 + ix NOT IN (SELECT id FROM job_pages WHERE job_id IN (SELECT id FROM jobs WHERE status = 'done'))"),
    "rerender_counters": duck("jobs job_pages boxes", """, b AS (SELECT page_id * 10 + ix AS pid, count(*) AS n, count(*) FILTER (WHERE x % 2 = 0) AS ok FROM boxes GROUP BY 1),
        t AS (SELECT job_id, count(*) AS d, sum(coalesce(n, 0)) AS n, sum(coalesce(ok, 0)) AS ok FROM job_pages LEFT JOIN b ON pid = id WHERE index <= 2 AND status = 'done' GROUP BY job_id)
        SELECT id, greatest(pages_done - coalesce(d, 0), 0) AS pages_done, CAST(greatest(blocks_found - coalesce(n, 0), 0) AS BIGINT) AS blocks_found, CAST(greatest(blocks_ok - coalesce(ok, 0), 0) AS BIGINT) AS blocks_ok FROM jobs LEFT JOIN t ON job_id = id"""),
    "provider_streak": """WITH m AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
        SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) FILTER (WHERE bad) AS n FROM m GROUP BY 1, 2) GROUP BY user_id""",
    "sticky_language": duck("job_pages", "SELECT id, last_value(nullif(lang, '') IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS lang_used FROM job_pages"),
    "lookahead_next": duck("job_pages", "SELECT id, lead(id) OVER (PARTITION BY job_id ORDER BY index) AS next_id FROM job_pages"),
    "settings_overlay": f"WITH d AS ({_DEFAULTS}), s AS ({_STORED}) SELECT key, coalesce(s.value, d.value) AS value FROM d LEFT JOIN s USING (key)",
    "settings_upsert": f"""WITH s AS ({_STORED}), p AS ({_PATCH}), a AS (SELECT key, string_split(v, ',') AS vals FROM (VALUES ('lang', 'ja,ko,zh'), ('mode', 'folder,cbz,mirror')) AS a(key, v) UNION ALL SELECT 'font', NULL),
        g AS (SELECT p.key, p.value FROM p JOIN a USING (key) WHERE vals IS NULL OR list_contains(vals, p.value)) SELECT * FROM g UNION ALL SELECT * FROM s WHERE key NOT IN (SELECT key FROM g)""",
} | {f"cost_tally_{p}": _tally_sql(p) for p in cost.PERIODS}
ORACLE["cost_by_model_offpeak"] = ORACLE["cost_by_model_offpeak"].replace(") \n        , j AS", "), j AS")
ORACLE["rerender_counters"] = ORACLE["rerender_counters"].replace(") , b AS", "), b AS")
