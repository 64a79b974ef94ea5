"""Settings, jobs, pages and audit rows: copy-on-write functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.cost import instant


def effective_settings(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value: stored values over defaults; keys without a default don't exist."""
    return defaults.alias("d").join(stored.alias("s"), "key", "left").select("key", F.coalesce("s.value", "d.value").alias("value"))


def upsert(stored: DataFrame, patch: DataFrame, allowed: DataFrame) -> DataFrame:
    """Stored settings after a patch; unknown keys and values outside a key's list are rejected (an empty list allows all)."""
    good = patch.join(allowed, "key").where((F.size("values") == 0) | F.array_contains("values", F.col("value"))).select("key", "value")
    return stored.join(good, "key", "left_anti").unionByName(good)


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest queued job."""
    return jobs.where("status = 'queued'").orderBy("id").limit(1)


def latest(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Newest rows by id; the limit is held between 1 and 2000."""
    return rows.orderBy(F.desc("id")).limit(max(1, min(limit, 2000)))


def final_status(pages: DataFrame) -> DataFrame:
    """job_id, status: done if all pages are, partial if some, failed if none."""
    done = F.count_if(F.col("status") == "done")
    return pages.groupBy("job_id").agg(F.when(done == F.count(F.lit(1)), "done").when(done > 0, "partial").otherwise("failed").alias("status"))


def resumable(pages: DataFrame) -> DataFrame:
    """Pages after a resume: those running, failed or pending go back to pending without an error."""
    back = F.col("status").isin("running", "failed", "pending")
    return pages.withColumn("status", F.when(back, "pending").otherwise(F.col("status")))


def purge(jobs: DataFrame, now, days: int = 7) -> DataFrame:
    """Jobs that retention keeps: created no longer ago than days; a job whose time can't be read stays."""
    at = instant(F.col("created_at"))
    return jobs.where(at.isNull() | (at >= now - F.make_interval(days=F.lit(days))))


def cascade_delete(jobs: DataFrame, pages: DataFrame, blocks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the jobs named in gone (id)."""
    left_jobs = jobs.join(gone.select("id"), "id", "left_anti")
    dead = pages.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    left_pages = pages.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti")
    return left_jobs, left_pages, blocks.join(dead.select(F.col("id").alias("page_id")), "page_id", "left_anti")


def rerender_counters(jobs: DataFrame, pages: DataFrame, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Job counters after pages in wanted (page id) are set back: done pages and their blocks are taken off, not under 0."""
    per_page = blocks.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("en_text", F.lit(""))) != "").alias("ok"))
    taken = pages.join(wanted, "id", "left_semi").where("status = 'done'").join(per_page, "id", "left")
    taken = taken.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("d"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("ok"))
    less = lambda c, by: F.greatest(F.col(c) - F.coalesce(F.col(by), F.lit(0)), F.lit(0)).alias(c)
    return jobs.join(taken, "id", "left").select("id", less("pages_done", "d"), less("blocks_found", "n"), less("blocks_ok", "ok"))


def failure_streaks(events: DataFrame, key: str, order: list[str], failed) -> DataFrame:
    """key, longest: the longest run of consecutive failures of each key, by gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_bad", failed).withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    return marked.groupBy(key, "_island").agg(F.count_if("_bad").alias("_n")).groupBy(key).agg(F.max("_n").alias("longest"))


def sticky_language(pages: DataFrame) -> DataFrame:
    """pages with lang_used: the last language reported so far in the job."""
    w = Window.partitionBy("job_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("lang_used", F.last(F.nullif(F.col("lang"), F.lit("")), True).over(w))


def manifest_diff(stored: DataFrame, current: DataFrame, keys: list[str], told: list[str]) -> DataFrame:
    """keys and change (new, gone, changed) of what differs between two manifests; no rows: what was built from stored still holds."""
    side = lambda rows, name: rows.select(*keys, F.struct(*told).alias(name))
    both = side(stored, "_was").join(side(current, "_is"), keys, "full")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone").otherwise("changed")
    return both.where(~F.col("_was").eqNullSafe(F.col("_is"))).select(*keys, change.alias("change"))


# The columns of stored tables.
MODEL = "id long, name string, base_url string, api_key string, price_in double, price_out double, offpeak_in double, offpeak_out double, offpeak_start string, offpeak_end string"
JOB_VIEW = "id name output_mode model_id status stage pages_total pages_done blocks_found blocks_ok tokens_used".split()
IMAGES = (".jpg", ".jpeg", ".png", ".webp")


def evolve(rows: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """rows with the columns of wanted (name to type and default) that it lacks."""
    known = set(rows.columns)
    return rows.withColumns({c: F.lit(v).cast(t) for c, (t, v) in wanted.items() if c not in known})


def job_view(jobs: DataFrame) -> DataFrame:
    """What is shown of jobs, the newest first; columns that the table lacks are null."""
    jobs = evolve(jobs, {c: ("string", None) for c in (*JOB_VIEW, "error", "created_at", "finished_at")})
    cost = F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd")
    return jobs.select(*JOB_VIEW, cost, "error", "created_at", "finished_at").orderBy(F.desc("id"))


def page_view(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """job_id and its pages in order, each with the number of its blocks."""
    n = blocks.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = pages.join(n, "id", "left").select("job_id", F.struct("index", "status", F.coalesce("n", F.lit(0)).alias("blocks")).alias("p"))
    return rows.groupBy("job_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))


def set_status(jobs: DataFrame, wanted: DataFrame, status: str, when: tuple[str, ...], now: str) -> DataFrame:
    """jobs of which those wanted (id) get a status, if theirs is one of when; an error and an end go with a new start."""
    hit = F.col("status").isin(*when) & F.col("_hit").isNotNull()
    rows = jobs.join(wanted.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    put = {"status": status, "updated_at": now}
    if status == "queued":
        put |= {"error": None, "finished_at": None}
    return rows.select(*[F.when(hit, F.lit(put[c])).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in jobs.columns])


def pause(jobs: DataFrame, wanted: DataFrame, now: str) -> DataFrame:
    return set_status(jobs, wanted, "paused", ("running",), now)


def stop(jobs: DataFrame, wanted: DataFrame, now: str) -> DataFrame:
    return set_status(jobs, wanted, "cancelled", ("queued", "running", "paused"), now)


def start(jobs: DataFrame, wanted: DataFrame, now: str) -> DataFrame:
    return set_status(jobs, wanted, "queued", ("paused", "cancelled", "failed", "partial", "done"), now)


def new_jobs(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, pages) of uploads (id, name, output_mode, paths): pages in natural order; an upload without an image is no job."""
    path = F.filter("paths", lambda p: F.lower(p).rlike(r"\.(" + "|".join(x[1:] for x in IMAGES) + ")$"))
    last = lambda p: F.regexp_extract(p, "[^/]*$", 0)
    sorted_ = F.transform(F.array_sort(F.transform(path, lambda p: F.struct(T.natural_key(last(p)).alias("k"), p.alias("p")))), lambda s: s["p"])
    rows = uploads.withColumn("paths", sorted_).where(F.size("paths") > 0)
    stem = F.regexp_replace(last(F.get("paths", F.lit(0))), r"(?<=.)\.[^.]*$", "")
    mode = F.when(F.col("output_mode").isin("folder", "cbz", "mirror"), F.col("output_mode")).otherwise("folder")
    jobs = rows.select("id", F.coalesce(F.nullif("name", F.lit("")), stem).alias("name"), mode.alias("output_mode"), F.lit("queued").alias("status"), F.size("paths").alias("pages_total"))
    pages = rows.select(F.col("id").alias("job_id"), F.posexplode("paths").alias("index", "original_path"))
    return jobs, pages


def model_view(models: DataFrame) -> DataFrame:
    """What is shown of models, by id: the key masked, missing prices 0."""
    key, price = F.col("api_key"), lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    shown = [T.mask_key(key).alias("api_key"), (T.strip(F.coalesce(key, F.lit(""))) != "").alias("api_key_set")]
    return models.select("id", "name", "base_url", *shown, price("price_in"), price("price_out"), "offpeak_in", "offpeak_out", "offpeak_start", "offpeak_end").orderBy("id")


def default_model(models: DataFrame) -> DataFrame:
    return models.orderBy("id").limit(1)


def job_model(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """id, model, dry_run: the job's model if it exists, else the first; a dry run where there is none or it has no key."""
    first = models.agg(F.min_by(F.struct("id", "api_key"), "id").alias("_first"))
    own = models.select(F.col("id").alias("_id"), F.struct("id", "api_key").alias("_own"))
    rows = jobs.select("id", "model_id").join(own, F.col("model_id") == F.col("_id"), "left").join(F.broadcast(first), F.lit(True), "left")  # one row
    used = F.coalesce("_own", "_first")
    return rows.select("id", used["id"].alias("model"), (F.coalesce(used["api_key"], F.lit("")) == "").alias("dry_run"))


def add_models(models: DataFrame, new: DataFrame) -> DataFrame:
    """models and, after the last id, the new ones that have a name and an address, trimmed; missing prices are 0."""
    text = lambda c: T.strip(F.coalesce(c, F.lit(""))).alias(c)
    rows = new.select(text("name"), text("base_url"), text("api_key"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("price_in", "price_out")], "offpeak_in", "offpeak_out", "offpeak_start", "offpeak_end")
    rows = rows.where("name <> '' and base_url <> ''").withColumn("_n", F.row_number().over(Window.orderBy("name", "base_url")))
    last = models.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    rows = rows.join(F.broadcast(last), F.lit(True)).withColumn("id", F.col("_last") + F.col("_n"))  # one row
    return models.unionByName(rows.select(*models.columns))


def update_models(models: DataFrame, patch: DataFrame) -> DataFrame:
    """models with the fields of patch (by id) that are not null; an empty or masked key leaves the stored one."""
    rows = models.alias("m").join(patch.alias("p"), "id", "left")
    out = [F.col("id")]
    for c in models.columns:
        if c == "id":
            continue
        new = F.col(f"p.{c}") if c in patch.columns else F.lit(None)
        if c == "api_key" and c in patch.columns:
            new = F.when(~T.is_masked(new), T.strip(new))
        out.append(F.coalesce(new, F.col(f"m.{c}")).alias(c))
    return rows.select(*out).select(*models.columns)


def delete_models(models: DataFrame, gone: DataFrame) -> DataFrame:
    return models.join(gone.select("id"), "id", "left_anti")


def seed_model(models: DataFrame, default: DataFrame) -> DataFrame:
    """models, or the default row if there is none."""
    some = models.limit(1).select(F.lit(True).alias("_some"))
    return models.unionByName(default.join(F.broadcast(some), F.lit(True), "left_anti").select(*models.columns))


def audit_rows(actions: DataFrame, now) -> DataFrame:
    """Audit rows of actions (action, target, actor, detail map): the detail as JSON with sorted keys."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("detail")))
    detail = F.when(F.col("detail").isNotNull(), F.to_json(entries))
    return actions.select(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("ts"), F.coalesce("actor", F.lit("user")).alias("actor"), "action", "target", detail.alias("detail"))


def request_audit(requests: DataFrame) -> DataFrame:
    """Requests that change something."""
    return requests.where(F.upper("method").isin("POST", "PUT", "PATCH", "DELETE"))


def errors(log: DataFrame) -> DataFrame:
    """Log rows of level warning (30) and above."""
    return log.where("level_no >= 30")
