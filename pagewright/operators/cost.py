"""Peak and off-peak prices, and calendar totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import minutes

PERIODS = ("day", "week", "month", "year")
SUMS = ("pages_done", "blocks_found", "blocks_ok", "tokens_used")


def utc(at: Column) -> Column:
    """The UTC wall clock of an instant, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def is_offpeak(start: Column, end: Column, at: Column) -> Column:
    """Whether a UTC time of day is in [start, end), which may wrap midnight; no window, or an empty one, is never off-peak."""
    s, e, m = minutes(start), minutes(end), F.hour(at) * 60 + F.minute(at)
    inside = F.when(s < e, (m >= s) & (m < e)).otherwise((m >= s) | (m < e))
    return F.coalesce(F.when(s != e, inside), F.lit(False))


def priced(usage: DataFrame, models: DataFrame) -> DataFrame:
    """usage with off (bool) and cost in dollars; a missing off-peak rate falls back to the peak rate of its own side."""
    at = utc(F.col("ts")) if dict(usage.dtypes)["ts"] == "timestamp" else F.col("ts")
    joined = usage.join(models.withColumnRenamed("id", "_model"), F.col("model") == F.col("_model"), "left")
    off = is_offpeak(F.col("offpeak_start"), F.col("offpeak_end"), at)
    rate = lambda side: F.coalesce(F.when(off, F.col(f"offpeak_{side}")), F.col(f"price_{side}"), F.lit(0.0))
    cost = (F.col("prompt_tokens") * rate("in") + F.col("completion_tokens") * rate("out")) / 1e6
    return joined.select(*usage.columns, off.alias("off"), cost.alias("cost"))


def period_start(period: str, now: Column, tz: str) -> Column:
    """Start of the local day, Monday week, month or year that holds now, as an instant; unknown periods mean day."""
    p = period if period in PERIODS else "day"
    local = F.convert_timezone(F.current_timezone(), F.lit(tz), now.cast("timestamp_ntz"))
    start = F.date_trunc(p, local).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(tz), F.current_timezone(), start).cast("timestamp")


def instant(text: Column) -> Column:
    """An ISO time as an instant; no zone means UTC; null where it can't be read."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & text.rlike(r"\d:\d")
    return F.when(zoned, text).when(text.rlike(r"\d:\d"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z"))).try_cast("timestamp")


def job_time(jobs: DataFrame) -> Column:
    """When a job counts: finished, else updated, else created; what can't be read is skipped, no zone means UTC."""
    return F.coalesce(*[instant(F.col(c)) for c in ("finished_at", "updated_at", "created_at")])


def resolve_zone(*names: str | None) -> str:
    """The first name that is a time zone, UTC if none is."""
    from zoneinfo import ZoneInfo

    for name in filter(None, names):
        try:
            return ZoneInfo(name).key
        except (KeyError, ValueError, OSError):
            continue
    return "UTC"


def tally(jobs: DataFrame, period: str, now: Column, tz: str) -> DataFrame:
    """One row: totals since the start of the period beside totals of all time, in one pass."""
    inside = job_time(jobs) >= period_start(period, now, tz)
    total = lambda c, part: F.coalesce(F.sum(F.when(part, F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    columns = []
    for name, part in (("window", inside), ("all", F.lit(True))):
        columns.append(F.count_if(part).alias(f"{name}_jobs"))
        columns += [total(c, part).cast("long").alias(f"{name}_{c}") for c in SUMS]
        columns.append(F.round(total("cost_usd", part), 6).alias(f"{name}_cost"))
    return jobs.agg(*columns)
