"""The log of how lettering was fitted: rows (page, kind, size, largest, flags), summed up page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(log: DataFrame) -> DataFrame:
    """One row a page.

    log: page, kind (region, block, degenerate, caption), branch, chosen, largest, reason, dx, dy, applied, fallback.
    """
    of = lambda kind: F.col("kind") == kind
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    recovered = F.coalesce(F.col("reason").rlike("^(region_)?recovered"), F.lit(False))
    moved = F.greatest(F.abs(F.coalesce("dx", F.lit(0))), F.abs(F.coalesce("dy", F.lit(0))))
    size = F.when(of("block"), F.col("chosen"))
    names = F.array_sort(F.collect_set(F.when(of("region"), F.col("branch"))))
    seen = F.collect_list(F.when(of("region"), F.col("branch")))
    out = log.groupBy("page").agg(
        F.count_if(of("block")).alias("blocks"), F.count_if(of("region")).alias("regions"),
        F.coalesce(F.min(size), F.lit(0)).alias("size_min"), F.coalesce(F.max(size), F.lit(0)).alias("size_max"),
        F.count_if(of("block") & (F.col("chosen") < F.col("largest"))).alias("under_sized"),
        F.count_if(of("block") & F.col("largest").isNull()).alias("unmeasurable"),
        F.count_if(of("degenerate") & ~recovered).alias("degenerate"), F.count_if(of("degenerate") & recovered).alias("recovered"),
        F.count_if(of("block") & (moved > 0)).alias("anchored"), F.sum(F.when(of("block"), moved).otherwise(0)).alias("anchor_shift"),
        F.count_if(of("caption") & flag("applied")).alias("captions"), F.count_if(of("block") & flag("fallback")).alias("fallback"),
        names.alias("_names"), seen.alias("_seen"))
    counted = F.map_from_entries(F.transform("_names", lambda b: F.struct(b, F.size(F.filter("_seen", lambda x: x == b)))))
    return out.withColumn("branches", counted).drop("_names", "_seen")
