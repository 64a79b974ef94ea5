"""Which font letters a page: catalogs (font_id, name, filename, is_default, pos), files (filename, path, folder) and requests.

A catalog has a row for each font at hand, so its rows are few; requests may be many and are joined to it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrower fonts for text that the chosen one cannot letter legibly, best first.
LEGIBLE = ("comic-neue", "patrick-hand")


def listing(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """catalog with path, that of the first folder which holds the file, and available."""
    found = files.groupBy(F.col("filename").alias("_file")).agg(F.min_by("path", "folder").alias("path"))
    return catalog.join(found, F.col("filename") == F.col("_file"), "left").drop("_file").withColumn("available", F.col("path").isNotNull())


def resolved(requests: DataFrame, fonts: DataFrame) -> DataFrame:
    """requests with used_id and path: the font asked for if its file is there, else the default, else the first that is there, else null."""
    first = fonts.agg(F.min_by("font_id", F.struct(~F.coalesce("is_default", F.lit(False)), "pos"))).scalar()
    here = fonts.where("available").select(F.col("font_id").alias("used_id"), F.col("path").alias("_path"), "pos")
    other = here.agg(F.min_by(F.struct("used_id", "_path"), F.struct(~(F.col("used_id") == first), F.col("pos")))).scalar()
    own = requests.join(here.select("used_id", "_path"), F.col("font_id") == F.col("used_id"), "left")
    found = F.when(F.col("used_id").isNotNull(), F.struct("used_id", "_path")).otherwise(other)
    return own.select(*[requests[c] for c in requests.columns], found["used_id"].alias("used_id"), found["_path"].alias("path"))


def legible(chosen: DataFrame, fonts: DataFrame, others: tuple[str, ...] = LEGIBLE) -> DataFrame:
    """chosen (used_id, path) with fallback: the path of the first other font that is there and is not the chosen one; null if none."""
    here = fonts.where(F.col("available") & F.col("font_id").isin(*others)).select("font_id", "path")
    known = here.agg(F.map_from_entries(F.collect_list(F.struct("font_id", "path")))).scalar()  # as many entries as others
    path = {i: F.try_element_at(known, F.lit(i)) for i in others}
    fits = [F.when(~F.lit(i).eqNullSafe(F.col("used_id")) & ~p.eqNullSafe(F.col("path")), p) for i, p in path.items()]
    return chosen.withColumn("fallback", F.coalesce(*fits))
