"""Rules that leave out boxes, sizes of captions, and the manifest of a job's pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import store
from pagewright.plans.views import duck, view

#: The page that the boxes of the test tables stand on.
PAGE_W, PAGE_H = 560, 520


def _boxes(spark, d):
    rows = view(spark, d, "boxes")
    return rows.withColumn("bbox", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def corner_watermark_filter(spark, d):
    return _boxes(spark, d).where(~G.is_corner_mark(F.col("bbox"), F.lit(PAGE_W), F.lit(PAGE_H))).select("page_id", "ix")


def title_filter(spark, d):
    kind = G.orientation(F.col("w"), F.col("h"))
    return _boxes(spark, d).where(~G.is_title(F.col("bbox"), kind, F.col("text"), F.lit(PAGE_H))).select("page_id", "ix")


def caption_capacity(spark, d):
    return _boxes(spark, d).select("page_id", "ix", G.capacity(F.col("w"), F.col("h"), F.lit(12)).alias("glyphs"))


def union_bbox(spark, d):
    far = lambda at, size: F.max(F.col(at) + F.col(size))
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (far("x", "w") - F.min("x")).alias("w"), (far("y", "h") - F.min("y")).alias("h")]
    return view(spark, d, "boxes").groupBy("page_id").agg(*box)


def glyph_count(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.glyph_count(F.col("text")).alias("glyphs"))


def manifest_diff(spark, d):
    """Stored names are those of lines before the seventh; every fifth has changed since, and every 13th page is gone."""
    pages = view(spark, d, "boxes").select("page_id", F.col("ix").alias("name"), F.col("w").alias("size"))
    stored = pages.where("name < 7").withColumn("size", F.when(F.col("page_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return store.manifest_diff(stored, pages.where("page_id % 13 <> 0"), ["page_id", "name"], ["size"])


QUERIES = {f.__name__: f for f in (corner_watermark_filter, title_filter, caption_capacity, union_bbox, glyph_count, manifest_diff)}

_VERTICAL = "h > 1.5 * w AND NOT (w <= 16 AND h > 2 * w)"
ORACLE = {
    "corner_watermark_filter": duck("boxes", f"SELECT page_id, ix FROM boxes WHERE NOT (y > 0.94 * {PAGE_H} AND (x < 0.25 * {PAGE_W} OR x + w > 0.75 * {PAGE_W}) AND w < 0.25 * {PAGE_W})"),
    "title_filter": duck("boxes", f"SELECT page_id, ix FROM boxes WHERE NOT (h > 0.15 * {PAGE_H} AND w > h) AND NOT ({_VERTICAL} AND w::BIGINT * h >= 100000 AND length(trim(text)) * 10000.0 / (w::BIGINT * h) < 0.8)"),
    "caption_capacity": duck("boxes", "SELECT page_id, ix, greatest(3, trunc(w / 12.0::DOUBLE * 1.25::DOUBLE * greatest(1, round_even(h / (1.15::DOUBLE * 12), 0)))::INT) AS glyphs FROM boxes"),
    "union_bbox": duck("boxes", "SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1"),
    "glyph_count": r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\s\pZ\x{0B}\x{1C}-\x{1F}\x{85}、。．，,.！？!?…‥ー〜～「」『』（）()\[\]【】]', '', 'g'))::INT AS glyphs FROM documents",
    "manifest_diff": duck("boxes", """, p AS (SELECT page_id, ix AS name, w AS size FROM boxes), s AS (SELECT page_id, name, CASE WHEN page_id % 5 = 0 THEN size + 1 ELSE size END AS size FROM p WHERE name < 7)
        SELECT page_id, name, CASE WHEN c.size IS NULL THEN 'gone' WHEN s.size IS NULL THEN 'new' ELSE 'changed' END AS change
        FROM s FULL JOIN (SELECT * FROM p WHERE page_id % 13 <> 0) c USING (page_id, name) WHERE s.size IS DISTINCT FROM c.size"""),
}
