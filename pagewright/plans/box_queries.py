"""Boxes of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators import boxes as B
from pagewright.plans.views import duck, view


#: Height of the page that the boxes stand on.
PAGE_H = 520


def _boxes(spark, d):
    rows = view(spark, d, "boxes")
    return rows.withColumn("bbox", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def _split(spark, d):
    """Every third box is a bubble, grown to hold others."""
    rows = _boxes(spark, d)
    grown = rows.where("ix % 3 = 1").withColumn("bbox", G.box(F.col("x") - 40, F.col("y") - 40, F.col("w") + 160, F.col("h") + 160))
    return rows.where("ix % 3 <> 1"), grown


def low_confidence_filter(spark, d):
    return _boxes(spark, d).where(B.confident(F.col("conf"))).select("page_id", "ix")


def orientation_class(spark, d):
    return _boxes(spark, d).select("page_id", "ix", G.orientation(F.col("w"), F.col("h")).alias("kind"))


def inset_box(spark, d):
    return _boxes(spark, d).select("page_id", "ix", G.inset(F.col("bbox")).alias("b")).select("page_id", "ix", "b.x", "b.y", "b.w", "b.h")


def box_iou_pairs(spark, d):
    return B.pairs(_boxes(spark, d), lambda a, b: G.inter(a, b) > 0).select("page_id", "ix_a", "ix_b", F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"))


def box_containment_pairs(spark, d):
    return B.pairs(_boxes(spark, d), lambda a, b: G.containment(a, b) > 0.25).select("page_id", "ix_a", "ix_b")


def overlap_anti_join(spark, d):
    return B.without(*_split(spark, d), G.intersects).select("page_id", "ix")


def bubble_covered_semi(spark, d):
    boxes, bubbles = _split(spark, d)
    return B.covered(bubbles, boxes).select("page_id", "ix")


def bubble_without_text(spark, d):
    boxes, bubbles = _split(spark, d)
    return B.without_text(bubbles, boxes).select("page_id", "ix")


def band_handover(spark, d):
    page, band = _split(spark, d)
    return B.handover(page, band, PAGE_H).select("page_id", "ix")


def parent_bubble_argmin(spark, d):
    return B.smallest_parent(*_split(spark, d))


def merge_per_bubble(spark, d):
    return B.merge_per_parent(*_split(spark, d))


def nms_boxes(spark, d):
    return B.nms(_boxes(spark, d))


def dedup_boxes_largest(spark, d):
    return B.dedup_largest(_boxes(spark, d))


def dedup_boxes_smallest(spark, d):
    return B.dedup_smallest(_boxes(spark, d))


QUERIES = {f.__name__: f for f in (low_confidence_filter, orientation_class, inset_box, box_iou_pairs, box_containment_pairs, overlap_anti_join, bubble_covered_semi, bubble_without_text, band_handover, parent_bubble_argmin, merge_per_bubble, nms_boxes, dedup_boxes_largest, dedup_boxes_smallest)}

_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))::BIGINT * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_HITS = "a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
_CENTRE = "a.x + a.w // 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h // 2 BETWEEN b.y AND b.y + b.h"
_SPLIT = "x AS (SELECT * FROM boxes WHERE ix % 3 <> 1), g AS (SELECT page_id, ix, x - 40 AS x, y - 40 AS y, w + 160 AS w, h + 160 AS h FROM boxes WHERE ix % 3 = 1)"
_PARENT = f"p AS (SELECT a.page_id, a.ix, arg_min(b.ix, b.w::BIGINT * b.h * 100 + b.ix) AS parent_ix FROM x a LEFT JOIN g b ON a.page_id = b.page_id AND {_CENTRE} GROUP BY 1, 2)"


def _with(rest: str) -> str:
    return duck("boxes", "").rstrip() + ", " + rest


ORACLE = {
    "low_confidence_filter": duck("boxes", "SELECT page_id, ix FROM boxes WHERE conf IS NULL OR conf >= 0.5"),
    "orientation_class": duck("boxes", "SELECT page_id, ix, CASE WHEN w <= 16 AND h > 2 * w THEN 'furigana' WHEN h > 1.5 * w THEN 'vertical' ELSE 'horizontal' END AS kind FROM boxes"),
    "inset_box": _with("i AS (SELECT *, CAST(trunc(w * CAST(0.15 AS DOUBLE)) AS INT) AS dx, CAST(trunc(h * CAST(0.12 AS DOUBLE)) AS INT) AS dy FROM boxes) SELECT page_id, ix, CASE WHEN k THEN x ELSE x + dx END AS x, CASE WHEN k THEN y ELSE y + dy END AS y, CASE WHEN k THEN w ELSE w - 2 * dx END AS w, CASE WHEN k THEN h ELSE h - 2 * dy END AS h FROM (SELECT *, w - 2 * dx < 8 OR h - 2 * dy < 8 AS k FROM i)"),
    "box_iou_pairs": duck("boxes", f"SELECT page_id, ix_a, ix_b, round(s / (t - s)::DOUBLE, 6) AS iou FROM (SELECT a.page_id, a.ix AS ix_a, b.ix AS ix_b, {_INTER} AS s, a.w::BIGINT * a.h + b.w::BIGINT * b.h AS t FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.ix < b.ix) WHERE s > 0"),
    "box_containment_pairs": duck("boxes", f"SELECT a.page_id, a.ix AS ix_a, b.ix AS ix_b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.ix < b.ix WHERE {_INTER} > 0.25 * least(a.w::BIGINT * a.h, b.w::BIGINT * b.h)"),
    "overlap_anti_join": _with(f"{_SPLIT} SELECT page_id, ix FROM x a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.page_id = b.page_id AND {_HITS})"),
    "bubble_covered_semi": _with(f"{_SPLIT} SELECT page_id, ix FROM g b WHERE EXISTS (SELECT 1 FROM x a WHERE a.page_id = b.page_id AND ({_INTER} >= 0.25 * (a.w::BIGINT * a.h) OR {_INTER} >= 0.15 * (a.w::BIGINT * a.h + b.w::BIGINT * b.h - {_INTER})))"),
    "bubble_without_text": _with(f"{_SPLIT} SELECT page_id, ix FROM g b WHERE NOT EXISTS (SELECT 1 FROM x a WHERE a.page_id = b.page_id AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h)"),
    "band_handover": _with(f"{_SPLIT}, o AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.page_id = b.page_id AND b.y + b.h > {PAGE_H} AND {_INTER} / least(a.w::BIGINT * a.h, b.w::BIGINT * b.h)::DOUBLE > 0.6)) SELECT page_id, ix FROM o UNION ALL SELECT page_id, ix FROM g a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.page_id = b.page_id AND {_INTER} / least(a.w::BIGINT * a.h, b.w::BIGINT * b.h)::DOUBLE > 0.6)"),
    "parent_bubble_argmin": _with(f"{_SPLIT}, {_PARENT} SELECT * FROM p"),
    "merge_per_bubble": _with(f"{_SPLIT}, {_PARENT} SELECT page_id, parent_ix, string_agg(text, ' ' ORDER BY y, x, ix) AS text, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM p JOIN x USING (page_id, ix) WHERE parent_ix IS NOT NULL GROUP BY 1, 2"),
}
