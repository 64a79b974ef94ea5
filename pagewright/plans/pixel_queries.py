"""Line breaking, overlapping balloons, masks, room, fonts and readings over the test tables."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import fonts, lettering, masks, rasters
from pagewright.plans.views import duck, table, union_sql, view

_WORD = "CASE ix % 3 WHEN 0 THEN concat(text, '-', text, '!') WHEN 1 THEN concat(text, '...') ELSE text END"
_FONTS = """SELECT n_name AS font_id, n_name AS name, concat(n_name, '.ttf') AS filename, n_nationkey IN (7, 9) AS is_default, n_nationkey AS pos,
 CASE WHEN n_nationkey % 3 <> 0 THEN concat('/fonts/', CAST(n_nationkey AS STRING)) END AS path FROM nation"""
_ASKED = "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'none' ELSE concat('N', CAST(s_nationkey AS STRING)) END AS asked, s_nationkey FROM supplier"
_PATHS = """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN '/data/jobs/' ELSE '/data/work/' END, CAST(o_custkey AS STRING), '/page.',
 CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '.jpg' ELSE '' END) AS path FROM orders"""
_READ = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'sfx' ELSE 'Caption' END AS kind,
 CASE WHEN l_partkey % 5 = 0 THEN ' ' WHEN l_partkey % 5 = 1 THEN 'abc' WHEN l_partkey % 5 = 2 THEN '原作 テスト' ELSE '給仕する人' END AS jp,
 CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'The waiter' END AS en, CAST(l_suppkey % 4 + 3 AS INT) AS cap FROM lineitem"""
#: Fonts that stand in for illegible ones, by their names in the test tables.
OTHERS = ("JAPAN", "CHINA")
PAGE_W, PAGE_H = 120, 100


def _advance(text: str) -> float:
    """Every character ten wide, blanks four."""
    return 10 * len(text) - 6 * text.count(" ")


def token_breaks(spark, d):
    parts = lettering.word_parts(F.expr(_WORD))
    return view(spark, d, "boxes").select("page_id", "ix", F.array_join(parts, "|").alias("parts"))


def line_wrap(spark, d):
    said = F.array_join(F.transform(F.sequence(F.lit(0), F.col("ix")), lambda i: F.concat(F.col("text"), F.repeat(F.lit("o"), i))), " ")
    found = lettering.wrap(view(spark, d, "boxes").select("page_id", "ix", said.alias("text"), F.col("w").alias("room")), _advance)
    return found.select("page_id", "ix", F.array_join("lines", "|").alias("lines"))


def partition_shared_bubble(spark, d):
    return lettering.part_regions(view(spark, d, "boxes"))


def _scaled(spark, d):
    at = [F.floor(F.col(c) / 5).cast("int").alias(c) for c in "xywh"]
    return view(spark, d, "boxes").select("page_id", "ix", *at)


def _found(rule):
    return lambda spark, d: masks.boxes_drawn(_scaled(spark, d), PAGE_W, PAGE_H, 0, rule)


def _holes(stack: np.ndarray):
    return masks.blob_boxes_in(masks.filled_in(stack) & (stack == 0), 1)


def caption_room(spark, d):
    return rasters.rooms(_scaled(spark, d), PAGE_W, PAGE_H, 30)


def _listed(spark, d):
    rows = table(spark, d, "nation", _FONTS)
    return fonts.listing(rows.drop("path"), rows.where("path is not null").select("filename", "path", F.lit(0).alias("folder")))


def font_listing(spark, d):
    return _listed(spark, d).select("font_id", "pos", "path", "available")


def font_resolve(spark, d):
    names = _listed(spark, d).select(F.col("pos").alias("_pos"), F.col("font_id"))
    asked = table(spark, d, "supplier", _ASKED).join(names, F.col("s_nationkey") == F.col("_pos"))
    asked = asked.select("s_suppkey", F.when(F.col("asked") != "none", F.col("font_id")).alias("font_id"))
    return fonts.legible(fonts.resolved(asked, _listed(spark, d)), _listed(spark, d), OTHERS).select("s_suppkey", "used_id", "path", "fallback")


def page_stems(spark, d):
    return table(spark, d, "orders", _PATHS).select("o_orderkey", T.page_stem(F.col("path")).alias("stem"))


def caption_verdicts(spark, d):
    verdict = T.caption_verdict(F.col("kind"), F.col("jp"), F.col("en"), F.col("cap"))
    return table(spark, d, "lineitem", _READ).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").cast("long").alias("parts"))


QUERIES = {f.__name__: f for f in (token_breaks, line_wrap, partition_shared_bubble, caption_room, font_listing, font_resolve, page_stems, caption_verdicts)}
QUERIES |= {
    "blob_boxes": _found(partial(masks.blob_boxes_in, least=20)), "filled_holes": _found(_holes), "tile_rects": _found(masks.tile_rects_in),
    "merge_rects": lambda spark, d: masks.merge_boxes(_scaled(spark, d)),
}
ORACLE = {
    "token_breaks": duck("boxes", "SELECT page_id, ix, CASE ix % 3 WHEN 0 THEN text || '-|' || text || '!' WHEN 1 THEN text || '|...' ELSE '' END AS parts FROM boxes"),
    "font_listing": union_sql("f", _FONTS, "SELECT font_id, pos, path, path IS NOT NULL AS available FROM f"),
    "font_resolve": union_sql("f", _FONTS, f""", a AS ({_ASKED}), h AS (SELECT * FROM f WHERE path IS NOT NULL),
        d AS (SELECT font_id, path FROM h ORDER BY pos <> 7, pos LIMIT 1),
        r AS (SELECT s_suppkey, coalesce(h.font_id, (SELECT font_id FROM d)) AS used_id, coalesce(h.path, (SELECT path FROM d)) AS path FROM a LEFT JOIN h ON a.s_nationkey = h.pos AND a.asked <> 'none')
        SELECT s_suppkey, used_id, path, (SELECT min_by(h.path, h.font_id <> 'JAPAN') FROM h WHERE h.font_id IN ('JAPAN', 'CHINA') AND h.font_id <> r.used_id) AS fallback FROM r""").replace(") , a AS", "), a AS"),
    "page_stems": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'j' || o_custkey || '_' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'page.' || o_orderkey ELSE 'page' END AS stem FROM orders",
    "caption_verdicts": union_sql("r", _READ, """SELECT CASE WHEN kind = 'sfx' THEN 'kind' WHEN jp = ' ' THEN 'empty reading' WHEN jp = 'abc' THEN 'not japanese' WHEN l_partkey % 5 = 2 THEN 'credit marker'
        WHEN cap < 5 THEN 'implausible length 5>' || cap WHEN en = '' THEN 'unusable translation' ELSE '' END AS verdict, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM r GROUP BY 1"""),
}
