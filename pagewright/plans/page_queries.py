"""Rules of pages: geometry, captions, siblings, second pass, merges, engine replies, the fit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators import boxes as B
from pagewright.operators import engine, fitlog, folds
from pagewright.plans.views import duck, table, union_sql, view

PAGE_W, PAGE_H = 560, 520
#: Captions of the boxes: every third in Japanese, some with credits or translated.
_CAPTION = """CASE WHEN ix % 3 = 0 THEN '原作 テスト' WHEN ix % 3 = 1 THEN concat('給仕', text) ELSE text END"""
_ENGLISH = "CASE WHEN x % 4 = 0 THEN 'word' WHEN x % 4 = 1 THEN concat('給仕', text) ELSE '' END"
_REPLY = """SELECT l_orderkey AS page_id, concat('{"translations":[{"text":{"', CASE WHEN l_partkey % 3 = 0 THEN 'JPN' WHEN l_partkey % 3 = 1 THEN 'ko' ELSE 'ENG' END,
 '":" src', CAST(l_partkey AS STRING), '","', CASE WHEN l_suppkey % 2 = 0 THEN 'ENG' ELSE 'zh' END, '":"dst', CAST(l_suppkey AS STRING), '"},"minX":', CAST(l_partkey % 50 AS STRING),
 ',"minY":1.5,"maxX":', CAST(l_partkey % 90 AS STRING), ',"maxY":60,"angle":', CAST(l_suppkey AS STRING), ',"prob":0.5}, {"text": null}]}') AS reply,
 l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) t WHERE rn = 1"""
_OPTIONS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' KO ' WHEN o_orderkey % 3 = 1 THEN 'ja' END AS lang, CASE WHEN o_orderkey % 5 = 0 THEN 'Off' ELSE 'per-language' END AS mode,
 CASE WHEN o_orderkey % 4 = 0 THEN '2048' WHEN o_orderkey % 4 = 1 THEN 'big' WHEN o_orderkey % 4 = 2 THEN '' END AS size, CASE WHEN o_orderkey % 2 = 0 THEN 'none' END AS inpainter FROM orders"""
_LOG = """SELECT user_id AS page, CASE event_type WHEN 'view' THEN 'block' WHEN 'click' THEN 'region' WHEN 'purchase' THEN 'degenerate' ELSE 'caption' END AS kind,
 CASE WHEN event_id % 3 = 0 THEN 'flood' ELSE 'own' END AS branch, CAST(event_id % 20 AS INT) AS chosen, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 23 AS INT) END AS largest,
 CASE WHEN event_id % 4 = 0 THEN 'region_recovered thin' WHEN event_id % 4 = 1 THEN 'recovered' ELSE 'too thin' END AS reason, CAST(event_id % 3 AS INT) AS dx, CAST(-(event_id % 5) AS INT) AS dy,
 event_id % 2 = 0 AS applied, event_id % 9 = 0 AS fallback FROM events"""


def _boxes(spark, d):
    rows = view(spark, d, "boxes").withColumn("bbox", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return rows.withColumn("kind", G.orientation(F.col("w"), F.col("h")))


def _split(spark, d):
    rows = _boxes(spark, d)
    grown = G.box(F.col("x") - 40, F.col("y") - 40, F.col("w") + 160, F.col("h") + 160)
    return rows.where("ix % 3 <> 1"), rows.where("ix % 3 = 1").withColumn("bbox", grown)


def _flat(rows, name="b"):
    return rows.select("page_id", "ix", f"{name}.x", f"{name}.y", f"{name}.w", f"{name}.h")


def noise_filter(spark, d):
    return _boxes(spark, d).where(~G.is_noise(F.col("w") - 30, F.col("h"), F.col("conf"))).select("page_id", "ix")


def halftone_filter(spark, d):
    return _boxes(spark, d).where(~G.is_screentone(F.col("h"), F.col("w"), F.col("conf"))).select("page_id", "ix")


def drawn_sfx(spark, d):
    big = G.box(F.col("x"), F.col("y"), F.col("w") * 3, F.col("h") * 3)
    return _boxes(spark, d).select("page_id", "ix", G.is_drawn_sound(big, F.col("kind"), F.col("text")).alias("sfx"))


def inset_expand_clamp(spark, d):
    grown = G.expand(F.col("bbox"))
    return _flat(_boxes(spark, d).select("page_id", "ix", G.on_page(grown, F.lit(PAGE_W), F.lit(PAGE_H)).alias("b")).where("b is not null"))


def quad_angle(spark, d):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    tilt = F.col("ix") * 3 - 9
    points = F.array(corner(F.col("x"), F.col("y")), corner(F.col("x") + F.col("w"), F.col("y") + tilt), corner(F.col("x") + F.col("w"), F.col("y") + tilt + 20), corner(F.col("x"), F.col("y") + 20))
    rows = _boxes(spark, d).select("page_id", "ix", G.quad_angle(points).alias("a"), G.polygon_box(points).alias("b"))
    return rows.select("page_id", "ix", F.round("a", 6).alias("angle"), "b.x", "b.y", "b.w", "b.h")


def near_pairs(spark, d):
    return B.pairs(_boxes(spark, d), lambda a, b: G.near(a, b, 0.1)).select("page_id", "ix_a", "ix_b", F.round(G.gap(F.col("a"), F.col("b")), 6).alias("gap"))


def plausible_balloon(spark, d):
    boxes, bubbles = _split(spark, d)
    left, right, on = B._pairs(boxes, bubbles)
    test = G.plausible_balloon(F.col("_bbox"), F.col("a.bbox"), F.col("a.bbox"), F.lit(PAGE_W), F.lit(PAGE_H))
    return left.join(right, on & test).select("a.page_id", "a.ix", F.col("_ix").alias("bubble"))


def sibling_boxes(spark, d):
    rows = B.siblings(_boxes(spark, d))
    return rows.select("page_id", "ix", F.size("others").alias("n"), F.aggregate("others", F.lit(0).cast("long"), lambda s, b: s + b["x"]).alias("xs"))


def window_ratio(spark, d):
    rows = B.siblings(_boxes(spark, d)).join(_boxes(spark, d).select("page_id", "ix", "bbox"), ["page_id", "ix"])
    return rows.select("page_id", "ix", F.round(G.enlargement(F.col("bbox"), F.col("others")), 6).alias("ratio"))


def clip_region(spark, d):
    rows = B.siblings(_boxes(spark, d)).join(_boxes(spark, d).select("page_id", "ix", "bbox"), ["page_id", "ix"])
    region = G.box(F.col("bbox.x") - 60, F.col("bbox.y") - 60, F.col("bbox.w") + 120, F.col("bbox.h") + 120)
    return _flat(rows.select("page_id", "ix", G.clip_off(region, F.col("bbox"), F.col("others")).alias("b")))


def second_pass_add(spark, d):
    boxes, engines = _split(spark, d)
    return B.second_pass(boxes.withColumn("translation", F.expr(_ENGLISH)), engines).select("page_id", "ix", "pass")


def caption_candidates(spark, d):
    rows = _boxes(spark, d).withColumn("translation", F.expr("CASE WHEN x % 4 = 0 THEN 'word' END"))
    return B.caption_candidates(rows.withColumn("text", F.expr(_CAPTION))).select("page_id", "ix")


def signage_filter(spark, d):
    boxes, bubbles = _split(spark, d)
    return B.no_signage(boxes.withColumn("text", F.expr(_CAPTION)), bubbles).select("page_id", "ix")


def stub_filter(spark, d):
    boxes, bubbles = _split(spark, d)
    return B.no_stubs(boxes.withColumn("text", F.substring("text", 1, 1)), bubbles).select("page_id", "ix")


def bullet_split(spark, d):
    rows = B.bullets(_boxes(spark, d).withColumn("text", F.expr("CASE WHEN ix % 2 = 0 THEN concat('●', text, ' ●b●', text, 'c') ELSE concat('●', text) END")))
    return rows.select("page_id", "ix", "part", "text", "kind", "bbox.x", "bbox.y", "bbox.w", "bbox.h")


def engine_json_regions(spark, d):
    rows = engine.regions(table(spark, d, "lineitem", _REPLY).select("page_id", "reply"))
    return rows.select("page_id", "ix", "text", "translation", "conf", "angle", "kind", "bbox.x", "bbox.y", "bbox.w", "bbox.h")


def engine_json_language(spark, d):
    return engine.language(table(spark, d, "lineitem", _REPLY).select("page_id", "reply"))


def config_precedence(spark, d):
    rows = table(spark, d, "orders", _OPTIONS)
    options = F.create_map(F.lit("detection_size"), "size", F.lit("inpainter"), "inpainter")
    return rows.select("o_orderkey", engine.config(options, F.col("lang"), F.col("mode")).alias("c")).select("o_orderkey", "c.detection_size", "c.box_threshold", "c.inpainter", "c.inpainting_size")


def fitlog_summary(spark, d):
    return fitlog.summary(table(spark, d, "events", _LOG)).withColumn("own", F.coalesce(F.col("branches")["own"], F.lit(0))).drop("branches")


def _folded(rule):
    def run(spark, d):
        return rule(view(spark, d, "boxes").withColumn("angle", F.col("ix").cast("double")))

    return run


def duplicate_collapse(spark, d):
    rows = view(spark, d, "boxes").withColumn("text", F.expr("CASE WHEN x % 3 = 0 THEN 'そういえば、' WHEN x % 3 = 1 THEN 'そういえ' ELSE text END"))
    return folds.collapse_duplicates(rows)


QUERIES = {f.__name__: f for f in (
    noise_filter, halftone_filter, drawn_sfx, inset_expand_clamp, quad_angle, near_pairs, plausible_balloon, sibling_boxes,
    window_ratio, clip_region, second_pass_add, caption_candidates, signage_filter, stub_filter, bullet_split,
    engine_json_regions, engine_json_language, config_precedence, fitlog_summary, duplicate_collapse)}
QUERIES |= {
    "merge_horizontal_words": _folded(folds.merge_words), "merge_stacked_lines": _folded(folds.merge_stacked),
    "merge_vertical_columns": _folded(folds.merge_columns), "caption_clusters": _folded(folds.caption_clusters),
}

_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))::BIGINT * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_SPLIT = "x AS (SELECT * FROM boxes WHERE ix % 3 <> 1), g AS (SELECT page_id, ix, x - 40 AS x, y - 40 AS y, w + 160 AS w, h + 160 AS h FROM boxes WHERE ix % 3 = 1)"
_CENTRE = "a.x + a.w // 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h // 2 BETWEEN b.y AND b.y + b.h"
_KIND = "CASE WHEN w <= 16 AND h > 2 * w THEN 'furigana' WHEN h > 1.5 * w THEN 'vertical' ELSE 'horizontal' END"
_HELD = f"EXISTS (SELECT 1 FROM g b WHERE a.page_id = b.page_id AND {_CENTRE})"


def _with(rest: str) -> str:
    return duck("boxes", "").rstrip() + ", " + rest


_GAP = "sqrt(greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) ** 2 + greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) ** 2)"
_SLACK = "0.1 * greatest(a.h, b.h, 1)"
_SIBLING = f"a.page_id = b.page_id AND a.ix <> b.ix AND NOT (b.w <= 16 AND b.h > 2 * b.w) AND {_INTER} < 0.5 * (b.w::BIGINT * b.h)"
ORACLE = {
    "noise_filter": duck("boxes", "SELECT page_id, ix FROM boxes WHERE NOT coalesce(w - 30 < 55 AND h < 55 AND conf < 0.9, false)"),
    "halftone_filter": duck("boxes", "SELECT page_id, ix FROM boxes WHERE NOT coalesce(h <= 48 AND w >= 80 AND conf < 0.44, false)"),
    "drawn_sfx": duck("boxes", f"SELECT page_id, ix, length(trim(text)) BETWEEN 1 AND 8 AND h * 3 >= 28 AND w * h * 9 >= 60000 AND ({_KIND} = 'horizontal' OR w >= 0.55 * h) AS sfx FROM boxes"),
    "inset_expand_clamp": _with(f"""e AS (SELECT page_id, ix, greatest(x - CAST(trunc(w * 0.25::DOUBLE) AS INT), 0) AS x0, greatest(y - CAST(trunc(h * 0.2::DOUBLE) AS INT), 0) AS y0, w + 2 * CAST(trunc(w * 0.25::DOUBLE) AS INT) AS ww, h + 2 * CAST(trunc(h * 0.2::DOUBLE) AS INT) AS hh FROM boxes),
        c AS (SELECT page_id, ix, x0 AS x, y0 AS y, least(x0 + ww, {PAGE_W}) - x0 AS w, least(y0 + hh, {PAGE_H}) - y0 AS h FROM e) SELECT * FROM c WHERE w >= 12 AND h >= 12"""),
    "quad_angle": duck("boxes", "SELECT page_id, ix, round(degrees(atan2(ix * 3 - 9, w)), 6) AS angle, x, y + least(0, ix * 3 - 9) AS y, w, 20 + abs(ix * 3 - 9) AS h FROM boxes"),
    "near_pairs": duck("boxes", f"SELECT a.page_id, a.ix AS ix_a, b.ix AS ix_b, round({_GAP}, 6) AS gap FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.ix < b.ix WHERE a.x + a.w + {_SLACK} >= b.x AND b.x + b.w + {_SLACK} >= a.x AND a.y + a.h + {_SLACK} >= b.y AND b.y + b.h + {_SLACK} >= a.y"),
    "plausible_balloon": _with(f"{_SPLIT} SELECT a.page_id, a.ix, b.ix AS bubble FROM x a JOIN g b ON a.page_id = b.page_id WHERE b.x <= a.x + 2 AND b.y <= a.y + 2 AND b.x + b.w >= a.x + a.w - 2 AND b.y + b.h >= a.y + a.h - 2 AND b.w * b.h <= 0.55 * {PAGE_W * PAGE_H} AND b.w * b.h <= 6 * greatest(a.w * a.h, 1)"),
    "sibling_boxes": duck("boxes", f"SELECT a.page_id, a.ix, CAST(count(b.ix) AS INT) AS n, CAST(coalesce(sum(b.x), 0) AS BIGINT) AS xs FROM boxes a LEFT JOIN boxes b ON {_SIBLING} GROUP BY 1, 2"),
    "second_pass_add": _with(f"{_SPLIT} SELECT page_id, ix, 'second' AS pass FROM x a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.page_id = b.page_id AND {_INTER} > 0) AND x % 4 < 2"),
    "caption_candidates": duck("boxes", f"SELECT page_id, ix FROM boxes WHERE {_KIND} = 'horizontal' AND ix % 3 = 1 AND h BETWEEN 1 AND 130 AND x % 4 <> 0"),
    "signage_filter": _with(f"{_SPLIT} SELECT page_id, ix FROM x a WHERE ix % 3 <> 2 OR {_HELD}"),
    "stub_filter": _with(f"{_SPLIT} SELECT page_id, ix FROM x a WHERE w * h < 25000 OR {_HELD}"),
    "bullet_split": _with(f"""r AS (SELECT *, {_KIND} AS k FROM boxes) SELECT page_id, ix, part, CASE part WHEN 0 THEN text WHEN 1 THEN 'b' ELSE text || 'c' END AS text, 'horizontal' AS kind, x, CAST(y + part * h // 3 AS INT) AS y, w, greatest(h // 3, 1) AS h FROM r, (VALUES (0), (1), (2)) AS p(part) WHERE ix % 2 = 0
        UNION ALL SELECT page_id, ix, 0, '●' || text, k, x, y, w, h FROM r WHERE ix % 2 = 1"""),
    "engine_json_regions": union_sql("r", _REPLY, """, s AS (SELECT page_id, 'src' || l_partkey AS src, 'dst' || l_suppkey AS dst, CASE l_partkey % 3 WHEN 0 THEN 'JPN' WHEN 1 THEN 'ko' ELSE 'ENG' END AS a, CASE WHEN l_suppkey % 2 = 0 THEN 'ENG' ELSE 'zh' END AS b, CAST(l_partkey % 50 AS INT) AS x, CAST(l_partkey % 90 - l_partkey % 50 AS INT) AS w, l_suppkey AS t FROM r),
        u AS (SELECT page_id, CASE WHEN a <> 'ENG' THEN src ELSE dst END AS text, CASE WHEN a = 'ENG' THEN src ELSE dst END AS translation, x, w, CASE WHEN t <= 45 THEN CAST(t AS DOUBLE) ELSE 0.0 END AS angle FROM s WHERE (a = 'ENG') <> (b = 'ENG'))
        SELECT page_id, 0 AS ix, text, translation, CAST(0.5 AS DOUBLE) AS conf, angle, CASE WHEN w <= 16 AND 59 > 2 * w THEN 'furigana' WHEN 59 > 1.5 * w THEN 'vertical' ELSE 'horizontal' END AS kind, x, 1 AS y, w, 59 AS h FROM u WHERE w >= 2""").replace(") , s AS", "), s AS"),
    "engine_json_language": union_sql("r", _REPLY, "SELECT page_id, CASE WHEN l_partkey % 3 = 0 THEN 'ja' WHEN l_partkey % 3 = 1 THEN 'ko' WHEN l_suppkey % 2 = 0 THEN '' ELSE 'zh' END AS lang FROM r"),
    "config_precedence": union_sql("o", _OPTIONS, "SELECT o_orderkey, CASE WHEN k THEN 2560 ELSE coalesce(TRY_CAST(nullif(size, '') AS INT), 1536) END AS detection_size, CAST(CASE WHEN k THEN 0.6 ELSE 0.7 END AS DOUBLE) AS box_threshold, coalesce(inpainter, 'default') AS inpainter, 1024 AS inpainting_size FROM (SELECT *, coalesce(trim(lang) = 'KO', false) AND mode <> 'Off' AS k FROM o)"),
    "fitlog_summary": union_sql("l", _LOG, """SELECT page, count(*) FILTER (WHERE kind = 'block') AS blocks, count(*) FILTER (WHERE kind = 'region') AS regions, coalesce(min(chosen) FILTER (WHERE kind = 'block'), 0) AS size_min, coalesce(max(chosen) FILTER (WHERE kind = 'block'), 0) AS size_max,
        count(*) FILTER (WHERE kind = 'block' AND chosen < largest) AS under_sized, count(*) FILTER (WHERE kind = 'block' AND largest IS NULL) AS unmeasurable, count(*) FILTER (WHERE kind = 'degenerate' AND reason = 'too thin') AS degenerate, count(*) FILTER (WHERE kind = 'degenerate' AND reason <> 'too thin') AS recovered,
        count(*) FILTER (WHERE kind = 'block' AND (dx <> 0 OR dy <> 0)) AS anchored, CAST(coalesce(sum(greatest(abs(dx), abs(dy))) FILTER (WHERE kind = 'block'), 0) AS BIGINT) AS anchor_shift, count(*) FILTER (WHERE kind = 'caption' AND applied) AS captions, count(*) FILTER (WHERE kind = 'block' AND fallback) AS fallback,
        CAST(count(*) FILTER (WHERE kind = 'region' AND branch = 'own') AS INT) AS own FROM l GROUP BY page"""),
}
