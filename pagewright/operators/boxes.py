"""Operators on the boxes of a page.  Joins are equi joins on the page with a spatial residue, so a page is a shuffle key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T

# Thresholds of the filters and joins.
MIN_CONFIDENCE, SHARED_BAND, NMS_IOU, DUP_IOU, DUP_CONTAINED = 0.5, 0.6, 0.3, 0.5, 0.85
CAPTION_CHARS, CAPTION_HEIGHT, SIGNAGE_SHARE = 60, 130, 0.6


def confident(conf: Column) -> Column:
    """No confidence means keep."""
    return conf.isNull() | (conf >= MIN_CONFIDENCE)


def _pairs(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    left, right = a.alias("a"), b.select(F.col("page_id").alias("_page"), F.col("ix").alias("_ix"), F.col("bbox").alias("_bbox"))
    return left, right, F.col("a.page_id") == F.col("_page")


def pairs(boxes: DataFrame, test) -> DataFrame:
    """page_id, ix_a, ix_b of boxes of one page that pass test(a, b), each pair once."""
    left, right, on = _pairs(boxes, boxes)
    met = left.join(right, on & (F.col("a.ix") < F.col("_ix")) & test(F.col("a.bbox"), F.col("_bbox")))
    return met.select(F.col("a.page_id").alias("page_id"), F.col("a.ix").alias("ix_a"), F.col("_ix").alias("ix_b"), F.col("a.bbox").alias("a"), F.col("_bbox").alias("b"))


def without(boxes: DataFrame, others: DataFrame, test) -> DataFrame:
    """Boxes that no other box of their page meets."""
    left, right, on = _pairs(boxes, others)
    return left.join(right, on & test(F.col("a.bbox"), F.col("_bbox")), "left_anti")


def met_by(boxes: DataFrame, others: DataFrame, test) -> DataFrame:
    """Boxes that some other box of their page meets."""
    left, right, on = _pairs(boxes, others)
    return left.join(right, on & test(F.col("a.bbox"), F.col("_bbox")), "left_semi")


def smallest_parent(boxes: DataFrame, parents: DataFrame) -> DataFrame:
    """page_id, ix, parent_ix: the smallest parent that holds a box's centre, the first of equals; null if none does."""
    left, right, on = _pairs(boxes, parents)
    found = left.join(right, on & G.centre_in(F.col("a.bbox"), F.col("_bbox")), "left")
    return found.groupBy("a.page_id", "a.ix").agg(F.min_by("_ix", F.when(F.col("_ix").isNotNull(), F.struct(G.area(F.col("_bbox")), F.col("_ix")))).alias("parent_ix"))


def covered(bubbles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bubbles that a block takes up."""
    return met_by(bubbles, blocks, G.covers)


def without_text(bubbles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bubbles in which no block has its centre."""
    middle = lambda b, at, size: 2 * b[at] + b[size]
    inside = lambda a, b, at, size: middle(b, at, size).between(2 * a[at], 2 * (a[at] + a[size]))
    return without(bubbles, blocks, lambda a, b: inside(a, b, "x", "w") & inside(a, b, "y", "h"))


def handover(page: DataFrame, band: DataFrame, page_h: int) -> DataFrame:
    """Boxes of a page and of the band across its lower edge, each line once: of a line that crosses the edge the band's."""
    shared = lambda a, b: G.containment(a, b) > SHARED_BAND
    own = without(page, band.where(F.col("bbox.y") + F.col("bbox.h") > page_h), shared)
    return own.unionByName(without(band, own, shared))


def siblings(boxes: DataFrame) -> DataFrame:
    """page_id, ix, others: the other boxes of the page, in order, but furigana, empty ones and those half inside the box."""
    left, right, on = _pairs(boxes, boxes.where((F.col("kind") != "furigana") & (F.col("bbox.w") > 0) & (F.col("bbox.h") > 0)))
    met = left.join(right, on & (F.col("a.ix") != F.col("_ix")) & ~G.inside_half(F.col("a.bbox"), F.col("_bbox")), "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("_ix").isNotNull(), F.struct("_ix", "_bbox"))))
    return met.groupBy("a.page_id", "a.ix").agg(F.transform(listed, lambda x: x["_bbox"]).alias("others"))


def bullets(boxes: DataFrame, mark: str = "●") -> DataFrame:
    """Boxes with text; one with two or more marked items becomes a horizontal box for each, evenly down its height."""
    parts = F.filter(F.transform(F.split("text", mark), T.strip), lambda p: p != "")
    many = (F.size(F.split("text", mark)) > 2) & (F.size(parts) > 1)
    n, b = F.size("_parts"), F.col("bbox")
    rows = boxes.withColumn("_many", F.coalesce(many, F.lit(False))).withColumn("_parts", F.when(F.col("_many"), parts).otherwise(F.array("text")))
    rows = rows.select("*", F.posexplode("_parts").alias("part", "_text"))
    slot = G.box(b["x"], b["y"] + F.floor(F.col("part") * b["h"] / n).cast("int"), b["w"], F.greatest(F.floor(b["h"] / n).cast("int"), F.lit(1)))
    rows = rows.withColumn("bbox", F.when(F.col("_many"), slot).otherwise(b)).withColumn("text", F.col("_text"))
    return rows.withColumn("kind", F.when(F.col("_many"), "horizontal").otherwise(F.col("kind"))).drop("_many", "_parts", "_text")


def caption_candidates(boxes: DataFrame) -> DataFrame:
    """Horizontal boxes of one to 60 characters of CJK text without credits or translation, at most 130 high."""
    bare = (F.coalesce("translation", F.lit("")) == "") & F.col("bbox.h").between(1, CAPTION_HEIGHT)
    short = F.exists(F.array(T.strip(F.coalesce("text", F.lit("")))), lambda t: F.char_length(t).between(1, CAPTION_CHARS) & T.has_cjk(t))  # one strip for all tests
    return boxes.where((F.col("kind") == "horizontal") & bare & short & ~T.has_credit(F.col("text")))


def unbubbled(boxes: DataFrame, bubbles: DataFrame, drop: Column) -> DataFrame:
    """Boxes but those that drop marks and whose centre no bubble holds."""
    marked = F.coalesce(drop, F.lit(False))
    return boxes.where(~marked).unionByName(met_by(boxes.where(marked), bubbles, G.centre_in))


def no_signage(boxes: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Boxes but those of mostly ASCII text outside bubbles."""
    return unbubbled(boxes, bubbles, T.ascii_share(F.col("text")) >= SIGNAGE_SHARE)


def no_stubs(boxes: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Boxes but large ones with one glyph at most outside bubbles."""
    return unbubbled(boxes, bubbles, (G.area(F.col("bbox")) >= G.STUB_AREA) & (T.glyph_count(F.col("text")) <= 1))


def second_pass(own: DataFrame, engine: DataFrame) -> DataFrame:
    """Own boxes that share nothing with the engine's and can be lettered: translated, not echoing, two pixels at least."""
    t, e = T.strip(F.coalesce("text", F.lit(""))), T.strip(F.coalesce("translation", F.lit("")))
    able = (t != "") & (e != "") & (t != e) & (F.col("bbox.w") >= 2) & (F.col("bbox.h") >= 2)
    return without(own, engine, lambda a, b: G.inter(a, b) > 0).where(able).withColumn("pass", F.lit("second"))


def greedy(boxes: DataFrame, clash, largest_first: bool = True) -> DataFrame:
    """page_id, ix of the boxes kept: by area, then ix, a box stays unless it clashes with one kept before."""
    size = G.area(F.col("bbox")) * (-1 if largest_first else 1)
    listed = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(size.alias("k"), "ix", "bbox"))).alias("all"))
    none = F.filter(F.col("all"), lambda b: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: clash(b["bbox"], k["bbox"])), acc).otherwise(F.concat(acc, F.array(b))))
    return listed.select("page_id", F.explode(kept).alias("b")).select("page_id", F.col("b.ix").alias("ix"))


def nms(boxes: DataFrame) -> DataFrame:
    return greedy(boxes, lambda a, b: G.iou(a, b) >= NMS_IOU)


def dedup_largest(boxes: DataFrame) -> DataFrame:
    return greedy(boxes, lambda a, b: (G.iou(a, b) > DUP_IOU) | (G.containment(a, b) > DUP_CONTAINED))


def dedup_smallest(boxes: DataFrame) -> DataFrame:
    return greedy(boxes, lambda a, b: (G.iou(a, b) > DUP_IOU) | (G.containment(a, b) > DUP_CONTAINED), largest_first=False)


def merge_per_parent(boxes: DataFrame, parents: DataFrame) -> DataFrame:
    """page_id, parent_ix, text, bounding box: texts of a parent's boxes in (y, x) order, joined by a blank."""
    owner = smallest_parent(boxes, parents).where("parent_ix is not null").select(F.col("page_id").alias("_p"), F.col("ix").alias("_i"), "parent_ix")
    rows = boxes.join(owner, (F.col("page_id") == F.col("_p")) & (F.col("ix") == F.col("_i")))
    order = F.array_sort(F.collect_list(F.struct(F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "ix", "text")))
    b = F.col("bbox")
    return rows.groupBy("page_id", "parent_ix").agg(F.array_join(F.transform(order, lambda r: r["text"]), " ").alias("text"), F.min(b["x"]).alias("x0"), F.min(b["y"]).alias("y0"), F.max(b["x"] + b["w"]).alias("x1"), F.max(b["y"] + b["h"]).alias("y1"))


def next_page(pages: DataFrame) -> DataFrame:
    """pages with next_id: the following page of the job."""
    return pages.withColumn("next_id", F.lead("id").over(Window.partitionBy("job_id").orderBy("index")))
