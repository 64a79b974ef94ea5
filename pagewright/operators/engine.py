"""Replies of a translation engine as rows, and the configuration of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T

REPLY = "translations array<struct<text: map<string,string>, minX: double, minY: double, maxX: double, maxY: double, angle: double, prob: double>>"
# The engine's codes of source languages, in order of preference, and what they are called here.
SOURCES = ("JPN", "KOR", "CHS", "CHT", "ja", "ko", "zh")
LANGUAGES = {
    "ja": "ja", "ko": "ko", "zh": "zh", "zh-cn": "zh", "zh-tw": "zh", "zh-hans": "zh", "zh-hant": "zh", "ja-jp": "ja",
    "ko-kr": "ko", "JPN": "ja", "KOR": "ko", "CHS": "zh", "CHT": "zh",
}
# A request's defaults with their types, and what is measured to be better for a language.
DEFAULTS = {
    "detector": ("default", "string"), "detection_size": ("1536", "int"), "box_threshold": ("0.7", "double"),
    "unclip_ratio": ("2.3", "double"), "render_direction": ("auto", "string"), "translator": ("deepseek", "string"),
    "target_lang": ("ENG", "string"), "inpainter": ("default", "string"), "inpainting_size": ("1024", "int"),
    "mask_dilation_offset": ("30", "int"),
}
PRESETS = {"ko": {"detection_size": "2560", "box_threshold": "0.6"}}


def blocks(replies: DataFrame, key: str = "page_id", reply: str = "reply") -> DataFrame:
    """key, ix and the fields of each block of a reply; what is no reply has no blocks."""
    told = F.from_json(F.col(reply), REPLY)["translations"]
    return replies.select(key, F.posexplode(told).alias("ix", "_b")).select(key, "ix", "_b.*")


def regions(replies: DataFrame, target: str = "ENG", key: str = "page_id") -> DataFrame:
    """key, ix, bbox, kind, text, translation, conf, angle: blocks with a source and a translation that differs from it.

    The source is that of the first known code, else the first text in another language than the target.
    """
    rows = blocks(replies, key)
    said = lambda code: F.when(F.col("text")[code] != "", F.col("text")[code])
    other = F.map_values(F.map_filter("text", lambda k, v: (k != target) & (v != "")))
    source = T.strip(F.coalesce(*[said(c) for c in SOURCES if c != target], F.get(other, F.lit(0))))
    corner = {c: F.coalesce(F.col(c), F.lit(0.0)).cast("int") for c in ("minX", "minY", "maxX", "maxY")}
    box = G.box(corner["minX"], corner["minY"], corner["maxX"] - corner["minX"], corner["maxY"] - corner["minY"])
    angle = F.coalesce(F.when(F.abs("angle") <= 45, F.col("angle")), F.lit(0.0))
    rows = rows.select(key, "ix", box.alias("bbox"), source.alias("source"), T.strip(F.col("text")[target]).alias("translation"), F.col("prob").alias("conf"), angle.alias("angle"))
    rows = rows.where((F.col("source") != "") & (F.col("translation") != "") & (F.col("source") != F.col("translation")))
    rows = rows.where((F.col("bbox.w") >= 2) & (F.col("bbox.h") >= 2))
    return rows.withColumn("kind", G.orientation(F.col("bbox.w"), F.col("bbox.h"))).withColumnRenamed("source", "text")


def language(replies: DataFrame, target: str = "ENG", key: str = "page_id") -> DataFrame:
    """key, lang: the source language that most blocks name, the first of equals; empty if none does."""
    rows = blocks(replies, key).select(key, "ix", F.posexplode(F.map_keys("text")).alias("at", "code"))
    rows = rows.where(F.col("code").isin(*LANGUAGES) & (F.col("code") != target))
    rows = rows.groupBy(key, "code").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ix", "at")).alias("first"))
    best = rows.groupBy(key).agg(F.min_by("code", F.struct(-F.col("n"), "first")).alias("code"))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = best.select(F.col(key).alias("_key"), names[F.col("code")].alias("lang"))
    return replies.select(key).distinct().join(known, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("lang", F.lit("")).alias("lang"))


def preset(lang: Column, mode: Column) -> Column:
    """Measured options of a language as a map; empty where there are none or presets are off."""
    empty = F.lit(None).cast("map<string,string>")
    known = empty
    for name, options in PRESETS.items():
        known = F.when(F.lower(T.strip(lang)) == name, F.create_map(*[F.lit(x) for kv in options.items() for x in kv])).otherwise(known)
    off = F.coalesce(F.lower(T.strip(mode)) == "off", F.lit(False))
    return F.coalesce(F.when(~off, known), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def config(options: Column, lang: Column, mode: Column) -> Column:
    """A request's options as a struct: a preset before what is stored, that before the default; what has no type is passed over."""
    best = preset(lang, mode)
    fields = []
    for name, (value, kind) in DEFAULTS.items():
        chosen = [F.nullif(m[name], F.lit("")).try_cast(kind) for m in (best, options)]
        fields.append(F.coalesce(*chosen, F.lit(value).cast(kind)).alias(name))
    return F.struct(*fields)
