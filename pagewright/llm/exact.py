"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each round looks at more of a text and only at the groups that the round before left with more than one row.
Which groups are left travels as a bitmap of fixed size, so no row moves to learn whether its full hash is needed:
a set bit may be shared by groups, which costs a hash and changes no result.

Defined results: a null text counts as empty; empty texts equal each other; a null id never wins over a number; rows
that share an id and a text are one group and each carries that id as ``keep_id``; an empty table gives an empty table;
other columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import table
from pagewright.llm.scratch import Scratch

#: White space of all text operators here: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of the survivors' bitmap: 256 pages of 4 KB, 1 MB whatever the input.
BITMAP_BITS = 1 << 23
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS)) + 1


def exact_groups(docs: DataFrame, text: str = "text", id_: str = "doc_id", carry: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has id_, key and the carried columns; groups has key, keep_id, group_size where two or more texts are equal.

    carry: further expressions over docs that rows shall hold.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    norm = normalised(F.col(text))
    size, prefix = F.octet_length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("p")

    first = scratch.cut(docs.select(size, prefix))
    sizes = first.groupBy("n").count().where("count > 1").select("n")
    left = first.join(scratch.cut(sizes), "n").groupBy("n", "p").count().where("count > 1")
    pages = left.select(_slot(F.col("n"), F.col("p")).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    pages = pages.toArrow()  # at most BITMAP_BITS / 32768 pages of 4 KB
    pages = table(spark, page=pages.column("page"), bits=pages.column("bits"))

    seen = docs.select(F.col(id_).alias("id"), F.col(text).alias("t"), size, prefix, *[c.alias(k) for k, c in (carry or {}).items()])
    seen = seen.withColumn("slot", _slot(F.col("n"), F.col("p"))).withColumn("page", F.expr("bitmap_bucket_number(slot)")).join(F.broadcast(pages), "page", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    live = F.col("bits").isNotNull() & (F.getbit(F.coalesce(byte, F.lit(0)), F.expr("cast(bitmap_bit_position(slot) % 8 as int)")) == 1)
    rows = scratch.cut(seen.select("id", F.when(live, F.concat_ws(":", "n", F.sha2(normalised(F.col("t")), 256))).alias("key"), *(carry or {})))
    scratch.drop(first)

    groups = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return rows, scratch.cut(groups)


def exact_dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id_, keep_id, group_size, kept and the carried columns."""
    rows, groups = exact_groups(docs, text, id_, carry)
    lone = rows.where("key is null").select(F.col("id").alias(id_), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *(carry or {}))
    met = rows.where("key is not null").join(groups, "key", "left").select(F.col("id").alias(id_), F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), *(carry or {}))
    return lone.unionByName(met).withColumn("kept", F.col(id_).eqNullSafe(F.col("keep_id")))
