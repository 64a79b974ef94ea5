"""Images of folders and of .cbz and .zip archives, and the ends of log files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.store import IMAGES

_ENDS = r"(?i)\.(" + "|".join(x[1:] for x in IMAGES) + ")$"


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content of the image files under path; the extension tells."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(_ENDS))
    return rows.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                continue
            for name in archive.namelist():
                if name.lower().endswith(IMAGES):
                    row = [pa.array([x], t) for x, t in ((path, pa.string()), (name, pa.string()), (archive.read(name), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(row, names=["path", "member", "content"])


def archive_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, name, index, content: images in archives, in natural order of their names; of equal names the last member counts.

    What is no archive, or is broken, has no pages.  One task holds one archive and one image of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(cbz|zip)$"))
    rows = files.select("path", "content").mapInArrow(_members, "path string, member string, content binary")
    rows = rows.withColumn("name", F.regexp_extract("member", "[^/]*$", 0)).withColumn("kind", F.lower(F.regexp_extract("path", "[^.]*$", 0)))
    last = Window.partitionBy("path", "name").orderBy(T.natural_key(F.col("member")).desc())
    rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("path").orderBy(T.natural_key(F.col("name"))))
    return rows.select("path", "kind", "name", (place - 1).alias("index"), "content")


def pack(pages: DataFrame, key: str = "job_id") -> DataFrame:
    """key, archive: the images (name, content) of each job in natural order, stored without compression."""

    def run(rows):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for row in rows.sort_values("place").itertuples():
                z.writestr(row.name, row.content)
        return pd.DataFrame({key: [rows[key].iloc[0]], "archive": [out.getvalue()]})

    place = F.row_number().over(Window.partitionBy(key).orderBy(T.natural_key(F.col("name"))))
    rows = pages.where(F.col("name").rlike(_ENDS)).select(key, "name", "content", place.alias("place"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {dict(pages.dtypes)[key]}, archive binary")


def tail(spark: SparkSession, path: str, lines: int = 200, most: int = 262_144) -> DataFrame:
    """path, text: the last lines of each file under path, looked for in its last bytes."""
    rows = spark.read.format("binaryFile").load(path)
    end = F.decode(F.expr(f"substring(content, greatest(1, length - {most} + 1))"), "UTF-8")
    kept = F.slice(F.reverse(F.split(F.regexp_replace(end, r"\r?\n$", ""), r"\r?\n")), 1, lines)
    return rows.select("path", F.array_join(F.reverse(kept), "\n").alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, modified of the files under path; contents are not read."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
