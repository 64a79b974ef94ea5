"""Tables written in the shared folder, to cut lineage and to let several passes read one result.

A lost executor costs a reread, never the run: what is written here is Parquet in
``spark.checkpoint.dir``, which the driver and all executors share.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables not yet deleted: application and path, with the owner on whose behalf they were written.
_OPEN: dict[tuple[str, str], object] = {}
_OWNER: list[object] = [None]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a fresh temporary folder only where it is unset on a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes df and returns the written table; its partitioning is forgotten, so joins on it can be split by AQE."""
        path = f"{shared_dir(self.spark)}/pagewright-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        _OPEN[self.spark.sparkContext.applicationId, path] = _OWNER[-1]
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                _delete(self.spark, path)
                _OPEN.pop((self.spark.sparkContext.applicationId, path), None)


@contextlib.contextmanager
def owned(owner: object) -> Iterator[None]:
    """Tables written meanwhile belong to owner."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def sweep(spark: SparkSession, owner: object) -> None:
    """Deletes the owner's tables of this application: call it when all results that read them are written."""
    for app, path in [k for k, v in _OPEN.items() if v is owner and k[0] == spark.sparkContext.applicationId]:
        _delete(spark, path)
        del _OPEN[app, path]
