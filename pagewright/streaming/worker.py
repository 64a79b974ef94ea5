"""Jobs as a stream: each micro-batch claims the queued jobs that came in, oldest first, and hands them on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "job_id long, page int, ok boolean, lang string, at timestamp"


def claimed(jobs: DataFrame) -> DataFrame:
    """Queued jobs, as running."""
    return jobs.where("status = 'queued'").withColumn("status", F.lit("running"))


def run_jobs(spark: SparkSession, queue: str, schema: str, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, seconds: int = 1) -> StreamingQuery:
    """Reads jobs from JSON files that arrive in queue, and appends what handle makes of a batch to the table at out.

    A batch that is run again after a failure overwrites its own partition, so no job is written twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        told = handle(claimed(rows).orderBy("id")).withColumn("batch", F.lit(number))
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    query = spark.readStream.schema(schema).json(queue).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=f"{seconds} seconds")).start()


def page_totals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """job_id, done, failed: pages of a stream of events, each page once however often it is told within the time allowed."""
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "page", "ok"])
    return once.groupBy("job_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
