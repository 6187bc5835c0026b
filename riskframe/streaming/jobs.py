"""Structured Streaming jobs (operators T1, T2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.sources.sinks import write_usage_batch

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession, name: str, given: str | None = None) -> str:
    """The folder of a job's checkpoint: the given one, else one in the cluster's shared folder."""
    if given:
        return given
    shared = spark.conf.get(CHECKPOINT_SETTING, None)
    if not shared:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder or pass a checkpoint folder")
    return f"{shared.rstrip('/')}/riskframe/{name}"


def stream_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Arriving parquet files with the schema of a known table."""
    return spark.readStream.schema(like.schema).parquet(path)


def start_scan(reports: DataFrame, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write the reports of arriving files (operator T1).

    ``reports`` is :func:`riskframe.plans.file_scan.file_reports` over a streaming table: the
    report is a projection, so the batch plan runs unchanged and without state, and the file sink
    makes it exactly-once.
    """
    return (
        reports.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint_folder(reports.sparkSession, "scan", checkpoint))
        .trigger(availableNow=True).start(out)
    )


def daily_counts(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests per actor and event-time day; state of a day is dropped once it is late."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", "1 day").alias("day"), "actor_key").agg(
        F.count(F.lit(1)).alias("scan_count")
    )
    return counted.select("actor_key", F.to_date("day.start").alias("usage_date"), "scan_count")


def start_usage(requests: DataFrame, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep daily usage counts up to date (operator T2)."""
    return (
        daily_counts(requests).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint_folder(requests.sparkSession, "usage", checkpoint))
        .foreachBatch(lambda batch, batch_id: write_usage_batch(batch, out, batch_id))
        .trigger(availableNow=True).start()
    )
