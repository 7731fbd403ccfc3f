"""Incremental ingestion: fragments that arrive as files are appended batch by batch, counts kept beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.schema import FRAGMENTS


def stream_fragments(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Fragments of Parquet files as they appear in a folder."""
    return spark.readStream.schema(FRAGMENTS).option("maxFilesPerTrigger", max_files).parquet(path)


def append_fragments(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch and its counts per barcode under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "sample", "chr").parquet(f"{out}/fragments")
        counts = batch.groupBy("sample", "barcode").agg(F.count(F.lit(1)).alias("n_frags")).withColumn("batch", F.lit(number))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/counts")
        batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def barcode_totals(spark: SparkSession, out: str) -> DataFrame:
    """Fragments per barcode over all batches so far."""
    return spark.read.parquet(f"{out}/counts").groupBy("sample", "barcode").agg(F.sum("n_frags").alias("n_frags"))


def event_windows(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of a stream per key and tumbling window; events later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
