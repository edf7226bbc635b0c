"""Structured Streaming over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.runtime import Scratch, table


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The event files as a stream; its schema is that of the files there."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant


def windowed_counts(stream: DataFrame, size: str, late: str) -> DataFrame:
    """Counts by window and event type; events later than ``late`` after the latest seen are dropped."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def run_to_end(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there now; each batch writes the complete result anew, and the last one stays."""
    scratch = Scratch(spark)
    last: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        last.append(scratch.cut(batch))
        if len(last) > 1:
            scratch.drop(last.pop(0))

    done = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.base}/stream").trigger(availableNow=True).start()
    done.awaitTermination()
    return last[-1] if last else spark.createDataFrame([], counts.schema)


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return run_to_end(windowed_counts(event_stream(spark, d), "1 day", "40 days"), spark)
