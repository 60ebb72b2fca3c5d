"""Streaming ingest (an addition of our own): documents arrive as files and become postings and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import ascii_words
from docloom.operators.search import postings


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files: int = 100) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def index_stream(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Postings of each micro-batch, written under its number: a replayed batch overwrites itself, so the sink is exactly-once."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, tokens=ascii_words).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total) with a watermark; events after it are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
