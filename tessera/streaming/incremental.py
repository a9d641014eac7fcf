"""Streams: matching arriving labels against a static target, and windowed
counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pairs


def match_stream(labels: DataFrame, target: DataFrame, t: float, path: str, checkpoint: str, q: int = 2) -> None:
    """Match streamed ``uri, label`` rows against a static ``uri, label`` table
    and write ``e1, e2, p`` below ``path``, a folder for each micro-batch.

    Each batch is a lossless q-gram join; a batch that runs again after a failure
    overwrites its own folder.  Pairs may come again if a label does."""

    def one(batch: DataFrame, number: int) -> None:
        pairs.qgram_join(batch, target, t, q).write.mode("overwrite").parquet(f"{path}/batch={number}")

    labels.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, end, <key>, n``: events by tumbling window; rows later than
    ``late`` behind the stream's end are dropped by the watermark."""
    kind = events.schema[ts].dataType
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), key, "n")


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; restarts go on from ``checkpoint``."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
