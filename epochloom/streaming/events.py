"""Event files as a stream: the same normal form as in batches.

Rows are normalised one by one, so a stream only lacks what needs a whole
table: ids made from a row's place (a stream must name its events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import text_or


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """CSV files dropped into a folder, as normalised events with a time stamp
    (column ``at``, taken from the schema)."""
    raw = spark.readStream.schema(schema).option("header", True).csv(folder)
    return raw.select(
        F.col("at"), text_or("event_id").alias("event_id"), text_or("recording_id").alias("recording_id"), F.coalesce(F.col("onset_seconds"), F.lit(0.0)).alias("onset_seconds"),
        F.coalesce(F.col("duration_seconds"), F.lit(0.0)).alias("duration_seconds"), text_or("target_label").alias("target_label"),
    ).filter("event_id <> '' AND onset_seconds >= 0 AND duration_seconds >= 0")


def label_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of labels by window of arrival; late rows up to the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "target_label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "target_label", "n")


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The events table kept up to date; exactly once by the file sink."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
