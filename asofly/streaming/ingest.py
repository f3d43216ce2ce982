"""Streaming ingestion of snapshots: late and repeated files are handled by a watermark and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROW = "source string, id string, snapshot_date date, fetched_at timestamp, url string, body string"


def snapshot_stream(spark: SparkSession, folder: str, delay: str = "2 days") -> DataFrame:
    """New snapshot rows (JSON lines) of a folder, one for each (source, id, day) within the watermark."""
    rows = spark.readStream.schema(ROW).json(folder).withColumn("sha256", F.sha2("body", 256))
    return rows.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source", "id", "snapshot_date"])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a Parquet table and stop; restarts go on where the checkpoint ends."""
    return snapshot_stream(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("source").outputMode("append").trigger(availableNow=True).start()


def daily_counts(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling daily counts of fetched snapshots by source, final once the watermark has passed."""
    return rows.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", "1 day"), "source").agg(F.count(F.lit(1)).alias("n"))
