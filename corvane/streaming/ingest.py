"""Incremental ingest: streams over growing folders. These are extensions; the batch operators are the contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(spark: SparkSession, path: str, watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """A stream of the Parquet files that a folder or glob holds and gets, with a watermark."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there and stop; the result as a table of the session."""
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def counted_by_type(spark: SparkSession, path: str) -> DataFrame:
    """Events by type and day; state and result hold a row a type and day."""
    return run_once(opened(spark, path).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("greatest")))


def append_new(spark: SparkSession, source: str, target: str, checkpoint: str, key: list[str], ts: str = "ts") -> None:
    """Append rows whose key was not seen within the watermark; resumable by its checkpoint."""
    rows = opened(spark, source, ts=ts).dropDuplicatesWithinWatermark(key)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
