"""A run's append-only manifest as a stream: tallies per condition and status.  An addition; batch runs do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "ts timestamp, case string, cond string, rep int, status string, cost double, lat double"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def tally(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Counts and cost per window, condition and status; events later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "cond", "status").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def run(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads what is there and stops; called again it goes on from its checkpoint."""
    return tally(events(spark, folder)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
