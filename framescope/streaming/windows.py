"""Windows and repeats over event time, on tables and on streams with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by window; on a stream, rows later than ``late`` are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late else timed
    return timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late else timed
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by overlapping windows of ``width`` that begin every ``step``."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late else timed
    return timed.groupBy(F.window("_ts", width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_of_key(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """A stream's first row of each key within ``late``; rows later than that are dropped, and keys forgotten after it."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")
