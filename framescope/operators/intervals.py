"""Timelines to intervals to segments, and joins on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(timeline: DataFrame, key: str, ts: str, flag: str, order: list[str] | None = None) -> DataFrame:
    """(key, start, end) of runs of rows with ``flag``. A run ends at the first row after it, or at its last row."""
    w = Window.partitionBy(key).orderBy(*(order or [ts]))
    before = F.coalesce(F.lag(flag).over(w), F.lit(False))
    marked = timeline.select(key, *dict.fromkeys([ts, flag, *(order or [])]), F.lead(ts).over(w).alias("next_ts"), (F.col(flag) & ~before).cast("int").alias("opens"))
    numbered = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = numbered.where(F.col(flag))
    return hits.groupBy(key, "island").agg(F.min(ts).alias("start"), F.max(F.coalesce("next_ts", ts)).alias("end")).drop("island")


def merge_close(intervals: DataFrame, key: str, gap: float) -> DataFrame:
    """Join intervals whose gap is at most ``gap``; the later one's end counts."""
    w = Window.partitionBy(key).orderBy("start", "end")
    marked = intervals.withColumn("opens", (F.col("start") - F.lag("end").over(w) > gap).cast("int"))
    numbered = marked.withColumn("part", F.sum(F.coalesce("opens", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def pad(intervals: DataFrame, padding: float, least: Column | float = 0, most: Column | float | None = None) -> DataFrame:
    """Widen intervals, inside bounds. They may overlap afterwards."""
    low = least if isinstance(least, Column) else F.lit(least)
    end = F.col("end") + padding
    if most is not None:
        end = F.least(end, most if isinstance(most, Column) else F.lit(most))
    return intervals.withColumn("start", F.greatest(F.col("start") - padding, low)).withColumn("end", end)


def slice_fixed(intervals: DataFrame, length: float, least: float) -> DataFrame:
    """Segments of equal ``length``; a last shorter one stays if it is at least ``least`` long."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("end") - F.col("start")) / length).cast("int")))
    cut = intervals.withColumn("step", F.explode(steps)).withColumn("slice_start", F.col("start") + F.col("step") * length)
    cut = cut.withColumn("slice_end", F.least(F.col("slice_start") + length, F.col("end")))
    return cut.where((F.col("slice_end") - F.col("slice_start") >= least) & (F.col("slice_end") > F.col("slice_start"))).drop("step")


def within(points: DataFrame, segments: DataFrame, key: str, ts: str, width: float) -> DataFrame:
    """Points inside segments, both ends included. Time is cut into cells of ``width``, so that the join has a key."""
    cells = segments.withColumn("cell", F.explode(F.sequence(F.floor(F.col("slice_start") / width).cast("long"), F.floor(F.col("slice_end") / width).cast("long"))))
    placed = points.withColumn("cell", F.floor(F.col(ts) / width).cast("long"))
    return cells.join(placed, [key, "cell"]).where(F.col(ts).between(F.col("slice_start"), F.col("slice_end"))).drop("cell")


def nearest(points: DataFrame, targets: DataFrame, key: str, ts: str, at: str) -> DataFrame:
    """For each target the nearest point of its key; of two equally near ones the earlier.

    Points and targets are put in one order; each target takes the last point before and the first after it.
    """
    a = points.select(key, F.col(ts).alias("t"), F.lit(0).alias("kind"))
    b = targets.select(key, F.col(at).alias("t"), F.lit(1).alias("kind"))
    w = Window.partitionBy(key).orderBy("t", "kind")
    back = F.last(F.when(F.col("kind") == 0, F.col("t")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fore = F.first(F.when(F.col("kind") == 0, F.col("t")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = a.unionByName(b).select(key, "t", "kind", back.alias("back"), fore.alias("fore")).where("kind = 1")
    near = F.when(F.col("back").isNull(), F.col("fore")).when(F.col("fore").isNull(), F.col("back")).when(F.col("t") - F.col("back") <= F.col("fore") - F.col("t"), F.col("back")).otherwise(F.col("fore"))
    return both.select(key, F.col("t").alias(at), near.alias("nearest"))
