"""Summaries of clips from the people found in their sampled frames, and of progress in a set of clips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PEOPLE = "array<struct<confidence: decimal(9,6), bbox_area_ratio: decimal(9,6), position_x: string, position_depth: string>>"


def clip_summary(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a clip from frames (``num_persons``, ``persons`` as ``PEOPLE``): people in all, least, most and mean of a
    frame, share of frames with anyone, mean and extremes of confidence and size, and the positions that occur, sorted.

    Each frame's people are folded inside its row, so that rows aren't repeated; clips without people have zeros.
    """
    people = F.coalesce("persons", F.array().cast(PEOPLE))
    zero = F.lit(0).cast("decimal(20,6)")
    total = lambda f: F.aggregate(people, zero, lambda s, p: (s + F.coalesce(p[f], zero)).cast("decimal(20,6)"))
    value = lambda f: F.transform(people, lambda p: p[f])
    folded = frames.select(
        *keys,
        F.col("num_persons").alias("n"),
        F.size(people).alias("found"),
        *(total(f).alias(f"sum_{f}") for f in ("confidence", "bbox_area_ratio")),
        F.array_max(value("confidence")).alias("most_confidence"),
        F.array_max(value("bbox_area_ratio")).alias("most_area"),
        F.array_min(value("bbox_area_ratio")).alias("least_area"),
        F.array_distinct(F.concat(value("position_x"), value("position_depth"))).alias("places"),
    )
    double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    mean = lambda a, b, digits: F.round(F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0)), digits)
    return folded.groupBy(*keys).agg(
        F.sum("n").alias("total_persons"),
        F.min("n").alias("min_persons"),
        F.max("n").alias("max_persons"),
        F.round(F.avg("n"), 2).alias("avg_persons"),
        F.round(F.count_if(F.col("n") > 0) / F.count(F.lit(1)), 4).alias("person_detection_ratio"),
        mean("sum_confidence", "found", 4).alias("avg_confidence"),
        F.round(double(F.max("most_confidence")), 4).alias("max_confidence"),
        mean("sum_bbox_area_ratio", "found", 6).alias("avg_bbox_area_ratio"),
        F.round(double(F.max("most_area")), 6).alias("max_bbox_area_ratio"),
        F.round(double(F.min("least_area")), 6).alias("min_bbox_area_ratio"),
        F.array_join(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("places"))))), ",").alias("person_positions"),
    )


def gate_reasons(ratio: Column, area: Column, confidence: Column, duration: Column, least: tuple[float, float, float, float] = (0.40, 0.005, 0.45, 8.0)) -> Column:
    """The gates that a segment fails, each with its value and limit as text."""
    gates = (("low_presence", "%.2f", ratio, ""), ("small_person", "%.4f", area, ""), ("low_confidence", "%.3f", confidence, ""), ("short_clip", "%.1f", duration, "s"))
    texts = [F.when(v < limit, F.concat(F.format_string(f"{name}:{form}", v.cast("double")), F.lit(f"{unit}<{limit}{unit}"))) for (name, form, v, unit), limit in zip(gates, least, strict=True)]
    return F.array_compact(F.array(*texts))


def phase_clips(everything: DataFrame, earlier: DataFrame, listed: DataFrame | None = None, key: str = "clip_id") -> DataFrame:
    """The clips of a phase: those ``listed``, or else all that don't belong to an earlier one."""
    return listed.select(key).distinct() if listed is not None else everything.select(key).distinct().join(earlier.select(key), key, "left_anti")


def phase_progress(assigned: DataFrame, records: DataFrame, phase: DataFrame) -> DataFrame:
    """(annotator_id, assigned, submitted, flagged, discarded, complete) inside a phase, of all who have work or records;
    ``complete`` in percent, 0 without work."""
    work = assigned.join(phase, "clip_id", "left_semi").groupBy("annotator_id").agg(F.count(F.lit(1)).alias("assigned"))
    here = phase.select("clip_id", F.lit(True).alias("_here"))
    states = ("submitted", "flagged", "discarded")
    done = records.join(here, "clip_id", "left").groupBy("annotator_id").agg(*(F.count_if(F.col("_here") & (F.col("status") == s)).alias(s) for s in states))
    both = work.join(done, "annotator_id", "full").fillna(0)
    return both.select("annotator_id", "assigned", *states, F.round(F.coalesce(F.try_divide(100.0 * F.col("submitted"), F.col("assigned")), F.lit(0.0)), 1).alias("complete"))
