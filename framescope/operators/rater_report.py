"""Agreement of every two raters on all axes, from one table of pairs of their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.taxonomy import GROUPS, PROTECTION, SPATIAL_TAGS
from framescope.operators.metrics import kappa, weighted_kappa

# The kappa that each axis should reach, and how many scenes make a scene's kappa worth stating.
TARGETS = {"action": 0.75, "spatial": 0.70, "protection": 0.65}
LEAST_SCENES = 5
KEYS = ["rater_a", "rater_b"]


def half_credit(a: Column, b: Column) -> Column:
    """Disagreement of two codes: none if equal, half in one known group."""
    group = lambda c: F.when(F.substring(c, 1, 1).isin(*GROUPS), F.substring(c, 1, 1))
    return F.when(a == b, 0.0).when(group(a) == group(b), 0.5).otherwise(1.0)


def _axes(a: Column, b: Column) -> Column:
    """(axis, item, a, b) of two records: the first person's action, each tag and item of protection, and the scene."""
    p, q = (F.get(x["persons"], F.lit(0)) for x in (a, b))
    text = lambda c: F.coalesce(c, F.lit(""))
    one = lambda axis, item, x, y: F.struct(F.lit(axis).alias("axis"), F.lit(item).alias("item"), x.cast("string").alias("a"), y.cast("string").alias("b"))
    has = lambda x, tag: F.coalesce(F.array_contains(x["spatial_context"], tag), F.lit(False))
    state = lambda x, i: F.coalesce(x["ppe"][i], F.lit("cannot_determine"))
    return F.array(
        one("action", "", text(p["action_code"]), text(q["action_code"])),
        *(one("spatial", t, has(p, t), has(q, t)) for t in SPATIAL_TAGS),
        *(one("protection", i, state(p, i), state(q, i)) for i in PROTECTION),
        one("scene", "", text(a["scene_type"]), text(b["scene_type"])),
    )


def pairs_of(rows: DataFrame, raters: list[str]) -> DataFrame:
    """(rater_a, rater_b, a, b) for every two record columns of a row that are both there."""
    two = [F.struct(F.lit(x).alias("rater_a"), F.lit(y).alias("rater_b"), F.col(x).alias("a"), F.col(y).alias("b")) for k, x in enumerate(raters) for y in raters[k + 1 :]]
    return rows.select(F.explode(F.array(*two)).alias("x")).select("x.*").where("a is not null and b is not null")


def bundle(pairs: DataFrame) -> DataFrame:
    """(rater_a, rater_b, axis, kappa, n, target, reached): kappa of actions with half credit inside a group, the mean over
    tags and over items of protection, and of scenes where both give one, if there are enough."""
    rows = pairs.select(*KEYS, F.explode(_axes(F.col("a"), F.col("b"))).alias("x")).select(*KEYS, "x.*")
    action = weighted_kappa(rows.where("axis = 'action'"), half_credit(F.col("a"), F.col("b")), keys=KEYS).withColumn("axis", F.lit("action"))
    items = kappa(rows.where("axis = 'spatial' OR axis = 'protection' OR (a <> '' AND b <> '' AND axis = 'scene')"), [*KEYS, "axis", "item"])
    means = items.groupBy(*KEYS, "axis").agg(F.avg("kappa").alias("kappa"), F.max("n").alias("n")).where(f"axis <> 'scene' OR n >= {LEAST_SCENES}")
    every = action.select(*KEYS, "axis", "kappa", "n").unionByName(means.select(*KEYS, "axis", "kappa", "n"))
    target = F.coalesce(*(F.when(F.col("axis") == a, t) for a, t in TARGETS.items()))
    met = F.when(F.col("axis") == "action", F.col("kappa")).otherwise(F.round("kappa", 4)) >= target
    return every.select(*KEYS, "axis", F.round("kappa", 4).alias("kappa"), "n", target.alias("target"), met.alias("reached"))
