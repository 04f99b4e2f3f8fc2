"""Agreement of two records of one clip: person by person, or by scene where the clip is crowded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.functions.taxonomy import PROTECTION
from framescope.operators.selection import match_people

# The share of each axis in the composite, and the agreement that crowded scenes should reach.
COMPOSITE = {"action": 0.67, "spatial": 0.0, "protection": 0.33}
CROWDED_TARGETS = {"dominant_actions": 0.70, "overall_protection": 0.80, "scene_type": 0.85}
AXES = ("action", "spatial", "protection", "interaction", "safety", "coordination", "composite")
PERSON = (
    "action_code string, position string, spatial_context array<string>, "
    f"ppe struct<{', '.join(f'{i}: string' for i in PROTECTION)}>, interaction string, unsafe_act string, coordinated_with array<string>"
)


def _word(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def _set_agreement(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return C.jaccard(F.coalesce(a, empty), F.coalesce(b, empty))


def protection_agreement(a: Column, b: Column) -> Column:
    """Share of equal states among the items that both records state; 0 if there is none."""
    sides = [(_word(a[i]), _word(b[i])) for i in PROTECTION]
    both = sum(((x != "") & (y != "")).cast("int") for x, y in sides)
    same = sum(((x != "") & (x == y)).cast("int") for x, y in sides)
    return F.when(both > 0, same / both).otherwise(0.0)


def scene_agreement(a: Column, b: Column) -> Column:
    """1 for equal scene types, 0.5 where only the part after the dash differs; an empty one agrees with nothing."""
    x, y = F.upper(_word(a)), F.upper(_word(b))
    base = lambda v: F.substring_index(v, "-", 1)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(base(x) == base(y), 0.5).otherwise(0.0)


def count_agreement(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most > 0, 1 - F.abs(a - b) / most).otherwise(1.0)


def person_agreement(a: Column, b: Column) -> Column:
    """A struct of the seven scores of two people, whose actions are codes already, to four digits."""
    action, spatial = C.action_agreement(a["action_code"], b["action_code"], normal=True), _set_agreement(a["spatial_context"], b["spatial_context"])
    protection = protection_agreement(a["ppe"], b["ppe"])
    met = (_word(a["interaction"]) != "") & (_word(a["interaction"]) == _word(b["interaction"]))
    scores = {
        "action": action,
        "spatial": spatial,
        "protection": protection,
        "interaction": met.cast("double"),
        "safety": ((_word(a["unsafe_act"]) != "") == (_word(b["unsafe_act"]) != "")).cast("double"),
        "coordination": _set_agreement(a["coordinated_with"], b["coordinated_with"]),
        "composite": COMPOSITE["action"] * action + COMPOSITE["spatial"] * spatial + COMPOSITE["protection"] * protection,
    }
    return F.struct(*(F.round(scores[x], 4).alias(x) for x in AXES))


def clip_agreement(rows: DataFrame, a: str, b: str, crowded: int = 5) -> DataFrame:
    """Adds the agreement of the records in columns ``a`` and ``b``, structs of ``scene_type``, ``persons`` and
    ``person`` (what the scene itself says of a person, for records that list nobody).

    People are matched greedily by position (3 parts) and action (7 parts). With more than ``crowded`` people on either
    side only the scenes are compared: person scores are 0 and the composite is that of the scene type. Null people
    count as none.
    """
    listed = {s: F.coalesce(F.col(s)["persons"], F.array().cast(f"array<struct<{PERSON}>>")) for s in (a, b)}
    whole = {s: F.when(F.size(listed[s]) > 0, listed[s]).otherwise(F.array(F.col(s)["person"])) for s in (a, b)}
    big = (F.size(listed[a]) > crowded) | (F.size(listed[b]) > crowded)
    coded = lambda people: F.transform(people, lambda p: p.withField("action_code", C.action_code(p["action_code"])))
    people = rows.withColumn("_big", big).withColumns({f"_{s}": F.when(big, listed[s]).otherwise(coded(whole[s])) for s in (a, b)})
    same_place = lambda x, y: F.coalesce(x["position"], F.lit("")) == F.coalesce(y["position"], F.lit(""))
    score = lambda x, y: 6 * same_place(x, y).cast("int") + (14 * C.action_agreement(x["action_code"], y["action_code"], normal=True)).cast("int")
    found = F.when(~F.col("_big"), match_people(F.col(f"_{a}"), F.col(f"_{b}"), score))
    people = people.withColumn("_at", found)
    rated = F.zip_with(f"_{a}", "_at", lambda x, i: F.when(i >= 0, person_agreement(x, F.get(F.col(f"_{b}"), i))))
    people = people.withColumn("_scores", F.when(~F.col("_big"), F.array_compact(rated)))
    n = F.greatest(F.coalesce(F.size("_scores"), F.lit(0)), F.lit(0))  # crowded clips have no scores of people
    mean = lambda x: F.when(n > 0, F.round(F.round(F.aggregate(F.transform("_scores", lambda v: v[x]), F.lit(0.0), lambda t, v: t + v), 4) / n, 4)).otherwise(0.0)
    scene = F.round(scene_agreement(F.col(a)["scene_type"], F.col(b)["scene_type"]), 4)
    scores = {x: mean(x) for x in AXES} | {"scene_type": scene, "people": F.round(count_agreement(F.size(f"_{a}"), F.size(f"_{b}")), 4), "matched": n}
    scores["composite"] = F.when(F.col("_big"), scene).otherwise(scores["composite"])
    scores["layer"] = F.when(F.col("_big"), 1).otherwise(2)
    return people.withColumns(scores).drop("_big", f"_{a}", f"_{b}", "_at", "_scores")


def crowded_agreement(rows: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """(metric, score, n, target, reached) over pairs of records of crowded clips; no rows below ``least`` pairs.

    A pair counts for actions and protection if either side says something, for the scene type if both do.
    """
    x, y = F.col(a), F.col(b)
    said = lambda f: (_word(x[f]) != "", _word(y[f]) != "")
    values = {
        "dominant_actions": F.when((F.size(x["dominant_actions"]) > 0) | (F.size(y["dominant_actions"]) > 0), _set_agreement(x["dominant_actions"], y["dominant_actions"])),
        "overall_protection": F.when(said("overall_protection")[0] | said("overall_protection")[1], x["overall_protection"].eqNullSafe(y["overall_protection"]).cast("double")),
        "scene_type": F.when(said("scene_type")[0] & said("scene_type")[1], (x["scene_type"] == y["scene_type"]).cast("double")),
    }
    sums = rows.agg(F.count(F.lit(1)).alias("_pairs"), *(F.struct(F.sum(v).alias("s"), F.count(v).alias("n")).alias(m) for m, v in values.items()))
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(m)["s"] / F.col(m)["n"]).alias("score"), F.col(m)["n"].alias("n"), F.lit(t).alias("target")) for m, t in CROWDED_TARGETS.items()))
    out = sums.where(F.col("_pairs") >= least).select(F.inline(parts)).where("n > 0")
    return out.withColumn("reached", F.col("score") >= F.col("target")).withColumn("score", F.round("score", 3))
