"""What people change of a model's records, and how that depends on having seen them: nested records side by side.

Rows have a ``condition`` (``anchored`` with the model's record in sight, ``blind`` without, or null) and records
``model``, ``first`` (of a tier-1 annotator) and ``expert``, any of which may be null. Records are structs as
``RECORD`` names; people correspond by their places. Everything is one pass over rows, with partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.functions.taxonomy import NO_VIOLATION, PROTECTION
from framescope.operators.metrics import ratio

PERSON = (
    "action_code: string, spatial_context: array<string>, ppe: struct<helmet: string, high_vis_vest: string, welding_protection: string, harness: string, safety_shoes: string>, "
    "occlusion_level: string, occlusion_source: array<string>, unsafe_act: string, interaction: string, group_flag: string"
)
RECORD = (
    "annotation_layer: int, scene_type: string, visibility: string, num_workers: int, visibility_conditions: array<string>, dominant_actions: array<string>, "
    f"overall_ppe_compliance: string, scene_unsafe_act: string, persons: array<struct<{PERSON}>>"
)
#: The items of protection that the chain of three records is followed for, and the code that models give too often.
CHAIN_ITEMS = ("helmet", "high_vis_vest", "safety_shoes")
IDLE = "F1"


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def _unsafe(c: Column, words: Sequence[str]) -> Column:
    return F.coalesce(~F.lower(F.trim(c)).isin(*words), F.lit(False))


def _count(record: Column) -> Column:
    return F.coalesce(F.size(record["persons"]), F.lit(0))


def side_by_side(rows: DataFrame, *names: str, keep: Sequence[str] = ("condition",)) -> DataFrame:
    """The ``keep`` columns with a person of each record named, for each place that all of them have."""
    n = F.least(*(_count(F.col(name)) for name in names))
    people = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*(F.get(F.col(name)["persons"], i).alias(name) for name in names)))
    return rows.where(n > 0).select(*keep, F.explode(people).alias("_at")).select(*keep, *(F.col("_at")[name].alias(name) for name in names))


def _layer2(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col(name)["annotation_layer"] == 2)


# --- anchoring ------------------------------------------------------------------------------------------------------


def anchoring_by_class(rows: DataFrame, least: int = 3) -> DataFrame:
    """Agreement with the model under both conditions, over all people, by group and by class, and the bias in points.

    A comparison counts for the classes and groups of both sides. Classes are those that people gave; they and not the
    groups need ``least`` comparisons.
    """
    p = side_by_side(_layer2(rows, "first").where(F.col("condition").isin("anchored", "blind")), "first", "model")
    h, v = F.col("first.action_code"), F.col("model.action_code")
    one = lambda level, value: F.struct(F.lit(level).alias("level"), value.alias("value"))
    groups = F.array_distinct(F.array(F.substring(h, 1, 1), F.substring(v, 1, 1)))
    places = F.concat(F.array(one("all", F.lit(""))), F.transform(groups, lambda g: one("group", g)), F.transform(F.array_distinct(F.array(h, v)), lambda c: one("class", c)))
    e = p.where(_said(h) & _said(v)).select("condition", h.alias("h"), (h == v).alias("same"), F.explode(places).alias("x")).select("condition", "h", "same", "x.*")
    shown, blind = F.col("condition") == "anchored", F.col("condition") == "blind"
    out = e.groupBy("level", "value").agg(
        F.count_if(shown).alias("anchored"), F.count_if(shown & F.col("same")).alias("anchored_agreed"), F.count_if(blind).alias("blind"), F.count_if(blind & F.col("same")).alias("blind_agreed"), F.count_if(F.col("h") == F.col("value")).alias("_given")
    )
    rate = lambda c: F.coalesce(ratio(F.col(f"{c}_agreed"), F.col(c)), F.lit(0.0))
    few = (F.col("level") == "class") & ((F.col("_given") == 0) | (F.col("anchored") + F.col("blind") < least))
    return out.where(~few).drop("_given").withColumn("bias_points", (rate("anchored") - rate("blind")) * 100)


def direction(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether people were right to keep or to change the model's action, an expert's record being the truth."""
    both = rows.where((F.col("first")["annotation_layer"] == 2) & (F.col("expert")["annotation_layer"] == 2))
    p = side_by_side(both, "first", "model", "expert", keep=keys)
    h, v, e = (F.col(f"{n}.action_code") for n in ("first", "model", "expert"))
    kept, right = h == v, v == e
    known = p.where(_said(h) & _said(v) & _said(e))
    sums = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in (("productive_anchor", kept & right), ("harmful_anchor", kept & ~right), ("productive_override", ~kept & ~right), ("harmful_override", ~kept & right))))
    return sums.withColumn("productive_share", ratio(F.col("productive_anchor") + F.col("productive_override"), F.col("n")))


# --- what the model does where nobody saw its record ----------------------------------------------------------------


def blind_truth(rows: DataFrame) -> DataFrame:
    """(truth, model) of blind clips: the expert's record if there is one, else the first annotator's."""
    truth = F.coalesce("expert", "first")
    return rows.where(F.col("condition") == "blind").select(truth.alias("truth"), "model").where("truth is not null and model is not null")


def blind_accuracy(rows: DataFrame) -> DataFrame:
    """By class and over all: comparisons, right ones with their interval, and wrong ones in which the model said idle.

    Over all, scenes of layer 1 count too, as right if half of all their actions are common.
    """
    pairs = blind_truth(rows)
    p = side_by_side(_layer2(pairs, "truth"), "truth", "model", keep=())
    t, v = F.col("truth.action_code"), F.col("model.action_code")
    people = p.where(_said(t) & _said(v)).select(F.explode(F.array(F.lit("all"), t)).alias("class"), (t == v).alias("right"), (v == IDLE).alias("idle"))
    a, b = _set(F.col("truth.dominant_actions")), _set(F.col("model.dominant_actions"))
    scenes = pairs.where((F.col("truth.annotation_layer") == 1) & (F.size(a) > 0) & (F.size(b) > 0)).select(F.lit("all").alias("class"), (2 * F.size(F.array_intersect(a, b)) >= F.size(F.array_union(a, b))).alias("right"), F.lit(None).cast("boolean").alias("idle"))
    n, k = F.col("n"), F.col("right")
    out = people.unionByName(scenes).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right"), F.count_if(~F.col("right") & F.col("idle").isNotNull()).alias("wrong"), F.count_if(~F.col("right") & F.col("idle")).alias("idle_wrong"))
    return out.withColumn("ci", C.wilson(k, n))


def spread(per_class: DataFrame) -> DataFrame:
    """Difference of the best and the worst class, and the mean of the classes."""
    share = ratio(F.col("right"), F.col("n"))
    return per_class.where("class <> 'all'").agg((F.max(share) - F.min(share)).alias("spread"), F.count(F.lit(1)).alias("classes"), F.avg(share).alias("macro"))


def degradation(rows: DataFrame) -> DataFrame:
    """People and right ones by the first of a clip's visibility conditions; ``clear`` where none is given."""
    seen = F.coalesce(F.get(F.col("truth.visibility_conditions"), F.lit(0)), F.lit("clear"))
    pairs = blind_truth(rows).withColumn("seen", seen)
    p = side_by_side(_layer2(pairs, "truth"), "truth", "model", keep=("seen",))
    t, v = F.col("truth.action_code"), F.col("model.action_code")
    return p.where(_said(t) & _said(v)).groupBy("seen").agg(F.count(F.lit(1)).alias("n"), F.count_if(t == v).alias("right"))


def clip_safety(rows: DataFrame) -> DataFrame:
    """Blind clips with a violation in the truth, those that the model saw too, missed ones and false alarms."""
    words = NO_VIOLATION["bias"]
    any_ = lambda people: F.coalesce(F.exists(people, lambda p: _unsafe(p["unsafe_act"], words)), F.lit(False))
    t, v = F.col("truth"), F.col("model")
    bad = ((t["annotation_layer"] == 2) & any_(t["persons"])) | _unsafe(t["scene_unsafe_act"], words)
    x = blind_truth(rows).select(F.coalesce(bad, F.lit(False)).alias("bad"), any_(v["persons"]).alias("seen"))
    sums = x.agg(F.count(F.lit(1)).alias("clips"), F.count_if("bad").alias("with_violation"), F.count_if(F.col("bad") & F.col("seen")).alias("detected"), F.count_if(F.col("bad") & ~F.col("seen")).alias("false_safe"), F.count_if(~F.col("bad") & F.col("seen")).alias("false_alarm"))
    return sums.withColumn("recall", ratio(F.col("detected"), F.col("with_violation")))


# --- overrides ------------------------------------------------------------------------------------------------------


def _field(name: str, comparable: Column, changed: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), F.coalesce(comparable, F.lit(False)).alias("comparable"), F.coalesce(changed, F.lit(True)).alias("changed"))


def field_changes(rows: DataFrame, keep: Sequence[str] = ("clip_id",)) -> DataFrame:
    """(field, comparable, changed) of the first annotator's record against the model's, a row a field and person.

    Fields of the scene always compare; of people, on layer 2, a value that both give, or tags that one of them gives.
    """
    a, b = F.col("first"), F.col("model")
    scene = [_field(f, F.lit(True), ~a[f].eqNullSafe(b[f])) for f in ("scene_type", "num_workers", "overall_ppe_compliance")]
    scene += [_field(f, F.lit(True), ~_set(a[f]).eqNullSafe(_set(b[f]))) for f in ("visibility_conditions", "dominant_actions")]

    def person(p: Column, q: Column) -> Column:
        both = lambda f: _field(f, _said(p[f]) & _said(q[f]), p[f] != q[f])
        tags = [_set(x["spatial_context"]) for x in (p, q)]
        items = [_field(f"ppe_{i}", _said(p["ppe"][i]) & _said(q["ppe"][i]), p["ppe"][i] != q["ppe"][i]) for i in PROTECTION]
        return F.array(both("action_code"), _field("spatial_context", (F.size(tags[0]) > 0) | (F.size(tags[1]) > 0), ~tags[0].eqNullSafe(tags[1])), *items, both("occlusion_level"))

    n = F.least(_count(a), _count(b))
    places = F.when((a["annotation_layer"] == 2) & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    people = F.flatten(F.transform(places, lambda i: person(F.get(a["persons"], i), F.get(b["persons"], i))))
    both_there = rows.where("first is not null and model is not null")
    return both_there.select(*keep, F.explode(F.concat(F.array(*scene), people)).alias("x")).select(*keep, "x.*")


def override_rates(changes: DataFrame) -> DataFrame:
    """By field: comparable values, changed ones, and the interval of their share."""
    out = changes.where("comparable").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))
    return out.withColumn("ci", C.wilson(F.col("changed"), F.col("n")))


def class_overrides(rows: DataFrame) -> DataFrame:
    """By the model's action: how often people changed it."""
    p = side_by_side(_layer2(rows, "first"), "first", "model", keep=())
    h, v = F.col("first.action_code"), F.col("model.action_code")
    return p.where(_said(h) & _said(v)).groupBy(v.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(h != v).alias("changed"))


#: Axes by which layers are compared; layer 1 against what the model says of its people.
AXES = {2: ("action", "spatial", "ppe"), 1: ("scene_type", "dominant_actions", "scene_unsafe_act")}


def layer_overrides(rows: DataFrame) -> DataFrame:
    """Override rates by layer and axis, by layer, and over all, from one pass with grouping sets; null means all."""
    a, b = F.col("first"), F.col("model")
    p, q = F.get(a["persons"], F.lit(0)), F.get(b["persons"], F.lit(0))
    there = p.isNotNull() & q.isNotNull()
    tags = [_set(x["spatial_context"]) for x in (p, q)]
    given = F.filter(F.transform(F.coalesce(b["persons"], F.array().cast(f"array<struct<{PERSON}>>")), lambda x: x["action_code"]), _said)
    named, derived = _set(a["dominant_actions"]), _set(given)
    acts = F.coalesce(F.exists(b["persons"], lambda x: _unsafe(x["unsafe_act"], ("", "none"))), F.lit(False))
    scene = [F.trim(x["scene_type"]) for x in (a, b)]
    second = F.array(
        _field("action", there & _said(p["action_code"]) & _said(q["action_code"]), p["action_code"] != q["action_code"]),
        _field("spatial", there & ((F.size(tags[0]) > 0) | (F.size(tags[1]) > 0)), ~tags[0].eqNullSafe(tags[1])),
        _field("ppe", there & p["ppe"].isNotNull() & q["ppe"].isNotNull(), ~p["ppe"].eqNullSafe(q["ppe"])),
    )
    first = F.array(
        _field("scene_type", _said(scene[0]) & _said(scene[1]), scene[0] != scene[1]),
        _field("dominant_actions", (F.size(named) > 0) | (F.size(derived) > 0), ~named.eqNullSafe(derived)),
        _field("scene_unsafe_act", F.lit(True), (F.trim(F.coalesce(a["scene_unsafe_act"], F.lit(""))) != "") != acts),
    )
    layer = a["annotation_layer"]
    axes = rows.where("first is not null and model is not null").select(layer.alias("layer"), F.explode(F.when(layer == 2, second).when(layer == 1, first)).alias("x")).select("layer", F.col("x.field").alias("axis"), "x.comparable", "x.changed").where("comparable")
    sets = axes.groupingSets([["layer", "axis"], ["layer"], []], "layer", "axis")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))
    return out.withColumn("ci", C.wilson(F.col("changed"), F.col("n")))


# --- experts --------------------------------------------------------------------------------------------------------


def expert_chain(rows: DataFrame) -> DataFrame:
    """Agreement of model, first annotator and expert, what experts do with kept and with changed labels, and whether
    they move away from the model or towards it."""
    both = rows.where((F.col("first")["annotation_layer"] == 2) & (F.col("expert")["annotation_layer"] == 2))
    p = side_by_side(both, "model", "first", "expert", keep=())
    v, h, e = (F.col(f"{n}.action_code") for n in ("model", "first", "expert"))
    kept, back = h == v, e == v
    named = {
        "model_first": kept, "model_expert": back, "first_expert": h == e, "kept": kept, "corrected": kept & ~back, "changed": ~kept,
        "confirmed": ~kept & (e == h), "returned": ~kept & back, "away": kept & ~back, "towards": ~kept & back,
    }
    sums = p.where(_said(v) & _said(h) & _said(e)).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in named.items()))
    return sums.withColumn("net_debiasing", F.col("away") - F.col("towards"))


def protection_chain(rows: DataFrame) -> DataFrame:
    """By item of protection and over all (null): agreement of the three records, where all of them give a state."""
    p = side_by_side(_layer2(rows, "first"), "model", "first", "expert", keep=())
    states = F.array(*(F.struct(F.lit(i).alias("item"), *(F.col(f"{n}.ppe")[i].alias(n) for n in ("model", "first", "expert"))) for i in CHAIN_ITEMS))
    x = p.select(F.explode(states).alias("x")).select("x.*").where(_said(F.col("model")) & _said(F.col("first")) & _said(F.col("expert")))
    m, t, e = F.col("model"), F.col("first"), F.col("expert")
    return x.rollup("item").agg(F.count(F.lit(1)).alias("n"), F.count_if(m == t).alias("model_first"), F.count_if(m == e).alias("model_expert"), F.count_if(t == e).alias("first_expert"))


# --- calibration by where labels come from --------------------------------------------------------------------------

#: Sets of labels; one record may be in several.
PROVENANCES = ("blind", "proper_chain", "gold", "model_sourced")


def provenance_mask(role: Column, source: Column, condition: Column, blind_clip: Column) -> Column:
    """Bit k for membership in ``PROVENANCES[k]``: labels given without sight of the model's, by experts who reviewed a
    person's record, by any expert, and by experts who edited the model's."""
    expert = role == "expert"
    unseen = (role == "annotator") & ((condition.eqNullSafe("blind") & ~source.eqNullSafe("vlm")) | (F.coalesce(blind_clip, F.lit(False)) & source.isNull()))
    bits = (unseen, expert & source.eqNullSafe("tier_1"), expert, expert & source.eqNullSafe("vlm"))
    return sum((F.when(F.coalesce(b, F.lit(False)), 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def first_of_each(rows: DataFrame, key: str, order: str, mask: str = "mask") -> DataFrame:
    """Rows whose mask keeps only the sets in which they are the first of their key."""
    w = Window.partitionBy(key)
    bits = range(len(PROVENANCES))
    has = lambda k: F.col(mask).bitwiseAND(1 << k) != 0
    marked = rows.select("*", *(F.min(F.when(has(k), F.col(order))).over(w).alias(f"_first{k}") for k in bits))
    kept = sum((F.when(has(k) & (F.col(order) == F.col(f"_first{k}")), 1 << k).otherwise(0) for k in bits), F.lit(0))
    return marked.withColumn(mask, kept).drop(*(f"_first{k}" for k in bits)).where(F.col(mask) != 0)


def calibration_by_set(rows: DataFrame, right: Column, confidence: str, bins: int = 10, mask: str = "mask") -> DataFrame:
    """Expected calibration error, accuracy and mean confidence of each set, from sums by mask and bin.

    Rows are added up once, whatever number of sets they belong to; only the sums are dealt out to the sets. Bins are
    open below and closed above, the first holds 0 too. ``confidence`` is a decimal, so sums are exact.
    """
    place = F.greatest(F.ceil(F.col(confidence) * bins).cast("int") - 1, F.lit(0))
    sums = rows.groupBy(mask, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.sum(confidence).alias("sure"))
    sets = F.filter(F.array(*(F.when(F.col(mask).bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(PROVENANCES))), lambda x: x.isNotNull())
    each = sums.select(F.explode(sets).alias("provenance"), "bin", "n", "right", "sure").groupBy("provenance", "bin").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("sure").alias("sure"))
    n = F.sum("n")
    return each.groupBy("provenance").agg(ratio(F.sum(F.abs(F.col("sure") - F.col("right"))), n).alias("ece"), ratio(F.sum("right"), n).alias("accuracy"), ratio(F.sum("sure"), n).alias("mean_confidence"), n.alias("n"))
