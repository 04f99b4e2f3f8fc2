"""Work dealt out to annotators, experts and safety officers; random orders are by hash, so that reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.operators import selection as S

# Share and least number of a route's clips that experts audit, and what annotators do by route.
AUDIT = {"high": (0.25, 20), "medium": (0.15, 10), "low": (0.15, 10)}
TASKS = {"high": "verify_consensus", "medium": "review_prefill", "low": "fresh_annotation"}
DOUBLE, OFFICER_SHARE, OFFICER_LEAST = 0.15, 0.10, 2


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with their ``place``, from 0, in an order by hash; counted by prefixes of the hash, not in one task."""
    order = S.hash_order(seed, key)
    return S.numbered(rows, F.conv(F.substring(order[0], 1, 3), 16, 10).cast("long"), order)


def _by_route(values: dict) -> Column:
    return F.coalesce(*(F.when(F.col("route") == r, v) for r, v in values.items()))


def _given(rows: DataFrame, role: str, task: Column, double: Column | None = None) -> DataFrame:
    return rows.select("worker", F.lit(role).alias("role"), "clip_id", task.alias("task"), F.coalesce(double if double is not None else F.lit(False), F.lit(False)).alias("double"), "critical")


def annotator_work(clips: DataFrame, workers: Sequence[str], seed: int = 8) -> DataFrame:
    """Each clip goes to one annotator in turn, and some to the next one too, to compare them."""
    placed = shuffled(clips, "clip_id", seed).withColumn("_again", S.hash_number(seed + 1, "clip_id", 1_000_000) < int(DOUBLE * 1_000_000))
    first = S.in_turn(placed, workers, "place").withColumn("double", F.lit(False))
    again = S.in_turn(placed.where("_again").withColumn("place", F.col("place") + 1), workers, "place").withColumn("double", F.lit(True))
    return _given(first.unionByName(again), "tier_1", _by_route(TASKS), F.col("double"))


def expert_work(clips: DataFrame, experts: Sequence[str], only_experts: bool = False, seed: int = 10) -> DataFrame:
    """A sample of each route to audit, dealt out in turn; or, with ``only_experts``, all clips to all experts."""
    if only_experts:
        everyone = F.explode(F.array(*map(F.lit, experts)))
        return _given(clips.withColumn("worker", everyone), "tier_2", F.lit("expert_gold"))
    shares, floors = _by_route({r: F.lit(s) for r, (s, _) in AUDIT.items()}), _by_route({r: F.lit(n) for r, (_, n) in AUDIT.items()})
    pool = S.audit_sample(clips.where(F.col("route").isin(*AUDIT)), ["route"], S.hash_order(seed, "clip_id"), shares, floors)
    return _given(S.in_turn(shuffled(pool, "clip_id", seed + 1), experts, "place"), "tier_2", F.lit("audit"))


def officer_work(clips: DataFrame, officers: Sequence[str], all_clips: bool = False, seed: int = 12) -> DataFrame:
    """For every officer, a sample by site of clips with an unsafe act and all safety-critical ones; or all clips."""
    if all_clips:
        chosen, task = clips, F.lit("safety_verification")
    else:
        acts = S.audit_sample(clips.where("unsafe").withColumn("site", F.coalesce("site", F.lit("unknown"))), ["site"], S.hash_order(seed, "clip_id"), OFFICER_SHARE, OFFICER_LEAST)
        chosen, task = acts.select("clip_id", "critical").unionByName(clips.where("critical").select("clip_id", "critical")).distinct(), F.lit("safety_audit")
    return _given(chosen.withColumn("worker", F.explode(F.array(*map(F.lit, officers)))), "tier_3", task)


def by_role(clips: DataFrame, annotators: Sequence[str], experts: Sequence[str], officers: Sequence[str], only_experts: bool = False, officers_see_all: bool = False) -> DataFrame:
    """(worker, role, clip_id, task, double, critical) of all roles. ``clips`` has ``clip_id``, ``route``, ``site``, ``unsafe``
    (an unsafe act in the model's record) and ``critical`` (in a flagged zone)."""
    experts_part = expert_work(clips, experts, only_experts)
    if only_experts:
        return experts_part
    return annotator_work(clips, annotators).unionByName(experts_part).unionByName(officer_work(clips, officers, officers_see_all))


def by_route(clips: DataFrame, workers: Sequence[str], seed: int = 14) -> DataFrame:
    """(worker, clip_id, task) without roles: doubtful clips go to two annotators, others to one, and of those that the
    model is sure of a sample."""
    low = S.in_turn(shuffled(clips.where("route = 'low'"), "clip_id", seed), workers, "place", 2)
    medium = S.in_turn(shuffled(clips.where("route = 'medium'"), "clip_id", seed), workers, "place")
    sample = S.verification_sample(clips.where("route = 'high'"), S.hash_order(seed, "clip_id"))
    high = S.in_turn(shuffled(sample, "clip_id", seed), workers, "place")
    return low.unionByName(medium).unionByName(high).select("worker", "clip_id", _by_route(TASKS).alias("task"))
