"""How far a set of annotations has come: sets of clips by who has done what, counted in one pass, against what is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many of each are wanted.
WANTED = {"proper_chain": 100, "blind_pairs": 50, "blind_clips": 50, "blind_with_expert": 30, "direction_clips": 100, "direction_people": 150, "officer_reviews": 50}
#: Counts that are reported, though none is wanted.
SIZES = ("tier_1_clips", "expert_clips", "either", "model_sourced", "anchored_clips", "pairs")


def clip_states(records: DataFrame) -> DataFrame:
    """A row a clip of submitted records (clip_id, annotator_id, role, status, source, condition, n_people): how many tier-1
    records there are, which conditions occur, what experts started from, and the first record's people of either side."""
    r = records.where("status = 'submitted'")
    first, expert = F.col("role") == "tier_1", F.col("role") == "tier_2"
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    proper = expert & F.col("source").eqNullSafe("tier_1")
    people = lambda c: F.min(F.when(c, F.struct("annotator_id", F.coalesce("n_people", F.lit(0)).alias("n"))))["n"]
    return r.groupBy("clip_id").agg(
        F.count_if(first).alias("first"),
        any_(first & F.col("condition").eqNullSafe("blind")).alias("blind"),
        any_(first & F.col("condition").eqNullSafe("anchored")).alias("anchored"),
        any_(expert).alias("expert"),
        any_(proper).alias("proper"),
        any_(expert & F.col("source").eqNullSafe("vlm")).alias("model_sourced"),
        F.count_if(F.col("role") == "tier_3").alias("officer"),
        people(first).alias("first_people"),
        people(proper).alias("expert_people"),
    )


def report(records: DataFrame, wanted: dict[str, int] | None = None) -> DataFrame:
    """(check, have, wanted, passed); sizes have nothing wanted."""
    wanted = wanted or WANTED
    c = lambda name: F.col(name)
    chain = c("proper") & (c("first") > 0)
    a, b = c("first_people"), c("expert_people")
    pairs: Column = F.when(chain, F.when((a > 0) & (b > 0), F.least(a, b)).when((a == 0) & (b == 0), 1).otherwise(0)).otherwise(0)
    counts = {
        "proper_chain": F.count_if("proper"),
        "blind_pairs": F.count_if((c("first") >= 2) & c("blind")),
        "blind_clips": F.count_if("blind"),
        "blind_with_expert": F.count_if(c("blind") & c("expert")),
        "direction_clips": F.count_if(chain),
        "direction_people": F.coalesce(F.sum(pairs), F.lit(0)).cast("long"),
        "officer_reviews": F.coalesce(F.sum("officer"), F.lit(0)).cast("long"),
        "tier_1_clips": F.count_if(c("first") > 0),
        "expert_clips": F.count_if("expert"),
        "either": F.count_if((c("first") > 0) | c("expert")),
        "model_sourced": F.count_if("model_sourced"),
        "anchored_clips": F.count_if("anchored"),
        "pairs": F.count_if(c("first") >= 2),
    }
    sums = clip_states(records).agg(*(v.alias(k) for k, v in counts.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("have"), F.lit(wanted.get(k)).cast("int").alias("wanted")) for k in counts))
    return sums.select(F.inline(rows)).withColumn("passed", F.col("have") >= F.col("wanted"))
