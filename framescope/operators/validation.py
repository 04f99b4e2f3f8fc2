"""Checks of annotation records as arrays of error texts, categories of records, repairs, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.columns import error_group, layer
from framescope.functions.taxonomy import ACTIONS, COMPANY, CONDITIONS, FLAG_CATEGORIES, OCCLUSION, OVERALL_PROTECTION, PROTECTION, PROTECTION_MAY_NOT_APPLY, PROTECTION_VALUES, SCENES, SPATIAL_TAGS

# Bounds of the number of people on each layer.
BOUNDS = {1: (6, 30), 2: (1, 5)}


def _errors(*checks: tuple[Column, Column | str]) -> Column:
    """Messages of the checks that fail; a check that is null fails too."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for ok, m in checks)))


def _filled(value: Column, least: int = 1) -> Column:
    return F.length(F.trim(value)) >= least


def _named(value: Column, known: tuple[str, ...] | dict, name: str) -> tuple[Column, Column]:
    """A check that a label is there and known, with one message for each way to fail."""
    return value.isin(*known), F.when(_filled(value), f"{name} is unknown").otherwise(f"{name} is required")


def _listed(values: Column, known: tuple[str, ...] | dict, name: str) -> Column:
    """Errors of a list of labels: none, or one error for each that is unknown."""
    wrong = F.filter(values, lambda v: ~F.coalesce(v.isin(*known), F.lit(False)))
    some = F.coalesce(F.size(values) > 0, F.lit(False))
    return F.when(some, F.transform(wrong, lambda v: F.concat_ws(" ", F.lit(f"{name} has unknown"), v))).otherwise(F.array(F.lit(f"{name} is empty")))


def _bonus(r: Column) -> Column:
    return F.coalesce(r["bonus_per_person"], F.lit(False))


def scene_errors(r: Column) -> Column:
    """Errors of a record's scene: labels, the number of people and the layer that follows from it, and texts."""
    n, filed = r["num_workers"], r["annotation_layer"]
    least, most = (F.when(filed == 1, BOUNDS[1][k]).otherwise(BOUNDS[2][k]) for k in (0, 1))
    some = F.coalesce(n >= 1, F.lit(False))
    moved = r["action_transition"]
    return F.concat(
        _errors(
            _named(r["scene_type"], SCENES, "scene_type"),
            (some, "num_workers is below 1"),
            (~some | (filed == layer(n)) | (_bonus(r) & (filed == 1) & (n > 5)), "annotation_layer does not match num_workers"),
            (~some | ~F.coalesce(filed.isin(1, 2), F.lit(False)) | n.between(least, most), "num_workers is out of bounds"),
        ),
        _listed(r["dominant_actions"], ACTIONS, "dominant_actions"),
        _errors((_filled(r["scene_description"], 10), "scene_description is short"), _named(r["overall_ppe_compliance"], OVERALL_PROTECTION, "overall_ppe_compliance")),
        _listed(r["visibility_conditions"], CONDITIONS, "visibility_conditions"),
        _errors(
            (moved["detected"].isNotNull(), "action_transition is missing"),
            (~F.coalesce(moved["detected"], F.lit(False)) | (F.size(moved["transitions"]) > 0), "action_transition lists none"),
            (r["annotator_confidence"].between(0, 1), "annotator_confidence is not in 0 to 1"),
        ),
    )


def person_errors(persons: Column) -> Column:
    """Errors of all people, each with the person's number."""

    def one(p: Column, i: Column) -> Column:
        found = F.concat(
            _errors(
                _named(p["action_code"], ACTIONS, "action_code"),
                (_filled(p["position"], 3), "position is short"),
                *(_named(p["ppe"][item], (*PROTECTION_VALUES, "not_applicable") if item in PROTECTION_MAY_NOT_APPLY else PROTECTION_VALUES, f"ppe.{item}") for item in PROTECTION),
            ),
            _listed(p["spatial_context"], SPATIAL_TAGS, "spatial_context"),
            _errors(_named(p["occlusion_level"], OCCLUSION, "occlusion_level"), _named(p["group_flag"], COMPANY, "group_flag")),
        )
        return F.transform(found, lambda e: F.concat(F.lit("P"), (i + 1).cast("string"), F.lit("."), e))

    return F.flatten(F.transform(persons, one))


def review_errors(review: Column) -> Column:
    """Errors of a safety officer's review, which has fields of its own in place of a scene."""
    overall, agrees = review["overall_compliance"], review["agree_with_vlm"]
    found = _errors(
        (_filled(overall), "overall_compliance is required"),
        (_filled(agrees), "agree_with_vlm is required"),
        (~agrees.eqNullSafe("Disagree") | _filled(review["disagree_reason"]), "disagree_reason is required"),
        (~F.coalesce(overall.isin("not_compliant", "cannot_determine"), F.lit(False)) | _filled(review["safety_description"]), "safety_description is required"),
    )
    return F.when(review.isNull(), F.array(F.lit("safety_review is required"))).otherwise(found)


def record_errors(r: Column) -> Column:
    """All errors of a record, by its status and its annotator's role.

    Layer 2 must list its people, and they are checked; layer 1 lists none, or has the bonus flag and goes unchecked.
    """
    people = F.coalesce(F.size(r["persons"]), F.lit(0))
    listed = F.concat(_errors((people == r["num_workers"], "persons do not match num_workers")), F.coalesce(person_errors(r["persons"]), F.array().cast("array<string>")))
    by_layer = (
        F.when(r["annotation_layer"] == 2, listed)
        .when(r["annotation_layer"] == 1, _errors((_bonus(r) | (people == 0), "persons are listed on layer 1")))
        .otherwise(F.array(F.lit("annotation_layer is neither 1 nor 2")))
    )
    return (
        F.when(r["status"] == "skipped", F.array().cast("array<string>"))
        .when(r["status"] == "discarded", _errors((_filled(r["discard_reason"]), "discard_reason is required")))
        .when(r["status"] == "flagged", _errors(_named(r["flag_category"], FLAG_CATEGORIES, "flag_category"), (_filled(r["flag_reason"], 5), "flag_reason is short")))
        .when(~r["status"].eqNullSafe("submitted"), F.array(F.lit("status is unknown")))
        .when(r["annotator_role"] == "tier_3", review_errors(r["safety_review"]))
        .otherwise(F.concat(scene_errors(r), by_layer))
    )


def category(r: Column, errors: Column) -> Column:
    """non_submitted, invalid_recoverable (a big scene filed on layer 2 with all people), valid or invalid_requeue.

    ``errors`` is a column with the record's errors, so that they are worked out once.
    """
    recoverable = (r["annotation_layer"] == 2) & (r["num_workers"] > 5) & (F.size(r["persons"]) == r["num_workers"]) & ~_bonus(r)
    return F.when(~r["status"].eqNullSafe("submitted"), "non_submitted").when(F.coalesce(recoverable, F.lit(False)), "invalid_recoverable").when(F.size(errors) == 0, "valid").otherwise("invalid_requeue")


def repaired(records: DataFrame, record: str = "record", at: Column | None = None) -> DataFrame:
    """Recoverable records moved to layer 1 with the bonus flag; others unchanged. With a time ``at``, ``repaired_at`` and
    ``repair`` say when and how a record was changed, null on others."""
    r = F.col(record)
    fixed = r.withField("annotation_layer", F.lit(1)).withField("bonus_per_person", F.lit(True))
    change = category(r, record_errors(r)) == "invalid_recoverable"
    if at is None:
        return records.withColumn(record, F.when(change, fixed).otherwise(r))
    marked = records.withColumn("_change", F.coalesce(change, F.lit(False)))
    stamped = marked.withColumn("repaired_at", F.when(F.col("_change"), at)).withColumn("repair", F.when(F.col("_change"), "layer_1_bonus_kept"))
    return stamped.withColumn(record, F.when(F.col("_change"), fixed).otherwise(r)).drop("_change")


def error_histogram(rows: DataFrame, errors: str, top: int = 15) -> DataFrame:
    """The most frequent errors, person numbers masked; ties by text."""
    found = rows.select(F.explode(errors).alias("error")).select(error_group(F.col("error")).alias("error"))
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(top)


def category_counts(rows: DataFrame, by: str, categories: list[str], column: str = "category") -> DataFrame:
    return rows.groupBy(by).pivot(column, categories).count().fillna(0)


def health(rows: DataFrame, truth: DataFrame, key: str = "clip_id") -> DataFrame:
    """One row: records, clean ones, issues, and how many ground-truth keys have a record. ``rows`` has ``issues``."""
    covered = truth.select(key).distinct().join(rows.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    a = rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("issues") == 0).alias("clean"), F.sum(F.size("issues")).cast("long").alias("issues"))
    b = covered.agg(F.count(F.lit(1)).alias("wanted"), F.count("_has").alias("covered"))
    return a.crossJoin(b)


def rerun_keys(wanted: DataFrame, rows: DataFrame, critical: list[str], key: str = "clip_id") -> DataFrame:
    """Keys without a record, and those with a critical issue."""
    missing = wanted.select(key).join(rows.select(key), key, "left_anti")
    broken = rows.where(F.arrays_overlap("issues", F.array(*map(F.lit, critical)))).select(key)
    return missing.union(broken).distinct()


def count_windows(rows: DataFrame, keys: list[str], order: list[str], size: int, failed: Column, limit: float = 0.05) -> DataFrame:
    """Failure rate of each ``size`` rows in order, by key, and whether it is over the limit."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rated = rows.withColumn("window", F.floor(place / size)).groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"))
    return rated.withColumn("alert", F.col("failed") > F.col("n") * limit)
