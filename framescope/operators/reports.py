"""Reports of many histograms over one table, each from a single scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histograms(rows: DataFrame, kinds: dict[str, Column], sums: dict[str, Column], sets: dict[str, Sequence[str]]) -> DataFrame:
    """(kind, value, n, sums, sets): a histogram of each of ``kinds``, and a row ``all`` over everything.

    ``sets`` names, for a kind, other kinds whose distinct values each of its values gets as sorted lists. The kinds are
    grouping sets of one aggregate, and so are the pairs that make the lists: only distinct pairs are gathered.
    """
    names = list(kinds)
    base = rows.select(*(c.cast("string").alias(f"_{k}") for k, c in kinds.items()), *(c.alias(f"_sum_{k}") for k, c in sums.items()))
    pairs = [(a, b) for a, others in sets.items() for b in others]
    groups = [[f"_{k}"] for k in names] + [[f"_{a}", f"_{b}"] for a, b in pairs] + [[]]
    made = base.groupingSets(groups, *(f"_{k}" for k in names)).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"_sum_{k}").alias(k) for k in sums), F.grouping_id().alias("_id"))

    def of(*own: str) -> int:  # a kind's bit is 0 where it is grouped by
        return sum(0 if k in own else 1 << (len(names) - 1 - i) for i, k in enumerate(names))

    kind, value = F.lit("all"), F.lit(None).cast("string")
    for k in names:
        ids = [of(k), *(of(a, b) for a, b in pairs if a == k)]
        kind = F.when(F.col("_id").isin(*ids), k).otherwise(kind)
        value = F.when(F.col("_id").isin(*ids), F.col(f"_{k}")).otherwise(value)
    whole = F.col("_id").isin(of(), *(of(k) for k in names))
    lists = [F.array_sort(F.collect_list(F.when(F.col("_id") == of(a, b), F.col(f"_{b}")))).alias(f"{a}_{b}") for a, b in pairs]
    return made.groupBy(kind.alias("kind"), value.alias("value")).agg(*(F.max(F.when(whole, F.col(c))).alias(c) for c in ("n", *sums)), *lists)


def tagged_counts(rows: DataFrame, single: dict[str, Column], many: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """(kind, value, n, means): counts by the values of columns and by the elements of arrays, and a row ``all`` with means.

    A null value isn't counted; the mean of a column leaves its nulls out.
    """
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    def several(kind: str, values: Column) -> Column:
        return F.coalesce(F.transform(values, lambda v: one(kind, v)), F.array())

    places = F.concat(F.array(one("all", F.lit(""))), F.filter(F.array(*(one(k, c) for k, c in single.items())), lambda x: x["value"].isNotNull()), *(several(k, c) for k, c in many.items()))
    e = rows.select(F.explode(places).alias("x"), *(c.alias(f"_{k}") for k, c in means.items())).select("x.*", *(F.when(F.col("x.kind") == "all", F.col(f"_{k}")).alias(f"_{k}") for k in means))
    return e.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"_{k}").alias(k) for k in means))


def top_of_each(counts: DataFrame, kind: str, most: int) -> DataFrame:
    """The ``most`` frequent values of each kind, with their ``place``; ties by value."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


# When an annotator or a model is worth a warning.
MOST_SKIPPED, LEAST_RECORDS, MOST_UNSURE, UNSURE, LEAST_SUCCESS = 0.20, 10, 5, 0.5, 0.80


def annotator_alerts(records: DataFrame) -> DataFrame:
    """(who, alert, value) from records (annotator_id, status, confidence): many skipped, or many submitted without being
    sure. A missing confidence counts as sure."""
    unsure = (F.col("status") == "submitted") & (F.coalesce(F.col("confidence"), F.lit(1.0)) < UNSURE)
    sums = records.groupBy(F.col("annotator_id").alias("who")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(unsure).alias("unsure"))
    rate = F.col("skipped") / F.col("n")
    found = F.array(
        F.when((F.col("n") >= LEAST_RECORDS) & (rate > MOST_SKIPPED), F.struct(F.lit("skip_rate").alias("alert"), rate.cast("double").alias("value"))),
        F.when(F.col("unsure") > MOST_UNSURE, F.struct(F.lit("low_confidence").alias("alert"), F.col("unsure").cast("double").alias("value"))),
    )
    return sums.select("who", F.explode(F.array_compact(found)).alias("x")).select("who", "x.*")


def model_alerts(results: DataFrame) -> DataFrame:
    """(who, alert, value) from results (model, success): models that succeed too seldom."""
    sums = results.groupBy(F.col("model").alias("who")).agg(F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("int")).alias("value"))
    return sums.where(F.col("value") < LEAST_SUCCESS).select("who", F.lit("success_rate").alias("alert"), "value")


def field_agreement(rows: DataFrame, fields: dict[str, tuple[Column, Column]], there: Column) -> DataFrame:
    """(field, agree, disagree, missing, mean_delta, max_delta) of two versions of records, in one pass.

    Rows that aren't ``there`` on both sides are missing for every field. Nulls agree with each other. Deltas are of
    numbers that differ; decimals or integers, so that their sums are exact.
    """
    kinds = dict(rows.select(*(a.alias(k) for k, (a, _) in fields.items())).dtypes)
    number = lambda k: not kinds[k].startswith(("string", "bool", "array", "struct"))
    none = F.lit(None).cast("decimal(18,6)")
    made = F.array(*(F.struct(F.lit(k).alias("field"), a.eqNullSafe(b).alias("same"), ((b - a).cast("decimal(18,6)") if number(k) else none).alias("delta")) for k, (a, b) in fields.items()))
    x = rows.select(F.coalesce(there, F.lit(False)).alias("there"), F.explode(made).alias("x")).select("there", "x.*")
    here, delta = F.col("there"), F.when(F.col("there") & ~F.col("same"), F.col("delta"))
    sums = x.groupBy("field").agg(F.count_if(here & F.col("same")).alias("agree"), F.count_if(here & ~F.col("same")).alias("disagree"), F.count_if(~here).alias("missing"), F.sum(delta).cast("double").alias("_sum"), F.count(delta).alias("_n"), F.max(F.abs(delta)).cast("double").alias("max_delta"))
    return sums.select("field", "agree", "disagree", "missing", F.try_divide("_sum", "_n").alias("mean_delta"), "max_delta")


def summary(values: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population deviation, least and greatest of a column."""
    c = F.col(column)
    return values.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), F.median(c).cast("double").alias("median"), F.stddev_pop(c).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"))


def unlisted_summary(people: DataFrame) -> DataFrame:
    """(closest, people, clips, coverage) of people (clip_id, code, closest) whose action isn't listed: by the class that is
    said to be closest, and over all (null). ``coverage`` is the share of all clips without such a person."""
    unlisted = F.coalesce(F.col("code") == "X1", F.lit(False))
    named = F.when(unlisted & (F.coalesce("closest", F.lit("")) != ""), F.col("closest"))
    # By clip and class first, so that a clip's list holds each class once, and the people are worked out once.
    pairs = people.groupBy("clip_id", named.alias("closest")).agg(F.count_if(unlisted).alias("n"))
    clips = pairs.groupBy("clip_id").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("closest").isNotNull(), F.struct("closest", "n"))).alias("by"))
    whole = F.struct(F.lit(None).cast("string").alias("closest"), "n")
    spread = clips.select("clip_id", F.explode(F.concat(F.array(whole), F.col("by"))).alias("x")).select("x.*", F.lit(1).alias("clip"))
    rows = spread.unionByName(people.sparkSession.range(1).select(F.lit(None).cast("string").alias("closest"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("clip")))
    sums = rows.groupBy("closest").agg(F.sum("n").alias("people"), F.count_if(F.col("n") > 0).alias("clips"), F.sum("clip").alias("all"))
    return sums.select("closest", "people", "clips", F.when(F.col("closest").isNull(), 1 - F.try_divide(F.col("clips").cast("double"), F.col("all").cast("double"))).alias("coverage"))


def model_health(log: DataFrame, truth: DataFrame, issues: DataFrame, failure: Column) -> DataFrame:
    """(kind, value, n) of a model's log (clip_id, success): all records, clips with a success, failed records by kind of
    ``failure``, clean clips and clips with issues, issues by kind, and how much of ``truth`` (clip_id) is covered.

    ``issues`` (clip_id, issue) are those of each clip's last success. A clip without any is clean.
    """
    good = F.coalesce(F.col("success"), F.lit(False))
    none = F.lit(None).cast("string")
    row = lambda rows, kind, value=none, good=F.lit(True): rows.select("clip_id", F.lit(kind).alias("kind"), value.alias("value"), good.alias("good"))
    issue = row(issues, "issue", F.substring_index("issue", "=", 1))
    # What is known of a clip meets in one shuffle of counts; the issues are worked out once.
    every = row(log, "record", F.when(~good, failure), good).unionByName(issue).unionByName(row(truth, "truth"))
    counts = every.groupBy("clip_id", "kind", "value", "good").agg(F.count(F.lit(1)).alias("n"))
    is_ = lambda kind: F.col("kind") == kind
    listed = F.collect_list(F.when(~is_("truth"), F.struct("kind", "value", "good", "n"))).alias("parts")
    clips = counts.groupBy("clip_id").agg(F.bool_or(is_("record") & F.col("good")).alias("done"), F.bool_or(is_("truth")).alias("wanted"), F.bool_or(is_("issue")).alias("issues"), listed)
    done, wanted, named = F.col("done"), F.col("wanted"), F.col("clip_id").isNotNull()
    flawed = done & F.col("issues") & named
    one = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), value.alias("value"), n.cast("long").alias("n"))
    states = {"succeeded": done, "flawed": flawed, "clean": done & ~flawed, "wanted": wanted, "covered": wanted & done & named}
    of = lambda kind, where: F.filter("parts", lambda p: (p["kind"] == kind) & where(p))
    parts = [
        F.array(*(one(k, none, c) for k, c in states.items())),
        F.transform(of("record", lambda p: F.lit(True)), lambda p: one("records", none, p["n"])),
        F.transform(of("record", lambda p: ~p["good"]), lambda p: one("failure", p["value"], p["n"])),
        F.transform(of("issue", lambda p: done & named), lambda p: one("issue", p["value"], p["n"])),
    ]
    rows = clips.select(F.explode(F.concat(*parts)).alias("x")).select("x.*")
    zeros = log.sparkSession.range(1).select(F.explode(F.array(*(one(k, none, F.lit(0)) for k in ("records", *states)))).alias("x")).select("x.*")
    return rows.unionByName(zeros).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def review_rollup(reviews: DataFrame) -> DataFrame:
    """(kind, value, status, n) of safety reviews (rule_id, status, overall, agrees, discard): statuses by rule, overall
    verdicts, agreement with the model and reasons of discards, from one pass; null values aren't counted."""
    one = lambda kind, value, status: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), status.cast("string").alias("status"))
    none = F.lit(None)
    made = F.array(
        F.when(F.col("status").isNotNull(), one("rule", F.col("rule_id"), F.col("status"))),
        F.when(F.col("overall").isNotNull(), one("overall", F.col("overall"), none)),
        F.when(F.col("agrees").isNotNull(), one("agreement", F.when(F.col("agrees"), "agree").otherwise("disagree"), none)),
        F.when(F.col("discard").isNotNull(), one("discard", F.col("discard"), none)),
    )
    return reviews.select(F.explode(F.array_compact(made)).alias("x")).groupBy("x.kind", "x.value", "x.status").agg(F.count(F.lit(1)).alias("n"))
