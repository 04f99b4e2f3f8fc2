"""Scores of predictions and raters. Frames are pairs of labels; sums of confidences are decimal, so that results do
not depend on the order of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.columns import is_violation, label_distance, wilson
from framescope.functions.taxonomy import DEGRADING

EXACT = "decimal(18,6)"


def ratio(k: Column, n: Column) -> Column:
    """k / n as a double; null without n."""
    return F.try_divide(k.cast("double"), n.cast("double"))


# --- accuracy and calibration ---------------------------------------------------------------------------------------


def accuracy(pairs: DataFrame, keys: Sequence[str] = (), truth: str = "gt", guess: str = "pred") -> DataFrame:
    """Weighted and macro accuracy, by ``keys``: the macro one is the mean over true classes."""
    per = pairs.groupBy(*keys, truth).agg(F.count_if(F.col(truth) == F.col(guess)).alias("right"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), ratio(F.sum("right"), F.sum("n")).alias("accuracy"), F.count(F.lit(1)).alias("classes"), F.max(ratio(F.col("right"), F.col("n"))).alias("best_class"), F.min(ratio(F.col("right"), F.col("n"))).alias("worst_class"))


def class_accuracy(pairs: DataFrame, keys: Sequence[str], truth: str = "gt", guess: str = "pred") -> DataFrame:
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("right"))
    ci = wilson(F.col("right"), F.col("n"))
    return out.select(*keys, "n", "right", ratio(F.col("right"), F.col("n")).alias("accuracy"), (ci["high"] > ci["low"]).alias("has_interval"))


def calibration_bins(pairs: DataFrame, keys: Sequence[str] = (), score: str = "confidence", right: Column | None = None, bins: int = 10, closed: str = "left") -> DataFrame:
    """Rows, summed confidence and hits of each bin; bins hold their left end, or their right one (and the first 0)."""
    c = F.col(score).cast(EXACT)
    hit = right if right is not None else F.col("gt") == F.col("pred")
    place = F.least(F.floor(c * bins), F.lit(bins - 1)) if closed == "left" else F.greatest(F.ceil(c * bins) - 1, F.lit(0))
    return pairs.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("confidence"), F.count_if(hit).alias("right"))


def expected_calibration_error(pairs: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Mean gap between confidence and accuracy, weighted by bin."""
    gaps = F.sum(F.abs(F.col("confidence") - F.col("right"))).cast("double")
    return calibration_bins(pairs, keys, **options).groupBy(*keys).agg((gaps / F.sum("n").cast("double")).alias("ece"), F.sum("n").alias("n"))


def magnet_share(pairs: DataFrame, label: str, truth: str = "gt", guess: str = "pred") -> DataFrame:
    """Share of the wrong predictions that name one class."""
    wrong = F.col(truth) != F.col(guess)
    return pairs.agg(F.count_if(wrong).alias("wrong"), F.count_if(wrong & (F.col(guess) == label)).alias("drawn"), ratio(F.count_if(wrong & (F.col(guess) == label)), F.count_if(wrong)).alias("share"))


def confusions(pairs: DataFrame, top: int | None = None, truth: str = "gt", guess: str = "pred") -> DataFrame:
    """Wrong pairs of labels by number; the first ``top`` of them, ties by label."""
    out = pairs.where(F.col(truth) != F.col(guess)).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), truth, guess).limit(top) if top else out


def class_scores(pairs: DataFrame, truth: str = "gt", guess: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where undefined."""
    cells = pairs.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(guess).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), (F.col(truth) == F.col(guess)).alias("hit"))
    sums = both.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("guessed"), F.sum(F.when(F.col("hit"), F.col("x.t")).otherwise(0)).alias("right"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select("label", "support", "guessed", "right", zero(ratio(F.col("right"), F.col("guessed"))).alias("precision"), zero(ratio(F.col("right"), F.col("support"))).alias("recall"), zero(ratio(2 * F.col("right"), F.col("guessed") + F.col("support"))).alias("f1"))


def degradation_curve(pairs: DataFrame, conditions: str, kept: Sequence[str]) -> DataFrame:
    """Accuracy in each visual condition, and the hits and rows of all; a pair counts in each of its conditions."""
    rows = pairs.withColumn("condition", F.explode(F.array_distinct(conditions))).where(F.col("condition").isin(*kept))
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("right"), ratio(F.count_if(F.col("gt") == F.col("pred")), F.count(F.lit(1))).alias("accuracy"))


def reasoning_gap(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 - P(safety label agrees | action is right)."""
    right = F.col("gt") == F.col("pred")
    agree = is_violation(F.col("gt_unsafe")) == is_violation(F.col("pred_unsafe"))
    return pairs.groupBy(*keys).agg(F.count_if(right).alias("right"), ratio(F.count_if(right & ~agree), F.count_if(right)).alias("gap"))


def safety_rates(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Recall of violations, its complement, and false alarms."""
    real, said = is_violation(F.col("gt_unsafe")), is_violation(F.col("pred_unsafe"))
    n, hit, quiet, alarm = F.count_if(real), F.count_if(real & said), F.count_if(~real), F.count_if(~real & said)
    return pairs.groupBy(*keys).agg(n.alias("violations"), ratio(hit, n).alias("recall"), ratio(n - hit, n).alias("false_safe"), ratio(alarm, quiet).alias("false_alarm"))


def distance_accuracy(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 - mean distance of labels in the taxonomy."""
    d = label_distance(F.col("gt"), F.col("pred")).cast(EXACT)
    return pairs.groupBy(*keys).agg((1 - F.sum(d).cast("double") / F.count(F.lit(1))).alias("accuracy"))


def detection_scores(clips: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """F2 and mean absolute error of counts; clips without people are left out."""
    g, p = F.col("gt_count"), F.col("pred_count")
    sums = clips.where(g > 0).groupBy(*keys).agg(F.sum(F.least(g, p)).alias("tp"), F.sum(F.greatest(p - g, F.lit(0))).alias("fp"), F.sum(F.greatest(g - p, F.lit(0))).alias("fn"), ratio(F.sum(F.abs(g - p)), F.count(F.lit(1))).alias("mae"))
    return sums.select(*keys, "tp", "fp", "fn", ratio(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")).alias("f2"), "mae")


def degradation_score(pairs: DataFrame, conditions: str, keys: Sequence[str] = (), kept: Sequence[str] = DEGRADING) -> DataFrame:
    """Mean accuracy over the conditions that occur, and that as a share of the best one's; 0 if nothing is right.

    One pass with a pair of counts for each condition; no row is repeated for its conditions.
    """
    right = F.col("gt") == F.col("pred")
    counts = [x for k, c in enumerate(kept) for x in (F.count_if(F.array_contains(conditions, c)).alias(f"_n{k}"), F.count_if(F.array_contains(conditions, c) & right).alias(f"_r{k}"))]
    places = range(len(kept))
    rows = pairs.groupBy(*keys).agg(*counts)
    each = [ratio(F.col(f"_r{k}"), F.col(f"_n{k}")) for k in places]
    total, some = F.lit(0.0), F.lit(0)
    for k in places:
        total, some = total + F.coalesce(each[k], F.lit(0.0)), some + (F.col(f"_n{k}") > 0).cast("int")
    rows = rows.withColumn("audc", total / F.nullif(some, F.lit(0))).withColumn("_best", F.greatest(*each))
    return rows.select(*keys, "audc", F.when(F.col("_best") > 0, F.col("audc") / F.col("_best")).when(F.col("_best").isNotNull(), 0.0).alias("naudc"))


def matched(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions joined with the truth of the same key; what only one side has counts on neither."""
    return predictions.join(truth, key)


#: Limits of the deployment readiness score.
READINESS = {"accuracy": ("at_least", 0.80), "naudc": ("at_least", 0.85), "gap": ("at_most", 0.20), "recall": ("at_least", 0.90), "f2": ("at_least", 0.70)}


def metric_row(pairs: DataFrame, keys: Sequence[str], conditions: str = "conditions") -> DataFrame:
    """One row by key with the five metrics that readiness is judged by; each part is a row by key, so that joins are small."""
    parts = (
        distance_accuracy(pairs, keys),
        degradation_score(pairs, conditions, keys).select(*keys, "naudc"),
        reasoning_gap(pairs, keys).select(*keys, "gap"),
        safety_rates(pairs, keys).select(*keys, "recall"),
        detection_scores(pairs, keys).select(*keys, "f2"),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), "left")
    return out


def readiness_score(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Share of limits that a row of metrics meets; a missing metric doesn't."""
    met = [F.coalesce((F.col(m) >= t) if side == "at_least" else (F.col(m) <= t), F.lit(False)).cast("int") for m, (side, t) in limits.items()]
    return metrics.withColumn("met", sum(met[1:], met[0])).withColumn("score", F.col("met") / F.lit(len(met)))


# --- agreement ------------------------------------------------------------------------------------------------------


def kappa(pairs: DataFrame, keys: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa from the sums of two raters' labels; 1 if chance agreement is complete."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*keys, F.col(a).alias("label")).agg(F.sum("n").alias("by_a"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed"))
    cols = cells.groupBy(*keys, F.col(b).alias("label")).agg(F.sum("n").alias("by_b"))
    joined = rows.join(cols, [*keys, "label"], "full").fillna(0, ["by_a", "by_b", "agreed"])
    n = F.sum("by_a")
    sums = joined.groupBy(*keys).agg(n.alias("n"), F.sum("agreed").alias("agreed"), F.sum(F.col("by_a") * F.col("by_b")).alias("chance"))
    observed, chance = F.col("n") * F.col("agreed"), F.col("n") * F.col("n")
    return sums.select(*keys, "n", F.when(F.col("chance") == chance, 1.0).otherwise(ratio(observed - F.col("chance"), chance - F.col("chance"))).alias("kappa"))


def weighted_kappa(pairs: DataFrame, weight: Column, a: str = "a", b: str = "b", keys: Sequence[str] = ()) -> DataFrame:
    """Kappa with a disagreement weight of two labels, over columns named ``a`` and ``b``, by ``keys``; 1 if chance leaves
    no disagreement. Chance comes from the labels' counts on each side, joined inside a key: labels by labels."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy(*keys, a).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*keys, b).agg(F.sum("n").alias("nb"))
    w = weight.cast(EXACT)
    seen = cells.groupBy(*keys).agg(F.sum(w * F.col("n")).alias("observed"), F.sum("n").alias("n"))
    met = left.join(right, list(keys)) if keys else left.crossJoin(F.broadcast(right))
    chance = met.groupBy(*keys).agg(F.sum(w * F.col("na") * F.col("nb")).alias("expected"))
    both = seen.join(chance, list(keys)) if keys else seen.crossJoin(chance)
    return both.select(*keys, "n", F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("observed").cast("double") * F.col("n") / F.col("expected").cast("double")).alias("kappa"))


def item_kappa(pairs: DataFrame, items: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Kappa of each item of two records."""
    rows = pairs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("item"), a.alias("a"), b.alias("b")) for k, (a, b) in items.items()))).alias("x")).select("x.*")
    return kappa(rows, ["item"])


def set_kappa(pairs: DataFrame, tags: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Kappa of the presence of each tag in two arrays."""
    return item_kappa(pairs, {t: (F.array_contains(a, t), F.array_contains(b, t)) for t in tags})


def rater_pairs(labels: DataFrame, item: str, rater: str, label: str, ordered: bool = False) -> DataFrame:
    """Pairs of raters of the same item: each pair once, or both ways."""
    x = labels.select(item, F.col(rater).alias("rater_a"), F.col(label).alias("a"))
    y = labels.select(item, F.col(rater).alias("rater_b"), F.col(label).alias("b"))
    on = F.col("rater_a") != F.col("rater_b") if ordered else F.col("rater_a") < F.col("rater_b")
    return x.join(y, item).where(on)


def first_raters(labels: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Labels of the first two raters of an item."""
    w = Window.partitionBy(item).orderBy(rater)
    ranked = labels.withColumn("place", F.row_number().over(w)).where("place <= 2")
    return ranked.groupBy(item).agg(F.max(F.when(F.col("place") == 1, F.col(label))).alias("a"), F.max(F.when(F.col("place") == 2, F.col(label))).alias("b")).where("b is not null")


def change_rates(pairs: DataFrame, fields: dict[str, tuple[Column, Column]], keys: Sequence[str] = (), both: bool = True) -> DataFrame:
    """How often each field was changed, among rows that can be compared (those with both sides, if ``both``)."""
    made = [F.struct(F.lit(k).alias("field"), ((a.isNotNull() & b.isNotNull()) if both else F.lit(True)).alias("comparable"), (~a.eqNullSafe(b)).alias("changed")) for k, (a, b) in fields.items()]
    rows = pairs.select(*keys, F.explode(F.array(*made)).alias("x")).where("x.comparable")
    return rows.groupBy(*keys, "x.field").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.changed").alias("changed"), ratio(F.count_if("x.changed"), F.count(F.lit(1))).alias("rate"))


def anchoring_bias(pairs: DataFrame, condition: str, right: Column, limit: float = 0.05) -> DataFrame:
    """Accuracy with a shown suggestion less accuracy without one."""
    shown, blind = F.col(condition) == "anchored", F.col(condition) == "blind"
    acc = lambda c: ratio(F.count_if(c & right), F.count_if(c))
    return pairs.agg(acc(shown).alias("anchored"), acc(blind).alias("blind"), (acc(shown) - acc(blind)).alias("bias")).withColumn("significant", F.col("bias") > limit)


def three_way(rows: DataFrame, model: str, first: str, expert: str) -> DataFrame:
    """Agreement of a model, a first rater and an expert; corrections of and returns to the model's label."""
    m, t, e = F.col(model), F.col(first), F.col(expert)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(m == t).alias("model_first"), F.count_if(m == e).alias("model_expert"), F.count_if(t == e).alias("first_expert"), F.count_if((m == t) & (t != e)).alias("corrected"), F.count_if((m != t) & (m == e)).alias("returned"))


def upper_median(values: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """The upper middle element: that at place n div 2 of the sorted values, by rank, without gathering a group."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    counts = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("k"))
    run = counts.withColumn("upto", F.sum("k").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(w))
    return run.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(column).alias("median"))


def _poisson_limits(digits: int) -> list[str]:
    """Hexadecimal numbers of so many digits up to which a uniform one draws 0, 1, 2, ... of a Poisson distribution of mean 1."""
    total, term, k, out = 0.0, math.exp(-1), 0, []
    while round((total + term) * 16**digits) < 16**digits:
        total, k = total + term, k + 1
        out.append(f"{round(total * 16**digits):0{digits}x}")
        term /= k
    return out


def bootstrap_mean(values: DataFrame, column: str, id_col: str, rounds: int = 200, level: float = 0.95, seed: int = 11) -> DataFrame:
    """Interval of a mean by Poisson bootstrap: each row's weight in a round comes from four digits of an MD5 of seed, id
    and round. All rounds are sums of one pass over the rows, which aren't repeated."""
    each = 8  # draws of one digest
    digests = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(str(k)))).alias(f"_d{k}") for k in range(-(-rounds // each))]
    drawn = values.select(F.col(column).alias("_x"), *digests)
    limits = _poisson_limits(4)

    def weight(r: int) -> Column:
        u = F.substring(F.col(f"_d{r // each}"), 1 + 4 * (r % each), 4)
        out = F.lit(len(limits))
        for k, limit in reversed(list(enumerate(limits))):
            out = F.when(u < limit, k).otherwise(out)
        return out

    sums = drawn.agg(*(x for r in range(rounds) for x in (F.sum(weight(r) * F.col("_x")).alias(f"_s{r}"), F.sum(weight(r)).alias(f"_w{r}"))))
    means = sums.select(F.explode(F.array(*(ratio(F.col(f"_s{r}"), F.col(f"_w{r}")) for r in range(rounds)))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit((1 - level) / 2)).alias("low"), F.percentile("mean", F.lit((1 + level) / 2)).alias("high"))
