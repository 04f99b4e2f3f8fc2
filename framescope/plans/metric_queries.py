"""Queries of scores and agreement, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import metrics as M
from framescope.plans.projections import CLIPS, PAIRS, RATERS, clips, pairs, raters, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("a01_clip_summary", "SELECT user_id, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec, CAST(count(*) FILTER (detected) AS DOUBLE) / count(*) AS ratio, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type IN ('click','purchase') AS detected, event_type AS kind FROM events) GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("sec"), "event_type")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), M.ratio(F.count_if(F.col("event_type").isin("click", "purchase")), F.count(F.lit(1))).alias("ratio"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a02_valid_mean_sentinel", f"WITH {CLIPS} SELECT l_suppkey, coalesce(CAST(sum(noise) FILTER (noise >= 80) AS DOUBLE) / count(*) FILTER (noise >= 80), -1.0) AS quality FROM clips GROUP BY l_suppkey")
def _(s, d):
    valid = F.col("noise") >= 80
    return clips(s, d).groupBy("l_suppkey").agg(F.coalesce(M.ratio(F.sum(F.when(valid, F.col("noise"))), F.count_if(valid)), F.lit(-1.0)).alias("quality"))


@query("a03_inventory_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def _(s, d):
    t = table(s, d, "lineitem")
    return t.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.grouping_id().cast("long").alias("level"))


@query("a04_tier_report", f"WITH {CLIPS} SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN disc < 4 THEN 'detection_ratio' END, CASE WHEN tax < 2 THEN 'bbox_area' END, CASE WHEN qty < 10 THEN 'confidence' END, CASE WHEN duration < 8 THEN 'duration' END], lambda x: x IS NOT NULL)) AS reason FROM clips) GROUP BY reason")
def _(s, d):
    failures = C.gate_failures(F.col("disc"), F.col("tax"), F.col("qty"), F.col("duration"), 4, 2, 10, 8)
    return clips(s, d).select(F.explode(failures).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a05_accuracy_weighted_macro_class_group", f"WITH {PAIRS}, per AS (SELECT model, gt, count(*) FILTER (gt = pred) AS r, count(*) AS n FROM pairs GROUP BY ALL) SELECT model, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy, count(*) AS classes, max(CAST(r AS DOUBLE) / n) AS best_class, min(CAST(r AS DOUBLE) / n) AS worst_class FROM per GROUP BY model")
def _(s, d):
    return M.accuracy(pairs(s, d), ["model"])


ECE = "SELECT {keys} CAST(sum(abs(c - 100 * r)) AS DOUBLE) / 100 / CAST(sum(n) AS DOUBLE) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {keys} {bin} AS b, sum(pct) AS c, count(*) FILTER (gt = pred) AS r, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY ALL"


@query("a06_ece", f"WITH {PAIRS} " + ECE.format(keys="model,", bin="least(pct // 10, 9)"))
def _(s, d):
    return M.expected_calibration_error(pairs(s, d), ["model"])


@query("a07_ece_right_closed", f"WITH {PAIRS} " + ECE.format(keys="", bin="greatest((pct + 9) // 10 - 1, 0)"))
def _(s, d):
    return M.expected_calibration_error(pairs(s, d), closed="right")


@query("a08_magnet_ratio", f"WITH {PAIRS} SELECT count(*) FILTER (gt <> pred) AS wrong, count(*) FILTER (gt <> pred AND pred = 'F1') AS drawn, CAST(count(*) FILTER (gt <> pred AND pred = 'F1') AS DOUBLE) / count(*) FILTER (gt <> pred) AS share FROM pairs")
def _(s, d):
    return M.magnet_share(pairs(s, d), "F1")


@query("a09_top_confusions", f"WITH {PAIRS} SELECT gt, pred, count(*) AS n FROM pairs WHERE gt <> pred GROUP BY ALL ORDER BY n DESC, gt, pred LIMIT 3")
def _(s, d):
    return M.confusions(pairs(s, d), 3)


@query("a10_confusion_prf", f"WITH {PAIRS}, l AS (SELECT gt AS label FROM pairs UNION SELECT pred FROM pairs), x AS (SELECT label, (SELECT count(*) FROM pairs WHERE gt = label) AS support, (SELECT count(*) FROM pairs WHERE pred = label) AS guessed, (SELECT count(*) FROM pairs WHERE gt = label AND pred = label) AS r FROM l) SELECT label, support, guessed, r AS \"right\", coalesce(CAST(r AS DOUBLE) / nullif(guessed, 0), 0.0) AS precision, coalesce(CAST(r AS DOUBLE) / nullif(support, 0), 0.0) AS recall, coalesce(CAST(2 * r AS DOUBLE) / nullif(guessed + support, 0), 0.0) AS f1 FROM x")
def _(s, d):
    return M.class_scores(pairs(s, d))


@query("a11_audc", f"WITH {PAIRS} SELECT condition, count(*) AS n, count(*) FILTER (gt = pred) AS \"right\", CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*) AS accuracy FROM (SELECT gt, pred, unnest(list_distinct(conditions)) AS condition FROM pairs) WHERE condition <> 'rain' GROUP BY condition")
def _(s, d):
    return M.degradation_curve(pairs(s, d), "conditions", ["clear", "steam", "dust", "smoke", "glare", "low_light"])


@query("a12_crg", f"WITH {PAIRS} SELECT model, count(*) FILTER (gt = pred) AS \"right\", CAST(count(*) FILTER (gt = pred AND gt_bad <> pred_bad) AS DOUBLE) / count(*) FILTER (gt = pred) AS gap FROM pairs GROUP BY model")
def _(s, d):
    return M.reasoning_gap(pairs(s, d), ["model"])


@query("a13_safety_recall", f"WITH {PAIRS} SELECT model, count(*) FILTER (gt_bad = 1) AS violations, CAST(count(*) FILTER (gt_bad = 1 AND pred_bad = 1) AS DOUBLE) / count(*) FILTER (gt_bad = 1) AS recall, CAST(count(*) FILTER (gt_bad = 1 AND pred_bad = 0) AS DOUBLE) / count(*) FILTER (gt_bad = 1) AS false_safe, CAST(count(*) FILTER (gt_bad = 0 AND pred_bad = 1) AS DOUBLE) / count(*) FILTER (gt_bad = 0) AS false_alarm FROM pairs GROUP BY model")
def _(s, d):
    return M.safety_rates(pairs(s, d), ["model"])


@query("a14_dwa", f"WITH {PAIRS} SELECT model, 1 - CAST(sum(CASE WHEN gt = pred THEN 0 WHEN gt[1] = pred[1] THEN 0.33 ELSE 0.5 + 0.1 * abs(strpos('ABCDEFX', gt[1]) - strpos('ABCDEFX', pred[1])) END::DECIMAL(18,6)) AS DOUBLE) / count(*) AS accuracy FROM pairs GROUP BY model")
def _(s, d):
    return M.distance_accuracy(pairs(s, d), ["model"])


@query("a15_f2_detect", f"WITH {PAIRS}, x AS (SELECT model, CAST(sum(least(gt_count, pred_count)) AS BIGINT) AS tp, CAST(sum(greatest(pred_count - gt_count, 0)) AS BIGINT) AS fp, CAST(sum(greatest(gt_count - pred_count, 0)) AS BIGINT) AS fn, CAST(sum(abs(gt_count - pred_count)) AS DOUBLE) / count(*) AS mae FROM pairs WHERE gt_count > 0 GROUP BY model) SELECT model, tp, fp, fn, CAST(5 * tp AS DOUBLE) / (5 * tp + 4 * fn + fp) AS f2, mae FROM x")
def _(s, d):
    return M.detection_scores(pairs(s, d), ["model"])


@query("a16_readiness_score", f"WITH {PAIRS}, m AS (SELECT model, CAST(count(*) FILTER (gt_bad = 1 AND pred_bad = 1) AS DOUBLE) / count(*) FILTER (gt_bad = 1) AS recall, CAST(count(*) FILTER (gt_bad = 1 AND pred_bad = 0) AS DOUBLE) / count(*) FILTER (gt_bad = 1) AS false_safe, CAST(count(*) FILTER (gt_bad = 0 AND pred_bad = 1) AS DOUBLE) / count(*) FILTER (gt_bad = 0) AS false_alarm FROM pairs GROUP BY model) SELECT model, CAST((recall >= 0.8)::INT + (false_safe <= 0.2)::INT + (false_alarm <= 0.3)::INT AS INT) AS met, ((recall >= 0.8)::INT + (false_safe <= 0.2)::INT + (false_alarm <= 0.3)::INT) / 3 AS score FROM m")
def _(s, d):
    return M.readiness_score(M.safety_rates(pairs(s, d), ["model"]), {"recall": ("at_least", 0.8), "false_safe": ("at_most", 0.2), "false_alarm": ("at_most", 0.3)}).select("model", "met", "score")


_BINS = ("clear", "low_light", "dust", "glare", "steam", "smoke")
_DEGRADED = (
    "b AS (SELECT model, " + ", ".join(f"count(*) FILTER (list_contains(conditions, '{c}')) AS n{k}, count(*) FILTER (list_contains(conditions, '{c}') AND gt = pred) AS r{k}" for k, c in enumerate(_BINS)) + " FROM pairs GROUP BY model), "
    "g AS (SELECT model, " + ", ".join(f"CAST(r{k} AS DOUBLE) / nullif(n{k}, 0) AS a{k}" for k in range(6)) + " FROM b), "
    "h AS (SELECT model, (0.0::DOUBLE + " + " + ".join(f"coalesce(a{k}, 0.0::DOUBLE)" for k in range(6)) + ") / nullif(" + " + ".join(f"(a{k} IS NOT NULL)::INT" for k in range(6)) + ", 0) AS audc, greatest(" + ", ".join(f"a{k}" for k in range(6)) + ") AS best FROM g), "
    "u AS (SELECT model, audc, CASE WHEN best > 0 THEN audc / best WHEN best IS NOT NULL THEN 0.0 END AS naudc FROM h)"
)


@query("a11_naudc", f"WITH {PAIRS}, {_DEGRADED} SELECT model, audc, naudc FROM u")
def _(s, d):
    return M.degradation_score(pairs(s, d), "conditions", ["model"])


@query("a16_readiness_five", f"WITH {PAIRS}, {_DEGRADED}, "
    "w AS (SELECT model, 1 - CAST(sum(CASE WHEN gt = pred THEN 0 WHEN gt[1] = pred[1] THEN 0.33 ELSE 0.5 + 0.1 * abs(strpos('ABCDEFX', gt[1]) - strpos('ABCDEFX', pred[1])) END::DECIMAL(18,6)) AS DOUBLE) / count(*) AS accuracy, "
    "CAST(count(*) FILTER (gt = pred AND gt_bad <> pred_bad) AS DOUBLE) / count(*) FILTER (gt = pred) AS gap, CAST(count(*) FILTER (gt_bad = 1 AND pred_bad = 1) AS DOUBLE) / count(*) FILTER (gt_bad = 1) AS recall FROM pairs GROUP BY model), "
    "f AS (SELECT model, CAST(5 * sum(least(gt_count, pred_count)) AS DOUBLE) / (5 * sum(least(gt_count, pred_count)) + 4 * sum(greatest(gt_count - pred_count, 0)) + sum(greatest(pred_count - gt_count, 0))) AS f2 FROM pairs WHERE gt_count > 0 GROUP BY model), "
    "z AS (SELECT model, accuracy, naudc, gap, recall, f2, CAST((accuracy >= 0.8)::INT + (naudc >= 0.85)::INT + (gap <= 0.2)::INT + (recall >= 0.9)::INT + (f2 >= 0.7)::INT AS INT) AS met FROM w JOIN u USING (model) JOIN f USING (model)) SELECT *, met / 5 AS score FROM z")
def _(s, d):
    return M.readiness_score(M.metric_row(pairs(s, d), ["model"]), M.READINESS)


@query("j01_prediction_truth", "WITH t AS (SELECT o_orderkey AS clip_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS gt FROM orders), p AS (SELECT l_orderkey AS clip_id, CAST(min(l_partkey) % 5 + 1 AS INT) AS pred FROM lineitem GROUP BY l_orderkey) SELECT gt, pred, count(*) AS n FROM p JOIN t USING (clip_id) GROUP BY ALL")
def _(s, d):
    """Predictions, one for each clip, against truth from another table, counted by both labels."""
    truth = table(s, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("gt"))
    said = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id")).agg((F.min("l_partkey") % 5 + 1).cast("int").alias("pred"))
    return M.matched(said, truth, "clip_id").groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("a17_leaderboard", f"WITH {PAIRS} SELECT model, CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*) AS accuracy, CAST(row_number() OVER (ORDER BY count(*) FILTER (gt = pred) * 1.0 / count(*) DESC, model) AS INT) AS place FROM pairs GROUP BY model")
def _(s, d):
    from pyspark.sql import Window

    scores = pairs(s, d).groupBy("model").agg(M.ratio(F.count_if(F.col("gt") == F.col("pred")), F.count(F.lit(1))).alias("accuracy"))
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "model")))  # a row per model


KAPPA = "SELECT {keys} CAST(sum(na) AS BIGINT) AS n, CASE WHEN sum(na * nb) = sum(na) * sum(na) THEN 1.0::DOUBLE ELSE CAST(CAST(sum(na) * sum(ok) - sum(na * nb) AS BIGINT) AS DOUBLE) / CAST(CAST(sum(na) * sum(na) - sum(na * nb) AS BIGINT) AS DOUBLE) END AS kappa FROM (SELECT {keys} label, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb, count(*) FILTER (side = 0 AND a = b) AS ok FROM (SELECT *, a AS label, 0 AS side FROM ab UNION ALL SELECT *, b AS label, 1 AS side FROM ab) GROUP BY ALL) GROUP BY ALL"


@query("a18_kappa", "WITH ab AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) " + KAPPA.format(keys=""))
def _(s, d):
    return M.kappa(table(s, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")).dropna())


@query("a19_weighted_kappa", f"WITH {PAIRS}, c AS (SELECT gt AS a, pred AS b, count(*) AS n FROM pairs GROUP BY ALL), w AS (SELECT a, b, n, CASE WHEN a = b THEN 0 WHEN a[1] = b[1] THEN 1 ELSE 2 END AS w FROM c), e AS (SELECT sum(CASE WHEN x.a = y.b THEN 0 WHEN x.a[1] = y.b[1] THEN 1 ELSE 2 END * x.n * y.n) AS e FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y) SELECT CAST(sum(n) AS BIGINT) AS n, 1 - CAST(sum(w * n) AS DOUBLE) * CAST(sum(n) AS DOUBLE) / CAST(max(e) AS DOUBLE) AS kappa FROM w CROSS JOIN e")
def _(s, d):
    w = F.when(F.col("a") == F.col("b"), 0).when(F.substring("a", 1, 1) == F.substring("b", 1, 1), 1).otherwise(2)
    return M.weighted_kappa(pairs(s, d).select(F.col("gt").alias("a"), F.col("pred").alias("b")), w)


@query("a20_multilabel_kappa", f"WITH {PAIRS}, ab AS (SELECT t AS item, list_contains(conditions, t) AS a, (pct % 3 = 0) = (t = 'clear') AS b FROM pairs CROSS JOIN (VALUES ('clear'),('dust'),('glare')) v(t)) " + KAPPA.format(keys="item,"))
def _(s, d):
    p = pairs(s, d).withColumn("third", (F.col("confidence") * 100).cast("int") % 3 == 0)
    other = F.when(F.col("third"), F.array(F.lit("clear"))).otherwise(F.array(F.lit("dust"), F.lit("glare")))
    return M.set_kappa(p.withColumn("b", other).withColumnRenamed("conditions", "a"), ["clear", "dust", "glare"])


@query("a21_item_kappa", f"WITH {CLIPS}, ab AS (SELECT 'helmet' AS item, most > 1 AS a, qty % 3 > 0 AS b FROM clips UNION ALL SELECT 'harness', least > 0, qty % 5 > 2 FROM clips) " + KAPPA.format(keys="item,"))
def _(s, d):
    return M.item_kappa(clips(s, d), {"helmet": (F.col("most") > 1, F.col("qty") % 3 > 0), "harness": (F.col("least") > 0, F.col("qty") % 5 > 2)})


@query("a22_iaa_by_rater_pair", f"WITH {RATERS}, ab AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.label AS a, y.label AS b FROM raters x JOIN raters y USING (clip_id) WHERE x.rater < y.rater) " + KAPPA.format(keys="rater_a, rater_b,"))
def _(s, d):
    return M.kappa(M.rater_pairs(raters(s, d), "clip_id", "rater", "label"), ["rater_a", "rater_b"])


@query("a22b_first_two_raters", f"WITH {RATERS}, f AS (SELECT clip_id, label, row_number() OVER (PARTITION BY clip_id ORDER BY rater) AS p FROM raters), ab AS (SELECT max(label) FILTER (p = 1) AS a, max(label) FILTER (p = 2) AS b FROM f GROUP BY clip_id HAVING count(*) > 1) " + KAPPA.format(keys=""))
def _(s, d):
    return M.kappa(M.first_raters(raters(s, d), "clip_id", "rater", "label"))


@query("a23_wilson", f"WITH {PAIRS}, x AS (SELECT gt, count(*) FILTER (gt = pred) AS k, count(*) AS n FROM pairs GROUP BY gt) SELECT gt, k, n, CAST(floor(1e6 * ((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(((k / n) * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) AS BIGINT) AS low, CAST(floor(1e6 * least(1.0, ((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt(((k / n) * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))) AS BIGINT) AS high FROM x")
def _(s, d):
    x = pairs(s, d).groupBy("gt").agg(F.count_if(F.col("gt") == F.col("pred")).alias("k"), F.count(F.lit(1)).alias("n"))
    open_, held = C.wilson(F.col("k"), F.col("n")), C.wilson(F.col("k"), F.col("n"), clamp=True)
    return x.select("gt", "k", "n", F.floor(open_["low"] * 1e6).alias("low"), F.floor(held["high"] * 1e6).alias("high"))


CHANGES = "SELECT {keys} field, count(*) AS n, count(*) FILTER (changed) AS changed, CAST(count(*) FILTER (changed) AS DOUBLE) / count(*) AS rate FROM ({rows}) GROUP BY ALL"


@query("a25_override_by_layer_axis", f"WITH {PAIRS} " + CHANGES.format(keys="layer,", rows="SELECT CASE WHEN gt_count <= 5 AND gt_count > 2 THEN 1 ELSE 2 END AS layer, 'action' AS field, gt IS DISTINCT FROM pred AS changed FROM pairs UNION ALL SELECT CASE WHEN gt_count <= 5 AND gt_count > 2 THEN 1 ELSE 2 END, 'safety', gt_bad <> pred_bad FROM pairs"))
def _(s, d):
    p = pairs(s, d).withColumn("layer", F.when(F.col("gt_count") > 2, 1).otherwise(2))
    return M.change_rates(p, {"action": (F.col("gt"), F.col("pred")), "safety": (C.is_violation(F.col("gt_unsafe")), C.is_violation(F.col("pred_unsafe")))}, ["layer"])


@query("a26_anchoring_bias", f"WITH {PAIRS}, x AS (SELECT CAST(count(*) FILTER (condition = 'anchored' AND gt = pred) AS DOUBLE) / count(*) FILTER (condition = 'anchored') AS anchored, CAST(count(*) FILTER (condition = 'blind' AND gt = pred) AS DOUBLE) / count(*) FILTER (condition = 'blind') AS blind FROM pairs) SELECT anchored, blind, anchored - blind AS bias, anchored - blind > 0.05 AS significant FROM x")
def _(s, d):
    return M.anchoring_bias(pairs(s, d), "condition", F.col("gt") == F.col("pred"))


@query("a27_decoy_catch", f"WITH {PAIRS} SELECT count(*) AS decoys, count(*) FILTER (gt = pred) AS caught, count(*) FILTER (gt = pred) >= 0.7 * count(*) AS ok FROM pairs WHERE clip_id IN (SELECT doc_id FROM labels)")
def _(s, d):
    shown = pairs(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("clip_id")).distinct(), "clip_id", "left_semi")
    caught = F.count_if(F.col("gt") == F.col("pred"))
    return shown.agg(F.count(F.lit(1)).alias("decoys"), caught.alias("caught"), (caught >= 0.7 * F.count(F.lit(1))).alias("ok"))


@query("a28_adjudication", f"WITH {RATERS}, e AS (SELECT clip_id, label FROM raters WHERE rater = 'r3'), f AS (SELECT r.clip_id, r.label AS was, e.label AS now, row_number() OVER (PARTITION BY r.clip_id ORDER BY r.rater) AS p FROM raters r JOIN e USING (clip_id) WHERE r.rater <> 'r3' AND r.label <> e.label) SELECT was || '->' || now AS change, count(*) AS n FROM f WHERE p = 1 GROUP BY ALL ORDER BY n DESC, change LIMIT 10")
def _(s, d):
    from framescope.operators.selection import latest

    r = raters(s, d)
    expert = r.where("rater = 'r3'").select("clip_id", F.col("label").alias("now"))
    first = latest(r.where("rater <> 'r3'").join(expert, "clip_id").where("label <> now"), ["clip_id"], F.col("rater"))
    return first.groupBy(F.concat_ws("->", "label", "now").alias("change")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "change").limit(10)


@query("a29_bias_by_group_class", f"WITH {PAIRS} SELECT c AS class, count(*) FILTER (condition = 'anchored') AS anchored, count(*) FILTER (condition = 'blind') AS blind, CAST(count(*) FILTER (condition = 'anchored' AND gt = pred) AS DOUBLE) / nullif(count(*) FILTER (condition = 'anchored'), 0) AS acc_anchored, CAST(count(*) FILTER (condition = 'blind' AND gt = pred) AS DOUBLE) / nullif(count(*) FILTER (condition = 'blind'), 0) AS acc_blind FROM (SELECT *, unnest(list_distinct([gt, pred])) AS c FROM pairs) GROUP BY c")
def _(s, d):
    rows = pairs(s, d).withColumn("class", F.explode(F.array_distinct(F.array("gt", "pred"))))
    right, a, b = F.col("gt") == F.col("pred"), F.col("condition") == "anchored", F.col("condition") == "blind"
    return rows.groupBy("class").agg(F.count_if(a).alias("anchored"), F.count_if(b).alias("blind"), M.ratio(F.count_if(a & right), F.count_if(a)).alias("acc_anchored"), M.ratio(F.count_if(b & right), F.count_if(b)).alias("acc_blind"))


@query("a30_blind_findings", f"WITH {PAIRS}, c AS (SELECT gt, CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*) AS acc FROM pairs WHERE condition = 'blind' GROUP BY gt) SELECT max(acc) - min(acc) AS spread, count(*) AS classes FROM c")
def _(s, d):
    per = M.class_accuracy(pairs(s, d).where("condition = 'blind'"), ["gt"])
    return per.agg((F.max("accuracy") - F.min("accuracy")).alias("spread"), F.count(F.lit(1)).alias("classes"))


@query("a31_field_override_stats", f"WITH {PAIRS}, e AS (SELECT model, (gt <> pred)::INT + (gt_bad <> pred_bad)::INT + abs(gt_count - pred_count) AS edits FROM pairs), s AS (SELECT model, list_sort(list(edits)) AS l, max(edits) AS most, min(edits) AS least, CAST(sum(edits) AS DOUBLE) / count(*) AS mean FROM e GROUP BY model) SELECT model, l[len(l) // 2 + 1] AS median, most, least, mean FROM s")
def _(s, d):
    edits = (F.col("gt") != F.col("pred")).cast("long") + (C.is_violation(F.col("gt_unsafe")) != C.is_violation(F.col("pred_unsafe"))).cast("long") + F.abs(F.col("gt_count") - F.col("pred_count"))
    e = pairs(s, d).select("model", edits.alias("edits"))
    return M.upper_median(e, "edits", ["model"]).join(e.groupBy("model").agg(F.max("edits").alias("most"), F.min("edits").alias("least"), M.ratio(F.sum("edits"), F.count(F.lit(1))).alias("mean")), "model")


@query("a32_three_way_chain", f"WITH {RATERS}, w AS (SELECT clip_id, max(label) FILTER (rater = 'r1') AS m, max(label) FILTER (rater = 'r2') AS t, max(label) FILTER (rater = 'r3') AS e FROM raters GROUP BY clip_id) SELECT count(*) AS n, count(*) FILTER (m = t) AS model_first, count(*) FILTER (m = e) AS model_expert, count(*) FILTER (t = e) AS first_expert, count(*) FILTER (m = t AND t <> e) AS corrected, count(*) FILTER (m <> t AND m = e) AS returned FROM w")
def _(s, d):
    r = raters(s, d)
    one = lambda who, name: r.where(F.col("rater") == who).select("clip_id", F.col("label").alias(name))
    return M.three_way(one("r1", "m").join(one("r2", "t"), "clip_id").join(one("r3", "e"), "clip_id"), "m", "t", "e")


@query("a33_ece_by_provenance", f"WITH {PAIRS} " + ECE.format(keys="condition,", bin="greatest((pct + 9) // 10 - 1, 0)"))
def _(s, d):
    return M.expected_calibration_error(pairs(s, d), ["condition"], closed="right")


@query("a34_readiness_sets", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT 'either' AS part, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n UNION ALL SELECT 'both', (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) UNION ALL SELECT 'first_only', (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b))")
def _(s, d):
    o = table(s, d, "orders")
    keys = lambda st: o.where(F.col("o_orderstatus") == st).select("o_custkey").distinct()
    a, b = keys("F"), keys("O")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(a.union(b).distinct(), "either").unionByName(count(a.intersect(b), "both")).unionByName(count(a.subtract(b), "first_only"))


@query("a35_prediction_stats", f"WITH {PAIRS} SELECT model, count(*) AS n, count(*) FILTER (pred = 'F1') AS idle, CAST(count(*) FILTER (pct > 90) AS DOUBLE) / count(*) AS sure, min(pct) AS least, max(pct) AS most FROM pairs GROUP BY model")
def _(s, d):
    pct = (F.col("confidence") * 100).cast("long")
    return pairs(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == "F1").alias("idle"), M.ratio(F.count_if(pct > 90), F.count(F.lit(1))).alias("sure"), F.min(pct).alias("least"), F.max(pct).alias("most"))


@query("a36_open_vocab", f"WITH {PAIRS} SELECT pred AS closest, count(*) AS n, 1 - CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM pairs) AS coverage FROM pairs WHERE pct < 10 GROUP BY pred")
def _(s, d):
    p = pairs(s, d)
    total = p.agg(F.count(F.lit(1)).alias("total"))
    return p.where("confidence < 0.10").groupBy(F.col("pred").alias("closest")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("closest", "n", (1 - M.ratio(F.col("n"), F.col("total"))).alias("coverage"))


@query("a37_routing_summary", f"WITH {PAIRS}, r AS (SELECT CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS route FROM pairs) SELECT route, count(*) AS n, CASE WHEN route = 'high' THEN greatest(1, count(*) * 8 // 100) ELSE count(*) END AS human FROM r GROUP BY route")
def _(s, d):
    r = pairs(s, d).groupBy(C.route(F.col("confidence")).alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("human", F.when(F.col("route") == "high", F.greatest(F.lit(1), F.floor(F.col("n") * 8 / 100))).otherwise(F.col("n")))


@query("a39_pairwise_agreement", f"WITH {PAIRS}, x AS (SELECT clip_id, CASE WHEN gt = pred THEN 1.0 WHEN gt[1] = pred[1] THEN 0.5 ELSE 0.0 END::DOUBLE AS action, list_distinct(conditions) AS a, CASE WHEN pct % 3 = 0 THEN ['clear'] ELSE ['dust','glare'] END AS b FROM pairs) SELECT clip_id, action, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS tags FROM x")
def _(s, d):
    third = (F.col("confidence") * 100).cast("int") % 3 == 0
    other = F.when(third, F.array(F.lit("clear"))).otherwise(F.array(F.lit("dust"), F.lit("glare")))
    return pairs(s, d).select("clip_id", C.action_agreement(F.col("gt"), F.col("pred")).alias("action"), C.jaccard(F.col("conditions"), other).alias("tags"))


@query("a41_status_pivot", "SELECT o_custkey % 7 AS worker, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
def _(s, d):
    o = table(s, d, "orders").withColumn("worker", F.col("o_custkey") % 7)
    return o.groupBy("worker").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("a42_alerts", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS skipped FROM orders GROUP BY o_custkey HAVING count(*) >= 10 AND count(*) FILTER (o_orderstatus = 'P') * 5 > count(*)")
def _(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped"))
    return g.where((F.col("n") >= 10) & (5 * F.col("skipped") > F.col("n")))


@query("a43_rule_status_pivot", "SELECT p_brand AS rule, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def _(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("rule")).pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)


@query("a44_edit_audit", f"WITH {PAIRS} SELECT model, field, count(*) AS n FROM (SELECT model, unnest(list_filter([CASE WHEN gt <> pred THEN 'action' END, CASE WHEN gt_bad <> pred_bad THEN 'unsafe' END, CASE WHEN gt_count <> pred_count THEN 'count' END], lambda x: x IS NOT NULL)) AS field FROM pairs) GROUP BY ALL")
def _(s, d):
    v = C.is_violation
    changed = C.changed_fields([("action", F.col("gt"), F.col("pred")), ("unsafe", v(F.col("gt_unsafe")), v(F.col("pred_unsafe"))), ("count", F.col("gt_count"), F.col("pred_count"))])
    return pairs(s, d).select("model", F.explode(changed).alias("field")).groupBy("model", "field").agg(F.count(F.lit(1)).alias("n"))


@query("a45_phase_progress", "WITH a AS (SELECT c_nationkey AS w, count(*) AS assigned FROM customer GROUP BY 1), b AS (SELECT c_nationkey AS w, count(DISTINCT o_custkey) AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT w AS worker, coalesce(assigned, 0) AS assigned, coalesce(done, 0) AS done, CAST(coalesce(done, 0) AS DOUBLE) / assigned AS share FROM a FULL JOIN b USING (w)")
def _(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    a = c.groupBy(F.col("c_nationkey").alias("worker")).agg(F.count(F.lit(1)).alias("assigned"))
    b = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("worker")).agg(F.countDistinct("o_custkey").alias("done"))
    return a.join(b, "worker", "full").fillna(0).withColumn("share", M.ratio(F.col("done"), F.col("assigned")))


@query("a46_ab_field_agreement", f"WITH {PAIRS}, x AS (SELECT a.gt_count AS x, b.pred_count AS y FROM pairs a JOIN pairs b ON b.clip_id = a.clip_id + 1) SELECT count(*) AS n, count(*) FILTER (x = y) AS agree, CAST(sum(y - x) AS DOUBLE) / count(*) AS mean_delta, max(abs(y - x)) AS max_delta FROM x")
def _(s, d):
    p = pairs(s, d)
    x = p.select((F.col("clip_id") + 1).alias("clip_id"), F.col("gt_count").alias("x")).join(p.select("clip_id", F.col("pred_count").alias("y")), "clip_id")
    delta = F.col("y") - F.col("x")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(delta == 0).alias("agree"), M.ratio(F.sum(delta), F.count(F.lit(1))).alias("mean_delta"), F.max(F.abs(delta)).alias("max_delta"))


@query("a47_score_distribution", f"WITH {PAIRS} SELECT model, CAST(sum(pct) AS DOUBLE) / count(*) AS mean, CAST(sum(pct * pct) AS BIGINT) AS squares, CAST(median(pct) AS DOUBLE) AS median, min(pct) AS least, max(pct) AS most FROM pairs GROUP BY model")
def _(s, d):
    pct = (F.col("confidence") * 100).cast("long")
    return pairs(s, d).groupBy("model").agg(M.ratio(F.sum(pct), F.count(F.lit(1))).alias("mean"), F.sum(pct * pct).alias("squares"), F.median(pct).alias("median"), F.min(pct).alias("least"), F.max(pct).alias("most"))


@query("a48_class_distribution_rollup", f"WITH {PAIRS}, a AS (SELECT gt AS label, count(*) AS batch FROM pairs WHERE clip_id % 2 = 0 GROUP BY 1), b AS (SELECT gt AS label, count(*) AS existing FROM pairs WHERE clip_id % 2 = 1 GROUP BY 1), u AS (SELECT label, coalesce(batch, 0) AS batch, coalesce(existing, 0) AS existing FROM a FULL JOIN b USING (label)) SELECT label, CAST(sum(batch) AS BIGINT) AS batch, CAST(sum(existing) AS BIGINT) AS existing FROM u GROUP BY ROLLUP (label)")
def _(s, d):
    p = pairs(s, d)
    part = lambda k, n: p.where(F.col("clip_id") % 2 == k).groupBy(F.col("gt").alias("label")).agg(F.count(F.lit(1)).alias(n))
    u = part(0, "batch").join(part(1, "existing"), "label", "full").fillna(0)
    return u.rollup("label").agg(F.sum("batch").alias("batch"), F.sum("existing").alias("existing"))


@query("a49_class_floor", f"WITH {PAIRS} SELECT code, count(clip_id) AS n, count(clip_id) < 100 AS short FROM (SELECT unnest(['A1','A2','A3','A4','A5','B1','B2','B3','B4','B5','B6','B7','B8','B9','C1','C2','C3','C4','D1','D2','D3','E1','E2','F1','F2','X1']) AS code) LEFT JOIN pairs ON gt = code GROUP BY code")
def _(s, d):
    from framescope.functions.taxonomy import action_table

    counts = pairs(s, d).groupBy(F.col("gt").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return action_table(s).select("code").join(counts, "code", "left").fillna(0, ["n"]).withColumn("short", F.col("n") < 100)
