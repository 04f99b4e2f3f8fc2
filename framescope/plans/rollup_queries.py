"""Queries of readiness, model health, open vocabulary, histograms and safety reviews, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import frames, readiness, reports
from framescope.operators import replies as R
from framescope.operators import rules
from framescope.plans.projections import table
from framescope.plans.reply_queries import FLAWS, REPLIES, issues, replies
from framescope.plans.review_queries import ITEMS, RECORDS, as_set, reviews
from framescope.session import shared_dir
from framescope.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- readiness ------------------------------------------------------------------------------------------------------

_STATES = """rec AS (SELECT k, j, CASE j WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS tier, (k + j) % 5 > 0 AS ok, CASE (k + j) % 3 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'vlm' END AS source, CASE WHEN c % 4 = 0 THEN 'blind' WHEN c % 4 = 1 THEN 'anchored' END AS cond, (k + 2 * j) % 4 AS n FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c, unnest(range(0, 6)) AS j FROM orders) WHERE (k + 3 * j) % 7 < 3),
st AS (SELECT k, count(*) FILTER (tier = 1) AS first, coalesce(bool_or(tier = 1 AND cond = 'blind'), FALSE) AS blind, coalesce(bool_or(tier = 1 AND cond = 'anchored'), FALSE) AS anchored, coalesce(bool_or(tier = 2), FALSE) AS expert, coalesce(bool_or(tier = 2 AND source = 'tier_1'), FALSE) AS proper, coalesce(bool_or(tier = 2 AND source = 'vlm'), FALSE) AS model_sourced, count(*) FILTER (tier = 3) AS officer,
  arg_min(n, j) FILTER (tier = 1) AS a, arg_min(n, j) FILTER (tier = 2 AND source = 'tier_1') AS b FROM rec WHERE ok GROUP BY k)"""
_CHECKS = {
    "proper_chain": "count(*) FILTER (proper)",
    "blind_pairs": "count(*) FILTER (first >= 2 AND blind)",
    "blind_clips": "count(*) FILTER (blind)",
    "blind_with_expert": "count(*) FILTER (blind AND expert)",
    "direction_clips": "count(*) FILTER (proper AND first > 0)",
    "direction_people": "CAST(coalesce(sum(CASE WHEN proper AND first > 0 THEN CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a = 0 AND b = 0 THEN 1 ELSE 0 END ELSE 0 END), 0) AS BIGINT)",
    "officer_reviews": "CAST(coalesce(sum(officer), 0) AS BIGINT)",
    "tier_1_clips": "count(*) FILTER (first > 0)",
    "expert_clips": "count(*) FILTER (expert)",
    "either": "count(*) FILTER (first > 0 OR expert)",
    "model_sourced": "count(*) FILTER (model_sourced)",
    "anchored_clips": "count(*) FILTER (anchored)",
    "pairs": "count(*) FILTER (first >= 2)",
}
_WANTED = {k: str(readiness.WANTED.get(k, "NULL")) for k in _CHECKS}


@query("a34_readiness_report", f"WITH {_STATES}, c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {v} AS have, CAST({_WANTED[k]} AS INT) AS wanted FROM st" for k, v in _CHECKS.items()) + ') SELECT "check", have, wanted, have >= wanted AS passed FROM c')
def _(s, d):
    k, c, j = F.col("k"), F.col("c"), F.col("j")
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).where((k + 3 * j) % 7 < 3)
    records = o.select(
        k.alias("clip_id"),
        F.concat(F.lit("a"), j.cast("string")).alias("annotator_id"),
        F.when(j == 4, "tier_2").when(j == 5, "tier_3").otherwise("tier_1").alias("role"),
        F.when((k + j) % 5 > 0, "submitted").otherwise("skipped").alias("status"),
        F.when((k + j) % 3 == 0, "tier_1").when((k + j) % 3 == 1, "vlm").alias("source"),
        F.when(c % 4 == 0, "blind").when(c % 4 == 1, "anchored").alias("condition"),
        ((k + 2 * j) % 4).cast("int").alias("n_people"),
    )
    return readiness.report(records)


# --- models ---------------------------------------------------------------------------------------------------------

_ERRORS = ("JSON Parse error", "HTTP 429", "read TIMEOUT", "Blocked", "max tokens", "gone")
_KINDS = ("parse_fail", "rate_limit", "timeout", "safety_block", "token_limit", "other")


@query(
    "v09_model_health",
    f"""WITH {FLAWS}, log AS (SELECT o_orderkey AS clip_id, o_orderkey % 4 > 0 AS success, CASE WHEN o_orderkey % 28 > 0 THEN (['{"','".join(_KINDS)}'])[o_custkey % 6 + 1] ELSE 'unknown' END AS kind FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 5 > 0, 'timeout' FROM orders WHERE o_orderkey % 3 = 0),
done AS (SELECT DISTINCT clip_id FROM log WHERE success), bad AS (SELECT * FROM flaws WHERE clip_id IN (SELECT clip_id FROM done)), want AS (SELECT DISTINCT doc_id AS clip_id FROM labels)
SELECT 'records' AS kind, NULL AS value, count(*) AS n FROM log UNION ALL SELECT 'succeeded', NULL, count(*) FROM done UNION ALL SELECT 'flawed', NULL, count(DISTINCT clip_id) FROM bad UNION ALL SELECT 'clean', NULL, count(*) FROM done WHERE clip_id NOT IN (SELECT clip_id FROM bad) UNION ALL SELECT 'wanted', NULL, count(*) FROM want UNION ALL SELECT 'covered', NULL, count(*) FROM want WHERE clip_id IN (SELECT clip_id FROM done)
UNION ALL SELECT 'issue', string_split(issue, '=')[1], count(*) FROM bad GROUP BY 2 UNION ALL SELECT 'failure', kind, count(*) FROM log WHERE NOT success GROUP BY 2""",
)
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(s, d, "orders")
    error = F.when(k % 28 > 0, F.element_at(F.array(*map(F.lit, _ERRORS)), (c % 6 + 1).cast("int")))
    once = o.select(k.alias("clip_id"), (k % 4 > 0).alias("success"), error.alias("error"))
    again = o.where(k % 3 == 0).select(k.alias("clip_id"), (k % 5 > 0).alias("success"), F.lit("Timeout").alias("error"))
    truth = table(s, d, "labels").select(F.col("doc_id").alias("clip_id"))
    return reports.model_health(once.unionByName(again), truth, issues(s, d), C.failure_kind(F.col("error")))


@query("a36_unlisted", f"WITH {REPLIES}, p AS (SELECT r.k, coalesce(action = 'X1', FALSE) AS x FROM r LEFT JOIN w ON w.k = r.k), c AS (SELECT k, count(*) FILTER (x) AS n FROM p GROUP BY k) SELECT NULL AS closest, CAST(sum(n) AS BIGINT) AS people, count(*) FILTER (n > 0) AS clips, 1 - CAST(count(*) FILTER (n > 0) AS DOUBLE) / count(*) AS coverage FROM c UNION ALL SELECT 'B1', CAST(sum(n) AS BIGINT), count(*) FILTER (n > 0), NULL FROM c")
def _(s, d):
    p = R.people_of(replies(s, d), "reply", ["clip_id"], ["action_code", "action_class", "closest_existing_class", "closest_existing_label"])
    code = C.action_code(F.coalesce(F.nullif(F.col("p.action_code"), F.lit("")), F.col("p.action_class"), F.lit("")))
    people = p.select("clip_id", code.alias("code"), F.coalesce("p.closest_existing_class", "p.closest_existing_label").alias("closest"))
    return reports.unlisted_summary(people)


@query("p31_truthy", "SELECT o_orderkey, v <> '' AS agreement FROM (SELECT o_orderkey, (['none', '', 'no helmet'])[o_orderkey % 3 + 1] AS v FROM orders)")
def _(s, d):
    """The fifth vocabulary: any text names a violation."""
    v = F.element_at(F.array(*map(F.lit, ("none", "", "no helmet"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", C.is_violation(v, "agreement").alias("agreement"))


# --- histograms and reviews -----------------------------------------------------------------------------------------

_COUNTED = {"scene": "scene_type", "workers": "CAST(n AS VARCHAR)", "visibility": "visibility", "overall": "overall_ppe_compliance"}
_HIST = " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS value, count(*) AS n FROM first_scene WHERE {c} <> '' GROUP BY 2" for k, c in _COUNTED.items())
_PEOPLE = " UNION ALL ".join(f"SELECT 'ppe_{i}', {i}, count(*) FROM first_people WHERE {i} <> '' GROUP BY 2" for i in ITEMS)


@query(
    "a41_histograms",
    f"""WITH {RECORDS}, h AS ({_HIST} UNION ALL SELECT 'dominant', x, count(*) FROM (SELECT unnest({as_set("dominant_actions")}) AS x FROM first_scene) GROUP BY 2 UNION ALL SELECT 'condition', x, count(*) FROM (SELECT unnest({as_set("visibility_conditions")}) AS x FROM first_scene) GROUP BY 2
UNION ALL SELECT 'action', action_code, count(*) FROM first_people WHERE action_code <> '' GROUP BY 2 UNION ALL SELECT 'spatial', x, count(*) FROM (SELECT unnest({as_set("spatial_context")}) AS x FROM first_people) GROUP BY 2 UNION ALL SELECT 'unsafe', unsafe_act, count(*) FROM first_people WHERE lower(unsafe_act) NOT IN ('', 'none') GROUP BY 2 UNION ALL {_PEOPLE})
SELECT kind, value, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS INT) AS place FROM h QUALIFY place <= 15""",
)
def _(s, d):
    """The fifteen most frequent values of every field of the annotators' records."""
    r = F.col("first")
    said = lambda c: F.when(c != "", c)
    several = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
    of_people = lambda f: F.transform(r["persons"], f)
    single = {"scene": said(r["scene_type"]), "workers": r["num_workers"], "visibility": said(r["visibility"]), "overall": said(r["overall_ppe_compliance"])}
    many = {"dominant": r["dominant_actions"], "condition": r["visibility_conditions"], "action": several(of_people(lambda p: p["action_code"])), "spatial": F.flatten(of_people(lambda p: p["spatial_context"]))}
    many["unsafe"] = several(of_people(lambda p: F.when(C.is_violation(p["unsafe_act"], "quality_control"), p["unsafe_act"])))
    for item in ITEMS:
        many[f"ppe_{item}"] = several(r["persons"]["ppe"][item])
    counts = reports.tagged_counts(reviews(s, d).where("first is not null"), single, many, {}).where("kind <> 'all'")
    return reports.top_of_each(counts, "kind", 15)


@query(
    "a43_review_rollup",
    """WITH v AS (SELECT p_brand AS rule, CASE WHEN l_orderkey % 6 > 0 THEN l_returnflag END AS status, CASE l_partkey % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'partial' WHEN 2 THEN 'non_compliant' END AS overall, CASE WHEN l_suppkey % 3 < 2 THEN l_suppkey % 3 = 0 END AS agrees, CASE WHEN l_linenumber = 7 THEN 'blurred' END AS discard FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'rule' AS kind, rule AS value, status, count(*) AS n FROM v WHERE status IS NOT NULL GROUP BY ALL UNION ALL SELECT 'overall', overall, NULL, count(*) FROM v WHERE overall IS NOT NULL GROUP BY 2 UNION ALL SELECT 'agreement', CASE WHEN agrees THEN 'agree' ELSE 'disagree' END, NULL, count(*) FROM v WHERE agrees IS NOT NULL GROUP BY 2 UNION ALL SELECT 'discard', discard, NULL, count(*) FROM v WHERE discard IS NOT NULL GROUP BY 2""",
)
def _(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    overall = F.when(F.col("l_partkey") % 4 == 0, "compliant").when(F.col("l_partkey") % 4 == 1, "partial").when(F.col("l_partkey") % 4 == 2, "non_compliant")
    return reports.review_rollup(j.select(F.col("p_brand").alias("rule_id"), F.when(F.col("l_orderkey") % 6 > 0, F.col("l_returnflag")).alias("status"), overall.alias("overall"), F.when(F.col("l_suppkey") % 3 < 2, F.col("l_suppkey") % 3 == 0).alias("agrees"), F.when(F.col("l_linenumber") == 7, "blurred").alias("discard")))


@query(
    "p42_flagged_people",
    f"WITH {RECORDS}, u AS (SELECT k, string_agg('P' || (i + 1) || ':' || action_code || ':' || trim(unsafe_act), ',' ORDER BY i) AS flagged FROM model_people WHERE lower(trim(unsafe_act)) NOT IN ('', 'none', 'none_visible') GROUP BY k) SELECT m.k AS clip_id, coalesce(flagged, '') AS flagged, flagged IS NOT NULL AS vlm_flagged_unsafe FROM model_scene m LEFT JOIN u ON u.k = m.k",
)
def _(s, d):
    rows = reviews(s, d).where("model is not null").select("clip_id", rules.flagged_people(F.col("model.persons")).alias("x"))
    text = F.array_join(F.transform("x", lambda p: F.concat_ws(":", p["person_id"], p["action_code"], p["unsafe_act"])), ",")
    return rows.select("clip_id", text.alias("flagged"), (F.size("x") > 0).alias("vlm_flagged_unsafe"))


@query("p32_prompt", """WITH b AS (SELECT n_name AS site, string_agg('r' || r_regionkey || ': ' || r_name, chr(10) ORDER BY r_regionkey) AS block FROM nation CROSS JOIN region WHERE r_regionkey <= n_regionkey GROUP BY n_name) SELECT site, '[{"role":"system","content":"Rules of ' || site || ':\\n' || replace(block, chr(10), '\\n') || '"},{"role":"user","content":"Look at 4 frames."}]' AS messages FROM b""")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    text = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("rule_id"), F.col("r_name").alias("description"), "r_regionkey")
    site_rules = n.select(F.col("n_name").alias("site"), "n_regionkey").join(F.broadcast(text), F.col("r_regionkey") <= F.col("n_regionkey")).select("site", "rule_id")
    blocks = rules.rule_text(site_rules, text)
    return blocks.select("site", rules.messages(F.col("site"), F.col("block"), F.lit(4)).alias("messages"))


# --- files ----------------------------------------------------------------------------------------------------------


def folder(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("s01_found_files", "SELECT 'json' AS kind, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'csv', count(DISTINCT c_mktsegment) FROM customer")
def _(s, d):
    """Files of two kinds below a folder, whatever the case of their names' ends, in order; a third kind is left out."""
    path = folder(s, "found")
    table(s, d, "nation").coalesce(1).write.partitionBy("n_regionkey").json(f"{path}/a")
    table(s, d, "customer").coalesce(1).write.partitionBy("c_mktsegment").csv(f"{path}/b")
    table(s, d, "region").write.parquet(f"{path}/c")
    found = files.find_kinds(s, path, ["JSON", "csv"])
    return found.groupBy(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("k06_rewritten", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' || o_orderkey WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders")
def _(s, d):
    """A table that is rewritten in place with some values changed."""
    path = folder(s, "rewritten") + "/table"
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    o.select("o_orderkey", F.when(k % 5 > 0, F.col("o_orderstatus")).alias("status")).write.parquet(path)
    changes = o.where(k % 3 == 0).select("o_orderkey", F.concat(F.lit("new"), k.cast("string")).alias("status"))
    files.rewrite(s, path, lambda rows: files.updated(rows, changes, "o_orderkey"))
    return s.read.parquet(path).select("o_orderkey", "status")


# --- frames and phases ----------------------------------------------------------------------------------------------

_PLACES, _DEPTHS = ("left", "center", "right"), ("foreground", "background")


@query(
    "a01_clip_frames",
    f"""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 4 AS n, l_partkey AS x FROM lineitem), p AS (SELECT k, i, (x + j) % 97 AS c, (x * 3 + j) % 89 AS a, (['{"','".join(_PLACES)}'])[(x + j) % 3 + 1] AS px, (['{"','".join(_DEPTHS)}'])[(x + j) % 2 + 1] AS pd FROM (SELECT *, unnest(range(0, n)) AS j FROM f)),
g AS (SELECT k, CAST(sum(n) AS BIGINT) AS total_persons, min(n) AS min_persons, max(n) AS max_persons, ((200 * sum(n) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS avg_persons, ((20000 * count(*) FILTER (n > 0) + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS person_detection_ratio FROM f GROUP BY k),
h AS (SELECT k, ((200 * sum(c) + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS avg_confidence, max(c) / 100.0::DOUBLE AS max_confidence, ((2000 * sum(a) + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS avg_bbox_area_ratio, max(a) / 1000.0::DOUBLE AS max_bbox_area_ratio, min(a) / 1000.0::DOUBLE AS min_bbox_area_ratio FROM p GROUP BY k),
s AS (SELECT k, string_agg(w, ',' ORDER BY w) AS places FROM (SELECT k, px AS w FROM p UNION SELECT k, pd FROM p) GROUP BY k)
SELECT g.k AS l_orderkey, total_persons, min_persons, max_persons, avg_persons, person_detection_ratio, coalesce(avg_confidence, 0) AS avg_confidence, coalesce(max_confidence, 0) AS max_confidence, coalesce(avg_bbox_area_ratio, 0) AS avg_bbox_area_ratio, coalesce(max_bbox_area_ratio, 0) AS max_bbox_area_ratio, coalesce(min_bbox_area_ratio, 0) AS min_bbox_area_ratio, coalesce(places, '') AS person_positions FROM g LEFT JOIN h USING (k) LEFT JOIN s USING (k)""",
)
def _(s, d):
    x, n = F.col("l_partkey"), F.col("l_partkey") % 4
    one = lambda values, place: F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))

    def person(j):
        return F.struct(((x + j) % 97 / 100).cast("decimal(9,6)").alias("confidence"), ((x * 3 + j) % 89 / 1000).cast("decimal(9,6)").alias("bbox_area_ratio"), one(_PLACES, x + j).alias("position_x"), one(_DEPTHS, x + j).alias("position_depth"))

    people = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), person))
    rows = table(s, d, "lineitem").select("l_orderkey", n.alias("num_persons"), people.alias("persons"))
    return frames.clip_summary(rows, ["l_orderkey"])


@query("p01_gate_reasons", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 50 * 10 + 3) / 1000.0::DOUBLE AS ratio, l_suppkey % 9 / 1000.0::DOUBLE AS area, l_partkey % 70 / 100.0::DOUBLE AS sure, CAST(l_quantity AS INT) % 20 AS long_ FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|', CASE WHEN ratio < 0.4 THEN printf('low_presence:%.2f<0.4', ratio) END, CASE WHEN area < 0.005 THEN printf('small_person:%.4f<0.005', area) END, CASE WHEN sure < 0.45 THEN printf('low_confidence:%.3f<0.45', sure) END, CASE WHEN long_ < 8 THEN printf('short_clip:%.1fs<8.0s', long_::DOUBLE) END) AS reasons FROM x")
def _(s, d):
    x = table(s, d, "lineitem")
    reasons = frames.gate_reasons((F.col("l_partkey") % 50 * 10 + 3) / 1000, F.col("l_suppkey") % 9 / 1000, F.col("l_partkey") % 70 / 100, F.col("l_quantity").cast("int") % 20)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(reasons, "|").alias("reasons"))


@query(
    "a45_phase",
    """WITH phase AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM labels)), a AS (SELECT 'w' || o_custkey % 7 AS who, count(*) AS assigned FROM orders JOIN phase ON k = o_orderkey WHERE o_custkey % 7 < 6 GROUP BY 1),
b AS (SELECT 'w' || (o_custkey % 7 + o_orderkey % 2) AS who, count(*) FILTER (o_orderstatus = 'F' AND k IS NOT NULL) AS submitted, count(*) FILTER (o_orderstatus = 'O' AND k IS NOT NULL) AS flagged, count(*) FILTER (o_orderstatus = 'P' AND k IS NOT NULL) AS discarded FROM orders LEFT JOIN phase ON k = o_orderkey WHERE o_orderkey % 4 > 0 GROUP BY 1)
SELECT who AS annotator_id, coalesce(assigned, 0) AS assigned, coalesce(submitted, 0) AS submitted, coalesce(flagged, 0) AS flagged, coalesce(discarded, 0) AS discarded, round(coalesce(100.0::DOUBLE * submitted / assigned, 0), 1) AS complete FROM a FULL JOIN b USING (who)""",
)
def _(s, d):
    o, c, k = table(s, d, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("w"), n.cast("string")).alias("annotator_id")
    phase = frames.phase_clips(o.select(k.alias("clip_id")), table(s, d, "labels").select(F.col("doc_id").alias("clip_id")))
    status = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "O", "flagged").otherwise("discarded")
    records = o.where(k % 4 > 0).select(k.alias("clip_id"), name(c % 7 + k % 2), status.alias("status"))
    return frames.phase_progress(o.where(c % 7 < 6).select(k.alias("clip_id"), name(c % 7)), records, phase)
