"""Queries of text, JSON, validation, review queues and event windows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.functions.taxonomy import ACTIONS
from framescope.operators import rules
from framescope.operators import validation as V
from framescope.plans.projections import PAIRS, pairs, table
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


@query("p05_parse_name", "SELECT o_orderkey, 'site' || o_custkey % 3 AS site, 'area' || o_custkey % 5 AS area, 'cam' || o_custkey AS camera, strftime(o_orderdate, '%Y-%m-%d') AS date, lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') AS start FROM orders")
def _(s, d):
    c = F.col("o_custkey")
    name = F.concat(F.lit("site"), (c % 3).cast("string"), F.lit("-area"), (c % 5).cast("string"), F.lit("_cam"), c.cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("o_orderkey") % 240000).cast("string"), 6, "0"), F.lit(".mp4"))
    return table(s, d, "orders").select("o_orderkey", C.file_parts(name).alias("p")).select("o_orderkey", "p.*")




@query("p16_code_normalize", "SELECT o_orderkey, ([" + ",".join(f"'{w}'" for w in ["A1", "A1", "F1", "F2", "[b3", "B3", "X1", "E2", "zzz", "", "B3"]) + "])[o_orderkey % 11 + 1] AS code FROM orders")
def _(s, d):
    forms = F.array(*map(F.lit, ["A1", "walking (A1)", "idle.standing", "IDLE_SITTING", "[b3", "B3 hot work", "unlisted thing", "supervis", "zzz", "", "hot_work_welding"]))
    return table(s, d, "orders").select("o_orderkey", C.action_code(F.element_at(forms, (F.col("o_orderkey") % 11 + 1).cast("int"))).alias("code"))


def _choice(values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))


@query("p17_scene_normalize", "SELECT o_orderkey, (['SA','MAI','SAX','MAC','MAI','MAC','SEQ','MULTIACTOR'])[o_orderkey % 8 + 1] AS scene FROM orders")
def _(s, d):
    forms = (" single actor", "Multi", "SA-X", "m_a c", "multi-actor independent", "MULTI_ACTOR_COORDINATED", "sequential ", "multi actor")
    return table(s, d, "orders").select("o_orderkey", C.scene_code(_choice(forms)).alias("scene"))


@query("p18_map_normalize", "SELECT o_orderkey, CASE WHEN o_orderkey % 26 < 8 THEN 'present' WHEN o_orderkey % 26 < 16 THEN 'absent' WHEN o_orderkey % 26 < 22 THEN 'cannot_determine' WHEN o_orderkey % 26 < 24 THEN 'not_applicable' ELSE '?' END AS state FROM orders")
def _(s, d):
    forms = ("present", "YES", "true", "1", "Worn ", "visible", " detected", "wearing", "absent", "no", "false", "0", "not_worn", "missing", "not_wearing", "none", "unknown", "unsure", "unclear", "Obscured", "partially_visible", "indeterminate", "n/a", "NA", "maybe", "")
    return table(s, d, "orders").select("o_orderkey", C.protection_state(_choice(forms), "?").alias("state"))


@query("p19_confidence", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.5 WHEN v > 1 THEN least(1.0, v / 100) ELSE greatest(0.0, v) END AS confidence FROM (SELECT event_id, CAST(value AS DOUBLE) AS v FROM events)")
def _(s, d):
    raw = F.when(F.col("event_id") % 5 == 0, "high").otherwise(F.col("value").cast("string"))
    return table(s, d, "events").select("event_id", C.confidence(raw).alias("confidence"))


@query("p20_json_extract", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def _(s, d):
    k, p = F.col("event_id") % 5, F.col("props")
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\n"), p, F.lit("\n``` done"))).when(k == 3, F.concat(F.lit("It is "), p, F.lit(" I think"))).otherwise("no {json here")
    return table(s, d, "events").select("event_id", F.get_json_object(C.json_in_text(text), "$.k").try_cast("long").alias("k"))


@query("p22_default_fill", "SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS lang, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE source END AS source FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("lang"), F.coalesce(F.nullif(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")), F.lit("")), F.lit("unknown")).alias("source"))


@query("p24_overall_rollup", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 6 AS w, l_suppkey % 4 AS a, 1 AS u FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = 0 AND w > 0 THEN 'compliant' WHEN a > 0 AND 2 * a >= a + w + 1 THEN 'non_compliant' WHEN a > 0 THEN 'partial' ELSE 'cannot_determine' END AS overall FROM x")
def _(s, d):
    x = table(s, d, "lineitem")
    states = F.concat(F.array_repeat(F.lit("present"), (F.col("l_partkey") % 6).cast("int")), F.array_repeat(F.lit("absent"), (F.col("l_suppkey") % 4).cast("int")), F.array(F.lit("cannot_determine"), F.lit("not_applicable")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", C.overall_protection(states).alias("overall"))


@query("p26_layer", "SELECT o_orderkey, CASE WHEN coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 13 END, 0) <= 5 THEN 2 ELSE 1 END AS layer FROM orders")
def _(s, d):
    n = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise((F.col("o_orderkey") % 13).cast("string"))
    return table(s, d, "orders").select("o_orderkey", C.layer(n).alias("layer"))


@query("p28_distance", f"WITH {PAIRS} SELECT clip_id, CASE WHEN gt = pred THEN 0.0 WHEN gt[1] = pred[1] THEN 0.33 ELSE least(1.0, 0.5 + 0.1 * abs(strpos('ABCDEFX', gt[1]) - strpos('ABCDEFX', pred[1]))) END::DECIMAL(5,3)::DOUBLE AS distance FROM pairs")
def _(s, d):
    return pairs(s, d).select("clip_id", C.label_distance(F.col("gt"), F.col("pred")).cast("decimal(5,3)").cast("double").alias("distance"))


@query("p31_violation_vocab", "SELECT o_orderkey, v <> 'none' AS scoring, v NOT IN ('', 'none') AS quality_control, v NOT IN ('', 'none', 'none_visible') AS routing, v NOT IN ('none', 'n/a', '', 'safe') AS bias FROM (SELECT o_orderkey, (['none','','none_visible','n/a','safe','no helmet'])[o_orderkey % 6 + 1] AS v FROM orders)")
def _(s, d):
    v = F.element_at(F.array(*map(F.lit, ("None", "", " none_visible", "N/A", "safe", "no helmet"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", *(C.is_violation(v, use).alias(use) for use in ("scoring", "quality_control", "routing", "bias")))


@query("p33_sanitize", "SELECT page_id, left(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS id FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", C.safe_id(F.col("url")).alias("id"))


@query("p34_error_group", "SELECT kind, count(*) AS n FROM (SELECT 'P*: ' || (['action','ppe'])[o_orderkey % 2 + 1] AS kind FROM orders) GROUP BY kind")
def _(s, d):
    e = F.concat(F.lit("P"), (F.col("o_orderkey") % 5).cast("string"), F.lit(": "), F.element_at(F.array(F.lit("action"), F.lit("ppe")), (F.col("o_orderkey") % 2 + 1).cast("int")))
    return table(s, d, "orders").groupBy(C.error_group(e).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p35_failure_class", "SELECT (['parse_fail','rate_limit','rate_limit','timeout','safety_block','safety_block','token_limit','token_limit','other','unknown'])[o_orderkey % 10 + 1] AS kind, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    texts = ("JSON Parse error", "HTTP 429", "Throttled", "read TIMEOUT", "Safety stop", "Blocked", "max tokens", "finish: LENGTH", "JSON error")
    e = F.get(F.array(*map(F.lit, texts), F.lit(None)), (F.col("o_orderkey") % 10).cast("int"))
    return table(s, d, "orders").groupBy(C.failure_kind(e).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p36_signature", """SELECT o_orderkey, substr(md5('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'), 1, 8) AS signature FROM orders""")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.substring(F.md5(F.to_json(F.struct("o_custkey", "o_orderpriority", "o_orderstatus"))), 1, 8).alias("signature"))


@query("p38_field_diff", f"WITH {PAIRS} SELECT clip_id, array_to_string(list_filter([CASE WHEN gt <> pred THEN 'action' END, CASE WHEN gt_count <> pred_count THEN 'count' END], lambda x: x IS NOT NULL), ',') AS changed FROM pairs")
def _(s, d):
    changed = C.changed_fields([("action", F.col("gt"), F.col("pred")), ("count", F.col("gt_count"), F.col("pred_count"))])
    return pairs(s, d).select("clip_id", F.concat_ws(",", changed).alias("changed"))


@query("k10_batch_request_json", "SELECT CAST(o_orderkey AS VARCHAR) AS custom_id, 2 AS images, o_orderkey || '/frame_01.jpg' AS last FROM orders")
def _(s, d):
    r = files.batch_requests(table(s, d, "orders"), "o_orderkey", "m", 2, "look")
    return r.select("custom_id", F.size(F.from_json(F.get_json_object("request", "$.body.images"), "array<string>")).alias("images"), F.get_json_object("request", "$.body.images[1]").alias("last"))


@query("k11_batch_results", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'req' || o_orderkey ELSE 'clip' || o_orderkey END AS clip_id FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("req"), F.col("o_orderkey").cast("string")).alias("custom_id"))
    ids = o.where("o_orderkey % 3 <> 0").select("custom_id", F.concat(F.lit("clip"), F.col("o_orderkey").cast("string")).alias("clip_id"))
    return files.batch_results(o, ids).select("o_orderkey", "clip_id")


@query("s08_last_success", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' AND event_id % 11 <> 0 GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events")
    line = F.to_json(F.struct("user_id", "event_id", (F.col("event_type") != "error").alias("success")))
    lines = e.select(F.col("event_id").alias("at"), F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).unionByName(e.select(F.col("event_id").alias("at"), F.lit(" ").alias("value")))
    return files.last_success(lines, "value", "user_id long, event_id long, success boolean", "user_id", ["at"]).select("user_id", "event_id")


# --- validation -----------------------------------------------------------------------------------------------------


def records(s, d):
    """Annotation records made of orders, with every status, reviews, bonus records and each way to break a rule."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    every = lambda m: k % m == 0
    n = (k % 8).cast("int")
    n = F.when(n == 0, 1).otherwise(n)
    lay = F.when(every(10), 2).otherwise(F.when(n <= 5, 2).otherwise(1))
    bonus = (lay == 1) & every(3)
    ppe = {"helmet": F.when(every(21), "not_applicable").otherwise("worn"), "high_vis_vest": F.lit("not_worn"), "welding_protection": F.lit("not_applicable"), "harness": F.lit("cannot_determine"), "safety_shoes": F.lit("worn")}
    person = F.struct(
        F.when(every(17), "").otherwise("A1").alias("action_code"),
        F.lit("left").alias("position"),
        F.struct(*(v.alias(i) for i, v in ppe.items())).alias("ppe"),
        F.array(F.lit("elevated")).alias("spatial_context"),
        F.lit("fully_visible").alias("occlusion_level"),
        F.lit("solo").alias("group_flag"),
    )
    people = F.when(lay == 2, n - every(67).cast("int")).when(bonus, n).otherwise(every(61).cast("int"))
    text = lambda empty: F.when(empty, "").otherwise("a text")
    review = F.struct(
        F.element_at(F.array(F.lit("compliant"), F.lit("not_compliant"), F.lit("")), (k % 3 + 1).cast("int")).alias("overall_compliance"),
        F.when(every(2), "Agree").otherwise("Disagree").alias("agree_with_vlm"),
        text(every(5)).alias("disagree_reason"),
        text(every(7)).alias("safety_description"),
    )
    status = F.when(F.col("o_orderstatus") == "P", "skipped").when(every(31), "flagged").when(every(37), "discarded").when(every(41), "draft").otherwise("submitted")
    record = F.struct(
        status.alias("status"),
        F.when(every(43), "tier_3").otherwise("tier_1").alias("annotator_role"),
        F.when(every(23), "").otherwise("MAI").alias("scene_type"),
        n.alias("num_workers"),
        lay.alias("annotation_layer"),
        F.when(every(59), F.array().cast("array<string>")).otherwise(F.array(F.lit("A1"))).alias("dominant_actions"),
        F.when(every(19), "short").otherwise("a long enough text").alias("scene_description"),
        F.lit("partial").alias("overall_ppe_compliance"),
        F.when(every(29), F.array(F.lit("clear"), F.lit("fog"))).otherwise(F.array(F.lit("clear"))).alias("visibility_conditions"),
        F.struct(every(13).alias("detected"), F.when(every(26), F.array().cast("array<string>")).otherwise(F.array(F.lit("A1>A2"))).alias("transitions")).alias("action_transition"),
        F.when(every(53), F.lit(None)).when(every(47), 1.5).otherwise(0.5).alias("annotator_confidence"),
        bonus.alias("bonus_per_person"),
        F.when(every(62), "dark").otherwise("image_unclear").alias("flag_category"),
        F.when(every(93), "x").otherwise("too dark").alias("flag_reason"),
        text(every(74)).alias("discard_reason"),
        F.when(~every(86), review).alias("safety_review"),
        F.array_repeat(person, people).alias("persons"),
    )
    return o.select(k.alias("clip_id"), "o_custkey", record.alias("record"))


def checked(s, d):
    r = F.col("record")
    return records(s, d).withColumn("errors", V.record_errors(r)).withColumn("category", V.category(r, F.col("errors")))


_SCENE = {
    "scene_type is required": "k % 23 = 0",
    "annotation_layer does not match num_workers": "lay = 2 AND n > 5",
    "num_workers is out of bounds": "lay = 2 AND n > 5",
    "dominant_actions is empty": "k % 59 = 0",
    "scene_description is short": "k % 19 = 0",
    "visibility_conditions has unknown fog": "k % 29 = 0",
    "action_transition lists none": "k % 26 = 0",
    "annotator_confidence is not in 0 to 1": "k % 47 = 0 OR k % 53 = 0",
}
_BY_STATUS = {
    "status is unknown": "status = 'draft'",
    "discard_reason is required": "status = 'discarded' AND k % 74 = 0",
    "flag_category is unknown": "status = 'flagged' AND k % 62 = 0",
    "flag_reason is short": "status = 'flagged' AND k % 93 = 0",
    "safety_review is required": "officer AND k % 86 = 0",
    "overall_compliance is required": "officer AND k % 86 <> 0 AND k % 3 = 2",
    "disagree_reason is required": "officer AND k % 86 <> 0 AND k % 2 = 1 AND k % 5 = 0",
    "safety_description is required": "officer AND k % 86 <> 0 AND k % 3 = 1 AND k % 7 = 0",
    "persons do not match num_workers": "strict AND lay = 2 AND k % 67 = 0",
    "persons are listed on layer 1": "strict AND lay = 1 AND NOT bonus AND k % 61 = 0",
}
_PEOPLE = """SELECT k, '{0}' AS error, i FROM (SELECT k, unnest(range(1, people + 1)) AS i FROM q WHERE lay = 2 AND {1}) WHERE i IS NOT NULL"""
RECORDS = f"""p AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN o_orderkey % 31 = 0 THEN 'flagged' WHEN o_orderkey % 37 = 0 THEN 'discarded' WHEN o_orderkey % 41 = 0 THEN 'draft' ELSE 'submitted' END AS status,
    CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE o_orderkey % 8 END AS n FROM orders),
  r AS (SELECT *, CASE WHEN k % 10 = 0 OR n <= 5 THEN 2 ELSE 1 END AS lay, status = 'submitted' AND k % 43 = 0 AS officer, status = 'submitted' AND k % 43 <> 0 AS strict FROM p),
  b AS (SELECT *, lay = 1 AND k % 3 = 0 AS bonus FROM r),
  q AS (SELECT *, CASE WHEN lay = 2 THEN n - (k % 67 = 0)::INT WHEN bonus THEN n ELSE (k % 61 = 0)::INT END AS people FROM b),
  sm AS ({" UNION ALL ".join(f"SELECT k, '{m}' AS error, strict FROM q WHERE {w}" for m, w in _SCENE.items())}),
  pm AS ({" UNION ALL ".join(_PEOPLE.format(m, w) for m, w in (("action_code is required", "k % 17 = 0"), ("ppe.helmet is unknown", "k % 21 = 0")))}),
  m AS (SELECT k, error FROM sm WHERE strict UNION ALL SELECT k, 'P' || i || '.' || error FROM pm WHERE k IN (SELECT k FROM q WHERE strict)
    UNION ALL {" UNION ALL ".join(f"SELECT k, '{m}' FROM q WHERE {w}" for m, w in _BY_STATUS.items())}),
  t AS (SELECT k, count(*) AS errors FROM m GROUP BY k),
  c AS (SELECT q.*, coalesce(errors, 0) AS errors, CASE WHEN status <> 'submitted' THEN 'non_submitted' WHEN lay = 2 AND n > 5 AND people = n THEN 'invalid_recoverable' WHEN errors IS NULL THEN 'valid' ELSE 'invalid_requeue' END AS category FROM q LEFT JOIN t USING (k))"""


@query("v01_scene_validate", f"WITH {RECORDS} SELECT k AS clip_id, coalesce((SELECT string_agg(error, '; ' ORDER BY error) FROM sm WHERE sm.k = q.k), '') AS errors FROM q")
def _(s, d):
    return records(s, d).select("clip_id", F.array_join(F.array_sort(V.scene_errors(F.col("record"))), "; ").alias("errors"))


@query("v02_person_validate", f"WITH {RECORDS} SELECT k AS clip_id, coalesce((SELECT string_agg('P' || i || '.' || error, '; ' ORDER BY i, error) FROM pm WHERE pm.k = q.k), '') AS errors FROM q WHERE lay = 2")
def _(s, d):
    r = F.col("record")
    return records(s, d).where(r["annotation_layer"] == 2).select("clip_id", F.array_join(V.person_errors(r["persons"]), "; ").alias("errors"))


@query("v03_status_validate", f"WITH {RECORDS} SELECT k AS clip_id, status, coalesce((SELECT string_agg(error, '; ' ORDER BY error) FROM m WHERE m.k = q.k), '') AS errors FROM q WHERE status <> 'submitted' OR officer OR bonus")
def _(s, d):
    """Records with rules of their own: flagged, discarded, skipped and unknown ones, reviews and bonus records."""
    r = F.col("record")
    own = (r["status"] != "submitted") | (r["annotator_role"] == "tier_3") | r["bonus_per_person"]
    return records(s, d).where(own).select("clip_id", r["status"].alias("status"), F.array_join(F.array_sort(V.record_errors(r)), "; ").alias("errors"))


@query("v05_categorize", f"WITH {RECORDS} SELECT k AS clip_id, category, CAST(errors AS INT) AS errors FROM c")
def _(s, d):
    return checked(s, d).select("clip_id", "category", F.size("errors").alias("errors"))


@query("v06_error_histogram", f"WITH {RECORDS} SELECT regexp_replace(error, '^P[0-9]+', 'P*') AS error, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, error LIMIT 15")
def _(s, d):
    return V.error_histogram(checked(s, d), "errors")


@query("v06b_category_counts", f"WITH {RECORDS} SELECT o_custkey, count(*) FILTER (category = 'valid') AS valid, count(*) FILTER (category = 'invalid_requeue') AS invalid_requeue, count(*) FILTER (category = 'invalid_recoverable') AS invalid_recoverable, count(*) FILTER (category = 'non_submitted') AS non_submitted FROM c GROUP BY o_custkey")
def _(s, d):
    return V.category_counts(checked(s, d), "o_custkey", ["valid", "invalid_requeue", "invalid_recoverable", "non_submitted"])


@query("v07_repair", f"WITH {RECORDS} SELECT k AS clip_id, CASE WHEN category = 'invalid_recoverable' THEN 1 ELSE lay END AS layer, bonus OR category = 'invalid_recoverable' AS bonus FROM c")
def _(s, d):
    return V.repaired(records(s, d)).select("clip_id", F.col("record.annotation_layer").alias("layer"), F.col("record.bonus_per_person").alias("bonus"))


@query("v09_health", f"WITH {RECORDS} SELECT count(*) AS records, count(*) FILTER (errors = 0) AS clean, CAST(sum(errors) AS BIGINT) AS issues, (SELECT count(DISTINCT doc_id) FROM labels) AS wanted, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT o_orderkey FROM orders)) AS covered FROM c")
def _(s, d):
    rows = checked(s, d).select("clip_id", F.col("errors").alias("issues"))
    return V.health(rows, table(s, d, "labels").select(F.col("doc_id").alias("clip_id")))


@query("v10_rerun", f"WITH {RECORDS} SELECT doc_id AS clip_id FROM labels WHERE doc_id NOT IN (SELECT k FROM r) UNION SELECT k FROM m WHERE error = 'scene_type is required'")
def _(s, d):
    rows = checked(s, d).select("clip_id", F.col("errors").alias("issues"))
    return V.rerun_keys(table(s, d, "labels").select(F.col("doc_id").alias("clip_id")), rows, ["scene_type is required"])


@query("v12_count_window", "SELECT user_id, p // 20 AS \"window\", count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') > count(*) * 0.05 AS alert FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events) GROUP BY 1, 2")
def _(s, d):
    return V.count_windows(table(s, d, "events"), ["user_id"], ["event_id"], 20, F.col("event_type") == "error")


@query("p23_normalize", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id")
def _(s, d):
    """Derived fields of a nested record: sizes, sorted distinct labels, and a mirror of the first element."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("persons"))
    roles = F.transform("persons", lambda p: p["role"])
    return c.select("conv_id", F.size("persons").cast("long").alias("turns"), F.size(F.filter("persons", lambda p: p["role"] == "user")).cast("long").alias("asked"), F.array_join(F.array_sort(F.array_distinct(roles)), ",").alias("roles"), F.get("persons", F.lit(0))["role"].alias("first"))


@query("p32_rule_text", "SELECT n_name AS site, string_agg('r' || n_nationkey % 3 || ': text ' || n_nationkey % 3, chr(10)) AS block FROM nation GROUP BY n_name")
def _(s, d):
    from framescope.operators.rules import rule_text

    n = table(s, d, "nation").select(F.col("n_name").alias("site"), F.concat(F.lit("r"), (F.col("n_nationkey") % 3).cast("string")).alias("rule_id"))
    return rule_text(n, s.createDataFrame([(f"r{k}", f"text {k}") for k in range(3)], "rule_id string, description string"))


@query("p37_queue_items", "SELECT o_orderkey AS at, CAST(o_orderkey AS VARCHAR) AS clip_id FROM orders")
def _(s, d):
    """Queue items in several shapes: a plain id, an object, or an object around a list."""
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    plain, item = k.cast("string"), F.concat(F.lit('{"clip_id": "'), k.cast("string"), F.lit('"}'))
    raw = F.when(k % 3 == 0, plain).when(k % 3 == 1, item).otherwise(F.concat(F.lit('{"items": ['), item, F.lit("]}")))
    return o.select(k.alias("at"), F.explode(C.queue_items(raw)).alias("clip_id"))


@query("p41_rule_rows", "SELECT r_name AS dept, 'r' || n_nationkey AS rule_id, n_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT NULL, 'g' || r_regionkey, r_name FROM region")
def _(s, d):
    """The rule book has a region's nations as its observations; regions are the general rules."""
    region = table(s, d, "region")
    listed = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")), "n_name")))
    book = table(s, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("dept")).agg(listed.alias("observations"))
    return rules.rule_rows(book, region.select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("rule_id"), F.col("r_name").alias("description")))


@query("p42_unsafe_workers", "SELECT user_id, string_agg('P' || p, ',' ORDER BY p) AS unsafe FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type = 'error' GROUP BY user_id")
def _(s, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    bad = table(s, d, "events").select("user_id", "event_type", place.alias("p")).where("event_type = 'error'")
    listed = bad.groupBy("user_id").agg(F.array_sort(F.collect_list("p")).alias("x"))
    return listed.select("user_id", F.array_join(F.transform("x", lambda p: F.concat(F.lit("P"), p.cast("string"))), ",").alias("unsafe"))
