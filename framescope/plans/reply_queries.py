"""Queries of model replies, agreement of records, two-level samples, files and small functions, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import agreement as G
from framescope.operators import replies as R
from framescope.operators import selection as S
from framescope.plans.projections import spread, table, taken
from framescope.session import shared_dir
from framescope.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CODES = ("A1", "A2", "B1", "C1", "X1")
PLACES = ("left", "center", "right")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _one_of(values, place):
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "([" + ",".join(f"'{v}'" for v in values) + "])"


# --- replies of models ------------------------------------------------------------------------------------------------


def replies(s, d):
    """(clip_id, c, reply): JSON as models send it, with other names, forms and units than asked for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = c % 8

    def person(i):
        x, text = k + i, F.lit
        action = F.when(x % 7 == 0, '"primary_action":"B1"').otherwise(F.concat(text('"Action Class":"'), _one_of(CODES, x), text('"')))
        sure = F.when(x % 3 == 0, '"high"').otherwise((x % 5 * 25).cast("string"))
        odd = text('{"helmet":"present","boots":"no","harness":"n/a","hard_hat":"no"}')
        items = F.when(x % 2 == 1, odd).when(k % 3 == 0, '{"Hard Hat":"YES","vest":"worn"}').otherwise('{"Hard Hat":"YES","vest":"missing"}')
        spatial = F.when(x % 5 == 0, '""').when(x % 5 == 1, '"walkway"').otherwise('["walkway","elevated"]')
        partner = F.when(x % 4 == 0, i.cast("string")).otherwise('["P9"]')
        unsafe = F.when(x % 6 == 0, ',"unsafe_act":"no helmet"').when(x % 6 == 1, "").otherwise(',"unsafe_act":""')
        flag = F.when(x % 3 == 1, ',"group_flag":"coordinated"').otherwise("")
        more = F.when(x % 5 == 4, ',"industry_specific":false,"Taxonomy Layer":2,"closest existing label":"B1"').otherwise("")
        return F.concat(text('{"mood":"x","position":"'), _one_of(PLACES, c + i), text('",'), action, text(',"confidence":'), sure, text(',"ppe":'), items, text(',"spatial_context":'), spatial, text(',"coordinated_with":'), partner, unsafe, flag, more, text("}"))

    people = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), person)).otherwise(F.array().cast("array<string>"))
    joined = F.concat_ws(",", people)
    whole = F.when((n == 1) & (k % 4 == 0), joined).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    scene = _one_of((" multi-actor independent", "SA", "m_a c", "Sequential"), k)
    moved = F.when(k % 5 == 0, ',"action_transition":{"detected":true,"transitions":[{"from_action":"A1"},"x"]}').when(k % 5 == 1, ',"action_transition":"none"')
    told = F.when(k % 3 == 0, ',"scene_description":"two people","group_activity":"lifting"')
    seen = F.when(k % 2 == 0, ',"visibility_conditions":"dust"').when(k % 7 == 0, ',"visibility":"harsh","visible_equipment":"crane"')
    scene_fields = [F.coalesce(c, F.lit("")) for c in (moved, told, seen)]
    total = F.when(k % 11 == 0, ',"total_workers":9').otherwise("")
    reply = F.concat(F.lit('{"scene_type":"'), scene, F.lit('"'), total, F.when(k % 2 == 0, ',"workers":').otherwise(',"persons":'), whole, *scene_fields, F.lit("}"))
    reply = F.when(k % 13 == 0, F.lit('{"scene_type": broken')).otherwise(reply)
    o = spread(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return o.select(k.alias("clip_id"), "o_custkey", reply.alias("reply"))


REPLIES = f"""r AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 8 AS n, CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE o_custkey % 8 END AS total, {_list(("MAI", "SA", "MAC", "SEQ"))}[o_orderkey % 4 + 1] AS scene FROM orders WHERE o_orderkey % 13 <> 0),
w AS (SELECT k, c, n, i, {_list(PLACES)}[(c + i) % 3 + 1] AS position, CASE WHEN (k + i) % 7 = 0 THEN 'B1' ELSE {_list(CODES)}[(k + i) % 5 + 1] END AS action,
  CASE WHEN (k + i) % 3 = 0 THEN 0.5 ELSE (k + i) % 5 * 0.25 END::DOUBLE AS sure, CASE WHEN (k + i) % 2 = 1 THEN 'absent' ELSE 'present' END AS helmet,
  CASE WHEN (k + i) % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'present' ELSE 'absent' END END AS vest, CASE (k + i) % 5 WHEN 0 THEN '' WHEN 1 THEN 'walkway' ELSE 'walkway|elevated' END AS spatial,
  CASE WHEN (k + i) % 4 = 0 THEN CAST(i AS VARCHAR) ELSE 'P9' END AS partners, CASE (k + i) % 6 WHEN 0 THEN 'no helmet' WHEN 1 THEN NULL ELSE '' END AS unsafe,
  CASE WHEN (k + i) % 3 = 1 THEN 'coordinated' END AS flag FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r))"""


def repaired(s, d):
    return R.with_once(replies(s, d), "fixed", R.repaired(F.col("reply"))).select("clip_id", "fixed")


def people(s, d, fields=None):
    """(clip_id, scene_type, total_workers, i, p) of every person, from 1; ``p`` with only ``fields``, if given."""
    return R.people_of(replies(s, d), "reply", ["clip_id"], fields).where("p is not null").withColumn("i", (F.col("place") + 1).cast("long")).drop("place")


def norms(s, d):
    """(clip_id, fixed, norm): repaired replies and their normal forms, both null where a reply can't be read."""
    return R.with_norm(repaired(s, d))


NORMS = f"""{REPLIES}, v AS (SELECT k, count(*) AS people, array_to_string(list_sort(list_distinct(list(action))), '|') AS codes, sum(sure) / count(*) AS sure, sum((helmet = 'absent')::INT + coalesce(vest = 'absent', FALSE)::INT + ((k + i) % 2)::INT) AS absent, sum((helmet = 'present')::INT + coalesce(vest = 'present', FALSE)::INT) AS worn, arg_min(action, i) AS action, coalesce(max(unsafe) FILTER (i = 1), '') AS unsafe FROM w GROUP BY k),
norm AS (SELECT r.k, n, total, CASE WHEN total = 1 THEN 'SA' ELSE scene END AS scene, CASE WHEN total <= 5 THEN 2 ELSE 1 END AS layer, total > 5 AND n > 0 AS bonus, coalesce(codes, 'X1') AS codes,
  CASE WHEN people IS NULL THEN 'cannot_determine' WHEN absent = 0 AND worn > 0 THEN 'compliant' WHEN absent > 0 AND 2 * absent >= 3 * people THEN 'non_compliant' WHEN absent > 0 THEN 'partial' ELSE 'cannot_determine' END AS overall,
  coalesce(round(v.sure, 3), 0.5) AS sure, v.sure AS raw, coalesce(action, '') AS action, coalesce(unsafe, '') AS unsafe FROM r LEFT JOIN v ON v.k = r.k)"""


@query("p21_repair", f"WITH {REPLIES} SELECT k AS clip_id, scene AS scene_type, CAST(total AS INT) AS total_workers, i, position, action, sure AS confidence, helmet, vest, spatial, partners FROM w JOIN r USING (k, c, n)")
def _(s, d):
    p = people(s, d, ("position", "action_class", "confidence", "ppe", "spatial_context", "coordinated_with"))
    item = lambda k: F.try_element_at("p.ppe", F.lit(k))
    return p.select("clip_id", "scene_type", "total_workers", "i", "p.position", F.col("p.action_class").alias("action"), "p.confidence", item("helmet").alias("helmet"), item("high_vis_vest").alias("vest"), F.concat_ws("|", "p.spatial_context").alias("spatial"), F.concat_ws("|", "p.coordinated_with").alias("partners"))


@query("p22_missing_fields", f"WITH {REPLIES} SELECT k AS clip_id, i, concat_ws(',', CASE WHEN spatial = '' THEN 'spatial_context' END, 'free_text_description', CASE WHEN flag IS NULL THEN 'group_flag' END, 'occlusion_level', CASE WHEN coalesce(unsafe, '') = '' THEN 'unsafe_act' END) AS missing, coalesce(flag, 'solo') AS group_flag, CASE WHEN spatial = '' THEN 'ground_level' ELSE spatial END AS spatial, coalesce(nullif(unsafe, ''), 'none') AS unsafe_act, 'fully_visible' AS occlusion_level FROM w")
def _(s, d):
    p = people(s, d).select("clip_id", "i", R.missing_fields(F.col("p")).alias("missing"), R.filled(F.col("p")).alias("p"))
    return p.select("clip_id", "i", F.concat_ws(",", "missing").alias("missing"), "p.group_flag", F.concat_ws("|", "p.spatial_context").alias("spatial"), "p.unsafe_act", "p.occlusion_level")


@query("p23_normal_form", f"WITH {NORMS} SELECT k AS clip_id, scene AS scene_type, CAST(total AS INT) AS num_workers, layer AS annotation_layer, bonus AS bonus_per_person, codes AS dominant, overall AS overall_ppe_compliance, sure AS annotator_confidence, action AS action_class, unsafe AS unsafe_act FROM norm")
def _(s, d):
    n = norms(s, d).where(F.col("norm").isNotNull())
    plain = ("scene_type", "num_workers", "annotation_layer", "bonus_per_person", "overall_ppe_compliance", "annotator_confidence", "action_class", "unsafe_act")
    return n.select("clip_id", *(f"norm.{f}" for f in plain), F.concat_ws("|", "norm.dominant_actions").alias("dominant"))


@query("p23_scene_fields", "SELECT o_orderkey AS clip_id, o_orderkey % 5 = 0 AS moved, CASE WHEN o_orderkey % 5 = 0 THEN '{\"from_action\":\"A1\"}|x' ELSE '' END AS transitions, CASE WHEN o_orderkey % 3 = 0 THEN 'two people' ELSE '' END AS scene_description, CASE WHEN o_orderkey % 3 = 0 THEN 'lifting' ELSE '' END AS group_activity, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 7 = 0 THEN 'harsh' ELSE 'clear' END AS visibility, CASE WHEN o_orderkey % 2 = 0 THEN 'dust' WHEN o_orderkey % 7 = 0 THEN 'harsh' ELSE 'clear' END AS conditions, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 7 = 0 THEN 'crane' ELSE '' END AS visible_equipment FROM orders WHERE o_orderkey % 13 <> 0")
def _(s, d):
    n = R.scenes_of(replies(s, d), "reply", ["clip_id"])
    moved = F.col("norm.action_transition")
    texts = ("scene_description", "group_activity", "visibility", "visible_equipment")
    return n.select("clip_id", moved["detected"].alias("moved"), F.concat_ws("|", moved["transitions"]).alias("transitions"), *(f"norm.{f}" for f in texts), F.concat_ws("|", "norm.visibility_conditions").alias("conditions"))


@query("p23_person_fields", f"WITH {REPLIES} SELECT k AS clip_id, 'P' || i AS person_id, CASE WHEN (k + i) % 5 = 4 THEN 2 ELSE 1 END AS taxonomy_layer, CASE WHEN total = 1 AND scene <> 'SA' AND i = 1 THEN 'solo' ELSE coalesce(flag, 'solo') END AS group_flag, CASE WHEN total = 1 AND scene <> 'SA' AND i = 1 THEN '' ELSE partners END AS partners, CASE WHEN action = 'X1' THEN 'B1' END AS closest, CASE WHEN action = 'X1' THEN FALSE END AS industry_specific FROM w JOIN r USING (k, c, n)")
def _(s, d):
    p = norms(s, d).select("clip_id", F.explode("norm.persons").alias("p"))
    other = F.col("p.unlisted_action")
    return p.select("clip_id", "p.person_id", "p.taxonomy_layer", "p.group_flag", F.concat_ws("|", "p.coordinated_with").alias("partners"), other["closest_existing_class"].alias("closest"), other["industry_specific"].alias("industry_specific"))


@query("p25_mean_confidence", f"WITH {NORMS} SELECT k AS clip_id, coalesce(round(raw, 3), 0.0) AS mean_confidence FROM norm")
def _(s, d):
    fixed = repaired(s, d).where(F.col("fixed").isNotNull())
    return fixed.select("clip_id", R.mean_confidence(F.col("fixed.persons"), 0.0).alias("mean_confidence"))


@query("p30_prefill", f"WITH {NORMS} SELECT o_orderkey AS clip_id, CASE WHEN scene IS NOT NULL AND o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'unknown' ELSE 'm' || o_orderkey % 4 END END AS source, CASE WHEN o_orderkey % 5 <> 0 THEN scene END AS scene FROM orders LEFT JOIN norm ON k = o_orderkey")
def _(s, d):
    k = F.col("clip_id")
    model = F.when(k % 4 != 1, F.concat(F.lit("m"), (k % 4).cast("string")))
    p = norms(s, d).select("clip_id", R.prefill(k % 5 != 0, model, F.col("norm")).alias("p"))
    return p.select("clip_id", "p.source", F.col("p.annotation.scene_type").alias("scene"))


@query("p39_compared_fields", f"WITH {NORMS} SELECT o_orderkey AS clip_id, scene AS scene_type, CAST(total AS INT) AS num_workers, layer AS annotation_layer, overall AS overall_ppe_compliance, sure AS annotator_confidence, string_split(codes, '|')[1] AS dominant_action_0, CAST(n AS INT) AS n_persons, nullif(action, '') AS primary_person_action, f.unsafe AS primary_person_unsafe FROM orders LEFT JOIN norm ON norm.k = o_orderkey LEFT JOIN (SELECT k, unsafe FROM w WHERE i = 1) f ON f.k = o_orderkey")
def _(s, d):
    return norms(s, d).select("clip_id", *R.compared_fields(F.col("norm")))


@query("p40_codes_by_layer", f"WITH {NORMS}, own AS (SELECT k, string_agg(action, '|' ORDER BY i) AS codes FROM w GROUP BY k) SELECT norm.k AS clip_id, CASE WHEN layer = 1 THEN norm.codes ELSE coalesce(own.codes, '') END AS codes FROM norm LEFT JOIN own ON own.k = norm.k")
def _(s, d):
    n = norms(s, d).where(F.col("norm").isNotNull())
    return n.select("clip_id", F.concat_ws("|", R.codes_by_layer(F.col("norm"))).alias("codes"))


@query("p43_human_person", f"WITH {REPLIES} SELECT k AS clip_id, i, action AS action_code, CASE WHEN action = 'X1' THEN 2 ELSE 1 END AS taxonomy_layer, coalesce(nullif(unsafe, ''), 'none') AS unsafe_act, CASE WHEN k % 2 = 0 THEN 'smoke' ELSE '' END AS hidden_by, coalesce(flag, 'solo') AS group_flag, CASE WHEN flag IS NULL THEN '' ELSE partners END AS partners, CASE WHEN flag IS NULL THEN '' ELSE 'lead' END AS role FROM w")
def _(s, d):
    p = F.col("p").withField("action_code", F.col("p.action_class")).withField("role_in_coordination", F.lit("lead"))
    p = p.withField("occlusion_level", F.when(F.col("clip_id") % 2 == 0, "heavily_occluded").otherwise("fully_visible")).withField("occlusion_source", F.array(F.lit("smoke")))
    h = people(s, d).select("clip_id", "i", R.human_person(p).alias("h"))
    return h.select("clip_id", "i", "h.action_code", "h.taxonomy_layer", "h.unsafe_act", F.concat_ws("|", "h.occlusion_source").alias("hidden_by"), "h.group_flag", F.concat_ws("|", "h.coordinated_with").alias("partners"), F.col("h.role_in_coordination").alias("role"))


def flawed(s, d):
    """(clip_id, norm, parsed): normal forms with planted flaws of every kind."""
    k, n = F.col("clip_id"), F.col("norm")
    x = lambda i: k + i + 1
    change = lambda p, f, cond, v: p.withField(f, F.when(cond, v).otherwise(p[f]))

    def person(p, i):
        p = change(p, "action_code", x(i) % 9 == 0, F.lit("Z1"))
        p = change(p, "confidence", x(i) % 10 == 0, F.lit(1.5))
        p = change(p, "ppe", x(i) % 8 == 0, p["ppe"].withField("helmet", F.lit("gone")))
        return p.withField("occlusion_level", F.when(x(i) % 12 == 0, F.lit("hidden")).otherwise(F.lit("fully_visible")))

    n = change(n, "scene_type", k % 19 == 0, F.lit("SA-X"))
    n = change(n, "num_workers", k % 23 == 0, F.lit(31))
    n = change(n, "annotator_confidence", k % 31 == 0, F.lit(None).cast("double"))
    n = change(n, "dominant_actions", k % 37 == 0, F.array(F.lit("A1"), F.lit("Z9")))
    n = change(n, "annotation_layer", k % 41 == 0, F.lit(3))
    n = change(n, "overall_ppe_compliance", k % 43 == 0, F.lit(""))
    n = n.withField("visibility_conditions", F.when(k % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("clear"))))
    n = n.withField("persons", F.transform("norm.persons", person))
    whole = R.with_once(norms(s, d), "flawed", F.when(F.col("norm").isNotNull(), n))
    return whole.select("clip_id", F.col("flawed").alias("norm"), F.when(k % 47 != 0, F.col("fixed")).alias("parsed"))


_FLAWS = {
    "no_parsed_output": "k % 47 = 0",
    "invalid_scene_type=SA-X": "k % 19 = 0",
    "num_workers=0": "total = 0 AND k % 23 <> 0",
    "num_workers_out_of_range=31": "k % 23 = 0",
    "invalid_layer=3": "k % 41 = 0",
    "invalid_dominant_action=Z9": "k % 37 = 0",
    "missing_visibility_conditions": "k % 17 = 0",
    "missing_overall_ppe_compliance": "k % 43 = 0",
    "missing_annotator_confidence": "k % 31 = 0",
    "layer2_but_no_persons": "layer = 2 AND k % 41 <> 0 AND n = 0",
}
_PERSON_FLAWS = {
    "invalid_action=Z1": "(k + i) % 9 = 0",
    "confidence_out_of_range=1.5": "(k + i) % 10 = 0",
    "invalid_ppe_helmet=gone": "(k + i) % 8 = 0",
    "missing_spatial_context": "spatial = ''",
    "invalid_occlusion=hidden": "(k + i) % 12 = 0",
    "missing_unsafe_act_field": "unsafe IS NULL",
}
FLAWS = (
    f"{NORMS}, flaws AS (SELECT o_orderkey AS clip_id, 'no_normalized_output' AS issue FROM orders WHERE o_orderkey % 13 = 0"
    + "".join(f" UNION ALL SELECT k, '{t}' FROM norm WHERE {c}" for t, c in _FLAWS.items())
    + "".join(f" UNION ALL SELECT k, 'p[' || (i - 1) || ']_{t}' FROM w WHERE {c}" for t, c in _PERSON_FLAWS.items())
    + ")"
)


def issues(s, d):
    return flawed(s, d).select("clip_id", F.explode(R.prediction_issues(F.col("norm"), F.col("parsed"))).alias("issue"))


@query("v08_prediction_issues", f"WITH {FLAWS} SELECT clip_id, issue FROM flaws")
def _(s, d):
    return issues(s, d)


@query("v09_issue_histogram", f"WITH {FLAWS} SELECT string_split(issue, '=')[1] AS kind, count(*) AS n FROM flaws GROUP BY 1")
def _(s, d):
    return issues(s, d).groupBy(R.issue_kind(F.col("issue")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("v09_people_stats", f"WITH {NORMS} SELECT (SELECT count(*) FROM norm) AS records, (SELECT CAST(sum(total) AS DOUBLE) / count(*) FROM norm) AS mean_people, avg(sure) AS mean_confidence, min(sure) AS least, max(sure) AS most FROM w")
def _(s, d):
    p = R.people_of(replies(s, d), "reply", ["clip_id"], ["confidence"])
    first, sure = F.coalesce(F.col("place"), F.lit(0)) == 0, F.col("p.confidence")
    records = F.count_if(first)
    return p.agg(records.alias("records"), (F.sum(F.when(first, F.col("total_workers"))) / records).alias("mean_people"), F.avg(sure).alias("mean_confidence"), F.min(sure).alias("least"), F.max(sure).alias("most"))


# --- agreement of records ---------------------------------------------------------------------------------------------


def two_records(s, d):
    """(clip_id, a, b): two records of each order's clip, with up to seven people."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def person(x, i):
        items = F.struct(_one_of(("worn", "not_worn", ""), x + i).alias("helmet"), F.lit(None).cast("string").alias("high_vis_vest"), F.lit("").alias("welding_protection"), F.lit(None).cast("string").alias("harness"), F.when((x + i) % 4 > 0, " WORN").otherwise("worn").alias("safety_shoes"))
        tags = F.when((x + i) % 4 == 0, F.array().cast("array<string>")).when((x + i) % 4 == 1, F.array(F.lit("walkway"))).otherwise(F.array(F.lit("walkway"), F.lit("elevated")))
        partners = F.when((x + i) % 2 == 0, F.array(F.lit("P1")))
        return F.struct(_one_of(CODES, x + 2 * i).alias("action_code"), _one_of(PLACES, x + i).alias("position"), tags.alias("spatial_context"), items.alias("ppe"), _one_of(("talk", "", "TALK "), x + i).alias("interaction"), F.when((x + i) % 6 == 0, "no helmet").otherwise("").alias("unsafe_act"), partners.alias("coordinated_with"))

    def record(x, n, scene):
        listed = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: person(x, i)))
        return F.struct(scene.alias("scene_type"), listed.alias("persons"), person(x, F.lit(0).cast("long")).alias("person"))

    a = record(k, c % 8, _one_of(("SA", "MAI", "MAC-X", ""), k))
    b = record(k + c % 3, (c + k % 3) % 8, _one_of(("sa", "MAI-X", "MAC"), k))
    return table(s, d, "orders").select(k.alias("clip_id"), a.alias("a"), b.alias("b"))


def _people_sql(x: str, n: str) -> str:
    one = f"""lambda i: {{'ac': {_list(CODES)}[(({x}) + 2 * i) % 5 + 1], 'pos': (({x}) + i) % 3, 'tags': least((({x}) + i) % 4, 2), 'helmet': (({x}) + i) % 3, 'talk': (({x}) + i) % 3 <> 1, 'bad': (({x}) + i) % 6 = 0, 'met': (({x}) + i) % 2 = 0}}"""
    return f"list_transform(CASE WHEN {n} = 0 THEN [0::BIGINT] ELSE range(1, {n} + 1) END, {one})"


_ACTION = "CASE WHEN {x}.ac = {y}.ac THEN 1.0 WHEN {x}.ac[1] = {y}.ac[1] THEN 0.5 ELSE 0.0 END"
_MEAN = "coalesce(max(CASE WHEN n > 0 THEN ((2 * t_{0} + n) // (2 * n)) / 10000.0 END), 0.0)::DOUBLE AS {0}"
_SCENE_SCORE = "(CASE WHEN k % 4 = 3 THEN 0.0 WHEN upper(sa) = upper(sb) THEN 1.0 WHEN string_split(upper(sa), '-')[1] = string_split(upper(sb), '-')[1] THEN 0.5 ELSE 0.0 END)::DOUBLE"
_SCORES = {
    "action": _ACTION.format(x="x", y="y"),
    "spatial": "CASE WHEN x.tags = y.tags THEN 1.0 WHEN x.tags = 0 OR y.tags = 0 THEN 0.0 ELSE 0.5 END",
    "protection": "CASE WHEN x.helmet = 2 OR y.helmet = 2 THEN 1.0 WHEN x.helmet = y.helmet THEN 1.0 ELSE 0.5 END",
    "interaction": "CASE WHEN x.talk AND y.talk THEN 1.0 ELSE 0.0 END",
    "safety": "CASE WHEN x.bad = y.bad THEN 1.0 ELSE 0.0 END",
    "coordination": "CASE WHEN x.met = y.met THEN 1.0 ELSE 0.0 END",
}
AGREEMENT = f"""RECURSIVE q AS (SELECT o_orderkey AS k, na, nb, na > 5 OR nb > 5 AS big, {_list(("SA", "MAI", "MAC-X", ""))}[o_orderkey % 4 + 1] AS sa, {_list(("sa", "MAI-X", "MAC"))}[o_orderkey % 3 + 1] AS sb, {_people_sql("o_orderkey", "na")} AS pa, {_people_sql("o_orderkey + o_custkey % 3", "nb")} AS pb FROM (SELECT *, o_custkey % 8 AS na, (o_custkey + o_orderkey % 3) % 8 AS nb FROM orders)),
m AS (SELECT k, 0 AS i, []::BIGINT[] AS used FROM q WHERE NOT big UNION ALL SELECT m.k, i + 1, list_append(used, coalesce(list_sort(list_filter(list_transform(range(1, len(pb) + 1), lambda j: {{'s': -(6 * (pa[i + 1].pos = pb[j].pos)::INT + 14 * ({_ACTION.format(x="pa[i + 1]", y="pb[j]")})), 'j': j}}), lambda z: NOT list_contains(used, z.j)))[1].j, -1)) FROM m JOIN q USING (k) WHERE i < len(pa)),
e AS (SELECT k, unnest(range(1, len(used) + 1)) AS i, used FROM m JOIN q USING (k) WHERE i = len(pa)),
f AS (SELECT e.k, pa[i] AS x, pb[used[i]] AS y FROM e JOIN q USING (k) WHERE used[i] > 0),
g AS (SELECT k, {", ".join(f"{v} AS {n}" for n, v in _SCORES.items())} FROM f),
h AS (SELECT k, count(*) AS n, {", ".join(f"CAST(sum({n} * 10000) AS BIGINT) AS t_{n}" for n in _SCORES)}, CAST(sum(6700 * action + 3300 * protection) AS BIGINT) AS t_composite FROM g GROUP BY k)"""


@query(
    "a38_clip_agreement",
    f"WITH {AGREEMENT} SELECT k AS clip_id, {', '.join(_MEAN.format(n) for n in _SCORES)}, max(CASE WHEN big THEN {_SCENE_SCORE} ELSE coalesce(((2 * t_composite + n) // (2 * n)) / 10000.0, 0.0) END)::DOUBLE AS composite, max({_SCENE_SCORE}) AS scene_type, max(round(CASE WHEN greatest(ca, cb) > 0 THEN 1 - CAST(abs(ca - cb) AS DOUBLE) / greatest(ca, cb) ELSE 1.0 END, 4)) AS people, CAST(coalesce(max(n), 0) AS INT) AS matched, CAST(max(CASE WHEN big THEN 1 ELSE 2 END) AS INT) AS layer FROM (SELECT *, CASE WHEN big THEN na ELSE greatest(na, 1) END AS ca, CASE WHEN big THEN nb ELSE greatest(nb, 1) END AS cb FROM q) q LEFT JOIN h USING (k) GROUP BY k",
)
def _(s, d):
    return G.clip_agreement(two_records(s, d), "a", "b").drop("a", "b")


@query("a40_crowded_agreement", """WITH p AS (SELECT list_filter([CASE WHEN o_orderkey % 5 > 0 THEN 'A1' END, CASE WHEN o_orderkey % 5 > 2 THEN 'B1' END], lambda x: x IS NOT NULL) AS x, list_filter([CASE WHEN o_custkey % 4 > 0 THEN 'A1' END, CASE WHEN o_custkey % 4 > 2 THEN 'B1' END], lambda x: x IS NOT NULL) AS y, (['compliant','partial',''])[o_orderkey % 3 + 1] AS pa, (['compliant',''])[o_custkey % 2 + 1] AS pb, (['SA','MAI',''])[o_orderkey % 3 + 1] AS sa, (['SA','MAI'])[o_custkey % 2 + 1] AS sb FROM orders),
m AS (SELECT 'dominant_actions' AS metric, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END AS v, 0.70 AS target FROM p WHERE len(x) > 0 OR len(y) > 0 UNION ALL SELECT 'overall_protection', CASE WHEN pa = pb THEN 1.0 ELSE 0.0 END, 0.80 FROM p WHERE pa <> '' OR pb <> '' UNION ALL SELECT 'scene_type', CASE WHEN sa = sb THEN 1.0 ELSE 0.0 END, 0.85 FROM p WHERE sa <> '' AND sb <> '')
SELECT metric, round(avg(v), 3) AS score, count(*) AS n, CAST(target AS DOUBLE) AS target, avg(v) >= target AS reached FROM m GROUP BY metric, target""")
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    codes = lambda x, m: F.array_compact(F.array(F.when(x % m > 0, "A1"), F.when(x % m > 2, "B1")))
    side = lambda acts, ppe, scene: F.struct(acts.alias("dominant_actions"), ppe.alias("overall_protection"), scene.alias("scene_type"))
    a = side(codes(k, 5), _one_of(("compliant", "partial", ""), k), _one_of(("SA", "MAI", ""), k))
    b = side(codes(c, 4), _one_of(("compliant", ""), c), _one_of(("SA", "MAI"), c))
    return G.crowded_agreement(table(s, d, "orders").select(a.alias("a"), b.alias("b")), "a", "b")


# --- samples ----------------------------------------------------------------------------------------------------------


_O = "SELECT *, md5('42|' || o_orderkey) AS h FROM orders"


def _two_level_sql(target: int, least: int) -> str:
    return f"""WITH o AS ({_O}), z AS (SELECT *, least(greatest({least}, {target} // (SELECT count(DISTINCT o_orderstatus) FROM o)), count(*) OVER (PARTITION BY o_orderstatus)) AS goal FROM o),
t AS {taken("z", "o_orderpriority", "goal", "o_orderstatus")}, p AS (SELECT o_orderkey, h FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY h, o_orderkey) AS place FROM z) JOIN t USING (o_orderstatus, o_orderpriority) WHERE place <= take),
y AS (SELECT *, {target} - (SELECT count(*) FROM p) AS more FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)), u AS {taken("y", "o_orderpriority", "greatest(more, 0)")},
e AS (SELECT o_orderkey, h FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS place FROM y) JOIN u USING (o_orderpriority) WHERE place <= take)
SELECT o_orderkey FROM (SELECT * FROM p UNION ALL SELECT * FROM e WHERE (SELECT count(*) FROM p) < {target}) ORDER BY h, o_orderkey LIMIT {target}"""


@query("m02_two_level_trimmed", _two_level_sql(500, 200))
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return S.two_level(o, "o_orderkey", "o_orderstatus", "o_orderpriority", 500, S.hash_order(42, "o_orderkey"), 200).select("o_orderkey")


@query("m02_two_level_filled", _two_level_sql(3000, 100))
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return S.two_level(o, "o_orderkey", "o_orderstatus", "o_orderpriority", 3000, S.hash_order(42, "o_orderkey"), 100).select("o_orderkey")


@query("m04_tier_split", f"""WITH o AS ({_O}), c AS (SELECT least(400, count(*) FILTER (o_orderstatus = 'P')) AS b FROM o), x AS (SELECT *, 1000 - (SELECT b FROM c) AS goal FROM o WHERE o_orderstatus <> 'P'), y AS (SELECT *, (SELECT b FROM c) AS goal FROM o WHERE o_orderstatus = 'P'),
t AS {taken("x", "o_orderpriority", "goal")}, u AS {taken("y", "o_orderpriority", "goal")}
SELECT o_orderkey, 'A' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS place FROM x) JOIN t USING (o_orderpriority) WHERE place <= take UNION ALL SELECT o_orderkey, 'B' FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS place FROM y) JOIN u USING (o_orderpriority) WHERE place <= take""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    second = F.col("o_orderstatus") == "P"
    return S.tier_split(o.where(~second), o.where(second), "o_orderpriority", 1000, 0.4, S.hash_order(42, "o_orderkey")).select("o_orderkey", "tier")


# --- small functions --------------------------------------------------------------------------------------------------


@query("p04_source_kind", "SELECT o_orderkey, (['A','B','A','A'])[o_orderkey % 4 + 1] AS kind FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    n = k.cast("string")
    folder = F.when(k % 4 == 0, F.concat(F.lit("cam@10.0.0.1_"), n)).when(k % 4 == 1, F.concat(F.lit("x_10.0.0.1_"), n)).when(k % 4 == 2, F.concat(F.lit("x_10.0.1_"), n)).otherwise(n)
    return table(s, d, "orders").select("o_orderkey", C.source_kind(folder).alias("kind"))


@query("p06_names", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'MACHINERY' THEN 'shop' ELSE c_mktsegment END AS name FROM customer")
def _(s, d):
    spelled = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("  "))
    return table(s, d, "customer").select("c_custkey", C.canonical(spelled, {"BUILDING": "works", "MACHINERY": "shop"}).alias("name"))


@query("p09_luma_light", "SELECT o_orderkey, round(y, 3) AS luma, CASE WHEN y < 60 THEN 'low_light' ELSE 'normal' END AS light FROM (SELECT o_orderkey, (114 * (o_orderkey % 256) + 587 * (o_custkey % 256) + 299 * ((o_orderkey + o_custkey) % 256)) / 1000.0 AS y FROM orders)")
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    y = F.round(C.luma(k % 256, c % 256, (k + c) % 256), 3)
    return table(s, d, "orders").select("o_orderkey", y.alias("luma"), C.low_light(y).alias("light"))


@query("p11_crowd", "SELECT o_orderkey, CASE WHEN o_custkey % 13 <= 3 THEN 'low' WHEN o_custkey % 13 <= 8 THEN 'medium' ELSE 'high' END AS crowd FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", C.crowd(F.col("o_custkey") % 13 / 2).alias("crowd"))


@query("p12_wanted_files", "SELECT path FROM (SELECT 'in/cam' || (CASE WHEN o_orderkey % 3 = 0 THEN '_main_' ELSE '_side_' END) || o_orderkey || '.mp4' AS path, CAST(o_totalprice * 1000 AS BIGINT) AS length FROM orders) WHERE contains(path, '_main_') AND length >= 20 * 1048576 AND length <= 200 * 1048576 ORDER BY path LIMIT 100")
def _(s, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("in/cam"), F.when(k % 3 == 0, "_main_").otherwise("_side_"), k.cast("string"), F.lit(".mp4"))
    found = table(s, d, "orders").select(name.alias("path"), (F.col("o_totalprice") * 1000).cast("long").alias("length"))
    return files.wanted_files(found, 20, 200, True, 100).select("path")


@query("p15_padded_box", "SELECT o_orderkey, greatest(x0 - w // 5, 0) AS x0, greatest(y0 - h // 5, 0) AS y0, least(x0 + w + w // 5, 640) AS x1, least(y0 + h + h // 5, 480) AS y1 FROM (SELECT o_orderkey, o_orderkey % 500 AS x0, o_custkey % 400 AS y0, 10 * (o_orderkey % 17 + 1) AS w, 10 * (o_custkey % 13 + 1) AS h FROM orders)")
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y, w, h = k % 500, c % 400, 10 * (k % 17 + 1), 10 * (c % 13 + 1)
    return table(s, d, "orders").select("o_orderkey", C.padded_box(x, y, x + w, y + h, F.lit(640).cast("long"), F.lit(480).cast("long")).alias("b")).select("o_orderkey", "b.*")


@query("p27_condition", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN CASE WHEN o_custkey % 20 = 0 THEN 'anchored' ELSE 'blind' END END AS condition FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def _(s, d):
    cust = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    split = cust.where(F.col("o_custkey") % 10 == 0).withColumn("condition", F.when(F.col("o_custkey") % 20 == 0, "anchored").otherwise("blind"))
    return table(s, d, "orders").join(cust, "o_custkey", "left_semi").join(split, "o_custkey", "left").select("o_orderkey", "condition")


@query("j16_flag_resolved", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1 AND o_orderstatus = 'F') THEN 'yes' ELSE 'pending' END AS resolved FROM orders WHERE o_orderkey % 31 = 0")
def _(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    expert = o.where((k % 3 == 1) & (F.col("o_orderstatus") == "F")).select("o_custkey").distinct().withColumn("_done", F.lit(True))
    flagged = o.where(k % 31 == 0).join(expert, "o_custkey", "left")
    return flagged.select("o_orderkey", F.when(F.col("_done"), "yes").otherwise("pending").alias("resolved"))


# --- files: written, then read back -----------------------------------------------------------------------------------


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s05_manifest_numbers", "SELECT p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size FROM part")
def _(s, d):
    path = _folder(s, "manifest")
    size = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    files.append_manifest(table(s, d, "part").select("p_name", size.alias("size")), path)
    missing = files.read_manifest(s, f"{path}-none", ["size"], ["p_name", "size"])  # a second tier without a file
    return files.read_manifest(s, path, ["size"]).unionByName(missing)


@query("s07_last_row", "SELECT CAST(o_custkey AS VARCHAR) AS clip_id, CAST(max(o_orderkey) AS VARCHAR) AS line FROM orders GROUP BY o_custkey")
def _(s, d):
    path = _folder(s, "index")
    files.append_manifest(table(s, d, "orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("line")), path)
    rows = files.read_manifest(s, path)
    return S.latest(rows, ["clip_id"], F.col("line").cast("long").desc())


@query("s14_id_lists", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + i FROM customer, (VALUES (0), (5)) t(i) WHERE c_custkey % 4 = 0)")
def _(s, d):
    path = _folder(s, "lists")
    c = F.col("c_custkey")
    lists = F.when(c % 4 == 0, F.to_json(F.array(c, c + 5))).when(c % 4 == 1, "[null]").otherwise("[")
    table(s, d, "customer").select(lists.alias("value")).write.text(path)
    ids = files.id_list(s.read.text(path), "value", "o_custkey").select(F.col("o_custkey").cast("long"))
    return table(s, d, "orders").join(ids, "o_custkey", "left_anti").select("o_orderkey")


@query("k01_append_manifest", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def _(s, d):
    path = _folder(s, "append")
    x = table(s, d, "supplier").select("s_suppkey", "s_name")
    for part in range(2):
        files.append_manifest(x.where(F.col("s_suppkey") % 2 == part), path)
    return files.read_manifest(s, path)


@query("k02_tier_files", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size > 25 THEN 'A' ELSE 'B' END AS tier, p_brand || ',' || p_type AS tags FROM part")
def _(s, d):
    path = _folder(s, "tiers")
    x = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, "A").otherwise("B").alias("tier"), F.array("p_brand", "p_type").alias("tags"), F.lit(1).alias("_own"))
    files.write_tiers(x, path)
    return files.read_manifest(s, path)


@query("k03_sheets", "SELECT s_nationkey % 5 AS annotator, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids FROM supplier GROUP BY 1")
def _(s, d):
    path = _folder(s, "sheets")
    x = table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("annotator"))
    files.write_sheets(x, path, "annotator")
    sheets = files.read_manifest(s, path, ["s_suppkey"])
    return sheets.groupBy(F.col("annotator").cast("int").alias("annotator")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").cast("long").alias("ids"))


@query("k04_reports", "SELECT o_orderstatus AS status, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY 1")
def _(s, d):
    path = _folder(s, "reports")
    o = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").cast("long").alias("last"))
    files.write_json_lines(o, path, "overwrite")
    return s.read.schema("status string, n bigint, last bigint").json(path)


@query("s09_strict_lines", "SELECT o_custkey AS clip_id, max(o_orderkey) AS line FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def _(s, d):
    """JSON lines appended in two runs and read strictly: the last successful record of each key."""
    path = _folder(s, "lines")
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("clip_id"), k.alias("line"), (k % 3 != 0).alias("success"))
    for half in range(2):
        files.write_json_lines(rows.where(k % 2 == half), path)
    lines = s.read.text(path).withColumn("_at", F.get_json_object("value", "$.line").cast("long"))
    return files.last_success(lines, "value", "clip_id bigint, line bigint, success boolean", "clip_id", ["_at"], strict=True).select("clip_id", "line")


@query("k08_quarantine", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'valid' ELSE 'quarantine' END AS place FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    verdict = F.when(k % 4 == 0, F.lit(None).cast("boolean")).otherwise(k % 4 < 3)
    good, bad = files.write_split(table(s, d, "orders").select("o_orderkey"), verdict, _folder(s, "split"))
    return s.read.parquet(good).withColumn("place", F.lit("valid")).unionByName(s.read.parquet(bad).withColumn("place", F.lit("quarantine")))


@query("k15_image_addresses", "SELECT s_suppkey, 'data:image/jpeg;base64,' || base64(encode(s_name)) AS inline, 'https://images.example/frames/' || replace(s_name, '#', '%23') || '/frame_' || lpad(CAST(s_suppkey % 8 AS VARCHAR), 2, '0') || '.jpg' AS address FROM supplier")
def _(s, d):
    frame = F.concat(F.lit("frame_"), F.lpad((F.col("s_suppkey") % 8).cast("string"), 2, "0"), F.lit(".jpg"))
    return table(s, d, "supplier").select("s_suppkey", files.data_url(F.encode("s_name", "utf-8")).alias("inline"), files.object_url("https://images.example/frames", F.col("s_name"), frame).alias("address"))
