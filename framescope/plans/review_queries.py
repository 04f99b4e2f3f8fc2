"""Queries over nested records of a model, a first annotator and an expert, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.operators import record_diff as D
from framescope.operators import reviews as R
from framescope.operators.replies import with_once
from framescope.plans.projections import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- records played by orders ---------------------------------------------------------------------------------------
# Values as SQL that both engines read: k is the order, c its customer, i a person's place, x = k + i + the writer's
# shift for that person, y = k + the writer's shift for the scene. Lists are texts with bars.

PERSON = {
    "action_code": "CASE {x} % 6 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' WHEN 3 THEN 'F1' WHEN 4 THEN 'F1' ELSE '' END",
    "spatial_context": "CASE {x} % 4 WHEN 0 THEN 'walkway|elevated' WHEN 1 THEN 'elevated|walkway' WHEN 2 THEN 'hot_area' ELSE '' END",
    "helmet": "CASE {x} % 3 WHEN 0 THEN 'worn' WHEN 1 THEN 'not_worn' END",
    "high_vis_vest": "CASE {x} % 2 WHEN 0 THEN 'worn' ELSE 'cannot_determine' END",
    "welding_protection": "CASE WHEN {x} % 10 = 0 THEN 'worn' ELSE 'not_applicable' END",
    "harness": "CASE {x} % 5 WHEN 0 THEN 'worn' WHEN 1 THEN '' ELSE 'not_applicable' END",
    "safety_shoes": "CASE WHEN {x} % 7 = 0 THEN 'not_worn' ELSE 'worn' END",
    "occlusion_level": "CASE {x} % 4 WHEN 0 THEN 'fully_visible' WHEN 1 THEN 'partially_occluded' WHEN 2 THEN 'fully_visible' END",
    "occlusion_source": "CASE {x} % 8 WHEN 0 THEN 'smoke' ELSE '' END",
    "unsafe_act": "CASE {x} % 11 WHEN 0 THEN 'no helmet' WHEN 1 THEN 'None' WHEN 2 THEN NULL ELSE 'none' END",
    "interaction": "CASE {x} % 3 WHEN 0 THEN 'talk' ELSE '' END",
    "group_flag": "CASE {x} % 2 WHEN 0 THEN 'solo' ELSE 'coordinated' END",
}
SCENE = {
    "scene_type": "CASE {y} % 3 WHEN 0 THEN 'SA' WHEN 1 THEN 'MAI' ELSE '' END",
    "visibility": "CASE {y} % 2 WHEN 0 THEN 'clear' ELSE 'harsh' END",
    "visibility_conditions": "CASE {y} % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'dust|clear' WHEN 2 THEN 'clear|dust' ELSE '' END",
    "dominant_actions": "CASE {y} % 3 WHEN 0 THEN 'A1|B1' WHEN 1 THEN 'B1|A1' ELSE 'F1' END",
    "overall_ppe_compliance": "CASE WHEN {y} % 5 = 0 THEN 'partial' ELSE 'compliant' END",
    "scene_unsafe_act": "CASE {y} % 9 WHEN 0 THEN 'climbs' WHEN 1 THEN 'Safe' ELSE '' END",
}
ITEMS = ("helmet", "high_vis_vest", "welding_protection", "harness", "safety_shoes")
LISTS = ("spatial_context", "occlusion_source", "visibility_conditions", "dominant_actions")
#: By writer: shifts of a person and of the scene, the number of people, and whether there is no record.
WRITERS = {
    "model": ("0", "0", "c % 4", "k % 13 = 0"),
    "first": ("CASE WHEN (k + i) % 3 = 0 THEN 1 ELSE 0 END", "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END", "c % 4 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END", "k % 17 = 0"),
    "expert": ("CASE WHEN (k + 2 * i) % 4 = 0 THEN 1 WHEN (k + i) % 5 = 0 THEN 2 ELSE 0 END", "CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END", "c % 4", "k % 2 = 1"),
}
LAYER, CONDITION = "CASE WHEN c % 5 = 0 THEN 1 ELSE 2 END", "CASE c % 3 WHEN 0 THEN 'anchored' WHEN 1 THEN 'blind' END"


def _value(field: str, text: str, who: str) -> str:
    person, scene, *_ = WRITERS[who]
    return text.format(x=f"(k + i + {person})", y=f"(k + {scene})")


def reviews(s, d):
    """(clip_id, condition, model, first, expert): records of an order's clip."""

    def listed(field: str, value: str) -> str:
        return f"filter(split({value}, '[|]'), t -> t <> '')" if field in LISTS else value

    def record(who: str) -> str:
        values = {f: listed(f, _value(f, t, who)) for f, t in PERSON.items()}
        ppe = "named_struct(" + ", ".join(f"'{i}', {values[i]}" for i in ITEMS) + ")"
        person = {f: values[f] for f in ("action_code", "spatial_context")} | {"ppe": ppe} | {f: values[f] for f in ("occlusion_level", "occlusion_source", "unsafe_act", "interaction", "group_flag")}
        n = WRITERS[who][2]
        one = "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in person.items()) + ")"
        people = f"CASE WHEN {n} > 0 THEN transform(sequence(0L, {n} - 1), i -> {one}) ELSE array() END"
        scene = {f: listed(f, _value(f, t, who)) for f, t in SCENE.items()}
        fields = {"annotation_layer": LAYER, "scene_type": scene["scene_type"], "visibility": scene["visibility"], "num_workers": f"CAST({n} AS INT)"}
        fields |= {f: scene[f] for f in ("visibility_conditions", "dominant_actions", "overall_ppe_compliance", "scene_unsafe_act")} | {"persons": people}
        whole = "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in fields.items()) + ")"
        return f"CAST(CASE WHEN NOT ({WRITERS[who][3]}) THEN {whole} END AS struct<{R.RECORD}>)"

    o = spread(table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c")), "k")
    return o.select(F.col("k").alias("clip_id"), F.expr(CONDITION).alias("condition"), *(F.expr(record(who)).alias(who) for who in WRITERS))


def _sql() -> str:
    views = ["o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c FROM orders)"]
    for who, (_, _, n, gone) in WRITERS.items():
        scene = ", ".join(f"{_value(f, t, who)} AS {f}" for f, t in SCENE.items())
        views.append(f"{who}_scene AS (SELECT k, c, {LAYER} AS layer, {CONDITION} AS condition, {n} AS n, {scene} FROM o WHERE NOT ({gone}))")
        person = ", ".join(f"{_value(f, t, who)} AS {f}" for f, t in PERSON.items())
        views.append(f"{who}_people AS (SELECT k, i, layer, condition, {person} FROM (SELECT k, c, layer, condition, unnest(range(0, n)) AS i FROM {who}_scene))")
    return ",\n".join(views)


RECORDS = _sql()


def as_set(column: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({column}, '|'), lambda t: t <> '')))"


# --- anchoring: agreement by class, direction -----------------------------------------------------------------------


@query(
    "a29_anchoring_by_class",
    f"""WITH {RECORDS}, p AS (SELECT h.condition, h.action_code AS h, v.action_code AS v FROM first_people h JOIN model_people v USING (k, i) WHERE h.layer = 2 AND h.condition IS NOT NULL AND h.action_code <> '' AND v.action_code <> ''),
e AS (SELECT 'all' AS level, '' AS value, * FROM p UNION ALL SELECT 'group', unnest(list_distinct([h[1], v[1]])), * FROM p UNION ALL SELECT 'class', unnest(list_distinct([h, v])), * FROM p),
g AS (SELECT level, value, count(*) FILTER (condition = 'anchored') AS anchored, count(*) FILTER (condition = 'anchored' AND h = v) AS anchored_agreed, count(*) FILTER (condition = 'blind') AS blind, count(*) FILTER (condition = 'blind' AND h = v) AS blind_agreed, count(*) FILTER (h = value) AS given FROM e GROUP BY ALL)
SELECT level, value, anchored, anchored_agreed, blind, blind_agreed, (coalesce(anchored_agreed::DOUBLE / nullif(anchored, 0), 0) - coalesce(blind_agreed::DOUBLE / nullif(blind, 0), 0)) * 100 AS bias_points FROM g WHERE level <> 'class' OR (given > 0 AND anchored + blind >= 3)""",
)
def _(s, d):
    return R.anchoring_by_class(reviews(s, d))


DIRECTION = "count(*) AS n, count(*) FILTER (h = v AND v = e) AS productive_anchor, count(*) FILTER (h = v AND v <> e) AS harmful_anchor, count(*) FILTER (h <> v AND v <> e) AS productive_override, count(*) FILTER (h <> v AND v = e) AS harmful_override, CAST(count(*) FILTER ((h = v) = (v = e)) AS DOUBLE) / count(*) AS productive_share"
CHAIN = "SELECT h.condition, h.action_code AS h, v.action_code AS v, e.action_code AS e FROM first_people h JOIN model_people v USING (k, i) JOIN expert_people e USING (k, i) WHERE h.layer = 2 AND h.action_code <> '' AND v.action_code <> '' AND e.action_code <> ''"


@query("a29_direction", f"WITH {RECORDS}, p AS ({CHAIN}) SELECT condition, {DIRECTION} FROM p GROUP BY condition")
def _(s, d):
    return R.direction(reviews(s, d), ["condition"])


# --- blind clips ----------------------------------------------------------------------------------------------------

BLIND = """truth_people AS (SELECT * FROM expert_people WHERE condition = 'blind' UNION ALL SELECT * FROM first_people WHERE condition = 'blind' AND k NOT IN (SELECT k FROM expert_scene)),
truth_scene AS (SELECT * FROM expert_scene WHERE condition = 'blind' UNION ALL SELECT * FROM first_scene WHERE condition = 'blind' AND k NOT IN (SELECT k FROM expert_scene)),
hit AS (SELECT t.k, t.action_code AS t, v.action_code AS v FROM truth_people t JOIN model_people v USING (k, i) WHERE t.layer = 2 AND t.action_code <> '' AND v.action_code <> '')"""
BOUND = "CAST(floor(1e6 * (({k} / {n} + 3.8416 / (2 * {n})) {sign} 1.96 * sqrt((({k} / {n}) * (1 - {k} / {n}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n})) AS BIGINT)"


def bounds(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.floor(F.col(f"ci.{name}") * 1e6) for name in ("low", "high")}).drop("ci")


def bound_sql(k: str, n: str = "n") -> str:
    return f"{BOUND.format(k=k, n=n, sign='-')} AS low, {BOUND.format(k=k, n=n, sign='+')} AS high"


@query(
    "a30_blind_accuracy",
    f"""WITH {RECORDS}, {BLIND}, x AS (SELECT t AS class, t = v AS ok, v = 'F1' AS idle FROM hit UNION ALL SELECT 'all', t = v, v = 'F1' FROM hit
  UNION ALL SELECT 'all', 2 * len(list_intersect(a, b)) >= len(list_distinct(list_concat(a, b))), NULL FROM (SELECT {as_set("t.dominant_actions")} AS a, {as_set("v.dominant_actions")} AS b FROM truth_scene t JOIN model_scene v USING (k) WHERE t.layer = 1)),
g AS (SELECT class, count(*) AS n, count(*) FILTER (ok) AS hits, count(*) FILTER (NOT ok AND idle IS NOT NULL) AS wrong, count(*) FILTER (NOT ok AND idle) AS idle_wrong FROM x GROUP BY class)
SELECT class, n, hits AS "right", wrong, idle_wrong, {bound_sql("hits")} FROM g""",
)
def _(s, d):
    return bounds(R.blind_accuracy(reviews(s, d)))


@query("a30_spread", f"WITH {RECORDS}, {BLIND}, g AS (SELECT CAST(count(*) FILTER (t = v) AS DOUBLE) / count(*) AS share FROM hit GROUP BY t) SELECT max(share) - min(share) AS spread, count(*) AS classes, CAST(round(1e9 * avg(share)) AS BIGINT) AS macro FROM g")
def _(s, d):
    return R.spread(R.blind_accuracy(reviews(s, d))).withColumn("macro", F.round(1e9 * F.col("macro")).cast("long"))


@query("a30_degradation", f"WITH {RECORDS}, {BLIND} SELECT coalesce(nullif(string_split(visibility_conditions, '|')[1], ''), 'clear') AS seen, count(*) AS n, count(*) FILTER (t = v) AS \"right\" FROM hit JOIN truth_scene USING (k) GROUP BY 1")
def _(s, d):
    return R.degradation(reviews(s, d))


@query(
    "a30_clip_safety",
    f"""WITH {RECORDS}, {BLIND}, b AS (SELECT DISTINCT k FROM truth_people WHERE layer = 2 AND lower(unsafe_act) NOT IN ('none', 'n/a', '', 'safe')), m AS (SELECT DISTINCT k FROM model_people WHERE lower(unsafe_act) NOT IN ('none', 'n/a', '', 'safe')),
x AS (SELECT k IN (SELECT k FROM b) OR lower(scene_unsafe_act) NOT IN ('none', 'n/a', '', 'safe') AS bad, k IN (SELECT k FROM m) AS seen FROM truth_scene WHERE k IN (SELECT k FROM model_scene))
SELECT count(*) AS clips, count(*) FILTER (bad) AS with_violation, count(*) FILTER (bad AND seen) AS detected, count(*) FILTER (bad AND NOT seen) AS false_safe, count(*) FILTER (NOT bad AND seen) AS false_alarm, CAST(count(*) FILTER (bad AND seen) AS DOUBLE) / count(*) FILTER (bad) AS recall FROM x""",
)
def _(s, d):
    return R.clip_safety(reviews(s, d))


# --- overrides ------------------------------------------------------------------------------------------------------

_ITEM_CHANGES = "\n  ".join(f"UNION ALL SELECT 'ppe_{i}', coalesce(p.{i}, '') <> '' AND coalesce(q.{i}, '') <> '', p.{i} <> q.{i}, p.k FROM both_people" for i in ITEMS)
FIELD_CHANGES = f"""both_scene AS (SELECT a AS a, b AS b, a.k AS k FROM first_scene a JOIN model_scene b USING (k)),
pair AS (SELECT p, q, p.k AS k FROM first_people p JOIN model_people q USING (k, i) WHERE p.layer = 2),
change AS (SELECT 'scene_type' AS field, TRUE AS comparable, a.scene_type <> b.scene_type AS changed, k FROM both_scene
  UNION ALL SELECT 'num_workers', TRUE, a.n <> b.n, k FROM both_scene UNION ALL SELECT 'overall_ppe_compliance', TRUE, a.overall_ppe_compliance <> b.overall_ppe_compliance, k FROM both_scene
  UNION ALL SELECT 'visibility_conditions', TRUE, {as_set("a.visibility_conditions")} <> {as_set("b.visibility_conditions")}, k FROM both_scene
  UNION ALL SELECT 'dominant_actions', TRUE, {as_set("a.dominant_actions")} <> {as_set("b.dominant_actions")}, k FROM both_scene
  UNION ALL SELECT 'action_code', p.action_code <> '' AND q.action_code <> '', p.action_code <> q.action_code, k FROM pair
  UNION ALL SELECT 'spatial_context', p.spatial_context <> '' OR q.spatial_context <> '', {as_set("p.spatial_context")} <> {as_set("q.spatial_context")}, k FROM pair
  {_ITEM_CHANGES.replace("p.k FROM both_people", "k FROM pair")}
  UNION ALL SELECT 'occlusion_level', p.occlusion_level IS NOT NULL AND q.occlusion_level IS NOT NULL, p.occlusion_level <> q.occlusion_level, k FROM pair)"""


@query("a31_field_overrides", f"WITH {RECORDS}, {FIELD_CHANGES}, g AS (SELECT field, count(*) AS n, count(*) FILTER (changed) AS changed FROM change WHERE comparable GROUP BY field) SELECT *, {bound_sql('changed')} FROM g")
def _(s, d):
    return bounds(R.override_rates(R.field_changes(reviews(s, d))))


@query("a31_class_overrides", f"WITH {RECORDS} SELECT v.action_code AS class, count(*) AS n, count(*) FILTER (h.action_code <> v.action_code) AS changed FROM first_people h JOIN model_people v USING (k, i) WHERE h.layer = 2 AND h.action_code <> '' AND v.action_code <> '' GROUP BY 1")
def _(s, d):
    return R.class_overrides(reviews(s, d))


@query("a31_clips_with_overrides", f"WITH {RECORDS}, {FIELD_CHANGES} SELECT count(DISTINCT k) AS clips, count(DISTINCT k) FILTER (comparable AND changed) AS overridden FROM change")
def _(s, d):
    x = R.field_changes(reviews(s, d)).groupBy("clip_id").agg(F.max(F.col("comparable") & F.col("changed")).alias("any"))
    return x.agg(F.count(F.lit(1)).alias("clips"), F.count_if("any").alias("overridden"))


@query(
    "a25_layer_overrides",
    f"""WITH {RECORDS}, pair AS (SELECT p, q FROM first_people p JOIN model_people q USING (k, i) WHERE p.layer = 2 AND i = 0), named AS (SELECT k, list_sort(list_distinct(list(action_code) FILTER (action_code <> ''))) AS codes, bool_or(coalesce(lower(unsafe_act), '') NOT IN ('', 'none')) AS acts FROM model_people GROUP BY k),
both_scene AS (SELECT a, b, coalesce(codes, []) AS codes, coalesce(acts, FALSE) AS acts FROM first_scene a JOIN model_scene b USING (k) LEFT JOIN named USING (k) WHERE a.layer = 1),
x AS (SELECT 2 AS layer, 'action' AS axis, p.action_code <> q.action_code AS changed FROM pair WHERE p.action_code <> '' AND q.action_code <> ''
  UNION ALL SELECT 2, 'spatial', {as_set("p.spatial_context")} <> {as_set("q.spatial_context")} FROM pair WHERE p.spatial_context <> '' OR q.spatial_context <> ''
  UNION ALL SELECT 2, 'ppe', {" OR ".join(f"p.{i} IS DISTINCT FROM q.{i}" for i in ITEMS)} FROM pair
  UNION ALL SELECT 1, 'scene_type', a.scene_type <> b.scene_type FROM both_scene WHERE a.scene_type <> '' AND b.scene_type <> ''
  UNION ALL SELECT 1, 'dominant_actions', {as_set("a.dominant_actions")} <> codes FROM both_scene
  UNION ALL SELECT 1, 'scene_unsafe_act', (a.scene_unsafe_act <> '') <> acts FROM both_scene),
g AS (SELECT layer, axis, count(*) AS n, count(*) FILTER (changed) AS changed FROM x GROUP BY GROUPING SETS ((layer, axis), (layer), ()))
SELECT *, {bound_sql("changed")} FROM g""",
)
def _(s, d):
    return bounds(R.layer_overrides(reviews(s, d)))


# --- experts --------------------------------------------------------------------------------------------------------


@query(
    "a32_expert_chain",
    f"""WITH {RECORDS}, p AS ({CHAIN}) SELECT count(*) AS n, count(*) FILTER (h = v) AS model_first, count(*) FILTER (e = v) AS model_expert, count(*) FILTER (h = e) AS first_expert, count(*) FILTER (h = v) AS kept, count(*) FILTER (h = v AND e <> v) AS corrected, count(*) FILTER (h <> v) AS changed,
  count(*) FILTER (h <> v AND e = h) AS confirmed, count(*) FILTER (h <> v AND e = v) AS returned, count(*) FILTER (h = v AND e <> v) AS away, count(*) FILTER (h <> v AND e = v) AS towards, count(*) FILTER (h = v AND e <> v) - count(*) FILTER (h <> v AND e = v) AS net_debiasing FROM p""",
)
def _(s, d):
    return R.expert_chain(reviews(s, d))


_STATES = " UNION ALL ".join(f"SELECT '{i}' AS item, v.{i} AS m, h.{i} AS t, e.{i} AS e FROM first_people h JOIN model_people v USING (k, i) JOIN expert_people e USING (k, i) WHERE h.layer = 2" for i in R.CHAIN_ITEMS)


@query("a32_protection_chain", f"WITH {RECORDS}, x AS ({_STATES}) SELECT item, count(*) AS n, count(*) FILTER (m = t) AS model_first, count(*) FILTER (m = e) AS model_expert, count(*) FILTER (t = e) AS first_expert FROM x WHERE m <> '' AND t <> '' AND e <> '' GROUP BY ROLLUP (item)")
def _(s, d):
    return R.protection_chain(reviews(s, d))


# --- paths that changed ---------------------------------------------------------------------------------------------

SETS = ("visibility_conditions", "dominant_actions", "spatial_context", "occlusion_source")
_FLAT = ("action_code", "occlusion_level", "unsafe_act", "interaction", "group_flag")


def _joined(c: str) -> str:
    return f"array_to_string({as_set(c)}, '|')"


_SCENE_PATHS = [(f, f"a.{f}", f"b.{f}") for f in ("scene_type", "visibility", "overall_ppe_compliance", "scene_unsafe_act")]
_SCENE_PATHS += [(f, _joined(f"a.{f}"), _joined(f"b.{f}")) for f in ("visibility_conditions", "dominant_actions")]
_SCENE_PATHS += [("num_workers", "CAST(a.n AS VARCHAR)", "CAST(b.n AS VARCHAR)"), ("persons.length", "CAST(a.n AS VARCHAR)", "CAST(b.n AS VARCHAR)")]
_PERSON_PATHS = [(f, f"a.{f}", f"b.{f}") for f in _FLAT] + [(f, _joined(f"a.{f}"), _joined(f"b.{f}")) for f in ("spatial_context", "occlusion_source")]
_PERSON_PATHS += [(f"ppe.{i}", f"a.{i}", f"b.{i}") for i in ITEMS]
PATHS = (
    f"{RECORDS}, scene_path AS ("
    + " UNION ALL ".join(f"SELECT a.k, '{f}' AS path, {x} AS before, {y} AS after FROM model_scene a JOIN first_scene b USING (k)" for f, x, y in _SCENE_PATHS)
    + "), person_path AS ("
    + " UNION ALL ".join(f"SELECT a.k, 'persons[' || a.i || '].{f}' AS path, {x} AS before, {y} AS after FROM model_people a JOIN first_people b USING (k, i)" for f, x, y in _PERSON_PATHS)
    + "), path AS (SELECT * FROM scene_path WHERE before IS DISTINCT FROM after UNION ALL SELECT * FROM person_path WHERE before IS DISTINCT FROM after)"
)


def both(s, d):
    """(clip_id, before, after): records of the model and the first annotator as texts, where both are there."""
    whole = with_once(reviews(s, d), "_x", F.struct(F.to_json("model").alias("before"), F.to_json("first").alias("after")))
    return whole.select("clip_id", "_x.*").where("before is not null and after is not null")


def changes(s, d):
    return D.changed_paths(both(s, d), "before", "after", ["clip_id"], SETS)


@query("p38_changed_paths", f"WITH {PATHS} SELECT k AS clip_id, path, before, after FROM path")
def _(s, d):
    return changes(s, d)


@query("a44_change_histogram", f"WITH {PATHS}, x AS (SELECT regexp_replace(path, '\\[\\d+\\]', '') AS field, TRY_CAST(nullif(regexp_extract(path, '\\[(\\d+)\\]', 1), '') AS INT) AS place FROM path) SELECT field, place, GROUPING(place) = 1 AS all_places, count(*) AS n FROM x GROUP BY GROUPING SETS ((field, place), (field))")
def _(s, d):
    return D.change_histogram(changes(s, d))


@query("a31_edit_counts", f"WITH {PATHS}, e AS (SELECT k, count(path) AS edits FROM (SELECT a.k FROM model_scene a JOIN first_scene b USING (k)) LEFT JOIN path USING (k) GROUP BY k), l AS (SELECT list_sort(list(edits)) AS l FROM e) SELECT (SELECT l[len(l) // 2 + 1] FROM l) AS median, max(edits) AS most, min(edits) AS least, CAST(sum(edits) AS DOUBLE) / count(*) AS mean FROM e")
def _(s, d):
    from framescope.operators import metrics as M

    # A clip's row with no edit lies beside those of its changed paths, so that one aggregate counts both.
    edits = both(s, d).select("clip_id", F.lit(0).alias("n")).unionByName(changes(s, d).select("clip_id", F.lit(1).alias("n")))
    e = edits.groupBy("clip_id").agg(F.sum("n").alias("edits"))
    stats = e.agg(F.max("edits").alias("most"), F.min("edits").alias("least"), M.ratio(F.sum("edits"), F.count(F.lit(1))).alias("mean"))
    return M.upper_median(e, "edits").crossJoin(stats)  # one row each


# --- calibration of sets of labels that overlap ---------------------------------------------------------------------

LABELS = """label AS (SELECT k, j, CASE WHEN (k + j) % 3 = 0 THEN 'expert' ELSE 'annotator' END AS role, CASE (k + 2 * j) % 4 WHEN 0 THEN 'vlm' WHEN 1 THEN 'tier_1' END AS source, CASE WHEN c % 3 = 1 THEN 'blind' WHEN c % 3 = 0 THEN 'anchored' END AS condition, k % 5 = 0 AS blind_clip, (k * 7 + j * 3) % 101 AS pct, (k + j) % 4 <> 0 AS hit FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c, unnest(range(0, 4)) AS j FROM orders)),
member AS (SELECT *, 'blind' AS provenance FROM label WHERE role = 'annotator' AND ((condition = 'blind' AND source IS DISTINCT FROM 'vlm') OR (blind_clip AND source IS NULL)) UNION ALL SELECT *, 'proper_chain' FROM label WHERE role = 'expert' AND source = 'tier_1' UNION ALL SELECT *, 'gold' FROM label WHERE role = 'expert' UNION ALL SELECT *, 'model_sourced' FROM label WHERE role = 'expert' AND source = 'vlm'),
one AS (SELECT * FROM member QUALIFY row_number() OVER (PARTITION BY provenance, k ORDER BY j) = 1),
bin AS (SELECT provenance, greatest((pct + 9) // 10 - 1, 0) AS b, count(*) AS n, count(*) FILTER (hit) AS r, sum(pct) AS c FROM one GROUP BY ALL)"""


@query("a33_ece_of_sets", f"WITH {LABELS} SELECT provenance, CAST(sum(abs(c - 100 * r)) AS DOUBLE) / 100 / CAST(sum(n) AS DOUBLE) AS ece, CAST(sum(r) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy, CAST(sum(c) AS DOUBLE) / 100 / CAST(sum(n) AS DOUBLE) AS mean_confidence, CAST(sum(n) AS BIGINT) AS n FROM bin GROUP BY provenance")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    k, c, j = F.col("k"), F.col("c"), F.col("j")
    role = F.when((k + j) % 3 == 0, "expert").otherwise("annotator")
    source = F.when((k + 2 * j) % 4 == 0, "vlm").when((k + 2 * j) % 4 == 1, "tier_1")
    condition = F.when(c % 3 == 1, "blind").when(c % 3 == 0, "anchored")
    labels = o.select("k", "j", (((k * 7 + j * 3) % 101) / F.lit(100).cast("decimal(5,2)")).cast("decimal(5,2)").alias("confidence"), ((k + j) % 4 != 0).alias("hit"), R.provenance_mask(role, source, condition, k % 5 == 0).alias("mask"))
    return R.calibration_by_set(R.first_of_each(labels, "k", "j"), F.col("hit"), "confidence")
