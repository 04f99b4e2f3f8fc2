"""Queries of assignment by role, verification samples, alerts, names, requests and folders, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import assignment as A
from framescope.operators import reports
from framescope.operators import selection as S
from framescope.operators import validation as V
from framescope.plans.label_queries import RECORDS, records
from framescope.plans.projections import PAIRS, pairs, table
from framescope.plans.review_queries import RECORDS as REVIEWS
from framescope.plans.review_queries import reviews
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


def folder(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# --- assignment -----------------------------------------------------------------------------------------------------

ANNOTATORS, EXPERTS, OFFICERS = ["w0", "w1", "w2", "w3", "w4"], ["e0", "e1"], ["s0", "s1"]


def routed(s, d):
    k = F.col("clip_id")
    p = pairs(s, d)
    return p.select("clip_id", C.route(F.col("confidence")).alias("route"), F.when(k % 23 > 0, F.concat(F.lit("site"), (k % 9).cast("string"))).alias("site"), (k % 7 == 0).alias("unsafe"), (k % 29 == 0).alias("critical"))


ROUTED = f"{PAIRS}, routed AS (SELECT clip_id, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS route, CASE WHEN clip_id % 23 > 0 THEN 'site' || clip_id % 9 ELSE 'unknown' END AS site, clip_id % 7 = 0 AS unsafe, clip_id % 29 = 0 AS critical FROM pairs)"
_TASK = "CASE route WHEN 'high' THEN 'verify_consensus' WHEN 'medium' THEN 'review_prefill' ELSE 'fresh_annotation' END"


def _order(seed: int) -> str:
    return f"md5('{seed}|' || clip_id), clip_id"


TIERS = f"""one AS (SELECT *, row_number() OVER (ORDER BY {_order(8)}) - 1 AS p, CAST('0x' || substr(md5('9|' || clip_id), 1, 13) AS BIGINT) % 1000000 < 150000 AS again FROM routed),
pool AS (SELECT *, row_number() OVER (ORDER BY {_order(11)}) - 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY {_order(10)}) AS place, count(*) OVER (PARTITION BY route) AS n FROM routed) WHERE place <= CASE route WHEN 'high' THEN greatest(20, floor(n * 0.25)) ELSE greatest(10, floor(n * 0.15)) END),
acts AS (SELECT clip_id FROM (SELECT clip_id, row_number() OVER (PARTITION BY site ORDER BY {_order(12)}) AS place, count(*) OVER (PARTITION BY site) AS n FROM routed WHERE unsafe) WHERE place <= greatest(2, floor(n * 0.1)))
SELECT 'w' || p % 5 AS worker, 'tier_1' AS role, clip_id, {_TASK} AS task, FALSE AS double, critical FROM one UNION ALL SELECT 'w' || (p + 1) % 5, 'tier_1', clip_id, {_TASK}, TRUE, critical FROM one WHERE again
UNION ALL SELECT 'e' || p % 2, 'tier_2', clip_id, 'audit', FALSE, critical FROM pool
UNION ALL SELECT w, 'tier_3', clip_id, 'safety_audit', FALSE, critical FROM routed CROSS JOIN (VALUES ('s0'), ('s1')) t(w) WHERE critical OR clip_id IN (SELECT clip_id FROM acts)"""


@query("m08_by_role", f"WITH {ROUTED}, {TIERS}")
def _(s, d):
    return A.by_role(routed(s, d), ANNOTATORS, EXPERTS, OFFICERS)


@query("m08_only_experts", f"WITH {ROUTED} SELECT w AS worker, 'tier_2' AS role, clip_id, 'expert_gold' AS task, FALSE AS double, critical FROM routed CROSS JOIN (VALUES ('e0'), ('e1')) t(w)")
def _(s, d):
    return A.by_role(routed(s, d), ANNOTATORS, EXPERTS, OFFICERS, only_experts=True)


@query(
    "m09_by_route",
    f"""WITH {ROUTED}, low AS (SELECT clip_id, row_number() OVER (ORDER BY {_order(14)}) - 1 AS p FROM routed WHERE route = 'low'), medium AS (SELECT clip_id, row_number() OVER (ORDER BY {_order(14)}) - 1 AS p FROM routed WHERE route = 'medium'),
high AS (SELECT clip_id, row_number() OVER (ORDER BY {_order(14)}) - 1 AS p FROM routed WHERE route = 'high' QUALIFY p < least(400, greatest(1, floor(0.08 * count(*) OVER ()))))
SELECT 'w' || (p + j) % 5 AS worker, clip_id, 'fresh_annotation' AS task FROM low CROSS JOIN range(2) AS r(j) UNION ALL SELECT 'w' || p % 5, clip_id, 'review_prefill' FROM medium UNION ALL SELECT 'w' || p % 5, clip_id, 'verify_consensus' FROM high""",
)
def _(s, d):
    return A.by_route(routed(s, d), ANNOTATORS)


@query(
    "m05_by_strata",
    f"""WITH {ROUTED}, h AS (SELECT *, nullif(site, 'unknown') AS place_of FROM routed WHERE route = 'high'), size AS (SELECT greatest(1, least(400, CAST(floor(0.08 * count(*)) AS BIGINT))) AS size, count(*) AS total FROM h),
st AS (SELECT place_of, unsafe, count(*) AS n FROM h GROUP BY ALL), want AS (SELECT *, least(n, greatest(1, CAST(round_even(n::DOUBLE / total * size, 0) AS BIGINT))) AS want FROM st CROSS JOIN size),
take AS (SELECT *, greatest(0, least(want, size - coalesce(sum(want) OVER (ORDER BY place_of NULLS FIRST, unsafe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM want),
r AS (SELECT clip_id, place_of, unsafe, row_number() OVER (PARTITION BY place_of, unsafe ORDER BY {_order(3)}) AS p FROM h)
SELECT clip_id FROM r JOIN take t ON r.place_of IS NOT DISTINCT FROM t.place_of AND r.unsafe = t.unsafe WHERE p <= take""",
)
def _(s, d):
    high = routed(s, d).where("route = 'high'")
    return S.stratified_verification(high, ["site", "unsafe"], S.hash_order(3, "clip_id")).select("clip_id")


# --- alerts and summaries -------------------------------------------------------------------------------------------


@query(
    "a42_all_alerts",
    """WITH r AS (SELECT o_custkey % 400 AS who, CASE WHEN o_orderkey % 13 < 2 OR o_custkey % 400 < 9 AND o_orderkey % 3 = 0 THEN 'skipped' ELSE 'submitted' END AS status, CASE WHEN o_orderkey % 17 > 0 THEN (o_orderkey * 7 + o_custkey) % 101 / 100.0 END AS sure FROM orders),
g AS (SELECT CAST(who AS VARCHAR) AS who, count(*) AS n, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'submitted' AND sure < 0.5) AS unsure FROM r GROUP BY 1), m AS (SELECT 'm' || o_custkey % 6 AS who, CAST(count(*) FILTER (o_orderkey % (o_custkey % 6 + 2) > 0) AS DOUBLE) / count(*) AS rate FROM orders GROUP BY 1)
SELECT who, 'skip_rate' AS alert, CAST(skipped AS DOUBLE) / n AS value FROM g WHERE n >= 10 AND CAST(skipped AS DOUBLE) / n > 0.2::DOUBLE UNION ALL SELECT who, 'low_confidence', CAST(unsure AS DOUBLE) FROM g WHERE unsure > 5 UNION ALL SELECT who, 'success_rate', rate FROM m WHERE rate < 0.8::DOUBLE""",
)
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(s, d, "orders")
    skipped = (k % 13 < 2) | ((c % 400 < 9) & (k % 3 == 0))
    sure = F.when(k % 17 > 0, ((k * 7 + c) % 101) / 100)
    people = o.select((c % 400).cast("string").alias("annotator_id"), F.when(skipped, "skipped").otherwise("submitted").alias("status"), sure.alias("confidence"))
    results = o.select(F.concat(F.lit("m"), (c % 6).cast("string")).alias("model"), (k % (c % 6 + 2) > 0).alias("success"))
    return reports.annotator_alerts(people).unionByName(reports.model_alerts(results))


_FIELDS = {"scene_type": ("a.scene_type", "b.scene_type", False), "num_workers": ("a.n", "b.n", True), "overall_ppe_compliance": ("a.overall_ppe_compliance", "b.overall_ppe_compliance", False), "n_persons": ("a.n", "b.n", True), "first_action": ("p.action_code", "q.action_code", False), "first_unsafe": ("p.unsafe_act", "q.unsafe_act", False)}
_FIELD_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, {x} IS NOT DISTINCT FROM {y} AS same, {f'{y} - {x}' if n else 'NULL'} AS delta, a.k IS NOT NULL AND b.k IS NOT NULL AS there FROM two" for f, (x, y, n) in _FIELDS.items())


@query(
    "a46_field_agreement",
    f"""WITH {REVIEWS}, two AS (SELECT a, b, p, q FROM o LEFT JOIN model_scene a ON a.k = o.k LEFT JOIN first_scene b ON b.k = o.k LEFT JOIN (SELECT * FROM model_people WHERE i = 0) p ON p.k = o.k LEFT JOIN (SELECT * FROM first_people WHERE i = 0) q ON q.k = o.k), x AS ({_FIELD_SQL})
SELECT field, count(*) FILTER (there AND same) AS agree, count(*) FILTER (there AND NOT same) AS disagree, count(*) FILTER (NOT there) AS missing, CAST(sum(delta) FILTER (there AND NOT same) AS DOUBLE) / count(delta) FILTER (there AND NOT same) AS mean_delta, CAST(max(abs(delta)) FILTER (there AND NOT same) AS DOUBLE) AS max_delta FROM x GROUP BY field""",
)
def _(s, d):
    a, b = F.col("model"), F.col("first")
    first = [F.get(x["persons"], F.lit(0)) for x in (a, b)]
    fields = {f: (a[f], b[f]) for f in ("scene_type", "num_workers", "overall_ppe_compliance")}
    fields |= {"n_persons": (F.size(a["persons"]), F.size(b["persons"])), "first_action": tuple(p["action_code"] for p in first), "first_unsafe": tuple(p["unsafe_act"] for p in first)}
    return reports.field_agreement(reviews(s, d), fields, a.isNotNull() & b.isNotNull())


@query("a47_summary", f"WITH {PAIRS} SELECT model, count(*) AS n, CAST(round(1e6 * avg(pct)) AS BIGINT) AS mean, CAST(median(pct) AS DOUBLE) AS median, CAST(round(1e6 * stddev_pop(pct)) AS BIGINT) AS deviation, min(pct) AS least, max(pct) AS most FROM pairs GROUP BY model")
def _(s, d):
    p = pairs(s, d).select("model", (F.col("confidence") * 100).cast("long").alias("pct"))
    return reports.summary(p, "pct", ["model"]).withColumns({c: F.round(1e6 * F.col(c)).cast("long") for c in ("mean", "deviation")})


# --- names, requests, records ---------------------------------------------------------------------------------------

_STAMP = "'20240102' || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0')"


@query(
    "p05_video_names",
    f"""WITH n AS (SELECT o_orderkey, o_orderkey % 4 AS form, 'Site ' || o_custkey % 3 AS site, 'Bay ' || o_custkey % 5 AS area, {_STAMP} AS stamp FROM orders)
SELECT o_orderkey, CASE form WHEN 3 THEN '' ELSE site END AS site, CASE form WHEN 0 THEN area || '_north' WHEN 1 THEN area WHEN 2 THEN '' ELSE '' END AS area,
  CASE form WHEN 0 THEN replace(site || '_' || area || '_north', ' ', '_') WHEN 1 THEN replace(site || '_' || area, ' ', '_') WHEN 2 THEN replace(site, ' ', '_') ELSE 'x_' || stamp || '_1' END AS camera, '2024-01-02' AS date, stamp AS start FROM n""",
)
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda t, x: F.concat(F.lit(t), x.cast("string"))
    site, area = text("Site ", c % 3), text("Bay ", c % 5)
    stamp = F.concat(F.lit("20240102"), F.lpad((k % 240000).cast("string"), 6, "0"))
    form = lambda *cases: F.element_at(F.array(*cases), (k % 4 + 1).cast("int"))
    old = F.concat(F.lit("x_"), stamp, F.lit("_1.mp4"))
    name = form(F.concat_ws("_", site, area, F.lit("north_main"), F.concat(stamp, F.lit(".mp4"))), old, old, old)
    where = form(F.lit("/v/18112025"), F.concat(F.lit("/v/"), site, F.lit("_"), area, F.lit("_20240103@10")), F.concat(F.lit("/v/"), site, F.lit("/")), F.lit("/v/18112025"))
    parts = table(s, d, "orders").select("o_orderkey", C.video_parts(name, where).alias("x"))
    return parts.select("o_orderkey", "x.*")


@query("p36_sorted_signature", """SELECT o_orderkey, substr(md5('{"a":{"k":' || o_orderkey || ',"z":[1,"x"]},"b":"' || o_orderpriority || '"}'), 1, 8) AS signature FROM orders""")
def _(s, d):
    """Half of the records give their keys in another order."""
    k, b = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    one = F.concat(F.lit('{"b": "'), b, F.lit('", "a": {"z": [1, "x"], "k": '), k, F.lit("}}"))
    other = F.concat(F.lit('{"a":{"k":'), k, F.lit(',"z":[1,"x"]},"b":"'), b, F.lit('"}'))
    return table(s, d, "orders").select("o_orderkey", C.signature(F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(other)).alias("signature"))


_MESSAGES = """'{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"look"},{"type":"image_url","image_url":{"url":"' || o_orderkey || '/frame_00.jpg"}},{"type":"image_url","image_url":{"url":"' || o_orderkey || '/frame_01.jpg"}}]}]}'"""


@query("k10_request_forms", f"""SELECT 'chat' AS form, '{{"custom_id":"' || o_orderkey || '","method":"POST","url":"/v1/chat/completions","body":' || {_MESSAGES} || '}}' AS request FROM orders UNION ALL SELECT 'params', '{{"custom_id":"' || o_orderkey || '","params":' || {_MESSAGES} || '}}' FROM orders UNION ALL SELECT 'record', '{{"recordId":"' || o_orderkey || '","modelInput":' || {_MESSAGES} || '}}' FROM orders""")
def _(s, d):
    made = [files.batch_requests(table(s, d, "orders"), "o_orderkey", "m", 2, "look", form).select(F.lit(form).alias("form"), "request") for form in files.FORMS if form != "plain"]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("v07_stamped_repair", f"WITH {RECORDS} SELECT k AS clip_id, CASE WHEN category = 'invalid_recoverable' THEN 1 ELSE lay END AS layer, CASE WHEN category = 'invalid_recoverable' THEN 'layer_1_bonus_kept' END AS repair, CASE WHEN category = 'invalid_recoverable' THEN 1704067200 END AS repaired_at FROM c")
def _(s, d):
    fixed = V.repaired(records(s, d), at=F.timestamp_seconds(F.lit(1704067200)))
    return fixed.select("clip_id", F.col("record.annotation_layer").alias("layer"), "repair", F.unix_seconds("repaired_at").alias("repaired_at"))


# --- folders --------------------------------------------------------------------------------------------------------


@query("s11_active_annotators", "SELECT 'ann' || o_custkey % 4 AS annotator_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_custkey % 4 IN (0, 2) GROUP BY 1")
def _(s, d):
    """A folder of documents for each annotator and a hidden one, of which two are active."""
    path = folder(s, "annotations")
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("who"))
    for who, name in enumerate(("ann0", "ann1", "ann2", ".hidden")):
        o.where(F.col("who") == who).select("o_orderkey").write.json(f"{path}/{name}")
    tree = files.read_annotation_tree(s, path, "o_orderkey long", ["ann0", "ann2", ".hidden"], lines=True)
    return tree.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s15_frames", "SELECT n_nationkey, n_nationkey % 10 AS frames, n_nationkey % 10 = 8 AS complete, n_nationkey % 10 >= 2 AS usable FROM nation")
def _(s, d):
    """A folder of frames for each nation; those of some nations are too few, or there are none."""
    path = folder(s, "frames")
    nation = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    frames = nation.where("n_nationkey % 10 > 0").select(F.col("n_nationkey").alias("clip"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_nationkey") % 10)).alias("frame"))
    frames.select("clip", F.col("frame").cast("string")).write.option("maxRecordsPerFile", 1).partitionBy("clip").text(path)
    counts = files.frame_counts(s, path, "*.txt").withColumn("folder", F.replace("folder", F.lit("clip="), F.lit("")))
    return files.with_frames(nation, counts, "n_nationkey")
