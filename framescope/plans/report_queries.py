"""Queries of raters' agreement on all axes, curated batches, reports from one scan, and functions in SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.functions import sql as sql_functions
from framescope.functions.taxonomy import ACTIONS, GROUPS, SPATIAL_TAGS
from framescope.operators import metrics as M
from framescope.operators import rater_report, reports
from framescope.operators import selection as S
from framescope.plans.projections import CLIPS, PAIRS, clips, pairs, table
from framescope.plans.review_queries import ITEMS, RECORDS, WRITERS, reviews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- agreement of raters on all axes --------------------------------------------------------------------------------


def _bundle_sql() -> str:
    states = ", ".join(f"coalesce(p.{i}, 'cannot_determine') AS {i}" for i in ITEMS)
    first = [f"prim_{w} AS (SELECT s.k, coalesce(p.action_code, '') AS ac, string_split(coalesce(p.spatial_context, ''), '|') AS tags, {states}, s.scene_type AS scene FROM {w}_scene s LEFT JOIN (SELECT * FROM {w}_people WHERE i = 0) p ON p.k = s.k)" for w in WRITERS]
    names = list(WRITERS)
    two = " UNION ALL ".join(f"SELECT '{x}' AS rater_a, '{y}' AS rater_b, a, b FROM prim_{x} a JOIN prim_{y} b USING (k)" for k, x in enumerate(names) for y in names[k + 1 :])
    items = " UNION ALL ".join(f"SELECT rater_a, rater_b, 'protection', '{i}', a.{i}, b.{i} FROM two" for i in ITEMS)
    keys = "rater_a, rater_b, axis, item"
    return f"""{", ".join(first)}, two AS ({two}),
x AS (SELECT rater_a, rater_b, 'action' AS axis, '' AS item, a.ac AS a, b.ac AS b FROM two UNION ALL SELECT rater_a, rater_b, 'spatial', t, CAST(list_contains(a.tags, t) AS VARCHAR), CAST(list_contains(b.tags, t) AS VARCHAR) FROM two CROSS JOIN (SELECT unnest([{_texts(SPATIAL_TAGS)}]) AS t)
  UNION ALL {items} UNION ALL SELECT rater_a, rater_b, 'scene', '', a.scene, b.scene FROM two WHERE a.scene <> '' AND b.scene <> ''),
cell AS (SELECT {keys}, a, b, count(*) AS n, CASE WHEN a = b THEN 0.0 WHEN a[1] = b[1] AND a[1] IN ({_texts(GROUPS)}) THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM x GROUP BY ALL),
na AS (SELECT {keys}, a, sum(n) AS na FROM cell GROUP BY ALL), nb AS (SELECT {keys}, b, sum(n) AS nb FROM cell GROUP BY ALL),
chance AS (SELECT {keys}, sum(CASE WHEN a = b THEN na * nb ELSE 0 END) AS same, sum(CASE WHEN a = b THEN 0.0 WHEN a[1] = b[1] AND a[1] IN ({_texts(GROUPS)}) THEN 0.5 ELSE 1.0 END::DOUBLE * na * nb) AS weighted FROM na JOIN nb USING ({keys}) GROUP BY ALL),
seen AS (SELECT {keys}, sum(n) AS n, sum(n) FILTER (a = b) AS agreed, sum(w * n) AS observed FROM cell GROUP BY ALL),
k AS (SELECT rater_a, rater_b, axis, n, CASE WHEN axis = 'action' THEN CASE WHEN weighted = 0 THEN 1.0 ELSE 1 - CAST(observed AS DOUBLE) * CAST(n AS DOUBLE) / CAST(weighted AS DOUBLE) END WHEN same = n * n THEN 1.0 ELSE CAST(n * coalesce(agreed, 0) - same AS DOUBLE) / CAST(n * n - same AS DOUBLE) END AS kappa FROM seen JOIN chance USING ({keys})),
g AS (SELECT rater_a, rater_b, axis, avg(kappa) AS kappa, CAST(max(n) AS BIGINT) AS n, CASE axis WHEN 'action' THEN 0.75 WHEN 'spatial' THEN 0.70 WHEN 'protection' THEN 0.65 END::DOUBLE AS target FROM k GROUP BY ALL)
SELECT rater_a, rater_b, axis, round(kappa, 4) AS kappa, n, target, CASE WHEN axis = 'action' THEN kappa ELSE round(kappa, 4) END >= target AS reached FROM g WHERE axis <> 'scene' OR n >= 5"""


@query("a22_all_axes", f"WITH {RECORDS}, {_bundle_sql()}")
def _(s, d):
    return rater_report.bundle(rater_report.pairs_of(reviews(s, d), list(WRITERS)))


# --- curated batches ------------------------------------------------------------------------------------------------

RULES = {"targets": {"2-HIGH": 40, "9-none": 5}, "least": 25, "discovery": 30, "prioritize": ("rare",)}
_CLASS = "CASE WHEN o_orderkey % {gap} <> 0 THEN '' WHEN o_orderkey % 26 = 0 THEN 'rare' ELSE o_orderpriority END"


def _curated_sql(size: int, gap: int) -> str:
    targets = RULES["targets"]
    want = " ".join(f"WHEN '{c}' THEN {n}" for c, n in targets.items())
    seq = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(targets))
    return f"""WITH c AS (SELECT o_orderkey, nullif({_CLASS.format(gap=gap)}, '') AS class FROM orders), ex AS (SELECT o_orderpriority AS class, count(*) AS have FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY o_orderkey) AS place FROM c), pool AS (SELECT class, count(*) AS n FROM c WHERE class IS NOT NULL GROUP BY 1),
cls AS (SELECT class, coalesce(n, 0) AS n, coalesce(have, 0) AS have, least(coalesce(n, 0), CASE class {want} ELSE {RULES["least"]} END) AS want, CASE class {seq} ELSE 100 + row_number() OVER (ORDER BY class) END AS seq FROM pool FULL JOIN ex USING (class)),
got AS (SELECT *, greatest(0, least(want, {size} - coalesce(sum(want) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got FROM cls),
b AS (SELECT least({RULES["discovery"]}, {size} - (SELECT sum(got) FROM got), (SELECT count(*) FROM c WHERE class IS NULL)) AS found, {size} - (SELECT sum(got) FROM got) AS left_),
lack AS (SELECT *, row_number() OVER (ORDER BY greatest(0, ((SELECT sum(have) FROM cls) + {size})::DOUBLE / (SELECT count(*) FROM cls) - have - got) + CASE WHEN class = 'rare' THEN left_ - found ELSE 0 END DESC, class) AS turn FROM got CROSS JOIN b),
rest AS (SELECT o_orderkey, row_number() OVER (ORDER BY place - got, turn) AS o FROM p JOIN lack USING (class) WHERE place > got),
taken AS (SELECT o_orderkey FROM rest CROSS JOIN b WHERE o <= left_ - found)
SELECT o_orderkey, CASE WHEN class IN ({_texts(targets)}) THEN 'target' ELSE 'minimum' END AS step FROM p JOIN got USING (class) WHERE place <= got UNION ALL SELECT o_orderkey, 'deficit' FROM taken
UNION ALL SELECT o_orderkey, CASE WHEN place <= found THEN 'discovery' ELSE 'fill' END FROM p CROSS JOIN b WHERE class IS NULL AND place <= found + (left_ - found - (SELECT count(*) FROM taken))"""


def _curated(s, d, size: int, gap: int) -> DataFrame:
    o = table(s, d, "orders")
    rows = o.select("o_orderkey", F.expr(_CLASS.format(gap=gap)).alias("class"))
    existing = o.where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return S.curated(rows, "class", size, [F.col("o_orderkey")], existing, **RULES).select("o_orderkey", "step")


@query("m03_curated", _curated_sql(600, 2))
def _(s, d):
    return _curated(s, d, 600, 2)


@query("m03_curated_fill", _curated_sql(900, 13))
def _(s, d):
    """A batch that classes can't fill."""
    return _curated(s, d, 900, 13)


# --- resampling -----------------------------------------------------------------------------------------------------

_DRAW = "CASE " + " ".join(f"WHEN u < '{x}' THEN {k}" for k, x in enumerate(M._poisson_limits(4))) + f" ELSE {len(M._poisson_limits(4))} END"


@query(
    "a24_bootstrap",
    f"WITH {PAIRS}, d AS (SELECT r, CASE WHEN gt = pred THEN 1 ELSE 0 END AS hit, substr(md5('11|' || clip_id || '|' || (r // 8)), CAST(1 + 4 * (r % 8) AS INT), 4) AS u FROM pairs CROSS JOIN range(50) AS t(r)), w AS (SELECT r, hit, {_DRAW} AS w FROM d), m AS (SELECT CAST(sum(w * hit) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS m FROM w GROUP BY r) SELECT CAST(round(1e9 * quantile_cont(m, 0.025)) AS BIGINT) AS low, CAST(round(1e9 * quantile_cont(m, 0.975)) AS BIGINT) AS high FROM m",
)
def _(s, d):
    hits = pairs(s, d).select("clip_id", (F.col("gt") == F.col("pred")).cast("int").alias("hit"))
    both = M.bootstrap_mean(hits, "hit", "clip_id", rounds=50)
    return both.select(*(F.round(1e9 * F.col(c)).cast("long").alias(c) for c in ("low", "high")))


# --- reports from one scan ------------------------------------------------------------------------------------------

_KINDS = {"site": "'s' || l_suppkey % 7", "camera": "'c' || l_suppkey", "resolution": "l_returnflag", "date": "date", "source_type": "l_linestatus", "fps": "CAST(qty // 3 AS VARCHAR)", "area": "'a' || start_sec % 11"}
_INVENTORY = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(sum(duration) AS BIGINT) AS seconds, {'list_sort(list(DISTINCT ' + _KINDS['camera'] + '))' if k == 'site' else '[]'}::VARCHAR[] AS cameras, {'list_sort(list(DISTINCT ' + _KINDS['area'] + '))' if k == 'site' else '[]'}::VARCHAR[] AS areas FROM clips GROUP BY 2"
    for k, c in _KINDS.items()
)


@query("a03_inventory", f"WITH {CLIPS}, r AS ({_INVENTORY} UNION ALL SELECT 'all', NULL, count(*), CAST(sum(duration) AS BIGINT), [], [] FROM clips) SELECT kind, value, n, seconds, array_to_string(cameras, ',') AS cameras, array_to_string(areas, ',') AS areas FROM r")
def _(s, d):
    c = clips(s, d)
    text = lambda letter, col: F.concat(F.lit(letter), col.cast("string"))
    kinds = {"site": text("s", F.col("l_suppkey") % 7), "camera": text("c", F.col("l_suppkey")), "resolution": F.col("l_returnflag"), "date": F.col("date"), "source_type": F.col("l_linestatus"), "fps": F.floor(F.col("qty") / 3), "area": text("a", F.col("start_sec") % 11)}
    r = reports.histograms(c, kinds, {"seconds": F.col("duration").cast("long")}, {"site": ("camera", "area")})
    return r.select("kind", "value", "n", "seconds", F.array_join("site_camera", ",").alias("cameras"), F.array_join("site_area", ",").alias("areas"))


_FAILURES = "list_filter([CASE WHEN disc < 4 THEN 'detection_ratio' END, CASE WHEN tax < 2 THEN 'bbox_area' END, CASE WHEN qty < 10 THEN 'confidence' END, CASE WHEN duration < 8 THEN 'duration' END], lambda x: x IS NOT NULL)"


@query(
    "a04_whole_tier_report",
    f"""WITH {CLIPS}, f AS (SELECT *, {_FAILURES} AS reasons FROM clips), t AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'A' ELSE 'B' END AS tier FROM f),
u AS (SELECT tier, 'reason' AS kind, unnest(reasons) AS value, NULL AS noise FROM t UNION ALL SELECT tier, 'tag', unnest(list_filter([CASE WHEN intensity < 60 THEN 'low_light' END, CASE WHEN noise > 60 THEN 'noise' END], lambda x: x IS NOT NULL)), NULL FROM t WHERE tier = 'A'
  UNION ALL SELECT tier, 'camera', CAST(l_suppkey AS VARCHAR), NULL FROM t WHERE tier = 'A' UNION ALL SELECT tier, 'date', date, NULL FROM t WHERE tier = 'A' UNION ALL SELECT tier, 'crew', CASE WHEN most >= 2 THEN 'several' WHEN most = 1 THEN 'one' END, NULL FROM t WHERE tier = 'A' AND most > 0 UNION ALL SELECT tier, 'all', '', nullif(noise, 0) FROM t)
SELECT tier, kind, value, count(*) AS n, CAST(sum(noise) AS DOUBLE) / count(noise) AS mean_noise FROM u GROUP BY ALL""",
)
def _(s, d):
    failures = C.gate_failures(F.col("disc"), F.col("tax"), F.col("qty"), F.col("duration"), 4, 2, 10, 8)
    t = clips(s, d).withColumn("reasons", failures).withColumn("tier", C.tier(F.col("reasons")))
    best = F.col("tier") == "A"
    tags = F.array_compact(F.array(F.when(F.col("intensity") < 60, "low_light"), F.when(F.col("noise") > 60, "noise")))
    crew = F.when(F.col("most") >= 2, "several").when(F.col("most") == 1, "one")
    # The tier goes in front of each value, so that both tiers come from the same pass.
    tiered = lambda c: F.concat_ws("|", "tier", c.cast("string"))
    single = {"camera": F.when(best, tiered(F.col("l_suppkey"))), "date": F.when(best, tiered(F.col("date"))), "crew": F.when(best & crew.isNotNull(), tiered(crew)), "tier": F.col("tier")}
    many = {"reason": F.transform("reasons", tiered), "tag": F.when(best, F.transform(tags, tiered))}
    counts = reports.tagged_counts(t, single, many, {}).where("kind <> 'all'")
    sizes = t.groupBy("tier").agg(M.ratio(F.sum(F.nullif(F.col("noise"), F.lit(0))), F.count(F.nullif(F.col("noise"), F.lit(0)))).alias("mean_noise"))
    named = counts.withColumn("tier", F.substring_index("value", "|", 1)).withColumn("whole", F.col("kind") == "tier")
    named = named.select("tier", F.when(F.col("whole"), "all").otherwise(F.col("kind")).alias("kind"), F.when(F.col("whole"), "").otherwise(F.expr("substring(value, 3)")).alias("value"), "n", "whole")
    return named.join(F.broadcast(sizes), "tier").select("tier", "kind", "value", "n", F.when(F.col("whole"), F.col("mean_noise")).alias("mean_noise"))


# --- functions in SQL text ------------------------------------------------------------------------------------------

_GROUP_AT = "list_position([" + _texts(GROUPS) + "], {c}[1])"
_NAMES = "(['" + "', '".join(n for n in ("walking (A1)", "idle.standing", "B3 hot work", "crane_signalling", "zzz", " f2 ", "unlisted")) + "'])[o_orderkey % 7 + 1]"
_CODES = "(['A1', 'F1', 'B3', 'C1', 'zzz', 'F2', 'X1'])[o_orderkey % 7 + 1]"


@query("u06_sql_distance", f"WITH {PAIRS} SELECT gt, pred, CASE WHEN gt = pred THEN 0.0 WHEN gt[1] = pred[1] THEN 0.33 ELSE least(1.0, 0.5::DOUBLE + 0.1::DOUBLE * abs({_GROUP_AT.format(c='gt')} - {_GROUP_AT.format(c='pred')})) END::DOUBLE AS distance, count(*) AS n FROM pairs GROUP BY ALL")
def _(s, d):
    sql_functions.register(s)
    return s.sql("SELECT gt, pred, taxonomic_distance(gt, pred) AS distance, count(*) AS n FROM {rows} GROUP BY gt, pred", rows=pairs(s, d))


@query("u06_sql_wilson", f"WITH {PAIRS}, x AS (SELECT gt, count(*) FILTER (gt = pred) AS k, count(*) AS n FROM pairs GROUP BY gt) SELECT gt, CAST(floor(1e6 * ((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(((k / n) * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) AS BIGINT) AS low, CAST(floor(1e6 * ((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt(((k / n) * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) AS BIGINT) AS high FROM x")
def _(s, d):
    sql_functions.register(s)
    return s.sql("SELECT gt, floor(1e6D * wilson_low(count_if(gt = pred), count(*))) AS low, floor(1e6D * wilson_high(count_if(gt = pred), count(*))) AS high FROM {rows} GROUP BY gt", rows=pairs(s, d))


@query("u06_sql_action", f"SELECT o_orderkey, {_CODES} AS code FROM orders")
def _(s, d):
    sql_functions.register(s)
    names = F.element_at(F.array(*map(F.lit, ("walking (A1)", "idle.standing", "B3 hot work", "crane_signalling", "zzz", " f2 ", "unlisted"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return s.sql("SELECT o_orderkey, normalize_action(name) AS code FROM {rows}", rows=table(s, d, "orders").select("o_orderkey", names.alias("name")))


@query("u07_sql_slices", f"WITH {CLIPS}, x AS (SELECT clip_id, CAST(start_sec AS DOUBLE) AS b, CAST(start_sec + qty AS DOUBLE) AS e FROM clips), c AS (SELECT clip_id, e, b + 15 * unnest(range(0, CAST(floor((e - b) / 15) AS BIGINT) + 1)) AS f FROM x) SELECT clip_id, f AS slice_start, least(f + 15, e) AS slice_end FROM c WHERE least(f + 15, e) - f >= 5")
def _(s, d):
    sql_functions.register(s)
    rows = clips(s, d).select("clip_id", F.col("start_sec").cast("double").alias("b"), (F.col("start_sec") + F.col("qty")).cast("double").alias("e"))
    return s.sql("SELECT t.clip_id, x.slice_start, x.slice_end FROM {rows} t, LATERAL slices(t.b, t.e, 15, 5) x", rows=rows)
