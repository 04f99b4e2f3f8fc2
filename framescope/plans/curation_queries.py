"""Queries of intervals, selection, sampling, joins and sets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import intervals as I
from framescope.operators import rules as R
from framescope.operators import selection as S
from framescope.plans.projections import CLIPS, PAIRS, TIMELINE, clips, pairs, table, timeline, taken

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3600


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


ISLANDS = f"""WITH {TIMELINE}, m AS (SELECT *, lag(detected, 1, false) OVER w AS was, lead(sec) OVER w AS nxt FROM timeline WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
  n AS (SELECT *, sum((detected AND NOT was)::INT) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS k FROM m),
  islands AS (SELECT user_id, min(sec) AS "start", max(coalesce(nxt, sec)) AS "end" FROM n WHERE detected GROUP BY user_id, k)"""
MERGED = ISLANDS + f""", mm AS (SELECT *, coalesce(("start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start", "end") > {6 * HOUR})::INT, 1) AS o FROM islands),
  mn AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS p FROM mm), merged AS (SELECT user_id, min("start") AS "start", max("end") AS "end" FROM mn GROUP BY user_id, p)"""
PADDED = MERGED + f""", padded AS (SELECT user_id, greatest("start" - {HOUR}, 0) AS "start", least("end" + {HOUR}, {30 * 24 * HOUR}) AS "end" FROM merged)"""
SLICED = PADDED + f""", sliced AS (SELECT user_id, "start", "end", "start" + i * {12 * HOUR} AS slice_start, least("start" + (i + 1) * {12 * HOUR}, "end") AS slice_end FROM (SELECT *, unnest(range(0, ("end" - "start") // {12 * HOUR} + 1)) AS i FROM padded) WHERE least("start" + (i + 1) * {12 * HOUR}, "end") - ("start" + i * {12 * HOUR}) >= {4 * HOUR})"""


def islands(s, d):
    return I.islands(timeline(s, d), "user_id", "sec", "detected", ["sec", "event_id"])


def sliced(s, d):
    padded = I.pad(I.merge_close(islands(s, d), "user_id", 6 * HOUR), HOUR, 0, 30 * 24 * HOUR)
    return I.slice_fixed(padded, 12 * HOUR, 4 * HOUR)


@query("w01_islands", ISLANDS + ' SELECT user_id, "start", "end" FROM islands')
def _(s, d):
    return islands(s, d)


@query("w02_merge", MERGED + ' SELECT user_id, "start", "end" FROM merged')
def _(s, d):
    return I.merge_close(islands(s, d), "user_id", 6 * HOUR)


@query("w03_pad_clamp", PADDED + ' SELECT user_id, "start", "end" FROM padded')
def _(s, d):
    return I.pad(I.merge_close(islands(s, d), "user_id", 6 * HOUR), HOUR, 0, 30 * 24 * HOUR)


@query("w04_slice", SLICED + ' SELECT user_id, "start", "end", slice_start, slice_end FROM sliced')
def _(s, d):
    return sliced(s, d)


@query("w05_sequence", SLICED + ", q AS (SELECT user_id, slice_start, slice_end, row_number() OVER (PARTITION BY user_id ORDER BY slice_start, slice_end) AS n FROM sliced) SELECT user_id, CAST(max(n) AS INT) AS n FROM q GROUP BY user_id")
def _(s, d):
    q = sliced(s, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("slice_start", "slice_end")))
    return q.groupBy("user_id").agg(F.max("n").alias("n"))


@query("w06_time_bucket", f"WITH {CLIPS} SELECT l_suppkey, date, start_sec // 300 AS bucket, count(*) AS n FROM clips GROUP BY ALL")
def _(s, d):
    return S.time_bucket(clips(s, d), "start_sec", 300).groupBy("l_suppkey", "date", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w07_novelty_dedup",
    f"""WITH {CLIPS}, u AS (SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY l_suppkey, start_sec, noise, qty, date, tax, disc) = 1), c AS (SELECT clip_id, l_suppkey, start_sec // 3000 AS bucket, tax % 5 AS sev, most AS crowd, noise, row_number() OVER (PARTITION BY l_suppkey, start_sec // 3000 ORDER BY noise, clip_id) AS p FROM u),
  a AS (SELECT * FROM c WHERE p = 1),
  b0 AS (SELECT c.*, row_number() OVER (PARTITION BY c.l_suppkey, c.bucket ORDER BY (c.sev <> a.sev)::INT * 3 + (c.crowd <> a.crowd)::INT * 2 DESC, c.noise, c.clip_id) AS q, a.sev AS s1, a.crowd AS c1 FROM c JOIN a USING (l_suppkey, bucket) WHERE c.p > 1),
  b AS (SELECT * FROM b0 WHERE q = 1),
  d0 AS (SELECT b0.*, row_number() OVER (PARTITION BY b0.l_suppkey, b0.bucket ORDER BY (b0.sev NOT IN (b0.s1, b.sev))::INT * 3 + (b0.crowd NOT IN (b0.c1, b.crowd))::INT * 2 DESC, b0.noise, b0.clip_id) AS r FROM b0 JOIN b USING (l_suppkey, bucket) WHERE b0.q > 1)
  SELECT clip_id, 1 AS pick FROM a UNION ALL SELECT clip_id, 2 FROM b UNION ALL SELECT clip_id, 3 FROM d0 WHERE r = 1""",
)
def _(s, d):
    c = S.latest(clips(s, d), ["clip_id"], *map(F.col, ("l_suppkey", "start_sec", "noise", "qty", "date", "tax", "disc")))
    c = S.time_bucket(c, "start_sec", 3000).withColumn("sev", F.col("tax") % 5)
    return S.novel(c.select("clip_id", "l_suppkey", "bucket", "sev", F.col("most").alias("crowd"), "noise"), ["l_suppkey", "bucket"], "noise", {"sev": 3, "crowd": 2}, "clip_id").select("clip_id", "pick")


@query("w08_latest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(s, d):
    return S.latest(table(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("w10_round_robin", "SELECT o_orderkey, 'w' || ((p + c) % 3) AS worker FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) CROSS JOIN (VALUES (0), (1)) t(c)")
def _(s, d):
    n = S.numbered(table(s, d, "orders").select("o_orderkey"), F.floor(F.col("o_orderkey") / 1000), [F.col("o_orderkey")])
    return S.in_turn(n, ["w0", "w1", "w2"], "place", copies=2).select("o_orderkey", "worker")


@query("w11_priority", "WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 9 END AS band FROM orders) SELECT o_orderkey, band FROM b QUALIFY band = min(band) OVER (PARTITION BY o_custkey)")
def _(s, d):
    st = F.col("o_orderstatus")
    b = S.with_band(table(s, d, "orders"), (F.col("o_orderpriority") == "1-URGENT", 0), (st == "F", 1), (st == "P", 2))
    return b.withColumn("first", F.min("band").over(Window.partitionBy("o_custkey"))).where("band = first").select("o_orderkey", "band")


@query("j02_positional_pairs", "WITH g AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, length(text) AS n FROM conversations WHERE role = 'user'), h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, length(text) AS n FROM conversations WHERE role = 'assistant') SELECT conv_id, CAST(p - 1 AS INT) AS pos, g.n AS asked, h.n AS told FROM g JOIN h USING (conv_id, p)")
def _(s, d):
    c = table(s, d, "conversations")

    def side(role, name):
        lists = c.where(F.col("role") == role).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("x"))
        return lists.select("conv_id", F.posexplode("x").alias("pos", "y")).select("conv_id", "pos", F.col("y.n").alias(name))

    return side("user", "asked").join(side("assistant", "told"), ["conv_id", "pos"])


MATCHES = """WITH RECURSIVE g AS (SELECT l_orderkey, list({'p': l_linenumber, 'f': l_returnflag} ORDER BY l_linenumber, CAST(l_quantity AS INT), l_returnflag) AS v FROM lineitem GROUP BY l_orderkey),
x AS (SELECT a.l_orderkey AS k, a.v AS pa, b.v AS pb FROM g a JOIN g b ON b.l_orderkey = a.l_orderkey + 1),
m AS (SELECT k, 0 AS i, []::BIGINT[] AS used FROM x UNION ALL SELECT m.k, i + 1, list_append(used, coalesce(list_sort(list_filter(list_transform(range(1, len(pb) + 1), lambda j: {'s': -(3 * (pa[i + 1].p = pb[j].p)::INT + 7 * (pa[i + 1].f = pb[j].f)::INT), 'j': j}), lambda z: NOT list_contains(used, z.j)))[1].j, 0)) FROM m JOIN x USING (k) WHERE i < len(pa))
SELECT k AS l_orderkey, array_to_string(list_transform(used, lambda u: u - 1), ',') AS matches FROM m JOIN x USING (k) WHERE i = len(pa)"""


@query("j03_greedy_match", MATCHES)
def _(s, d):
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag"))).alias("a"))
    y = table(s, d, "lineitem").groupBy((F.col("l_orderkey") - 1).alias("l_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag"))).alias("b"))
    score = lambda p, q: 0.3 * (p["l_linenumber"] == q["l_linenumber"]).cast("int") + 0.7 * (p["l_returnflag"] == q["l_returnflag"]).cast("int")
    return x.join(y, "l_orderkey").select("l_orderkey", F.concat_ws(",", S.match_people(F.col("a"), F.col("b"), score).cast("array<string>")).alias("matches"))


@query("j05_zone_overlap", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def _(s, d):
    zones = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.array(F.concat(F.lit("z"), F.col("n_regionkey").cast("string"))).alias("zones"))
    return R.zone_flagged(table(s, d, "supplier"), zones, "s_nationkey", ["z1", "z3"]).select("s_suppkey")


@query(
    "j06_rule_theta",
    """WITH dep(dept, dept_site) AS (VALUES ('d1', 'nation_1'), ('d2', 'NATION_20'), ('d3', 'ASIA')), z(dept, zone) AS (VALUES ('d1', '0'), ('d4', '2')), r(dept, rule_id) AS (VALUES ('d1', 'r1'), ('d2', 'r2'), ('d3', 'r3'), ('d4', 'r4'), (NULL, 'g1')),
  st AS (SELECT n_name AS site, CAST(n_regionkey AS VARCHAR) AS zone FROM nation), named AS (SELECT DISTINCT site, dept FROM st JOIN dep ON contains(lower(site), lower(dept_site)) OR contains(lower(dept_site), lower(site))),
  byzone AS (SELECT DISTINCT site, dept FROM st JOIN z USING (zone) WHERE site NOT IN (SELECT site FROM named))
  SELECT DISTINCT site, rule_id FROM (SELECT site, rule_id FROM (SELECT * FROM named UNION ALL SELECT * FROM byzone) JOIN r USING (dept) UNION ALL SELECT site, rule_id FROM st CROSS JOIN r WHERE dept IS NULL)""",
)
def _(s, d):
    sites = table(s, d, "nation").select(F.col("n_name").alias("site"), F.array(F.col("n_regionkey").cast("string")).alias("zones"))
    dep = s.createDataFrame([("d1", "nation_1"), ("d2", "NATION_20"), ("d3", "ASIA")], "dept string, dept_site string")
    zones = s.createDataFrame([("d1", "0"), ("d4", "2")], "dept string, zone string")
    rules = s.createDataFrame([("d1", "r1"), ("d2", "r2"), ("d3", "r3"), ("d4", "r4"), (None, "g1")], "dept string, rule_id string")
    return R.applicable(sites, dep, zones, rules)


@query("j07_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j08_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    f = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(f, "c_custkey", "left_semi").select("c_custkey")


@query("j11_range", SLICED + " SELECT s.user_id, slice_start, slice_end, count(*) AS n FROM sliced s JOIN timeline t ON s.user_id = t.user_id AND sec BETWEEN slice_start AND slice_end GROUP BY ALL")
def _(s, d):
    segments = sliced(s, d).select("user_id", "slice_start", "slice_end")
    hits = I.within(timeline(s, d), segments, "user_id", "sec", 12 * HOUR)
    return hits.groupBy("user_id", "slice_start", "slice_end").agg(F.count(F.lit(1)).alias("n"))


@query("j12_nearest", f"WITH {TIMELINE}, t AS (SELECT DISTINCT user_id, moment FROM (SELECT user_id FROM timeline) CROSS JOIN (VALUES (600000), (1200000)) v(moment)) SELECT user_id, moment AS \"at\", (SELECT sec FROM timeline p WHERE p.user_id = t.user_id ORDER BY abs(sec - moment), sec LIMIT 1) AS nearest FROM t")
def _(s, d):
    t = timeline(s, d)
    targets = t.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(600000), F.lit(1200000))).alias("at"))
    return I.nearest(t, targets, "user_id", "sec", "at")


@query("j04_left_enrich", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(s, d):
    c = table(s, d, "customer").where("c_acctbal > 0")
    return table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("m01_stratified", f"WITH o AS (SELECT *, 2000 AS goal FROM orders), t AS {taken('o', 'o_orderpriority', 'goal', floor=50)} SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders) JOIN t USING (o_orderpriority) WHERE place <= take")
def _(s, d):
    return S.stratified(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 2000, [F.col("o_orderkey")], floor=50)


@query("m01b_strata_whole", "SELECT r_name, CAST(least(count(*), 3) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.stratified(n.select("n_nationkey", "r_name"), "r_name", 15, [F.col("n_nationkey")], cap=3).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("m03_class_balanced", "SELECT o_orderkey, turn FROM (SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INT) AS turn FROM orders) ORDER BY turn, o_orderpriority, o_orderkey LIMIT 333")
def _(s, d):
    return S.balanced(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 333, [F.col("o_orderkey")]).select("o_orderkey", "turn")


@query("m05_verification", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT least(400, greatest(1, CAST(floor(0.08 * (SELECT count(*) FROM orders)) AS BIGINT)))")
def _(s, d):
    return S.verification_sample(table(s, d, "orders").select("o_orderkey"), S.hash_order(42, "o_orderkey"))


@query("m06_calibration_split", f"WITH o AS (SELECT *, 250 AS goal FROM orders), t AS {taken('o', 'o_orderpriority', 'goal')} SELECT o_orderkey, o_orderpriority, CASE WHEN place % 2 = 1 THEN 'anchored' ELSE 'blind' END AS condition FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place FROM orders) JOIN t USING (o_orderpriority) WHERE place <= take")
def _(s, d):
    return S.split_in_halves(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 250, S.hash_order(42, "o_orderkey"))


@query("m07_decoys", f"WITH {PAIRS}, x AS (SELECT clip_id, gt, CAST('0x' || substr(md5('5|' || clip_id), 1, 13) AS BIGINT) % 1000000 AS p, CAST('0x' || substr(md5('6|' || clip_id), 1, 13) AS BIGINT) % 1000000 AS q, list_filter(['A1','A2','B1','C1','F1'], lambda c: c <> gt) AS wrong FROM pairs) SELECT clip_id, gt, wrong[q % len(wrong) + 1] AS shown FROM x WHERE p < 100000")
def _(s, d):
    return S.decoys(pairs(s, d).select("clip_id", "gt"), "clip_id", "gt", ["A1", "A2", "B1", "C1", "F1"])


@query("m08_role_assign", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE p <= greatest(20, n // 4)")
def _(s, d):
    return S.audit_sample(table(s, d, "orders"), ["o_orderstatus"], [F.col("o_orderkey")], 0.25, 20).select("o_orderkey")


@query("m09_simple_assign", f"WITH {PAIRS}, r AS (SELECT clip_id, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS route, row_number() OVER (ORDER BY clip_id) - 1 AS p FROM pairs) SELECT clip_id, 'w' || ((p + c) % 4) AS worker FROM r CROSS JOIN (VALUES (0), (1)) t(c) WHERE route = 'low' OR (route = 'medium' AND c = 0)")
def _(s, d):
    r = S.numbered(pairs(s, d).select("clip_id", C.route(F.col("confidence")).alias("route")), F.floor(F.col("clip_id") / 1000), [F.col("clip_id")])
    workers = ["w0", "w1", "w2", "w3"]
    return S.in_turn(r.where("route = 'low'"), workers, "place", 2).unionByName(S.in_turn(r.where("route = 'medium'"), workers, "place")).select("clip_id", "worker")


@query("t01_topk", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("t03_argbest", "SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS clip_id FROM (SELECT *, min(l_partkey % 90) OVER (PARTITION BY l_suppkey) AS best FROM lineitem) WHERE l_partkey % 90 = best GROUP BY l_suppkey")
def _(s, d):
    return clips(s, d).groupBy("l_suppkey").agg(F.min_by("clip_id", F.struct("noise", "clip_id")).alias("clip_id"))


@query("t04_chunks", "SELECT p // 100 AS chunk, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1")
def _(s, d):
    n = S.numbered(table(s, d, "orders").select("o_orderkey"), F.floor(F.col("o_orderkey") / 1000), [F.col("o_orderkey")])
    return n.groupBy(F.floor(F.col("place") / 100).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("u05_set_algebra", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))), ',') AS even, len(list_intersect(list(event_type) FILTER (event_id % 2 = 0), list(event_type) FILTER (event_id % 2 = 1))) AS common FROM events GROUP BY user_id")
def _(s, d):
    side = lambda k: F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type")))
    return table(s, d, "events").groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b")).select("user_id", F.array_join(F.array_sort("a"), ",").alias("even"), F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


@query("p01_tier", f"WITH {CLIPS} SELECT clip_id, qty, array_to_string(list_filter([CASE WHEN disc < 4 THEN 'detection_ratio' END, CASE WHEN tax < 2 THEN 'bbox_area' END, CASE WHEN qty < 10 THEN 'confidence' END, CASE WHEN duration < 8 THEN 'duration' END], lambda x: x IS NOT NULL), '|') AS reasons, CASE WHEN disc < 4 OR tax < 2 OR qty < 10 OR duration < 8 THEN 'B' ELSE 'A' END AS tier FROM clips")
def _(s, d):
    f = C.gate_failures(F.col("disc"), F.col("tax"), F.col("qty"), F.col("duration"), 4, 2, 10, 8)
    return clips(s, d).select("clip_id", "qty", F.concat_ws("|", f).alias("reasons"), C.tier(f).alias("tier"))


TAGS = f"""WITH {CLIPS}, t AS (SELECT clip_id, qty, list_filter([CASE WHEN intensity >= 0 AND intensity < 60 THEN 'low_light' END, CASE WHEN noise > 60 THEN 'low_quality' END, CASE WHEN most > 0 AND least = 0 AND disc BETWEEN 3 AND 6 THEN 'occlusion_dynamic' END, CASE WHEN tax > 0 AND tax < 3 THEN 'distant_scene' END], lambda x: x IS NOT NULL) AS deg, most FROM clips),
  u AS (SELECT clip_id, qty, list_concat(deg, list_filter([CASE WHEN most >= 2 THEN 'multi_worker' END, CASE WHEN len(deg) >= 2 THEN 'multi_degradation' END], lambda x: x IS NOT NULL)) AS tags FROM t)"""


def tagged(s, d):
    c = clips(s, d)
    tags = C.condition_tags(F.col("intensity"), F.col("noise"), F.col("least"), F.col("most"), F.col("disc") / 10, F.col("tax") * 0.004)
    return c.select("clip_id", "qty", tags.alias("tags"))


@query("p02_tags", TAGS + " SELECT clip_id, qty, CASE WHEN len(tags) = 0 THEN 'clean' ELSE array_to_string(tags, ',') END AS tags FROM u")
def _(s, d):
    return tagged(s, d).select("clip_id", "qty", F.concat_ws(",", "tags").alias("tags"))


@query("p03_severity", TAGS + " SELECT clip_id, qty, CASE WHEN list_contains(tags, 'multi_degradation') THEN 4 WHEN list_contains(tags, 'occlusion_dynamic') THEN 3 WHEN list_has_any(tags, ['low_light','low_quality','distant_scene']) THEN 1 ELSE 0 END AS severity FROM u")
def _(s, d):
    return tagged(s, d).select("clip_id", "qty", C.severity(F.col("tags")).alias("severity"))


@query("p07_clip_id", f"WITH {CLIPS} SELECT clip_id, qty, 'clip_cam' || l_suppkey || '_' || replace(date, '-', '') || '_' || CASE WHEN start_sec < 36000 THEN '0' ELSE '' END || CAST(start_sec // 3600 AS VARCHAR) || lpad(CAST(start_sec % 3600 // 60 AS VARCHAR), 2, '0') || lpad(CAST(start_sec % 60 AS VARCHAR), 2, '0') || '_' || lpad(CAST(qty AS VARCHAR), 4, '0') AS name FROM clips")
def _(s, d):
    name = C.segment_id(F.concat(F.lit("cam"), F.col("l_suppkey").cast("string")), F.col("date"), F.col("start_sec"), F.col("qty"))
    return clips(s, d).select("clip_id", "qty", name.alias("name"))


@query("p08_position_bucket", f"WITH {CLIPS} SELECT clip_id, qty, CASE WHEN 2 * noise + 20 < 80 THEN 'left' WHEN 2 * noise + 20 < 160 THEN 'center' ELSE 'right' END AS position, CASE WHEN disc * 10 > 30 THEN 'foreground' ELSE 'background' END AS depth FROM clips")
def _(s, d):
    return clips(s, d).select("clip_id", "qty", C.box_position(F.col("noise"), F.col("noise") + 20, F.lit(120)).alias("position"), C.box_depth(F.lit(0), F.col("disc"), F.lit(10)).alias("depth"))


@query("p13_systematic", "SELECT user_id, event_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 10 = 0")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(s, d, "events").withColumn("p", F.row_number().over(w) - 1).where("p % 10 = 0").select("user_id", "event_id")


@query("p14_offsets", f"WITH {CLIPS} SELECT clip_id, qty, CAST(0 AS BIGINT) AS first, ((qty + 8) - 1) // 3 AS second, (qty + 8) - 1 AS last FROM clips")
def _(s, d):
    p = C.even_places(F.col("qty") + 8, 4)
    return clips(s, d).select("clip_id", "qty", p[0].alias("first"), p[1].alias("second"), p[3].alias("last"))


@query("s12_priority_gt", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) = 1")
def _(s, d):
    return S.by_priority(table(s, d, "orders"), ["o_custkey"], "o_orderstatus", ["P", "F"], F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("k06_update_in_place", "SELECT c_custkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(s, d):
    from framescope.sources.files import updated

    changes = table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return updated(table(s, d, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey")
