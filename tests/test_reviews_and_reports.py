"""Nested records side by side, paths that change, curated batches, raters and reports, on small rows and random ones."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.functions import sql as sql_functions
from framescope.operators import metrics as M
from framescope.operators import rater_report, reports
from framescope.operators import record_diff as D
from framescope.operators import reviews as R
from framescope.operators import selection as S

ROW = f"clip_id long, condition string, model struct<{R.RECORD}>, first struct<{R.RECORD}>, expert struct<{R.RECORD}>"
ITEMS = ("helmet", "high_vis_vest", "welding_protection", "harness", "safety_shoes")


def person(code="A1", tags=(), helmet=None, act=None, level=None):
    return {"action_code": code, "spatial_context": None if tags is None else list(tags), "ppe": {"helmet": helmet}, "occlusion_level": level, "unsafe_act": act}


def record(*people, layer=2, **more):
    return {"annotation_layer": layer, "persons": list(people) if people else more.pop("persons", []), **more}


def rows(spark, *triples, condition="blind"):
    data = [{"clip_id": k, "condition": condition, **dict(zip(("model", "first", "expert"), t, strict=False))} for k, t in enumerate(triples)]
    return spark.createDataFrame([json.dumps(d) for d in data], "string").select(F.from_json("value", ROW).alias("x")).select("x.*")


def test_nothing_to_compare(spark):
    df = rows(spark, (None, None, None), (record(), record(), record()), (record(person()), None, None), (record(persons=None), record(person()), record(person())))
    empty = df.where("false")
    for one in (df, empty):
        assert R.anchoring_by_class(one).collect() == [] and R.direction(one).collect()[0].n == 0
        assert R.degradation(one).collect() == [] and R.class_overrides(one).collect() == []
        assert R.expert_chain(one).first().n == 0 and R.expert_chain(one).first().net_debiasing == 0
        assert rater_report.bundle(rater_report.pairs_of(one, ["model", "expert"])).where("axis = 'scene'").collect() == []
    assert R.clip_safety(empty).first().clips == 0
    assert {r.field for r in R.field_changes(df).collect()} == {"scene_type", "num_workers", "overall_ppe_compliance", "visibility_conditions", "dominant_actions"}


def test_direction_and_chain(spark):
    one = lambda m, t, e: (record(person(m)), record(person(t)), record(person(e)))
    df = rows(spark, one("A1", "A1", "A1"), one("A1", "A1", "B1"), one("A1", "B1", "B1"), one("A1", "B1", "A1"), one("A1", "B1", "C1"), one("A1", "", "A1"), one("A1", None, "A1"), one("A1", "A1", "C1"))
    r = R.direction(df).first()
    assert (r.n, r.productive_anchor, r.harmful_anchor, r.productive_override, r.harmful_override) == (6, 1, 2, 2, 1)
    r = R.expert_chain(df).first()
    assert (r.n, r.kept, r.corrected, r.changed, r.confirmed, r.returned, r.away, r.towards, r.net_debiasing) == (6, 3, 2, 3, 1, 1, 2, 1, 1)
    assert R.direction(df, ["condition"]).first().condition == "blind"


def test_places_that_only_one_side_has(spark):
    df = rows(spark, (record(person("A1"), person("B1")), record(person("A1")), record(person("A1"), person("B1"), person("C1"))))
    assert R.class_overrides(df).collect()[0].n == 1
    people = R.blind_accuracy(df).where("class <> 'all'").collect()
    assert sorted((r["class"], r.n, r.right) for r in people) == [("A1", 1, 1), ("B1", 1, 1)]


def test_anchoring_needs_a_class_that_people_gave(spark):
    shown = rows(spark, *[(record(person("A1")), record(person("A1")))] * 2, *[(record(person("C1")), record(person("B1")))] * 3, condition="anchored")
    blind = rows(spark, (record(person("A1")), record(person("B1"))), (record(person("X1"), layer=1), record(person("X1"), layer=1)))
    got = {(r.level, r.value): (r.anchored, r.anchored_agreed, r.blind, r.blind_agreed, r.bias_points) for r in R.anchoring_by_class(shown.unionByName(blind)).collect()}
    assert got[("all", "")] == (5, 2, 1, 0, 40.0)
    assert got[("class", "A1")] == (2, 2, 1, 0, 100.0) and got[("group", "C")] == (3, 0, 0, 0, 0.0)
    assert ("class", "C1") not in got  # only the model gave it
    assert got[("class", "B1")][:2] == (3, 0)


def test_field_changes_compare_sets_and_given_values(spark):
    a = record(person("A1", ["x", "y", "x"], "worn", level="far"), person("B1", None), visibility_conditions=["dust", "clear"], scene_type="SA")
    b = record(person("A1", ["y", "x"], None, level="near"), person("C1", []), visibility_conditions=["clear", "dust"], scene_type=None)
    got = {(r.field, r.comparable, r.changed) for r in R.field_changes(rows(spark, (b, a))).collect() if r.comparable}
    assert got == {("scene_type", True, True), ("num_workers", True, False), ("overall_ppe_compliance", True, False), ("visibility_conditions", True, False), ("dominant_actions", True, False), ("action_code", True, False), ("action_code", True, True), ("spatial_context", True, False), ("occlusion_level", True, True)}


def test_safety_words(spark):
    df = rows(spark, (record(person(act="Safe")), record(person(act="climbs"))), (record(person(act="climbs")), record(person(act=" none "), scene_unsafe_act="N/A")), (record(person(act="runs")), record(person(act=None), scene_unsafe_act="runs", layer=1)), (record(), record(person(act="x"), layer=1)))
    r = R.clip_safety(df).first()
    assert (r.clips, r.with_violation, r.detected, r.false_safe, r.false_alarm) == (4, 2, 1, 1, 1)


# --- paths ----------------------------------------------------------------------------------------------------------


def brute_paths(a, b, sets, path=""):
    """Differences of two JSON values by plain recursion."""
    if isinstance(a, dict) and (isinstance(b, dict) or b is None) or isinstance(b, dict) and a is None:
        a, b = a or {}, b or {}
        for k in sorted(a.keys() | b.keys()):
            x, y = a.get(k), b.get(k)
            if k in sets:
                x, y = ("|".join(sorted(set(v))) if isinstance(v, list) else v for v in (x, y))
            yield from brute_paths(x, y, sets, f"{path}.{k}" if path else k)
    elif isinstance(a, list) and (isinstance(b, list) or b is None) or isinstance(b, list) and a is None:
        a, b = a or [], b or []
        for k, (x, y) in enumerate(zip(a, b, strict=False)):
            yield from brute_paths(x, y, sets, f"{path}[{k}]")
        if len(a) != len(b):
            yield f"{path}.length", str(len(a)), str(len(b))
    elif json.dumps(a) != json.dumps(b):
        show = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True)
        yield path, show(a), show(b)


def some_json(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.4:
        return r.choice([None, "", "x", "a|b", 1, 2, True, False])
    if kind < 0.75:
        fields = {k: some_json(r, depth - 1) for k in r.sample(["p", "q", "ppe"], r.randint(0, 3))}
        return fields | ({"tags": r.choices(["a", "b", "c"], k=r.randint(0, 4))} if r.random() < 0.5 else {})
    return [some_json(r, depth - 1) for _ in range(r.randint(0, 3))]


def test_paths_of_random_records(spark):
    r = random.Random(12)
    pairs = [({"o": some_json(r, 3)}, {"o": some_json(r, 3)}) for _ in range(300)]
    pairs += [({"o": a}, {"o": a}) for a, _ in pairs[:20]] + [({"tags": ["b", "a", "a"]}, {"tags": ["a", "b"]}), ({"tags": "a"}, {"tags": ["a"]})]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = defaultdict(set)
    for x in D.changed_paths(df, "a", "b", ["k"], ["tags"], depth=7).collect():
        got[x.k].add((x.path, x.before, x.after))
    for k, (a, b) in enumerate(pairs):
        clean = lambda v: json.loads(json.dumps(v))
        assert got[k] == set(brute_paths(clean(a), clean(b), {"tags"})), (a, b)


def test_paths_without_records(spark):
    df = spark.createDataFrame([(1, None, None), (2, "no json", "{}"), (3, None, '{"a": {"b": 1}}'), (4, "{}", '{"a": null}'), (5, "[1]", "[1, 2]")], "k int, a string, b string")
    assert sorted(tuple(r) for r in D.changed_paths(df, "a", "b", ["k"]).collect()) == [(3, "a.b", None, "1"), (5, ".length", "1", "2")]
    assert D.changed_paths(df.where("false"), "a", "b", ["k"]).collect() == []
    deep = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}}', '{"a": {"b": {"c": 2}}}')], "k int, a string, b string")
    assert [tuple(r) for r in D.changed_paths(deep, "a", "b", ["k"], depth=2).collect()] == [(1, "a.b", '{"c":1}', '{"c":2}')]


def test_change_histogram(spark):
    paths = spark.createDataFrame([("persons[0].action",), ("persons[2].action",), ("persons[0].action",), ("scene",)], "path string")
    got = {(r.field, r.place, r.all_places): r.n for r in D.change_histogram(paths).collect()}
    assert got == {("persons.action", 0, False): 2, ("persons.action", 2, False): 1, ("persons.action", None, True): 3, ("scene", None, False): 1, ("scene", None, True): 1}


# --- calibration of overlapping sets --------------------------------------------------------------------------------


def test_sets_overlap_and_each_takes_its_first(spark):
    labels = [(1, 0, "expert", "vlm", None, False, 0.9, True), (1, 1, "expert", "tier_1", None, False, 0.8, False), (1, 2, "annotator", None, "blind", False, 0.7, True), (1, 3, "annotator", None, None, True, 0.1, True), (2, 0, "annotator", "vlm", "blind", True, 0.5, True), (2, 1, None, None, None, None, 0.2, None)]
    df = spark.createDataFrame(labels, "k int, j int, role string, source string, condition string, listed boolean, confidence double, hit boolean").withColumn("confidence", F.col("confidence").cast("decimal(5,2)"))
    marked = df.withColumn("mask", R.provenance_mask(*(F.col(c) for c in ("role", "source", "condition", "listed"))))
    assert [r.mask for r in marked.orderBy("k", "j").collect()] == [12, 6, 1, 1, 0, 0]
    kept = R.first_of_each(marked, "k", "j")
    assert {(r.j, r.mask) for r in kept.collect()} == {(0, 12), (1, 2), (2, 1)}
    got = {r.provenance: (round(r.ece, 6), r.accuracy, r.n) for r in R.calibration_by_set(kept, F.col("hit"), "confidence").collect()}
    assert got == {"gold": (0.1, 1.0, 1), "model_sourced": (0.1, 1.0, 1), "proper_chain": (0.8, 0.0, 1), "blind": (0.3, 1.0, 1)}


# --- curated batches ------------------------------------------------------------------------------------------------


def turns(pools, budget, order):
    """Level filling as it is defined: round by round."""
    out = dict.fromkeys(pools, 0)
    while budget:
        added = 0
        for k in order:
            if budget and out[k] < pools[k]:
                out[k], budget, added = out[k] + 1, budget - 1, added + 1
        if not added:
            break
    return out


def test_levels_are_those_of_rounds():
    r = random.Random(1)
    for _ in range(500):
        pools = {k: r.randint(0, 12) for k in range(r.randint(0, 7))}
        order = r.sample(list(pools), len(pools))
        budget = r.randint(0, 50)
        assert S.fill_levels(pools, budget, order) == turns(pools, budget, order)
    assert S.fill_levels({"a": 10**12, "b": 10**13}, 10**12 + 5, ["b", "a"]) == {"a": (10**12 + 5) // 2, "b": (10**12 + 5) // 2 + 1}


def test_curated_steps():
    pools = {"a": 10, "b": 3, "c": 50}
    takes = S.curated_takes(pools, 20, 40, {"c": 100, "d": 4}, {"c": 5, "z": 9}, least=2, discovery=6)
    assert takes["c"] == {"target": 5, "deficit": 16} and takes["a"] == {"minimum": 2, "deficit": 8} and takes["b"] == {"minimum": 2, "deficit": 1}
    assert takes[None] == {"discovery": 6} and sum(sum(t.values()) for t in takes.values()) == 40
    assert S.curated_takes(pools, 0, 4, {}, {"c": 9})["c"] == {"target": 4}
    first = S.curated_takes({"a": 5, "b": 5}, 0, 1, {"a": 1}, prioritize=("a",))
    assert first["a"] == {"deficit": 1} and first["b"] == {}
    assert S.curated_takes({}, 3, 10, {}) == {None: {"fill": 3}}


def test_curated_rows(spark):
    data = [(k, ["a", "b", "", None][k % 4] if k < 80 else "a") for k in range(100)]
    df = spark.createDataFrame(data, "k int, class string")
    got = S.curated(df, "class", 50, [F.col("k")], least=3, discovery=10).collect()
    assert len(got) == len({r.k for r in got}) == 50
    assert Counter(r.step for r in got) == {"minimum": 6, "discovery": 10, "deficit": 34}
    assert Counter(r["class"] or None for r in got) == {"a": 20, "b": 20, None: 10}
    assert S.curated(df.where("false"), "class", 5, [F.col("k")]).collect() == []
    clash = df.withColumn("step_", F.lit(1))
    assert S.curated(clash, "class", 500, [F.col("k")]).count() == 100


def test_audit_samples_bound_what_they_keep(spark):
    df = spark.createDataFrame([(k, "big" if k < 90 else None if k < 95 else "s") for k in range(100)], "k int, g string")
    got = S.audit_sample(df, ["g"], [F.col("k")], 0.25, 3).collect()
    assert Counter(r.g for r in got) == {"big": 22, None: 3, "s": 3}
    assert S.audit_sample(df.where("false"), ["g"], [F.col("k")], 0.25, 3).collect() == []


# --- raters, resampling, reports, SQL -------------------------------------------------------------------------------


def plain_weighted(pairs):
    cost = lambda a, b: 0 if a == b else 0.5 if a[:1] == b[:1] and a[:1] in set("ABCDEFX") else 1
    n = len(pairs)
    seen = sum(cost(a, b) for a, b in pairs) / n
    x, y = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    chance = sum(cost(a, b) * i * j for a, i in x.items() for b, j in y.items()) / n / n
    return 1.0 if chance == 0 else 1 - seen / chance


def test_weighted_kappa_by_key(spark):
    r = random.Random(7)
    data = [(key, r.choice(["A1", "A2", "B1", "", "zz"]), r.choice(["A1", "A2", "B1", "", "zz"])) for key in "xyz" for _ in range(40)] + [("one", "A1", "A1")]
    df = spark.createDataFrame(data, "key string, a string, b string")
    got = {x["key"]: x.kappa for x in M.weighted_kappa(df, rater_report.half_credit(F.col("a"), F.col("b")), keys=["key"]).collect()}
    for key in "xyz":
        assert got[key] == pytest.approx(plain_weighted([(a, b) for k, a, b in data if k == key]))
    assert got["one"] == 1.0


def test_bundle_of_raters(spark):
    a = record(person("A1", ["walkway"], "worn"), scene_type="SA")
    b = record(person("A2", ["walkway", "elevated"], "worn"), scene_type="MAI")
    df = rows(spark, *[(a, a)] * 4, (b, a), (a, record(scene_type="")), (None, a))
    got = {r.axis: (r.kappa, r.n, r.reached) for r in rater_report.bundle(rater_report.pairs_of(df, ["model", "first"])).collect()}
    assert got["action"][1] == 6 and not got["action"][2]
    assert got["protection"] == (0.8, 6, True)  # four items alike, of the helmet one is unsaid by chance
    assert got["scene"] == (0.0, 5, None)
    few = rater_report.bundle(rater_report.pairs_of(df.limit(3), ["model", "first"])).collect()
    assert {r.axis for r in few} == {"action", "spatial", "protection"}


def test_bootstrap_draws_and_interval(spark):
    limits = [int(x, 16) / 16**4 for x in M._poisson_limits(4)]
    assert limits[0] == pytest.approx(0.3679, abs=1e-4) and limits[1] == pytest.approx(0.7358, abs=1e-4) and limits == sorted(limits) and limits[-1] < 1
    df = spark.range(2000).withColumn("x", (F.col("id") % 4 == 0).cast("int"))
    r = M.bootstrap_mean(df, "x", "id", rounds=100).first()
    assert 0.22 < r.low < 0.245 and 0.255 < r.high < 0.28
    same = M.bootstrap_mean(df.repartition(7), "x", "id", rounds=100).first()
    assert (same.low, same.high) == (r.low, r.high)
    assert M.bootstrap_mean(df.where("false"), "x", "id", rounds=9).first().low is None


def test_histograms_of_one_scan(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 3), ("b", "y", None), ("a", "x", 5)], "site string, camera string, sec int")
    got = {(r.kind, r.value): (r.n, r.sec, r.site_camera) for r in reports.histograms(df, {"site": F.col("site"), "camera": F.col("camera")}, {"sec": F.col("sec")}, {"site": ["camera"]}).collect()}
    assert got[("all", None)] == (5, 11, []) and got[("site", "a")] == (3, 8, ["x"]) and got[("site", None)] == (1, 3, ["x"])
    assert got[("camera", None)][:2] == (1, 2) and got[("site", "b")] == (1, None, ["y"])


def test_tagged_counts(spark):
    df = spark.createDataFrame([("c", ["t", "u"], 1.0), (None, None, None), ("c", [], 3.0)], "cam string, tags array<string>, x double")
    got = {(r.kind, r.value): (r.n, r.x) for r in reports.tagged_counts(df, {"cam": F.col("cam")}, {"tag": F.col("tags")}, {"x": F.col("x")}).collect()}
    assert got == {("all", ""): (3, 2.0), ("cam", "c"): (2, None), ("tag", "t"): (1, None), ("tag", "u"): (1, None)}


def test_sql_functions_equal_the_columns(spark):
    sql_functions.register(spark)
    names = [None, "", "A1", "walking (A1)", "idle.standing", "idle_standing", "[A1] x", "A1 walking", "unlisted", "hot_work_welding", "qq", " b9 ", "Crane", "(z9)", "CRANE.SIGNALLING"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    both = df.select(C.action_code(F.col("n")).alias("a"), F.expr("normalize_action(n)").alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    codes = spark.createDataFrame([(a, b) for a in ("A1", "A2", "C1", "X1", None) for b in ("A1", "B2", "X1")], "a string, b string")
    assert all(r.x == r.y or (r.x is None and r.y is None) for r in codes.select(C.label_distance(F.col("a"), F.col("b")).alias("x"), F.expr("taxonomic_distance(a, b)").alias("y")).collect())
    counts = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (93, 224)], "k int, n int")
    w = C.wilson(F.col("k"), F.col("n"))
    assert all(r.a == pytest.approx(r.x) and r.b == pytest.approx(r.y) for r in counts.select(w["low"].alias("a"), w["high"].alias("b"), F.expr("wilson_low(k, n)").alias("x"), F.expr("wilson_high(k, n)").alias("y")).collect())
    spans = spark.sql("SELECT x.* FROM VALUES (0D, 35D), (0D, 34.9D), (1D, 1D), (5D, 4D) t(a, b), LATERAL slices(t.a, t.b, 15, 5) x").collect()
    assert sorted(tuple(r) for r in spans) == [(0, 15), (0, 15), (15, 30), (15, 30), (30, 35)]
