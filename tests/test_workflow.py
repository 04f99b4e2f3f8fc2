"""Assignment, verification samples, alerts, names, requests and folders on small hand-made rows."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import agreement as G
from framescope.operators import assignment as A
from framescope.operators import replies as R
from framescope.operators import reports
from framescope.operators import selection as S
from framescope.sources import files


def clips(spark, n):
    k = F.col("clip_id")
    route = F.when(k % 10 < 5, "low").when(k % 10 < 8, "medium").otherwise("high")
    return spark.range(n).withColumnRenamed("id", "clip_id").select("clip_id", route.alias("route"), F.when(k % 5 > 0, k % 3).cast("string").alias("site"), (k % 4 == 0).alias("unsafe"), (k % 50 == 0).alias("critical"))


def test_roles_get_their_work(spark):
    rows = A.by_role(clips(spark, 1000), ["a", "b", "c"], ["x", "y"], ["s"]).collect()
    by_role = defaultdict(list)
    for r in rows:
        by_role[r.role].append(r)
    first = [r for r in by_role["tier_1"] if not r.double]
    assert sorted(r.clip_id for r in first) == list(range(1000))
    assert max(Counter(r.worker for r in first).values()) - min(Counter(r.worker for r in first).values()) <= 1
    again = [r for r in by_role["tier_1"] if r.double]
    assert 100 < len(again) < 200
    primary = {r.clip_id: r.worker for r in first}
    assert all(r.worker != primary[r.clip_id] for r in again)
    routes = Counter("low" if r.clip_id % 10 < 5 else "medium" if r.clip_id % 10 < 8 else "high" for r in by_role["tier_2"])
    assert routes == {"low": 75, "medium": 45, "high": 50} and len({r.clip_id for r in by_role["tier_2"]}) == 170
    acts = Counter((r.clip_id % 3 if r.clip_id % 5 else "none") for r in by_role["tier_3"] if r.clip_id % 50)
    assert {r.clip_id for r in by_role["tier_3"]} >= set(range(0, 1000, 50)) and all(n >= 2 for n in acts.values())
    assert A.by_role(clips(spark, 0), ["a"], ["x"], ["s"]).collect() == []
    assert len(A.by_role(clips(spark, 30), ["a"], ["x", "y"], ["s"], only_experts=True).collect()) == 60
    everything = A.by_role(clips(spark, 30), ["a"], ["x"], ["s", "t"], officers_see_all=True).where("role = 'tier_3'").collect()
    assert len(everything) == 60 and {r.task for r in everything} == {"safety_verification"}


def test_small_routes_are_audited_whole(spark):
    rows = A.expert_work(clips(spark, 20), ["x"]).collect()
    assert Counter(r.clip_id % 10 >= 8 for r in rows) == {True: 4, False: 16}  # each has at most its least number


def test_routes_without_roles(spark):
    rows = A.by_route(clips(spark, 1000), ["a", "b", "c"]).collect()
    assert Counter(r.task for r in rows) == {"fresh_annotation": 1000, "review_prefill": 300, "verify_consensus": 16}
    two = defaultdict(set)
    for r in rows:
        if r.task == "fresh_annotation":
            two[r.clip_id].add(r.worker)
    assert all(len(w) == 2 for w in two.values())


def test_shuffled_places(spark):
    rows = A.shuffled(spark.range(500).withColumnRenamed("id", "k"), "k", 3).collect()
    assert sorted(r.place for r in rows) == list(range(500))
    again = A.shuffled(spark.range(500).repartition(7).withColumnRenamed("id", "k"), "k", 3).collect()
    assert {r.k: r.place for r in rows} == {r.k: r.place for r in again}


def test_verification_by_strata(spark):
    assert S.in_order_takes({("a",): 100, ("b",): 1, ("c",): 1}, 8) == {("a",): 8, ("b",): 0, ("c",): 0}
    assert S.in_order_takes({(None, 1): 10, ("a", 1): 10, ("a", None): 80}, 10) == {(None, 1): 1, ("a", None): 8, ("a", 1): 1}
    df = spark.createDataFrame([(k, "a" if k < 50 else None) for k in range(100)], "k int, g string")
    got = S.stratified_verification(df, ["g"], [F.col("k")], 0.1, 400).collect()
    assert Counter(r.g for r in got) == {None: 5, "a": 5} and {r.k for r in got} == {0, 1, 2, 3, 4, 50, 51, 52, 53, 54}
    assert S.stratified_verification(df.where("false"), ["g"], [F.col("k")]).collect() == []


def test_alerts(spark):
    rows = [("lazy", "skipped", None)] * 3 + [("lazy", "submitted", 0.9)] * 7 + [("new", "skipped", None)] * 9 + [("unsure", "submitted", 0.4)] * 6 + [("fine", "submitted", None)] * 20 + [("fine", "submitted", 0.5)] * 20
    got = {(r.who, r.alert): r.value for r in reports.annotator_alerts(spark.createDataFrame(rows, "annotator_id string, status string, confidence double")).collect()}
    assert got == {("lazy", "skip_rate"): 0.3, ("unsure", "low_confidence"): 6.0}
    results = spark.createDataFrame([("m", True)] * 4 + [("m", None), ("n", True)], "model string, success boolean")
    assert reports.model_alerts(results).collect() == []
    assert [(r.who, r.value) for r in reports.model_alerts(results.unionByName(results.where("model = 'm' AND success IS NULL"))).collect()] == [("m", 4 / 6)]


def test_field_agreement_and_summary(spark):
    df = spark.createDataFrame([(1, 3, "x", "x"), (2, 2, None, None), (5, None, "y", None), (None, None, None, "z")], "a int, b int, s string, t string")
    got = {r.field: (r.agree, r.disagree, r.missing, r.mean_delta, r.max_delta) for r in reports.field_agreement(df, {"n": (F.col("a"), F.col("b")), "w": (F.col("s"), F.col("t"))}, F.col("a").isNotNull()).collect()}
    assert got == {"n": (1, 2, 1, 2.0, 2.0), "w": (2, 1, 1, None, None)}
    r = reports.summary(spark.createDataFrame([(1,), (3,), (None,)], "x int"), "x").first()
    assert (r.n, r["mean"], r.median, r.deviation, r.least, r.most) == (2, 2.0, 2.0, 1.0, 1, 3)


@pytest.mark.parametrize(
    ("name", "folder", "want"),
    [
        ("Plant_Stock Bin_main_20240102030405.mp4", None, ("Plant", "Stock Bin", "Plant_Stock_Bin", "2024-01-02", "20240102030405")),
        ("Plant_main_20240102030405.mp4", "x", ("Plant", "", "Plant", "2024-01-02", "20240102030405")),
        ("a_main_b_main_20240102.mp4", "x", ("a", "main_b", "a_main_b", "2024-01-02", "20240102")),
        ("20240102_030405_060708_1.mp4", "/v/Plant_Bay 1_20240103@10", ("Plant", "Bay 1", "Plant_Bay_1", "2024-01-02", "20240102")),
        ("20240102030405_1.mp4", "/v/Plant", ("Plant", "", "Plant", "2024-01-02", "20240102030405")),
        ("20240102_1.mp4", "/v/18112025", ("", "", "20240102_1", "2024-01-02", "20240102")),
        ("clip one.mp4", None, ("", "", "clip_one", "", "")),
    ],
)
def test_video_names(spark, name, folder, want):
    r = spark.range(1).select(C.video_parts(F.lit(name), F.lit(folder).cast("string")).alias("x")).first().x
    assert tuple(r) == want


def test_signatures_ignore_the_order_of_keys(spark):
    one = lambda t: spark.range(1).select(C.signature(F.lit(t).cast("string")).alias("x")).first().x
    assert one('{"a": 1, "b": {"d": 2, "c": [1, 2]}}') == one('{"b":{"c":[1,2],"d":2},"a":1}')
    assert one('{"a": [1, 2]}') != one('{"a": [2, 1]}') and len(one("{}")) == 8
    assert one(None) is None and one("no json") is None


@pytest.mark.parametrize("form", files.FORMS)
def test_requests_are_json_and_ids_safe(spark, form):
    df = spark.createDataFrame([("a/b c",)], "k string")
    r = files.batch_requests(df, "k", "m", 2, 'say "hi"', form).first()
    request = json.loads(r.request)
    assert r.custom_id == "a_b_c" and "a_b_c" in request.values()
    assert 'say "hi"' in json.dumps(request, ensure_ascii=False).replace("\\", "")
    with pytest.raises(ValueError):
        files.batch_requests(df, "k", "m", 2, "x", "other")


def test_frames_of_clips(spark, tmp_path):
    for clip, n in (("c1", 8), ("c2", 1)):
        (tmp_path / clip).mkdir()
        for k in range(n):
            (tmp_path / clip / f"f{k}.jpg").write_text("x")
    counts = files.frame_counts(spark, str(tmp_path))
    got = {r.clip: (r.frames, r.complete, r.usable) for r in files.with_frames(spark.createDataFrame([("c1",), ("c2",), ("c3",)], "clip string"), counts, "clip").collect()}
    assert got == {"c1": (8, True, True), "c2": (1, False, False), "c3": (0, False, False)}


def test_active_annotators(spark, tmp_path):
    for who in ("a", "b", ".c"):
        (tmp_path / who).mkdir()
        (tmp_path / who / "x.json").write_text('{"v": 1}')
    read = lambda active: sorted(r.annotator_id for r in files.read_annotation_tree(spark, str(tmp_path), "v int", active).collect())
    assert read(None) == ["a", "b"] and read(["b", ".c"]) == ["b"] and read([]) == []


def test_actions_are_compared_as_codes(spark):
    one = lambda a, b: spark.range(1).select(C.action_agreement(F.lit(a), F.lit(b)).alias("x")).first().x
    assert one("walking (A1)", "A1") == 1.0 and one("locomotion.walking", "A2") == 0.5 and one("", "A1") == 0.0
    row = lambda code: (code, "left", [], (None,) * 5, None, None, None)
    record = f"struct<scene_type: string, persons: array<struct<{G.PERSON}>>, person: struct<{G.PERSON}>>"
    df = spark.createDataFrame([(("SA", [row("walking (A1)")], row("")), ("SA", [row("A1")], row("")))], f"a {record}, b {record}")
    assert G.clip_agreement(df, "a", "b").first().action == 1.0


def test_people_as_rows_equal_the_nested_form(spark):
    texts = [None, "", "x", "[1]", '{"workers": []}', '{"persons": [null, 3, {"Action Code": "A1", "action_code": "B1"}]}', '{"workers": {"id": "P7", "ppe": {"Hard Hat": "yes"}, "industry_specific": false}, "scene_type": "multi", "total_workers": "9"}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, reply string")
    nested = df.select("k", R.repaired(F.col("reply")).alias("x")).where("x is not null").select("k", "x.scene_type", "x.total_workers", F.posexplode_outer("x.persons").alias("place", "p")).collect()
    assert sorted(map(repr, R.people_of(df, "reply", ["k"]).collect())) == sorted(map(repr, nested)) and len(nested) == 3


def test_normal_form_of_a_lone_person(spark):
    reply = '{"scene_type": "multi", "workers": [{"action_code": "X1", "group_flag": "coordinated", "coordinated_with": ["P2"], "closest existing label": "B1", "industry_specific": "false", "taxonomy_layer": 5}], "action_transition": {"detected": true, "transitions": [{"a": 1}]}, "visibility": "harsh"}'
    df = spark.createDataFrame([(1, reply), (2, None), (3, "{}")], "k int, reply string")
    rows = {r.k: r.norm for r in R.with_norm(R.with_once(df, "fixed", R.repaired(F.col("reply")))).collect()}
    n = rows[1]
    p = n.persons[0]
    assert (n.scene_type, n.num_workers, n.visibility, n.visibility_conditions, n.action_transition.detected) == ("SA", 1, "harsh", ["harsh"], True)
    assert (p.person_id, p.group_flag, p.coordinated_with, p.taxonomy_layer) == ("P1", "solo", [], 2)
    assert (p.unlisted_action.closest_existing_class, p.unlisted_action.industry_specific) == ("B1", False)
    assert rows[2] is None
    assert (rows[3].scene_type, rows[3].num_workers, rows[3].persons, rows[3].visibility_conditions, rows[3].action_transition.detected) == ("SA", 0, [], ["clear"], False)


def test_stamps_of_repair(spark):
    from framescope.operators import validation as V
    from framescope.plans.label_queries import records

    df = records(spark, "/root/testdata/sf0.001")
    at = datetime(2024, 1, 1)
    rows = V.repaired(df, at=F.lit(at)).collect()
    changed = [r for r in rows if r.repair]
    assert changed and all(r.repaired_at is not None and r.record.bonus_per_person and r.record.annotation_layer == 1 for r in changed)
    assert all(r.repaired_at is None for r in rows if not r.repair)
    assert sorted(map(repr, (r.record for r in V.repaired(df).collect()))) == sorted(map(repr, (r.record for r in rows)))
