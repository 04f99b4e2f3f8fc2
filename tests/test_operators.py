"""Operators on small hand-made rows: edges of intervals, bins, allocation, files and queues."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import intervals as I
from framescope.operators import metrics as M
from framescope.operators import selection as S
from framescope.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def timeline(spark, flags, step=1):
    return spark.createDataFrame([("v", k * step, f) for k, f in enumerate(flags)], "v string, t int, f boolean")


@pytest.mark.parametrize(
    ("flags", "want"),
    [([], []), ([False, False], []), ([True], [(0, 0)]), ([False, True, True], [(1, 2)]), ([True, False, True, False], [(0, 1), (2, 3)])],
)
def test_islands(spark, flags, want):
    rows = I.islands(timeline(spark, flags), "v", "t", "f").collect()
    assert sorted((r["start"], r["end"]) for r in rows) == want


def intervals(spark, *pairs):
    return spark.createDataFrame([("v", float(a), float(b)) for a, b in pairs], "v string, start double, end double")


def spans(df, a="start", b="end"):
    return sorted((r[a], r[b]) for r in df.collect())


def test_merge_pad_slice(spark):
    assert spans(I.merge_close(intervals(spark, (0, 1), (6, 7), (12.5, 13)), "v", 5)) == [(0, 7), (12.5, 13)]
    assert spans(I.pad(intervals(spark, (1, 9)), 2, 0, 10)) == [(0, 10)]
    assert spans(I.slice_fixed(intervals(spark, (0, 35)), 15, 5), "slice_start", "slice_end") == [(0, 15), (15, 30), (30, 35)]
    assert spans(I.slice_fixed(intervals(spark, (0, 34.9)), 15, 5), "slice_start", "slice_end") == [(0, 15), (15, 30)]


def test_ranges_hold_both_ends(spark):
    segments = spark.createDataFrame([("v", 0, 15), ("v", 15, 30)], "v string, slice_start int, slice_end int")
    assert I.within(timeline(spark, [True] * 31), segments, "v", "t", 10).count() == 32
    targets = spark.createDataFrame([("v", 5), ("v", 100)], "v string, at int")
    got = {r["at"]: r["nearest"] for r in I.nearest(timeline(spark, [True] * 3, 5), targets, "v", "t", "at").collect()}
    assert got == {5: 5, 100: 10}


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "gt string, pred string, confidence double")


def test_bins_at_their_edges(spark):
    p = pairs(spark, *[("A1", "A1", c) for c in (0.0, 0.1, 0.3, 0.7, 0.95, 1.0)])
    bins = lambda closed: sorted(r["bin"] for r in M.calibration_bins(p, closed=closed).collect() for _ in range(r["n"]))
    assert bins("left") == [0, 1, 3, 7, 9, 9]
    assert bins("right") == [0, 0, 2, 6, 9, 9]


def test_kappa_degenerate(spark):
    k = lambda *rows: [r["kappa"] for r in M.kappa(spark.createDataFrame(rows, "a string, b string")).collect()]
    assert k(("x", "x"), ("x", "x")) == [1.0]
    assert k(("x", "y"), ("x", "y")) == [0.0]
    assert k(("x", "x"), ("y", "y"), ("x", "y"), ("y", "x")) == [0.0]


def test_wilson_and_bins_without_rows(spark):
    w = one(spark, C.wilson(F.lit(0), F.lit(0)))
    assert (w["low"], w["high"]) == (0.0, 0.0)
    w = one(spark, C.wilson(F.lit(93), F.lit(224), True))
    assert w["low"] == pytest.approx(0.353, abs=1e-3) and w["high"] == pytest.approx(0.481, abs=1e-3)


def test_allocation():
    assert S.allocate({"a": 100, "b": 100}, 50) == {"a": 25, "b": 25}
    assert sum(S.allocate({"a": 997, "b": 2, "c": 1}, 10, floor=1).values()) == 10
    assert S.allocate({"a": 5, "b": 3}, 100) == {"a": 5, "b": 3}
    assert S.allocate({"a": 50, "b": 50}, 20, cap=8) == {"a": 8, "b": 8}
    assert S.allocate({}, 10) == {}


def test_numbered_is_the_global_order(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "k int").repartition(7)
    got = S.numbered(df, F.floor(F.col("k") / 10), [F.col("k")]).collect()
    assert all(r["place"] == r["k"] for r in got) and len(got) == 101


@pytest.mark.parametrize(
    ("text", "want"),
    [("A1", "A1"), ("walking (A1)", "A1"), ("idle.standing", "F1"), ("idle_standing", "F1"), ("[A1] x", "[A1] x"), ("A1 walking", "A1"), ("unlisted", "X1"), ("hot_work_welding", "B3"), ("", ""), ("qq", "qq")],
)
def test_action_codes(spark, text, want):
    assert one(spark, C.action_code(F.lit(text))) == want


@pytest.mark.parametrize(("raw", "want"), [("87", 0.87), ("0.9", 0.9), ("high", 0.5), ("-1", 0.0), ("250", 1.0)])
def test_confidence(spark, raw, want):
    assert one(spark, C.confidence(F.lit(raw))) == pytest.approx(want)


def test_json_in_text(spark):
    for text in ('{"a": 1}', 'x ```json\n{"a": 1}\n``` y', '```\n{"a": 1}\n```', 'well {"a": 1} then'):
        assert one(spark, F.get_json_object(C.json_in_text(F.lit(text)), "$.a")) == "1"
    assert one(spark, C.json_in_text(F.lit("nothing {here"))) is None


def test_label_distance_and_routes(spark):
    d = lambda a, b: one(spark, C.label_distance(F.lit(a), F.lit(b)))
    assert (d("A1", "A1"), d("A1", "A2"), d("A1", "B1")) == (0.0, 0.33, pytest.approx(0.6))
    assert d("A1", "X1") == 1.0
    assert [one(spark, C.route(F.lit(x))) for x in (0.8, 0.5, 0.49)] == ["high", "medium", "low"]
    assert one(spark, C.route(F.lit(0.1), high=0)) == "low"


def test_match_takes_each_once(spark):
    a, b = (F.array(*map(F.lit, x)) for x in ([1, 1, 2], [2, 1]))
    assert one(spark, S.match_people(a, b, lambda x, y: (x == y).cast("int"))) == [1, 0, -1]


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("clip_id,score\nc1,0.5\nc2,\nc3,x\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.csv"), ["score"]).orderBy("clip_id").collect()
    assert [r["score"] for r in rows] == [0.5, None, None]
    assert files.read_manifest(spark, str(tmp_path / "none.csv"), ["score"], ["clip_id", "score"]).count() == 0
    (tmp_path / "p.jsonl").write_text('{"clip_id":"a","success":false,"v":1}\n\n{"clip_id":"a","success":true,"v":2}\nbroken\n{"clip_id":"a","success":true,"v":3}\n{"clip_id":"b","success":false,"v":4}\n')
    got = files.read_predictions(spark, str(tmp_path / "p.jsonl"), "clip_id string, success boolean, v int").collect()
    assert [(r["clip_id"], r["v"]) for r in got] == [("a", 3)]
    for who in ("ann", ".hidden"):
        (tmp_path / "tree" / who).mkdir(parents=True)
        (tmp_path / "tree" / who / "c.json").write_text('{\n"clip_id": "c"}')
    assert [r["annotator_id"] for r in files.read_annotation_tree(spark, str(tmp_path / "tree"), "clip_id string").collect()] == ["ann"]
    tiers = spark.createDataFrame([("c", "A", ["x", "y"], 1)], "clip_id string, tier string, tags array<string>, _private int")
    files.write_tiers(tiers, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["tags"] == "x,y"
    assert files.find_files(spark, str(tmp_path), "*.json").count() == 1  # hidden folders are left out
    files.write_json_lines(tiers, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 1


def test_segment_ids_keep_long_numbers(spark):
    name = lambda sec, n: one(spark, C.segment_id(F.lit("c"), F.lit("2024-01-02"), F.lit(sec), F.lit(n)))
    assert name(3661, 7) == "clip_c_20240102_010101_0007"
    assert name(360000, 7) == "clip_c_20240102_1000000_0007"
    assert name(389 * 3600 + 59, 12345) == "clip_c_20240102_3890059_12345"


def test_entry_module():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in e.queries()} or not any(k.startswith("op1_") for k in e.queries())
    assert e.oracle_sql().keys() <= e.queries().keys()
