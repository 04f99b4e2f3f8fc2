"""Readiness, model health, open vocabulary, safety reviews and rewritten tables on small hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.operators import readiness, reports, rules
from framescope.operators import selection as S
from framescope.sources import files

RECORDS = "clip_id int, annotator_id string, role string, status string, source string, condition string, n_people int"


def checks(spark, rows):
    return {r.check: (r.have, r.passed) for r in readiness.report(spark.createDataFrame(rows, RECORDS)).collect()}


def test_readiness_counts_sets_of_clips(spark):
    rows = [
        (1, "a", "tier_1", "submitted", "vlm", "blind", 2), (1, "b", "tier_1", "submitted", None, None, 5), (1, "e", "tier_2", "submitted", "tier_1", None, 3),
        (2, "a", "tier_1", "skipped", "vlm", "blind", 1), (2, "e", "tier_2", "submitted", "vlm", None, 1),
        (3, "a", "tier_1", "submitted", None, "anchored", 0), (3, "e", "tier_2", "submitted", "tier_1", None, 0),
        (4, "e", "tier_2", "submitted", "tier_1", None, 4), (4, "s", "tier_3", "submitted", None, None, None),
        (5, "a", "tier_1", "submitted", None, "blind", 3), (5, "e", "tier_2", "submitted", "tier_1", None, None),
        (None, None, None, None, None, None, None),
    ]
    got = checks(spark, rows)
    have = {k: n for k, (n, _) in got.items()}
    assert have == {
        "proper_chain": 4, "blind_pairs": 1, "blind_clips": 2, "blind_with_expert": 2, "direction_clips": 3, "direction_people": 3, "officer_reviews": 1,
        "tier_1_clips": 3, "expert_clips": 5, "either": 5, "model_sourced": 1, "anchored_clips": 1, "pairs": 1,
    }
    assert got["proper_chain"][1] is False and got["pairs"][1] is None
    assert {n for n, _ in checks(spark, []).values()} == {0}
    lower = readiness.report(spark.createDataFrame(rows, RECORDS), {"proper_chain": 4, "pairs": 2})
    assert {r.check: r.passed for r in lower.collect() if r.passed is not None} == {"proper_chain": True, "pairs": False}


def test_model_health(spark):
    log = spark.createDataFrame([(1, True, None), (1, False, "Timeout"), (2, False, "parse"), (2, True, None), (3, False, None), (4, None, "x")], "clip_id int, success boolean, error string")
    issues = spark.createDataFrame([(1, "a=1"), (1, "a=2"), (1, "b"), (3, "c")], "clip_id int, issue string")
    truth = spark.createDataFrame([(1,), (1,), (9,)], "clip_id int")
    got = {(r.kind, r.value): r.n for r in reports.model_health(log, truth, issues, C.failure_kind(F.col("error"))).collect()}
    assert got == {("records", None): 6, ("succeeded", None): 2, ("flawed", None): 1, ("clean", None): 1, ("wanted", None): 2, ("covered", None): 1, ("issue", "a"): 2, ("issue", "b"): 1, ("failure", "timeout"): 1, ("failure", "parse_fail"): 1, ("failure", "unknown"): 1, ("failure", "other"): 1}


def test_unlisted_actions(spark):
    people = spark.createDataFrame([(1, "X1", "B1"), (1, "X1", None), (2, "A1", "B1"), (3, None, None), (4, "X1", "B1")], "clip_id int, code string, closest string")
    got = {r.closest: (r.people, r.clips, r.coverage) for r in reports.unlisted_summary(people).collect()}
    assert got == {None: (3, 2, 0.5), "B1": (2, 2, None)}
    none = reports.unlisted_summary(people.where("false")).collect()
    assert [(r.people, r.clips, r.coverage) for r in none] == [(0, 0, None)]


def test_review_rollup_leaves_nulls_out(spark):
    rows = spark.createDataFrame([("r1", "ok", "compliant", True, None), ("r1", "ok", None, False, "dark"), ("r2", None, "partial", None, "dark")], "rule_id string, status string, overall string, agrees boolean, discard string")
    got = {(r.kind, r.value, r.status): r.n for r in reports.review_rollup(rows).collect()}
    assert got == {("rule", "r1", "ok"): 2, ("overall", "compliant", None): 1, ("overall", "partial", None): 1, ("agreement", "agree", None): 1, ("agreement", "disagree", None): 1, ("discard", "dark", None): 2}


def test_most_frequent_of_each_kind(spark):
    counts = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 3), ("b", "x", 1)], "kind string, value string, n long")
    assert sorted((r.kind, r.value, r.place) for r in reports.top_of_each(counts, "kind", 2).collect()) == [("a", "y", 1), ("a", "z", 2), ("b", "x", 1)]


def test_flagged_people_and_messages(spark):
    df = spark.createDataFrame([([("A1", " none_visible"), ("B1", " climbs "), (None, None), ("C1", "x")],), ([],), (None,)], "p array<struct<action_code: string, unsafe_act: string>>")
    got = [[tuple(p) for p in r.x] for r in df.select(rules.flagged_people(F.col("p")).alias("x")).collect()]
    assert got == [[("P2", "B1", "climbs"), ("P4", "C1", "x")], [], []]
    text = spark.range(1).select(rules.messages(F.lit('S "1"'), F.lit("r1: a\nr2: b"), F.lit(8)).alias("m")).first().m
    assert json.loads(text) == [{"role": "system", "content": 'Rules of S "1":\nr1: a\nr2: b'}, {"role": "user", "content": "Look at 8 frames."}]


def test_tables_are_rewritten_and_recovered(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    files.rewrite(spark, path, lambda rows: rows.where("id > 1"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that ended between the renames
    files.rewrite(spark, path, lambda rows: rows.where("id > 2"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]

    def broken(rows):
        raise ValueError("no")

    with pytest.raises(ValueError):
        files.rewrite(spark, path, broken)
    assert spark.read.parquet(path).count() == 2


def test_files_by_kind(spark, tmp_path):
    for name in ("b/x.MP4", "a/y.mkv", "a/z.txt", "c.avi", "mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = [r.path.rsplit("/", 1)[1] for r in files.find_kinds(spark, str(tmp_path)).collect()]
    assert found == ["y.mkv", "x.MP4", "c.avi"]


def test_novel_rows_of_a_bucket(spark):
    rows = [("p", 1, 1, "a", "u"), ("p", 2, 2, "a", "u"), ("p", 3, 9, "b", "u"), ("p", 4, 5, "a", "v"), ("q", 5, 1, None, None), ("q", 6, 2, None, "u"), (None, 7, 1, "a", "u")]
    df = spark.createDataFrame(rows, "k string, id int, quality int, x string, y string")
    got = {(r.k, r.pick): r.id for r in S.novel(df, ["k"], "quality", {"x": 3, "y": 2}, "id").collect()}
    assert got == {("p", 1): 1, ("p", 2): 3, ("p", 3): 4, ("q", 1): 5, ("q", 2): 6, (None, 1): 7}
    many = spark.range(1000).select(F.lit("p").alias("k"), F.col("id"), (1000 - F.col("id")).alias("quality"), (F.col("id") % 2).alias("x"))
    assert [r.id for r in S.novel(many, ["k"], "quality", {"x": 1}, "id").orderBy("pick").collect()] == [999, 998, 997]


def test_clip_summary_of_awkward_frames(spark):
    from framescope.operators import frames

    rows = [("a", 2, [(0.5, 0.1, "left", "background"), (0.9, 0.3, "center", None)]), ("a", 0, []), ("a", 1, [(None, 0.2, "left", "background")]), ("b", 0, None), (None, 1, [(0.7, 0.4, "right", "foreground")])]
    df = spark.createDataFrame(rows, "clip string, num_persons int, persons array<struct<confidence: double, bbox_area_ratio: double, position_x: string, position_depth: string>>")
    df = df.withColumn("persons", F.col("persons").cast(frames.PEOPLE))
    got = {r.clip: r for r in frames.clip_summary(df, ["clip"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.total_persons, a.min_persons, a.max_persons, a.avg_persons, a.person_detection_ratio) == (3, 0, 2, 1.0, 0.6667)
    assert (a.max_confidence, a.avg_bbox_area_ratio, a.max_bbox_area_ratio, a.min_bbox_area_ratio, a.person_positions) == (0.9, 0.2, 0.3, 0.1, "background,center,left")
    assert (b.total_persons, b.avg_confidence, b.max_confidence, b.person_positions) == (0, 0.0, 0.0, "") and got[None].person_positions == "foreground,right"
    assert frames.clip_summary(df.where("false"), ["clip"]).collect() == []


def test_gate_reasons_and_phases(spark):
    from framescope.operators import frames

    one = lambda *v: spark.range(1).select(frames.gate_reasons(*map(F.lit, v)).alias("x")).first().x
    assert one(0.4, 0.005, 0.45, 8.0) == []
    assert one(0.316, 0.00412, 0.4444, 7.25) == ["low_presence:0.32<0.4", "small_person:0.0041<0.005", "low_confidence:0.444<0.45", "short_clip:7.3s<8.0s"]
    clips = lambda *k: spark.createDataFrame([(x,) for x in k], "clip_id int")
    assert sorted(r.clip_id for r in frames.phase_clips(clips(1, 2, 2, 3), clips(2)).collect()) == [1, 3]
    assert [r.clip_id for r in frames.phase_clips(clips(1, 2), clips(2), clips(7, 7)).collect()] == [7]
    work = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("c", 9)], "annotator_id string, clip_id int")
    records = spark.createDataFrame([("a", 1, "submitted"), ("a", 2, "submitted"), ("d", 3, "flagged"), ("d", 3, None)], "annotator_id string, clip_id int, status string")
    got = {r.annotator_id: tuple(r)[1:] for r in frames.phase_progress(work, records, clips(1, 3)).collect()}
    assert got == {"a": (2, 1, 0, 0, 50.0), "d": (0, 0, 1, 0, 0.0)}
