"""Streams against tables: review queues, health windows, restarts and late rows, on small hand-made rows."""

from __future__ import annotations

import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from framescope.plans import registry, stream_queries
from framescope.streaming import health, resume, review, windows

SAVED = "clip_id long, annotator_id string, status string, unsafe string, suggested string, action string, saved_at long"


def feed(df, folder, order="saved_at", parts=1):
    """The rows as files of a stream, in order."""
    values = sorted(r[0] for r in df.select(order).distinct().collect())
    step = -(-len(values) // parts)
    for k in range(0, len(values), step):
        df.where(F.col(order).isin(values[k : k + step])).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, folder):
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def plain(df):
    return sorted((r.clip_id, r.queue, r.saved_at, r.change, r.reason) for r in df.collect())


def both_ways(df, folder, parts=1):
    """Queue changes of the table, which those of the stream must equal."""
    want = plain(review.changes_of(df))
    assert plain(drain(review.review_changes(feed(df, f"{folder}/in", parts=parts)), folder)) == want
    return want


def test_first_reason_of_a_clip(spark, tmp_path):
    rows = [(1, "a", "submitted", "none", "none", "A1", 1), (1, "b", "submitted", "none", "none", "B1", 2), (2, "a", "flagged", "none", "none", None, 1), (3, "a", "submitted", "x", "none", "A1", 1), (4, "a", "submitted", "none", "none", "A1", 1), (4, "a", "submitted", "none", "none", "B1", 3)]
    changes = both_ways(spark.createDataFrame(rows, SAVED), str(tmp_path), 2)
    assert changes == [(1, "tier_2", 2, "add", "disagreement"), (2, "tier_2", 1, "add", "flagged"), (3, "tier_2", 1, "add", "safety_label_changed")]


def test_scenes_and_critical_clips(spark, tmp_path):
    row = lambda clip, who, at, scene, critical=False, unsafe="none", status="submitted": (clip, who, status, unsafe, unsafe, None, at, scene, critical)
    rows = [row(1, "a", 1, ["x", "y"]), row(1, "b", 2, ["x", "z"]), row(2, "a", 1, ["x", "y"]), row(2, "b", 2, ["y", "x", "z"]), row(3, "a", 1, [], True, "climbs"), row(4, "a", 1, None, True, " None "), row(5, "a", 1, None, False, "climbs")]
    rows += [row(6, "a", 1, ["x"]), row(6, "a", 2, ["y"]), row(6, "b", 3, ["y"]), row(7, "a", 1, []), row(7, "b", 2, []), row(8, "a", 1, []), row(8, "b", 2, ["x"]), row(9, "a", 1, ["x"]), row(9, "c", 2, ["x"]), row(9, "b", 3, ["x"]), row(9, "a", 4, ["y"])]
    df = spark.createDataFrame(rows, SAVED + ", dominant array<string>, critical boolean")
    want = {(1, "scene_disagreement", 2), (3, "safety_critical", 1), (8, "scene_disagreement", 2), (9, "scene_disagreement", 4)}
    assert {(c, why, at) for c, _, at, _, why in both_ways(df, str(tmp_path), 3)} == want


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ("w1 A, w1 B, w2 B", []),  # the first action no longer stands
        ("w1 A, w1 B, w2 A", [(3, "add")]),
        ("w1 A, w2 skip, w1 B", []),
        ("w1 A, w2 B skip", []),
        ("w1 A, w1 B skip, w2 B", []),  # a skipped record replaces what was submitted
        ("w1 A, w2 B, w3 B", [(2, "add")]),  # already there
        ("w1 A, w2 B, e A, w3 B", [(2, "add"), (3, "remove"), (4, "add")]),  # out and in again
        ("w1 A, e B, w2 A", []),  # an expert's record isn't compared
        ("w1 A, w2 B, e A skip", [(2, "add")]),
        ("e A, w1 A", []),  # nothing to leave
    ],
)
def test_overwriting_skipping_and_experts(spark, steps, want):
    rows = []
    for at, step in enumerate(steps.split(", "), 1):
        who, action, *rest = step.split()
        status = "skipped" if "skip" in (action, *rest) else "submitted"
        rows.append((1, who, "tier_2" if who == "e" else "tier_1", status, None, None, None if action == "skip" else action, at))
    df = spark.createDataFrame(rows, "clip_id long, annotator_id string, role string, status string, unsafe string, suggested string, action string, saved_at long")
    assert [(at, change) for _, _, at, change, _ in plain(review.changes_of(df))] == want


def test_officers_queue_and_random_sequences(spark, tmp_path):
    r = random.Random(9)
    rows = []
    for at in range(1, 500):
        who = r.choice(["a", "b", "c", "e", "s"])
        role = {"e": "tier_2", "s": "tier_3"}.get(who, "tier_1")
        acts = r.choice([None, [], ["none"], ["climbs"], ["none_visible"], [None, " None "]])
        rows.append((r.randint(1, 12), who, role, r.choice(["submitted"] * 5 + ["skipped", "flagged", None]), acts, r.choice([acts, acts, None, ["none"]]), r.choice(["A1", "A2", "", None]), r.choice([None, None, [], ["x"], ["x", "y"]]), r.random() < 0.3, at))
    rows.append((None, None, None, None, None, None, None, None, None, 600))
    df = spark.createDataFrame(rows, "clip_id long, annotator_id string, role string, status string, unsafe array<string>, suggested array<string>, action string, dominant array<string>, critical boolean, saved_at long")
    changes = both_ways(df, str(tmp_path), 4)
    assert {(q, c) for _, q, _, c, _ in changes} == {(q, c) for q in ("tier_2", "tier_3") for c in ("add", "remove")}
    for key in {(c[0], c[1]) for c in changes}:
        own = [c[3] for c in changes if c[:2] == key]
        assert own == ["add", "remove"] * (len(own) // 2) + ["add"] * (len(own) % 2)
    assert plain(review.changes_of(df.where("false"))) == []


def test_open_entries_are_those_not_taken_out(spark):
    rows = [(1, "tier_2", "add", "x", "a", 1), (1, "tier_2", "remove", None, "e", 2), (2, "tier_2", "add", "x", "a", 1), (2, "tier_2", "remove", None, "e", 2), (2, "tier_2", "add", "y", "a", 3), (2, "tier_3", "add", "z", "e", 2)]
    changes = spark.createDataFrame(rows, review.CHANGES)
    assert [tuple(r) for r in review.open_entries(changes).collect()] == [(2, "y", 3)]
    assert [tuple(r) for r in review.open_entries(changes, "tier_3").collect()] == [(2, "z", 2)]


def test_count_windows_leave_when_full_or_idle(spark, tmp_path):
    rows = [("a", k, datetime(2024, 1, 1, 0, 0, k), k % 3 == 0) for k in range(7)] + [("b", 3, datetime(2024, 1, 1, 0, 0, 3), None)]
    rows += [("end", 100, datetime(2024, 1, 2), False)]
    df = spark.createDataFrame(rows, "who string, place long, at timestamp, bad boolean")
    stream = feed(df, str(tmp_path / "in"), "place", 4)
    out = drain(health.count_windows(stream, "who", "place", "at", F.col("bad"), 3, "10 minutes", "0 seconds"), str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 3, 1, True), ("a", 1, 3, 1, True), ("a", 2, 1, 1, True), ("b", 0, 1, 0, False)]


def test_windows_and_queues_of_keys_that_share_a_bucket(spark, tmp_path):
    """With one bucket for all: keys without a value, beyond 2^53 and back after a rest; rows without a place tell the time alone."""
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = [(2**53 + 1, 0, at(0), True), (None, 1, at(1), False), (2**53, 2, at(2), False), (None, None, at(15), None), (None, None, at(16), None), (2**53 + 1, 3, at(20), False), (2**53, 4, at(21), True), (None, None, at(50), None)]
    df = spark.createDataFrame([(*row, part) for part, row in enumerate(rows)], "who long, place long, at timestamp, bad boolean, part int")
    stream = feed(df, str(tmp_path / "in"), "part", 8)
    out = drain(health.count_windows(stream, "who", "place", "at", F.col("bad"), 2, "10 minutes", "0 seconds", buckets=1), str(tmp_path))
    want = [(None, 0, 1, 0), (2**53, 0, 1, 0), (2**53, 1, 1, 1), (2**53 + 1, 0, 1, 1), (2**53 + 1, 1, 1, 0)]
    assert sorted((r.who or 0, r.window, r.n, r.failed) for r in out.collect()) == [(who or 0, *x) for who, *x in want]

    texts = lambda clip, who, action, k: (clip, who, "submitted", None, None, action, k)
    saved = [texts(2**53, "a", "A1", 1), texts(2**53 + 1, "b", "A2", 2), texts(None, "a", "A1", 3), texts(2**53 + 1, "a", "A1", 4), texts(None, "b", "A1", 5)]
    stream = feed(spark.createDataFrame(saved, SAVED), f"{tmp_path}/saved", parts=3)
    assert plain(drain(review.review_changes(stream, buckets=1), f"{tmp_path}/queues")) == [(2**53 + 1, "tier_2", 4, "add", "disagreement")]


def test_parts_keep_their_borders_in_many_files(spark, tmp_path):
    """Parts of few rows or none still come as batches of their own, each from as many files as there are shuffle partitions."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(0, "a"), (1, None), (90, "b"), (90, "b")]
    stream = stream_queries.as_stream(spark.createDataFrame(rows, "k long, v string"), "k", str(tmp_path / "in"), tail=spark.createDataFrame([("c", None)], "v string, k long"))
    seen = []
    stream.writeStream.foreachBatch(lambda batch, number: seen.append(sorted(map(repr, map(tuple, batch.collect()))))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [["(0, 'a')", "(1, None)"], [], ["(90, 'b')", "(90, 'b')", "(None, 'c')"]]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * files


def test_keys_are_called_by_bucket(spark, tmp_path):
    """A call for each key took most of the time of large batches."""
    spark.createDataFrame([(1, "a", "submitted", None, None, "A1", 1)], SAVED).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAVED).parquet(str(tmp_path / "in"))
    windows_of = health.count_windows(stream.withColumn("at", F.timestamp_seconds("saved_at")), "clip_id", "saved_at", "at", F.lit(False), 2, "1 minute", "0 seconds")
    for out in (windows_of, review.review_changes(stream)):
        node = next(x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "TransformWithState" in x)
        assert node.split("transformWithStateUDF(")[1].startswith("bucket")


def test_windows_of_sparse_users(spark, tmp_path):
    """A user who is idle for more than 9,000,000 events, and events without a user, count as in SQL."""
    events = [(0, 1, "error"), (11_000_000, 2, "view"), (13_000_000, 2, "view"), (20_000_000, None, "error"), (36_000_000, 1, "view")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = registry.QUERIES["r08_count_window_stream"](spark, str(tmp_path)).select("user_id", "window", "n", "failed", "alert").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(registry.ORACLES["r08_count_window_stream"]).fetchall()))


class Broken(Exception):
    pass


def test_a_failed_batch_is_written_once(spark, tmp_path):
    df = spark.range(100).withColumn("kind", F.col("id") % 3)
    calls = []

    def fail_once(batch, number):
        calls.append(number)
        if number == 2 and calls.count(2) == 1:
            raise Broken("in the middle of a batch")

    folder = f"file://{tmp_path}/out"
    begin = lambda: resume.start(feed(df, str(tmp_path / "in"), "id", 5) if not calls else spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), folder, ["kind"], F.col("id") % 10 == 0, fail_once)
    with pytest.raises(Exception, match="in the middle"):
        begin().awaitTermination()
    assert calls == [0, 1, 2]
    begin().awaitTermination()
    assert calls == [0, 1, 2, 2, 3, 4]
    assert sorted(r.id for r in resume.rows(spark, folder).collect()) == list(range(100))
    assert {r.kind: (r.n, r.failed) for r in resume.totals(spark, folder).collect()} == {0: (34, 4), 1: (33, 3), 2: (33, 3)}
    begin().awaitTermination()  # nothing new
    assert resume.rows(spark, folder).count() == 100


def test_unfinished_keys(spark):
    wanted = spark.range(4)
    history = spark.createDataFrame([(0, True), (1, False), (1, True), (2, False), (2, None)], "id long, ok boolean")
    assert [r.id for r in resume.unfinished(wanted, history, "id", F.col("ok")).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in resume.unfinished(wanted, history, "id").collect()] == [3]


def test_sliding_windows_leave_late_rows_out(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    df = spark.createDataFrame([(0, at(1)), (1, at(12)), (2, at(40)), (3, at(40)), (4, at(2)), (5, at(55))], "k long, at timestamp")
    stream = feed(df, str(tmp_path / "in"), "k", 6)
    got = drain(windows.sliding(stream, "at", "10 minutes", "5 minutes", [], "5 minutes"), str(tmp_path)).collect()
    closed = {(r.start.minute, r.n) for r in got if r.start.hour == 0}
    assert closed >= {(0, 1), (5, 1), (10, 1), (35, 2), (40, 2)} and (0, 2) not in closed
    every = windows.sliding(df, "at", "10 minutes", "5 minutes", []).collect()
    assert {(r.start.minute, r.n) for r in every if r.start.hour == 0 and r.start.day == 1} >= {(0, 2), (5, 1)}


def test_repeats_within_the_watermark(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = [(0, "a", at(0)), (1, "a", at(3)), (2, "b", at(30)), (3, "c", at(31)), (4, "a", at(32)), (5, "a", at(1)), (6, "b", at(33))]
    df = spark.createDataFrame(rows, "k long, who string, at timestamp")
    got = drain(windows.first_of_key(feed(df, str(tmp_path / "in"), "k", 7), "at", ["who"], "10 minutes"), str(tmp_path)).collect()
    assert sorted(r.k for r in got) == [0, 2, 3, 4]  # 1 and 6 repeat, 5 is late


def test_work_order_of_urgent_entries(spark):
    rows = [("x", 1, "tier_2", "high", "anchored", "audit", True), ("x", 2, "tier_2", "high", "blind", None, None), ("x", 3, "tier_2", None, None, "audit", None), ("x", 4, "tier_2", "normal", None, "expert_gold", False), ("y", 5, "tier_1", "urgent", None, None, None), ("y", 6, "tier_1", "high", None, None, None)]
    df = spark.createDataFrame(rows, "who string, k int, role string, priority string, condition string, task string, reviewed boolean")
    got = review.work_order(df, "who", "k").orderBy("who", "place").collect()
    assert [(r.who, r.k, r.band) for r in got] == [("x", 2, 0), ("x", 1, 1), ("x", 4, 2), ("x", 3, 5), ("y", 5, 6)]
