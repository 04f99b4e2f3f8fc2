"""Work that costs much a row: dealt out to all tasks, however few row groups a file has, and done once a row."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from framescope.operators import record_diff as D
from framescope.operators import replies as R
from framescope.plans import registry, reply_queries, review_queries

DIR = "/root/testdata/sf0.001"


def tasks(rows) -> int:
    return rows.rdd.getNumPartitions()


def test_records_are_spread_over_tasks(spark):
    assert tasks(review_queries.table(spark, DIR, "orders")) == 1
    assert tasks(review_queries.reviews(spark, DIR).select("clip_id")) >= 2 * spark.sparkContext.defaultParallelism


def test_paths_are_taken_apart_once_a_row(spark):
    plan = review_queries.changes(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") <= 2  # one generator for each level before, and the records built in the filter too


def test_kinds_of_values_and_sets_of_paths(spark):
    same = [({"a": 1}, {"a": 1.0}), ({"t": ["x", "y", "y"]}, {"t": ["y", "x"]}), ({"t": ["x"]}, {"t": "x"}), ({"a": {"b": None}}, {}), ({"a": []}, {})]
    rows = [(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(same)]
    rows += [(10, '{"a": 1}', '{"a": "1"}'), (11, '{"a": true}', '{"a": 1}'), (12, '{"a": 1, "a": 2}', '{"a": 2}'), (13, '{"a": NaN}', '{"a": [{"é": "\\ud800"}]}'), (14, '{"t": {"u": 1}}', '{"t": ["u"]}')]
    got = {(r.k, r.path, r.before, r.after) for r in D.changed_paths(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b", ["k"], ["t"]).collect()}
    assert {x[:3] for x in got if x[0] == 13} == {(13, "a.length", "0")}
    assert {x for x in got if x[0] != 13} == {(10, "a", "1", "1"), (11, "a", "true", "1"), (12, "a", None, "2"), (14, "t", '{"u":1}', "u")}


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_spread_over_tasks(spark):
    assert tasks(reply_queries.replies(spark, DIR)) >= 2 * spark.sparkContext.defaultParallelism


def test_model_health_works_issues_out_once(spark):
    assert plan_of(registry.QUERIES["v09_model_health"](spark, DIR)).count("no_normalized_output") == 1


def test_unlisted_people_are_worked_out_once(spark):
    assert plan_of(registry.QUERIES["a36_unlisted"](spark, DIR)).count("explode(array(from_json") <= 2


def test_only_fields_that_are_asked_for(spark):
    rows = reply_queries.replies(spark, DIR)
    whole, part = (R.people_of(rows, "reply", ["clip_id"], f) for f in (None, ["confidence"]))
    assert part.select("p.*").columns == ["confidence"]
    key = lambda df: sorted(map(repr, df.select("clip_id", "place", F.col("p").isNull(), "p.confidence").collect()))
    assert key(whole) == key(part)


def test_scenes_without_their_people(spark):
    rows = reply_queries.replies(spark, DIR)
    scenes = R.scenes_of(rows, "reply", ["clip_id"])
    fields = [f"norm.{f}" for f in scenes.schema["norm"].dataType.names]
    whole = reply_queries.norms(spark, DIR).where("norm is not null")
    assert sorted(map(repr, scenes.select("clip_id", *fields).collect())) == sorted(map(repr, whole.select("clip_id", *fields).collect()))
