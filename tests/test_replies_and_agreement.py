"""Repair and checks of replies, agreement of records and samples on small hand-made rows, awkward ones included."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.operators import agreement as G
from framescope.operators import replies as R
from framescope.operators import selection as S
from framescope.sources import files

RECORD = f"struct<scene_type: string, persons: array<struct<{G.PERSON}>>, person: struct<{G.PERSON}>>"


def repaired(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, reply string")
    return [r.fixed for r in rows.select("id", R.repaired(F.col("reply")).alias("fixed")).orderBy("id").collect()]


def test_replies_that_cannot_be_read_are_null(spark):
    assert repaired(spark, None, "", "no json", "[1]", '{"a": broken') == [None] * 5


def test_reply_forms(spark):
    a, b, c, d = repaired(
        spark,
        '{"scene_type": "multi", "workers": {"Action Code": "A1", "ppe": {"Hard Hat": "yes", "helmet": "no"}, "made_up": 1}}',
        '{"persons": [null, 3, {"primary_action": "walk", "confidence": "87", "spatial_context": "walkway", "coordinated_with": 2}]}',
        '{"workers": "many", "num_workers": 4}',
        '{"workers": [], "persons": [{"id": "P1"}]}',
    )
    assert (a.scene_type, a.total_workers, a.persons[0].action_code, a.persons[0].ppe) == ("MAI", 1, "A1", {"helmet": "absent"})
    p = b.persons[0]
    assert (b.scene_type, len(b.persons), p.action_class, p.confidence, p.spatial_context, p.coordinated_with) == ("SA", 1, "walk", 0.87, ["walkway"], ["2"])
    assert (c.total_workers, c.persons) == (4, [])
    assert d.persons == []  # workers are given, though empty


def test_defaults_fill_only_what_is_missing(spark):
    rows = spark.createDataFrame([('{"workers": [{"position": "left", "ppe": {}, "unsafe_act": "runs"}]}',)], "reply string")
    p = rows.select(R.repaired(F.col("reply")).alias("x")).select(F.explode("x.persons").alias("p"))
    r = p.select(R.missing_fields(F.col("p")).alias("gaps"), R.filled(F.col("p")).alias("p")).first()
    assert r.gaps == ["action_class", "confidence", "spatial_context", "free_text_description", "group_flag", "occlusion_level"]
    assert (r.p.position, r.p.confidence, r.p.spatial_context, r.p.group_flag, r.p.unsafe_act) == ("left", 0.5, ["ground_level"], "solo", "runs")


def person(code="A1", position="left", act="", tags=("walkway",), helmet="worn"):
    return (code, position, list(tags), (helmet, None, None, None, None), "talk", act, None)


def test_clip_agreement_edges(spark):
    one, alone = person(), person("B1")
    pairs = [
        (1, ("SA", [one], alone), ("sa", [one], alone)),  # equal
        (2, ("SA", None, alone), ("SA-X", [], alone)),  # nobody listed: the scene's own person counts
        (3, ("MAC", [one] * 6, alone), ("MAC", [one], alone)),  # crowded: the scene alone
        (4, (None, [person("A1"), person("A2", "right")], alone), ("SA", [person("A2", "right")], alone)),  # the first one takes the only match
        (5, ("SA", [person(None, None, None, (), None)], alone), ("SA", [person("A1")], alone)),  # nulls
    ]
    rows = spark.createDataFrame(pairs, f"id int, a {RECORD}, b {RECORD}")
    r = {x.id: x for x in G.clip_agreement(rows, "a", "b").collect()}
    assert (r[1].composite, r[1].action, r[1].scene_type, r[1].people, r[1].matched, r[1].layer) == (1.0, 1.0, 1.0, 1.0, 1, 2)
    assert (r[2].matched, r[2].action, r[2].scene_type) == (1, 1.0, 0.5)
    assert (r[3].layer, r[3].matched, r[3].action, r[3].composite, r[3].people) == (1, 0, 0.0, 1.0, round(1 / 6, 4))
    assert (r[4].matched, r[4].action, r[4].scene_type, r[4].people) == (1, 0.5, 0.0, 0.5)
    assert (r[5].action, r[5].spatial, r[5].protection, r[5].safety) == (0.0, 0.0, 0.0, 1.0)
    assert G.clip_agreement(rows.limit(0), "a", "b").count() == 0


def test_crowded_agreement_needs_enough_pairs(spark):
    side = "struct<dominant_actions: array<string>, overall_protection: string, scene_type: string>"
    row = ((["A1"], "compliant", "SA"), (["A1", "B1"], None, "SA"))
    rows = lambda n: spark.createDataFrame([row] * n, f"a {side}, b {side}")
    assert G.crowded_agreement(rows(9), "a", "b").count() == 0
    got = {r.metric: (r.score, r.n, r.reached) for r in G.crowded_agreement(rows(10), "a", "b").collect()}
    assert got == {"dominant_actions": (0.5, 10, False), "overall_protection": (0.0, 10, False), "scene_type": (1.0, 10, True)}


def test_two_level_covers_every_outer_value(spark):
    rows = spark.createDataFrame([(i, "big" if i < 900 else f"s{i % 4}" if i < 990 else None, None if i % 9 == 0 else "xyz"[i % 3]) for i in range(1000)], "id int, site string, grade string")
    order = S.hash_order(1, "id")
    got = S.two_level(rows, "id", "site", "grade", 120, order, 5).toPandas()
    assert len(got) == 120 and got["id"].is_unique and set(got["site"]) == {"big", "s0", "s1", "s2", "s3", None}
    assert S.two_level(rows, "id", "site", "grade", 2000, order, 5).count() == 1000
    assert S.two_level(rows.limit(0), "id", "site", "grade", 10, order, 5).count() == 0
    assert S.two_level(rows, "id", "site", "grade", 0, order, 5).count() == 0


def test_tier_split_fills_what_the_second_tier_lacks(spark):
    rows = lambda n, start: spark.range(start, start + n).withColumn("g", F.col("id") % 3)
    order = S.hash_order(1, "id")
    count = lambda a, b: {r.tier: r["count"] for r in S.tier_split(rows(a, 0), rows(b, 1000), "g", 50, 0.4, order).groupBy("tier").count().collect()}
    assert count(200, 100) == {"A": 30, "B": 20}
    assert count(200, 7) == {"A": 43, "B": 7}
    assert count(200, 0) == {"A": 50}


def test_files_by_size_and_name(spark):
    mb = 1024 * 1024
    rows = spark.createDataFrame([("a/x_main_1.mp4", mb), ("a_main_/x_2.mp4", mb), ("a/x_main_3.mp4", 9 * mb), ("a/x_main_0.mp4", 2 * mb)], "path string, length long")
    assert [r.path for r in files.wanted_files(rows, 1, 2, True, 1).collect()] == ["a/x_main_0.mp4"]
    assert files.wanted_files(rows).count() == 4


def test_quarantine_keeps_every_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    good, bad = files.write_split(rows, F.col("ok"), f"file://{tmp_path}")
    assert [r.id for r in spark.read.parquet(good).collect()] == [1]
    assert sorted(r.id for r in spark.read.parquet(bad).collect()) == [2, 3]


def test_prediction_issues_of_nothing(spark):
    rows = spark.createDataFrame([('{"workers": [{}]}',), (None,)], "reply string").select(R.repaired(F.col("reply")).alias("x"))
    norm = F.when(F.col("x").isNotNull(), R.normalised(F.col("x"), F.transform("x.persons", R.normalised_person)))
    rows = rows.withColumn("n", norm).withColumn("n", F.when(F.col("n").isNotNull(), F.col("n").withField("visibility_conditions", F.lit(None).cast("array<string>"))))
    found = [r.i for r in rows.select(R.prediction_issues(F.col("n"), F.col("x")).alias("i")).collect()]
    assert found[1] == ["no_normalized_output"]
    assert "p[0]_missing_action_code" in found[0] and "p[0]_missing_confidence" in found[0] and "missing_visibility_conditions" in found[0]
