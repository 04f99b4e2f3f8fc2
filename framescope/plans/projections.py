"""The roles of the annotation domain, played by the test tables; in Spark and, as views by name, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt out by key to all tasks, before work that costs much a row: a file may have but one row group."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Predictions against truth, from orders."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    codes = F.array(*map(F.lit, ("A1", "A2", "B1", "C1", "F1")))
    gt = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        k.alias("clip_id"),
        F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"),
        F.element_at(codes, gt).alias("gt"),
        F.element_at(codes, F.when(k % 4 == 0, gt % 5 + 1).otherwise(gt)).alias("pred"),
        (((k * 7 + c) % 101) / F.lit(100).cast("decimal(5,2)")).cast("decimal(5,2)").alias("confidence"),
        F.when(c % 5 == 0, "none").otherwise("no helmet").alias("gt_unsafe"),
        F.when((c + k) % 6 == 0, "None").otherwise("no helmet").alias("pred_unsafe"),
        F.array(F.element_at(F.array(*map(F.lit, ("clear", "dust", "smoke", "rain"))), (k % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("glare", "clear"))), (c % 2 + 1).cast("int"))).alias("conditions"),
        (k % 6).alias("gt_count"),
        (c % 6).alias("pred_count"),
        F.element_at(F.array(*map(F.lit, ("anchored", "blind", "contaminated"))), (c % 3 + 1).cast("int")).alias("condition"),
    )


PAIRS = """pairs AS (SELECT o_orderkey AS clip_id, 'm' || (o_custkey % 3) AS model,
  (['A1','A2','B1','C1','F1'])[CAST(substr(o_orderpriority,1,1) AS INT)] AS gt,
  (['A1','A2','B1','C1','F1'])[CASE WHEN o_orderkey % 4 = 0 THEN CAST(substr(o_orderpriority,1,1) AS INT) % 5 + 1 ELSE CAST(substr(o_orderpriority,1,1) AS INT) END] AS pred,
  (o_orderkey * 7 + o_custkey) % 101 AS pct,
  CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 1 END AS gt_bad, CASE WHEN (o_custkey + o_orderkey) % 6 = 0 THEN 0 ELSE 1 END AS pred_bad,
  [(['clear','dust','smoke','rain'])[o_orderkey % 4 + 1], (['glare','clear'])[o_custkey % 2 + 1]] AS conditions,
  o_orderkey % 6 AS gt_count, o_custkey % 6 AS pred_count, (['anchored','blind','contaminated'])[o_custkey % 3 + 1] AS condition FROM orders)"""


def raters(spark: SparkSession, d: str) -> DataFrame:
    """Labels of three raters for each order."""
    o = table(spark, d, "orders")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    labels = F.array(F.struct(F.lit("r1").alias("rater"), (p % 3).alias("label")), F.struct(F.lit("r2").alias("rater"), F.when(F.col("o_orderkey") % 5 == 0, (p + 1) % 3).otherwise(p % 3).alias("label")), F.struct(F.lit("r3").alias("rater"), F.when(F.col("o_custkey") % 4 == 0, F.lit(0)).otherwise(p % 3).alias("label")))
    return o.select(F.col("o_orderkey").alias("clip_id"), F.explode(labels).alias("x")).select("clip_id", "x.*")


RATERS = """raters AS (SELECT o_orderkey AS clip_id, r AS rater, CASE r WHEN 'r1' THEN p % 3 WHEN 'r2' THEN CASE WHEN o_orderkey % 5 = 0 THEN (p + 1) % 3 ELSE p % 3 END ELSE CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE p % 3 END END AS label
  FROM (SELECT *, CAST(substr(o_orderpriority,1,1) AS INT) AS p FROM orders) CROSS JOIN (VALUES ('r1'),('r2'),('r3')) t(r))"""


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """A detection timeline by user, in hours since 2024."""
    e = table(spark, d, "events")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.select("event_id", "user_id", seconds.alias("sec"), F.col("event_type").isin("click", "purchase").alias("detected"))


TIMELINE = """timeline AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS sec, event_type IN ('click','purchase') AS detected FROM events)"""


def clips(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of segments, from lineitem."""
    x = table(spark, d, "lineitem")
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey")
    return x.select(
        (k * 10 + F.col("l_linenumber")).alias("clip_id"),
        "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        (F.col("l_partkey") * 7 + F.col("l_linenumber")).alias("start_sec"),
        (q % 20).alias("duration"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
        (k % 130 - 1).alias("intensity"),
        (F.col("l_partkey") % 90).alias("noise"),
        (q % 4).alias("most"),
        (q % 2).alias("least"),
        "l_returnflag",
        "l_linestatus",
        q.alias("qty"),
    )


CLIPS = """clips AS (SELECT l_orderkey * 10 + l_linenumber AS clip_id, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS date, l_partkey * 7 + l_linenumber AS start_sec,
  CAST(l_quantity AS INT) % 20 AS duration, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS disc, l_orderkey % 130 - 1 AS intensity, l_partkey % 90 AS noise,
  CAST(l_quantity AS INT) % 4 AS most, CAST(l_quantity AS INT) % 2 AS least, l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS qty FROM lineitem)"""


def taken(rows: str, keys: str, target: str, within: str = "", floor: int = 0) -> str:
    """SQL of the rows that each stratum gives: in proportion, then moved by one where the sum is off the target."""
    part = f"PARTITION BY {within}" if within else ""
    also = f"{within}, " if within else ""
    return f"""(SELECT {also}{keys}, a + CASE WHEN drift > 0 AND up AND place_up <= drift THEN 1 WHEN drift < 0 AND down AND place_down <= -drift THEN -1 ELSE 0 END AS take FROM (SELECT *, row_number() OVER (PARTITION BY {also}up ORDER BY n DESC, {keys}) AS place_up, row_number() OVER (PARTITION BY {also}down ORDER BY n DESC, {keys}) AS place_down FROM (SELECT *, goal - sum(a) OVER ({part}) AS drift, a < n AS up, a > least({floor}, n) AS down FROM (SELECT *, least(n, greatest(CAST(round_even(CAST(goal * n AS DOUBLE) / sum(n) OVER ({part}), 0) AS BIGINT), least({floor}, n))) AS a FROM (SELECT {also}{keys}, count(*) AS n, any_value({target}) AS goal FROM {rows} GROUP BY {also}{keys})))))"""
