"""Queries of review queues, health, resumed work and event-time windows, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.plans.projections import table
from framescope.session import shared_dir
from framescope.streaming import health, resume, review, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def folder(s: SparkSession, label: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def as_stream(rows: DataFrame, at: str, path: str, parts: int = 3, tail: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of ``parts`` batches in the order of ``at``, from files that are written one part after another.

    A part has as many files as there are shuffle partitions, so that all tasks write and read it. Each file holds one row that
    only fills it and is left out again: a file that were missing would move the borders of the batches. ``tail`` comes with the
    last part.
    """
    s = rows.sparkSession
    files = int(s.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    edges = [low + (high - low) * k // parts for k in range(1, parts)]
    fill = s.range(files).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), F.col("id").cast("int").alias("_file"), F.lit(True).alias("_fill"))
    for k in range(parts):
        above = F.col(at) > edges[k - 1] if k else F.lit(True)
        upto = F.col(at) <= edges[k] if k < parts - 1 else F.lit(True)
        part = rows.where(above & upto)
        part = part.unionByName(tail) if tail is not None and k == parts - 1 else part
        dealt = part.withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")).withColumn("_fill", F.lit(False))
        dealt.unionByName(fill).repartitionById(files, "_file").drop("_file").write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
    schema = dealt.drop("_file").schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).where("NOT _fill").drop("_fill")


def finished(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream gives up to the end of its source."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


# --- review queues --------------------------------------------------------------------------------------------------


def saved(events):
    """Records that five tier-1 annotators, an expert and a safety officer save, some skipped, flagged or saved again."""
    k = F.col("event_id")
    who = F.when(k % 17 == 0, "e").when(k % 53 == 0, "s").otherwise(F.concat(F.lit("w"), (k % 5).cast("string")))
    texts = lambda *values: F.array(*map(F.lit, values))
    return events.select(
        F.col("user_id").cast("long").alias("clip_id"),
        who.alias("annotator_id"),
        F.when(k % 17 == 0, "tier_2").when(k % 53 == 0, "tier_3").otherwise("tier_1").alias("role"),
        F.when(k % 41 == 0, "flagged").when(k % 7 == 0, "skipped").otherwise("submitted").alias("status"),
        F.when(k % 29 == 0, texts("none", "no helmet")).when(k % 34 == 0, texts(" None", "climbs")).otherwise(texts("none", "none")).alias("unsafe"),
        F.when(k % 3 == 0, texts("none", "none")).when(k % 3 == 1, texts("none", "no helmet")).alias("suggested"),
        F.when(k % 50 == 0, "A2").when(k % 51 == 0, "").otherwise("A1").alias("action"),
        F.when(k % 11 == 0, F.when(k % 2 == 0, texts("A1", "A2")).when(k % 5 == 0, texts()).otherwise(texts("A1", "A3", "A3"))).alias("dominant"),
        (F.col("user_id") % 7 == 0).alias("critical"),
        k.cast("long").alias("saved_at"),
    )


SAVED = """saved AS (SELECT CAST(user_id AS BIGINT) AS clip, event_id AS k, CASE WHEN event_id % 17 = 0 THEN 'e' WHEN event_id % 53 = 0 THEN 's' ELSE 'w' || event_id % 5 END AS who,
  CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 53 = 0 THEN 3 ELSE 1 END AS tier, CASE WHEN event_id % 41 = 0 THEN 'flagged' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'submitted' END AS status,
  CASE WHEN event_id % 29 = 0 THEN 'none|no helmet' WHEN event_id % 34 = 0 THEN ' None|climbs' ELSE 'none|none' END AS unsafe, CASE event_id % 3 WHEN 0 THEN 'none|none' WHEN 1 THEN 'none|no helmet' END AS suggested,
  CASE WHEN event_id % 50 = 0 THEN 'A2' WHEN event_id % 51 = 0 THEN '' ELSE 'A1' END AS act, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN ['A1', 'A2'] WHEN event_id % 5 = 0 THEN []::VARCHAR[] ELSE ['A1', 'A3'] END END AS scene, user_id % 7 = 0 AS critical FROM events),
record AS (SELECT *, lead(k) OVER (PARTITION BY clip, who ORDER BY k) AS until FROM saved),
apart AS (SELECT DISTINCT a.k FROM record a JOIN record b ON a.clip = b.clip AND a.who <> b.who AND b.k < a.k AND (b.until IS NULL OR b.until > a.k) AND b.tier = 1 AND b.status = 'submitted' WHERE a.tier = 1 AND a.status = 'submitted'
  AND CASE WHEN a.scene IS NULL THEN a.act <> '' AND b.act <> '' AND a.act <> b.act ELSE len(list_intersect(a.scene, coalesce(b.scene, []))) < 0.5 * len(list_distinct(list_concat(a.scene, coalesce(b.scene, [])))) END),
step AS (SELECT clip, k, who, 'tier_2' AS queue, tier = 2 AND status = 'submitted' AS leaves, CASE WHEN tier = 1 AND status = 'submitted' AND unsafe <> suggested THEN 'safety_label_changed' WHEN status = 'flagged' THEN 'flagged' WHEN k IN (SELECT k FROM apart) THEN CASE WHEN scene IS NULL THEN 'disagreement' ELSE 'scene_disagreement' END
    WHEN tier = 1 AND status = 'submitted' AND critical AND (scene IS NOT NULL OR unsafe <> 'none|none') THEN 'safety_critical' END AS reason FROM record
  UNION ALL SELECT clip, k, who, 'tier_3', tier = 3 AND status = 'submitted', CASE WHEN tier = 2 AND status = 'submitted' AND (scene IS NOT NULL OR unsafe <> 'none|none') THEN 'unsafe_confirmed' END FROM record),
turn AS (SELECT *, coalesce(sum(leaves::INT) OVER (PARTITION BY clip, queue ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stay FROM step WHERE leaves OR reason IS NOT NULL),
entry AS (SELECT clip, queue, stay, min(k) FILTER (NOT leaves) AS added, min(k) FILTER (leaves) AS removed FROM turn GROUP BY ALL HAVING added IS NOT NULL),
changes AS (SELECT clip AS clip_id, e.queue, 'add' AS change, reason, who AS annotator_id, k AS saved_at FROM entry e JOIN turn t USING (clip, queue, stay) WHERE k = added
  UNION ALL SELECT clip, e.queue, 'remove', NULL, who, k FROM entry e JOIN turn t USING (clip, queue, stay) WHERE k = removed),
open AS (SELECT clip AS clip_id, reason, k AS saved_at FROM entry e JOIN turn t USING (clip, queue, stay) WHERE removed IS NULL AND k = added AND e.queue = 'tier_2')"""


@query("r06_queue", f"WITH {SAVED} SELECT * FROM changes")
def _(s, d):
    return review.changes_of(saved(table(s, d, "events")))


@query("r05_escalation", f"WITH {SAVED} SELECT * FROM changes")
def _(s, d):
    """The changes as a stream over saved annotations, run to the end of what is there."""
    path = folder(s, "review")
    events = as_stream(table(s, d, "events").select("user_id", "event_id"), "event_id", f"{path}/saved")
    return finished(review.review_changes(saved(events)), path)


@query("r06_open_entries", f"WITH {SAVED} SELECT * FROM open")
def _(s, d):
    return review.open_entries(review.changes_of(saved(table(s, d, "events"))))


@query("r07_live_entries", f"WITH {SAVED} SELECT DISTINCT clip_id FROM open WHERE clip_id IN (SELECT doc_id FROM labels)")
def _(s, d):
    queue = review.open_entries(review.changes_of(saved(table(s, d, "events")))).select("clip_id")
    return review.live_entries(queue, table(s, d, "labels").select(F.col("doc_id").alias("clip_id")))


@query(
    "w11_work_order",
    """WITH w AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'tier_1' ELSE 'tier_2' END AS role, CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 'urgent' WHEN o_orderkey % 4 = 1 THEN 'high' ELSE 'normal' END AS priority,
  CASE o_orderkey % 3 WHEN 0 THEN 'blind' WHEN 1 THEN 'anchored' END AS condition, (['expert_gold', 'adjudication', 'audit', 'audit', 'label'])[o_orderkey % 6 + 1] AS task, o_orderkey % 7 < 4 AS reviewed FROM orders),
b AS (SELECT *, CASE WHEN priority = 'high' THEN CASE WHEN role = 'tier_2' AND condition IS DISTINCT FROM 'blind' THEN 1 ELSE 0 END WHEN role = 'tier_1' THEN 6 ELSE CASE task WHEN 'expert_gold' THEN 2 WHEN 'adjudication' THEN 3 WHEN 'audit' THEN CASE WHEN reviewed THEN 4 ELSE 5 END ELSE 6 END END AS band FROM w),
o AS (SELECT * FROM b QUALIFY priority = 'urgent' OR NOT bool_or(priority = 'urgent') OVER (PARTITION BY o_custkey))
SELECT o_custkey, o_orderkey, band, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY band, o_orderkey) AS INT) AS place FROM o""",
)
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tasks = F.array(*map(F.lit, ("expert_gold", "adjudication", "audit", "audit", "label", None)))
    entries = table(s, d, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.when(c % 3 == 0, "tier_1").otherwise("tier_2").alias("role"),
        F.when((c % 5 == 0) & (k % 4 == 0), "urgent").when(k % 4 == 1, "high").otherwise("normal").alias("priority"),
        F.when(k % 3 == 0, "blind").when(k % 3 == 1, "anchored").alias("condition"),
        F.element_at(tasks, (k % 6 + 1).cast("int")).alias("task"),
        (k % 7 < 4).alias("reviewed"),
    )
    return review.work_order(entries, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "band", "place")


# --- health and resumed work ----------------------------------------------------------------------------------------

WINDOWS = "SELECT user_id, p // 20 AS \"window\", count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') > count(*) * 0.05 AS alert FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events) GROUP BY 1, 2"


@query("r08_count_window_stream", WINDOWS)
def _(s, d):
    """``v12_count_window`` as a stream: time is the event's number, and a row without one ends all windows after the last event."""
    path = folder(s, "health")
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.timestamp_seconds(F.col("event_id") + 1).alias("at"))
    bounds = e.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    idle = high - low + 1  # longer than any user can be idle before the last event
    last = s.range(1).select(*(F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns[:-1]), F.timestamp_seconds(F.lit(high + 1 + idle)).alias("at"))
    stream = as_stream(e, "event_id", f"{path}/events", tail=last)
    return finished(health.count_windows(stream, "user_id", "event_id", "at", F.col("event_type") == "error", 20, f"{idle} SECONDS", "0 seconds"), path)


@query("r03_resumed", "SELECT event_type, count(*) AS n, count(*) FILTER (CAST(event_id AS BIGINT) % 9 = 0) AS failed FROM events GROUP BY 1")
def _(s, d):
    """Totals of a stream that is stopped before its last batches come and then taken up from its checkpoint."""
    path = folder(s, "resumed")
    e = table(s, d, "events").select("event_id", "event_type")
    half = e.agg(F.avg("event_id")).first()[0]
    for rows in (e.where(F.col("event_id") <= half), e.where(F.col("event_id") > half)):
        stream = as_stream(rows, "event_id", f"{path}/events", 2)
        resume.start(stream, path, ["event_type"], F.col("event_id") % 9 == 0).awaitTermination()
    return resume.totals(s, path)


@query("r04_unfinished", "WITH h AS (SELECT CAST(user_id AS BIGINT) AS c_custkey, event_type <> 'error' AND event_id % 3 = 0 AS ok FROM events WHERE event_id % 5 = 0) SELECT c_custkey, c_custkey NOT IN (SELECT c_custkey FROM h) AS never_tried FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM h WHERE ok)")
def _(s, d):
    """Keys to run again: those without a success, and whether they were never tried at all."""
    wanted = table(s, d, "customer").select("c_custkey")
    history = table(s, d, "events").where("event_id % 5 = 0").select(F.col("user_id").alias("c_custkey"), ((F.col("event_type") != "error") & (F.col("event_id") % 3 == 0)).alias("ok"))
    again = resume.unfinished(wanted, history, "c_custkey", F.col("ok"))
    never = resume.unfinished(wanted, history, "c_custkey").withColumn("never_tried", F.lit(True))
    return again.join(never, "c_custkey", "left").withColumn("never_tried", F.coalesce("never_tried", F.lit(False)))


# --- event time: extensions -----------------------------------------------------------------------------------------


@query("x1_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return windows.tumbling(table(s, d, "events"), "ts", "6 hours", ["event_type"]).withColumn("start", F.unix_seconds("start"))


@query("x2_session", "WITH m AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL '4 hours')::INT, 1) AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM n GROUP BY user_id, k")
def _(s, d):
    return windows.sessions(table(s, d, "events"), "ts", "4 hours", "user_id").withColumn("start", F.unix_micros("start"))


@query("x3_sliding", "SELECT CAST(epoch(time_bucket(INTERVAL '2 hours', ts)) AS BIGINT) - 7200 * j AS start, event_type, count(*) AS n FROM events CROSS JOIN range(3) AS r(j) GROUP BY ALL")
def _(s, d):
    return windows.sliding(table(s, d, "events"), "ts", "6 hours", "2 hours", ["event_type"]).withColumn("start", F.unix_seconds("start"))


@query("x4_first_of_day", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(s, d):
    """One row a user, type and day of a stream in which the first rows come again at the end, too late to count."""
    path = folder(s, "repeats")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(s, d, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.timestamp_seconds(F.floor(seconds / 86400) * 86400).alias("at"), F.floor(seconds / 86400).alias("order"))
    as_stream(e, "order", f"{path}/events")
    first = e.agg(F.min("order")).first()[0]
    stream = as_stream(e.where(F.col("order") <= F.lit(first) + 2), "order", f"{path}/events", 1)
    return finished(windows.first_of_key(stream, "at", ["user_id", "event_type", "day"], "1 day").select("user_id", "event_type", "day"), path)
