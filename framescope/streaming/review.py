"""Review queues over saved annotations, as a stream with keyed state and over a table.

Saved annotations are rows (clip_id, annotator_id, status, unsafe, suggested, action, saved_at) with optional columns
``role`` (tier_1, tier_2 or tier_3; tier_1 if not given), ``dominant`` (the scene's actions of a layer-1 annotation, null
on others) and ``critical`` (whether the clip is safety-critical). ``unsafe`` and ``suggested`` are texts or lists of texts.

An annotator's later record of a clip replaces the earlier one, whatever their status. A clip enters the experts' queue
(tier_2) for the first reason that comes up while it isn't there:

* ``safety_label_changed``: a submitted tier-1 record whose unsafe acts differ from those suggested, if any were;
* ``flagged``: a flag, whoever sets it;
* ``disagreement``, ``scene_disagreement``: a submitted tier-1 record that differs from the record that another tier-1
  annotator has submitted and not replaced since, in its action or, on layer 1, by a Jaccard similarity of the scene's
  actions below 0.5 (two scenes without actions agree);
* ``safety_critical``: a submitted tier-1 record with an unsafe act on a safety-critical clip.

An expert's submitted record takes the clip out again. If it holds an unsafe act, the clip enters the safety officers'
queue (tier_3), which a submitted tier-3 record takes it out of. A clip may enter a queue again after it left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "clip_id long, queue string, change string, reason string, annotator_id string, saved_at long"
EXPERTS, OFFICERS = "tier_2", "tier_3"
#: A record's texts that name no unsafe act: of a tier-1 record on layer 2, and of an expert's there. On layer 1 any text names one.
NO_ACT, NO_ACT_FOR_EXPERTS = ("", "none"), ("", "none", "none_visible")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt out to so many groups of a stateful stream. A call of a processor costs some milliseconds, so that one for each key
#: would take most of the time where a batch holds many keys.
BUCKETS = 512


class Saved(NamedTuple):
    """A saved record as the rules read it; ``scene`` is null on layer 2."""

    annotator_id: str
    role: str
    status: str
    action: str | None
    scene: list[str] | None
    changed: bool
    act: bool
    confirmed: bool
    critical: bool
    saved_at: int


def _prepared(saved: DataFrame) -> DataFrame:
    """``clip_id`` and the fields of ``Saved``."""
    kinds = dict(saved.dtypes)
    given = lambda c, default: F.coalesce(F.col(c), default) if c in kinds else default
    acts = lambda c: F.col(c) if kinds[c].startswith("array") else F.when(F.col(c).isNotNull(), F.array(c))
    scene = F.array_distinct("dominant") if "dominant" in kinds else F.lit(None).cast("array<string>")
    words = F.transform(F.coalesce(acts("unsafe"), F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))

    def names(none: tuple[str, ...]):
        return F.when(scene.isNotNull(), F.exists(words, lambda x: x != "")).otherwise(F.exists(words, lambda x: ~x.isin(*none)))

    suggested = acts("suggested")
    return saved.select(
        "clip_id",
        F.coalesce("annotator_id", F.lit("")).alias("annotator_id"),
        given("role", F.lit("tier_1")).alias("role"),
        F.coalesce("status", F.lit("")).alias("status"),
        "action",
        scene.alias("scene"),
        (suggested.isNotNull() & ~suggested.eqNullSafe(acts("unsafe"))).alias("changed"),
        names(NO_ACT).alias("act"),
        names(NO_ACT_FOR_EXPERTS).alias("confirmed"),
        given("critical", F.lit(False)).alias("critical"),
        F.col("saved_at").cast("long").alias("saved_at"),
    )


class Clip:
    """What is known of one clip: the tier-1 records that stand, and the queues that it is in."""

    def __init__(self, records: dict[str, tuple[str, list[str]]] | None = None, queued: tuple[str, ...] = ()) -> None:
        self.records = records or {}
        self.queued = set(queued)

    def _reason(self, r: Saved, first: bool) -> str | None:
        if first and r.changed:
            return "safety_label_changed"
        if r.status == "flagged":
            return "flagged"
        if first:
            others = [x for who, x in self.records.items() if who != r.annotator_id]
            if r.scene is None and any(r.action and action and r.action != action for action, _ in others):
                return "disagreement"
            if r.scene is not None and any(len(set(r.scene) & set(x)) < 0.5 * len(set(r.scene) | set(x)) for _, x in others):
                return "scene_disagreement"
            if r.critical and r.act:
                return "safety_critical"
        return None

    def _enter(self, queue: str, reason: str | None) -> Iterator[tuple[str, str, str | None]]:
        if reason and queue not in self.queued:
            self.queued.add(queue)
            yield queue, "add", reason

    def _leave(self, queue: str) -> Iterator[tuple[str, str, str | None]]:
        if queue in self.queued:
            self.queued.remove(queue)
            yield queue, "remove", None

    def save(self, r: Saved) -> Iterator[tuple[str, str, str | None]]:
        """Changes (queue, add or remove, reason) that a record brings."""
        submitted = r.status == "submitted"
        yield from self._enter(EXPERTS, self._reason(r, submitted and r.role == "tier_1"))
        if submitted and r.role == EXPERTS:
            yield from self._leave(EXPERTS)
            yield from self._enter(OFFICERS, "unsafe_confirmed" if r.confirmed else None)
        if submitted and r.role == OFFICERS:
            yield from self._leave(OFFICERS)
        if submitted and r.role == "tier_1":
            self.records[r.annotator_id] = (r.action or "", list(r.scene) if r.scene is not None else [])
        else:
            self.records.pop(r.annotator_id, None)


def _rows(batch: pd.DataFrame) -> Iterator[tuple[Any, Saved]]:
    clean = batch.astype(object).where(batch.notna(), None)
    for clip, *fields in clean.itertuples(index=False):
        yield clip, Saved(*fields)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Desk(StatefulProcessor):
    """The clips of a bucket by id, each with its standing records and its queues, kept between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clips = handle.getMapState("clips", "clip_id string", "records string, queued string")

    @staticmethod
    def _texts(clip: Clip) -> tuple[str, str]:
        return json.dumps(clip.records, sort_keys=True), json.dumps(sorted(clip.queued))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).drop(columns="bucket").sort_values(["saved_at", "annotator_id"])
        any_known = self.clips.exists()
        clips: dict[Any, tuple[Clip, tuple[str, str] | None]] = {}
        made = []
        for who, r in _rows(batch):
            if who not in clips:
                found = self.clips.getValue((who,)) if any_known else None
                records = {k: (action, scene) for k, (action, scene) in json.loads(found[0]).items()} if found else None
                clips[who] = Clip(records, tuple(json.loads(found[1])) if found else ()), tuple(found) if found else None
            made += [(who, *change, r.annotator_id, r.saved_at) for change in clips[who][0].save(r)]
        for who, (clip, before) in clips.items():
            after = self._texts(clip)
            if not clip.records and not clip.queued:
                if before:
                    self.clips.removeKey((who,))
            elif after != before:
                self.clips.updateValue((who,), after)
        yield pd.DataFrame(made, columns=["clip_id", "queue", "change", "reason", "annotator_id", "saved_at"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that processors with several state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def review_changes(saved: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The stream of queue changes. Within a batch records count in the order in which they were saved.

    State is kept by ``buckets`` of clips, whose number must stay the same as long as a checkpoint is used.
    """
    use_rocksdb(saved.sparkSession)
    rows = _prepared(saved).select(bucket_of("clip_id", buckets).alias("bucket"), F.col("clip_id").cast("string").alias("clip_id"), *list(Saved._fields))
    out = rows.groupBy("bucket").transformWithStateInPandas(Desk(), CHANGES.replace("clip_id long", "clip_id string"), "Append", "None")
    return out.withColumn("clip_id", F.col("clip_id").cast("long"))


def changes_of(saved: DataFrame) -> DataFrame:
    """The same changes over a table: each clip's records pass in order, and only those that stand are held."""
    rows = _prepared(saved).repartition("clip_id").sortWithinPartitions("clip_id", "saved_at", "annotator_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, clip = None, Clip()
        for batch in batches:
            made = []
            for key, r in _rows(batch):
                if key != last:
                    last, clip = key, Clip()
                made += [(key, *change, r.annotator_id, r.saved_at) for change in clip.save(r)]
            yield pd.DataFrame(made, columns=["clip_id", "queue", "change", "reason", "annotator_id", "saved_at"])

    return rows.mapInPandas(run, CHANGES)


def open_entries(changes: DataFrame, queue: str = EXPERTS) -> DataFrame:
    """(clip_id, reason, saved_at) of the clips that are in a queue after all changes."""
    last = F.max_by(F.struct("change", "reason", "saved_at"), "saved_at").alias("last")
    return changes.where(F.col("queue") == queue).groupBy("clip_id").agg(last).where("last.change = 'add'").select("clip_id", "last.reason", "last.saved_at")


def live_entries(queue: DataFrame, annotations: DataFrame) -> DataFrame:
    """Queue entries whose clip still has an annotation."""
    return queue.join(annotations.select("clip_id").distinct(), "clip_id", "left_semi")


# --- order of the work ----------------------------------------------------------------------------------------------

def work_order(entries: DataFrame, annotator: str, order: str) -> DataFrame:
    """An annotator's open work with its ``band`` and ``place``. Entries have ``role``, ``priority``, ``condition``,
    ``task`` and ``reviewed`` (whether a tier-1 record exists).

    Urgent work hides all other of the same annotator. What has high priority comes first; experts see blind calibration
    before the rest of that, then first records for the expert set, adjudications, audits of what tier 1 has done, audits
    of what it hasn't, and all else.
    """
    expert, task = F.col("role") == EXPERTS, F.col("task")
    band = (
        F.when(F.col("priority") == "high", F.when(expert & ~F.col("condition").eqNullSafe("blind"), 1).otherwise(0))
        .when(~expert | task.isNull(), 6)
        .when(task == "expert_gold", 2)
        .when(task == "adjudication", 3)
        .when(task == "audit", F.when(F.col("reviewed"), 4).otherwise(5))
        .otherwise(6)
    )
    urgent = F.coalesce(F.col("priority") == "urgent", F.lit(False))
    blocked = F.max(urgent).over(Window.partitionBy(annotator))
    rows = entries.withColumn("band", band).withColumn("_blocked", blocked).where(urgent | ~F.col("_blocked")).drop("_blocked")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(annotator).orderBy("band", order)))
