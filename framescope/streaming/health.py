"""Health of a stream of results: failure rates of every so many rows of a key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framescope.streaming.review import BUCKETS, bucket_of, use_rocksdb


class CountWindow(StatefulProcessor):
    """Counts the rows of a bucket's keys; a full window leaves at once, what is left when the key has been idle by a timer.

    ``open`` holds the keys that a timer is still to close, ``closed`` the next window's number of all others. A bucket has
    one timer, never later than the first of its keys falls idle.
    """

    def __init__(self, size: int, limit: float, idle_ms: int) -> None:
        self.size, self.limit, self.idle_ms = size, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "key string", "number long, n long, failed long, last long")
        self.closed = handle.getMapState("closed", "key string", "number long")

    def _rows(self, made: list[tuple[Any, int, int, int]]) -> pd.DataFrame:
        columns = ["key", "window", "n", "failed", "alert"]
        return pd.DataFrame([(*x, x[3] > x[2] * self.limit) for x in made], columns=columns)

    def _known(self, bucket_open: bool, bucket_closed: bool, key: Any) -> list[int]:
        found = self.open.getValue((key,)) if bucket_open else None
        if found is None and bucket_closed and (last := self.closed.getValue((key,))) is not None:
            self.closed.removeKey((key,))
            found = (last[0], 0, 0, 0)
        return list(found) if found is not None else [0, 0, 0, 0]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("place")
        before = self.open.exists(), self.closed.exists()
        known: dict[Any, list[int]] = {}
        made = []
        for who, bad, ms in zip(batch["key"].tolist(), batch["bad"].tolist(), batch["ms"].tolist(), strict=True):
            if (own := known.get(who)) is None:
                own = known[who] = self._known(*before, who)
            own[1] += 1
            own[2] += bool(bad)
            own[3] = max(own[3], ms)
            if own[1] == self.size:
                made.append((who, *own[:3]))
                own[:3] = own[0] + 1, 0, 0
        for who, own in known.items():
            self.open.updateValue((who,), tuple(map(int, own)))
        self._set_timer(min(own[3] for own in known.values()) + self.idle_ms)
        yield self._rows(made)

    def _set_timer(self, at: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        made, left = [], []
        for (who,), (number, n, failed, last) in list(self.open.iterator()):
            if last + self.idle_ms > now:
                left.append(last + self.idle_ms)
                continue
            if n:
                made.append((who, number, n, failed))
            self.open.removeKey((who,))
            self.closed.updateValue((who,), (number + bool(n),))
        if left:
            self.handle.registerTimer(min(left))
        yield self._rows(made)

    def close(self) -> None:
        pass


def count_windows(results: DataFrame, key: str, order: str, at: str, failed: Column, size: int, idle: str, late: str, limit: float = 0.05, buckets: int = BUCKETS) -> DataFrame:
    """(key, window, n, failed, alert) of each ``size`` rows of a key on a stream; ``at`` is the event time.

    The rest of a key leaves when the watermark passes its last row by ``idle`` (such as "10 minutes"). Rows later than
    ``late`` don't count. Rows without ``order`` tell the time alone. State is kept by ``buckets`` of keys, whose number
    must stay the same as long as a checkpoint is used.
    """
    spark = results.sparkSession
    use_rocksdb(spark)
    idle_ms = spark.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).alias("ms")).first()["ms"]
    kind = dict(results.dtypes)[key]
    rows = results.select(bucket_of(key, buckets).alias("bucket"), F.col(key).cast("string").alias("key"), F.col(order).alias("place"), F.col(at).cast("timestamp").alias("at"), F.coalesce(failed, F.lit(False)).alias("bad"))
    counted = rows.withWatermark("at", late).where("place IS NOT NULL OR at IS NULL")  # naming the time keeps the filter behind the watermark
    timed = counted.withColumn("ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
    out = timed.groupBy("bucket").transformWithStateInPandas(CountWindow(size, limit, idle_ms), "key string, window long, n long, failed long, alert boolean", "Append", "EventTime")
    return out.select(F.col("key").cast(kind).alias(key), "window", "n", "failed", "alert")
