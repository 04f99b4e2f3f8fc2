"""Helpers shared by the corpus operators: reading tables, cutting lineage, words and span hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a run of anything but the ASCII white space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Odd multiplier of the span hash, and the step that mixes byte values.
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own; on a cluster that would not be shared, so
    it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the work above it, so a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` has written and nothing lazy depends on any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out, k = name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def free_fields(taken: Iterable[str], fields: Sequence[T.StructField]) -> list[T.StructField]:
    """``fields`` under names that differ from those taken and from one another, with a number where needed."""
    used, out = {t.lower() for t in taken}, []
    for f in fields:
        name, k = f.name, 0
        while name.lower() in used:
            k += 1
            name = f"{f.name}_{k}"
        used.add(name.lower())
        out.append(T.StructField(name, f.dataType, f.nullable))
    return out


def quoted(name: str) -> Column:
    """A column by its literal name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    with np.errstate(over="ignore"):
        return _splitmix(np.asarray(x, dtype=np.uint64))


class SpanHash:
    """64-bit hashes of any span of a byte string, from one pass of prefix sums.

    hash(i, j) = sum of value[b[k]] * m ** (k - i), modulo 2 ** 64. Equal spans hash alike wherever they stand.
    """

    def __init__(self, seed: int = 0) -> None:
        with np.errstate(over="ignore"):
            self.value = _splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) | np.uint64(1)
        self.multiplier = (_MULTIPLIER + 2 * seed * 0x632BE59BD9B4E019) & _MASK | 1
        self.inverse = pow(self.multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, m in (("up", self.multiplier), ("down", self.inverse)):
                steps = np.full(size, m, dtype=np.uint64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _splitmix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def normal_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased (A-Z only) words joined by single spaces, and each word's start and end there."""
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""
    data = np.frombuffer(joined, dtype=np.uint8)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return data, none, none
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))


def slices(n: int, step: int) -> Iterator[tuple[int, int]]:
    for start in range(0, n, step):
        yield start, min(n, start + step)


def flat_map(df: DataFrame, column: str, keep: Sequence[str], fields: Sequence[T.StructField], make: Callable[[], Callable[[Any], Iterable[tuple]]], limit: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns of ``df`` with ``fields``: one row for each tuple that a function makes of ``column``.

    ``make`` runs once a task and returns the function. Rows leave in batches of about ``limit`` bytes of new values,
    so that memory doesn't grow with a partition.
    """
    value = free_name(df, "value")
    source = df.select(*[quoted(k) for k in keep], quoted(column).alias(value))
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            values = batch.column(n)
            rows: list[int] = []
            new: list[list] = [[] for _ in kinds]
            size = 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                out = [batch.column(i).take(at) for i in range(n)] + [pa.array(x, k) for x, k in zip(new, kinds, strict=True)]
                return pa.RecordBatch.from_arrays(out, names)

            for k in range(len(values)):
                for made in function(values[k].as_py()):
                    rows.append(k)
                    for x, v in zip(new, made, strict=True):
                        x.append(v)
                        size += len(v) if isinstance(v, (bytes, str)) else v.nbytes if isinstance(v, np.ndarray) else 8
                    if size > limit:
                        yield flush()
                        rows.clear()
                        for x in new:
                            x.clear()
                        size = 0
            yield flush()

    return source.mapInArrow(run, schema)


def flat_map_arrays(df: DataFrame, column: str, keep: Sequence[str], fields: Sequence[T.StructField], make: Callable[[], Callable[[Any], tuple[np.ndarray, ...]]], limit: int = 8 << 20) -> DataFrame:
    """As ``flat_map``, for a function that gives one numpy array for each field, all of the same length."""
    value = free_name(df, "value")
    source = df.select(*[quoted(k) for k in keep], quoted(column).alias(value))
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            values = batch.column(n)
            counts: list[int] = []
            new: list[tuple[np.ndarray, ...]] = []
            first = size = 0
            for k in range(len(values)):
                new.append(function(values[k].as_py()))
                counts.append(len(new[-1][0]))
                size += 8 * counts[-1] * len(fields)
                if size > limit or k == len(values) - 1:
                    at = pa.array(np.repeat(np.arange(first, k + 1), counts))
                    out = [batch.column(i).take(at) for i in range(n)]
                    out += [pa.array(np.concatenate([x[j] for x in new]), kind) for j, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(out, names)
                    counts, new, first, size = [], [], k + 1, 0

    return source.mapInArrow(run, schema)
