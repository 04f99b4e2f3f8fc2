"""Substring dedup by hashing lines and runs of sentences.

A unit is a line of at least ``min_line_words`` words, or a run of whole sentences (line ends end sentences too) with at
least ``min_words`` words: the shortest such run from each sentence on, and the shortest back from each sentence end. A
paragraph is a union of such units, and so is a passage that was spliced into the middle of another line, which hashing
whole lines alone would miss. Sentences are also cut before each word whose hash is the least of ``WINDOW`` words in a
row, whatever stands around these. So equal stretches are cut alike, also where a passage begins and ends in the middle
of sentences, and 60 words that two texts share hold at least one whole unit of both: a cut is among the first 24, and
another among the 24 that follow the 12 words after it.

Units are compared as lower-cased words without marks and spacing, by 96 bits of their XXH3 digests. Digests are grouped
globally; the occurrence in the earliest ranked document (by id, then text hash, then place) stays and all others are
removed. Where removed units overlap, their union goes. Every removed sentence therefore stands in an earlier place
that is kept.

A task settles what it can see: of the units of one digest in a stretch of its rows, all but the earliest ranked are
repeats wherever else they stand, and go straight to their document. So a line that a third of all documents hold
reaches the global grouping once for each stretch, not once for each document.

A row of the result keeps the offsets, in the original text, of what is kept and what is removed.

Defined results: null and empty texts have no units and stay as they are. Ranking puts a null id last. Rows are told
apart by id and a 64-bit hash of the text; rows that are equal in both are one document: they get equal results and
none is removed in favour of the other. An empty table gives an empty result. Columns of the input that clash with
``kept_spans``, ``removed_spans`` or ``removed_chars`` keep their names; the result columns get a numbered suffix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import SpanHash, free_name, mix, quoted

MIN_WORDS = 12
MIN_LINE_WORDS = 5
#: Units that a task compares among themselves before it hands them on.
STRETCH = 100_000
#: Words in a row of which the one with the least hash opens a unit.
WINDOW = 24
_ENDS = np.zeros(128, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_WORD = np.zeros(128, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_BLANK = " \t\r\x0b\x0c"


class PointHash(SpanHash):
    """Span hashes over code points."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__(seed)
        self.table = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        value = self.table[data & 0xFFFF]
        with np.errstate(over="ignore"):
            if data.max(initial=0) > 0xFFFF:
                value = value + (data >> 16).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            np.cumsum(value * self.up[: len(data)], out=out[1:])
        return out


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the first least value of some ``width`` places in a row, or of all if there are fewer."""
    width = min(width, len(values))
    first = np.arange(0, len(values) - width + 1)
    found = []
    for k in range(0, len(first), 1 << 16):  # windows of long texts in turn
        part = np.lib.stride_tricks.sliding_window_view(values[k : k + (1 << 16) + width - 1], width)
        found.append(part.argmin(axis=1) + first[k : k + len(part)])
    return np.unique(np.concatenate(found))


class Units:
    """The units of a text in order of place: start and end in code points, and digests."""

    def __init__(self, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> None:
        self.min_words, self.min_line_words = min_words, min_line_words
        self.word_hash = PointHash(1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Two parts of each unit's digest, of 64 and of 32 bits."""
        points, normal, _, _, left, right = self._find(text)
        if points is None:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        data, digest = memoryview(normal.astype("<u4").tobytes()), xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip((4 * left).tolist(), (4 * right).tolist(), strict=True)]), dtype="<i8")
        return halves[::2], halves[1::2].astype(np.int32)

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each unit."""
        _, _, start, end, _, _ = self._find(text)
        return start, end

    def _find(self, text: str | None) -> tuple:
        nothing = np.zeros(0, dtype=np.int64)
        none = (None, None, nothing, nothing, nothing, nothing)
        if not text:
            return none
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        small = np.where((points >= 65) & (points <= 90), points + 32, points)
        narrow = np.minimum(small, 127)
        inside = (small >= 128) | _WORD[narrow]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        n = len(starts)
        if n < min(self.min_words, self.min_line_words):
            return none
        # Words joined by one space each: the characters of words, and the first one after each word as a space.
        taken = inside.copy()
        taken[ends[ends < len(points)]] = True
        place = np.concatenate(([0], np.cumsum(taken)))
        normal = np.where(inside, small, 32)[taken]
        begin, end = place[starts], place[ends]

        def heads_after(marks: np.ndarray) -> np.ndarray:
            """The first word, and each word before which a mark stands since the word before it."""
            count = np.concatenate(([0], np.cumsum(marks)))
            return np.flatnonzero(np.concatenate(([True], count[starts[1:]] > count[ends[:-1]])))

        opens = np.zeros(n + 1, dtype=bool)
        opens[heads_after(_ENDS[narrow] & (points < 128))] = True
        opens[least_of_windows(self.word_hash.spans(self.word_hash.prefix(normal), begin, end), WINDOW)] = True
        opens[n] = True
        bounds = np.flatnonzero(opens)
        to = np.searchsorted(bounds, bounds + self.min_words)  # forward from each bound
        fore = np.flatnonzero(to < len(bounds))
        back_to = np.searchsorted(bounds, bounds - self.min_words, side="right") - 1
        back = np.flatnonzero(back_to >= 0)
        lines = np.append(heads_after(points == 10), n)
        line = np.flatnonzero(np.diff(lines) >= self.min_line_words)
        first = np.concatenate((bounds[fore], bounds[back_to[back]], lines[line]))
        after = np.concatenate((bounds[to[fore]], bounds[back], lines[line + 1]))
        both = np.unique(first * (n + 1) + after)
        a, b = both // (n + 1), both % (n + 1) - 1  # first and last word
        return points, normal, starts[a], ends[b], begin[a], end[b]


def removed_spans(text: str, spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, each with the marks that follow it, the blanks after these, and its line end if it fills the line."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        while end < len(text) and not text[end].isalnum() and text[end] not in _BLANK and text[end] != "\n":
            end += 1
        while end < len(text) and text[end] in _BLANK:
            end += 1
        if end < len(text) and text[end] == "\n" and (start == 0 or text[start - 1] == "\n"):
            end += 1
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kept_spans", _SPANS), T.StructField("removed_spans", _SPANS)])


def _cut_text(units: Units, text: str | None, found: Iterable[int] | None) -> tuple:
    """Text without the units of these numbers, and what is kept and removed."""
    if text is None or found is None or not len(found):
        return text, [{"start": 0, "end": len(text)}] if text else [], []
    start, end = units.places(text)
    at = np.asarray(found, dtype=np.int64)
    gone = removed_spans(text, zip(start[at].tolist(), end[at].tolist(), strict=True))
    edges = [0, *(x for span in gone for x in span), len(text)]
    kept = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return "".join(text[a:b] for a, b in kept), [{"start": a, "end": b} for a, b in kept], [{"start": a, "end": b} for a, b in gone]


def earlier_ranked(rank: np.ndarray, number: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which units have an equal one in an earlier ranked document, or earlier in the same one."""
    if not len(rank):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((number, rank, two, one))
    o1, o2, r, k = one[order], two[order], rank[order], number[order]
    opens = np.concatenate(([True], (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])))
    first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (r != r[first]) | (k != k[first])
    return later


def unit_rows(df: DataFrame, units: Units, stretch: int) -> DataFrame:
    """(unit_id, unit_mark, number, known, d1, d2) for each unit of (unit_id, unit_mark, unit_text).

    ``known`` units are repeats for certain. They have a key of their own in place of the digest, so that they are
    dealt out evenly.
    """
    fields = [T.StructField("number", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.IntegerType())]
    schema = T.StructType([df.schema["unit_id"], df.schema["unit_mark"], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)
            # Rank of each row in the batch: by id, nulls last, then by mark; equal rows rank equally.
            ids = batch.column(0).to_pandas()
            rank = pd.DataFrame({"id": ids.rank(method="dense", na_option="bottom"), "mark": marks}).groupby(["id", "mark"], sort=True).ngroup().to_numpy()
            rows: list[int] = []
            made: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for k in range(len(texts)):
                rows.append(k)
                made.append(units(texts[k].as_py()))
                size += len(made[-1][0])
                if size >= stretch or k == len(texts) - 1:
                    counts = [len(x[0]) for x in made]
                    at = np.repeat(rows, counts).astype(np.int64)
                    number = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                    one, two = (np.concatenate([x[j] for x in made]) for j in (0, 1))
                    known = earlier_ranked(rank[at], number, one, two)
                    own = mix(marks[at].view(np.uint64) + number.astype(np.uint64)).view(np.int64)
                    one = np.where(known, own, one)
                    index = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(number), pa.array(known), pa.array(one), pa.array(two)], names)
                    rows, made, size = [], [], 0

    return df.mapInArrow(run, schema)


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """``df`` with repeated units cut out of its text, and ``kept_spans``, ``removed_spans`` and ``removed_chars``."""
    mark, numbers, cut = (free_name(df, n) for n in ("dedup_mark", "dedup_numbers", "dedup_cut"))
    marked = df.withColumn(mark, F.xxhash64(quoted(text_col)))
    units = Units(min_words, min_line_words)
    rows = unit_rows(marked.select(quoted(id_col).alias("unit_id"), quoted(mark).alias("unit_mark"), quoted(text_col).alias("unit_text")), units, STRETCH)
    order = [F.col("known"), F.col("unit_id").asc_nulls_last(), F.col("unit_mark"), F.col("number")]
    same = Window.partitionBy("d1", "d2").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("unit_id", "unit_mark", "number")
    repeats = rows.withColumn("kept", F.first(here).over(same)).where(F.col("known") | ~F.col("kept").eqNullSafe(here))
    by_id, by_mark = free_name(marked, "unit_id"), free_name(marked, "unit_mark")
    by_doc = repeats.groupBy(F.col("unit_id").alias(by_id), F.col("unit_mark").alias(by_mark)).agg(F.collect_set("number").alias(numbers))
    joined = marked.join(by_doc, quoted(id_col).eqNullSafe(F.col(by_id)) & (quoted(mark) == F.col(by_mark)), "left")

    @F.pandas_udf(_RESULT)
    def cut_out(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut_text(units, t, f) for t, f in zip(texts, found, strict=True)], columns=["text", "kept_spans", "removed_spans"])

    done = joined.withColumn(cut, cut_out(quoted(text_col), quoted(numbers)))
    c = quoted(cut)
    names = [free_name(df, n) for n in ("kept_spans", "removed_spans", "removed_chars")]
    gone = F.aggregate(c["removed_spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(*[(c["text"] if x == text_col else quoted(x)).alias(x) for x in df.columns], c["kept_spans"].alias(names[0]), c["removed_spans"].alias(names[1]), gone.alias(names[2]))
