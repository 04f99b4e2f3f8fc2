"""Periodic runs of words: stretches that repeat one block of words at least four times, and texts without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` whose length is at least ``min_length`` and
``min_exponent`` times ``q``, and which neither neighbouring word extends with that period. All runs of a text are
found at once on a harmonic grid. A run of period ``q`` and exponent ``e`` holds ``(e - 1) * q`` starts in a row whose
word equals the word ``q`` later, so one of them is a multiple of ``(e - 1) * q``: for all periods together that makes
about ``n * ln(n) / (e - 1)`` pairs (period, grid point). Their longest common extensions to both sides come from
binary searches over prefix hashes, one numpy step for all pairs at a time. Hashes can only make an extension too long,
so each distinct run is compared word by word; the periods of runs that fail are worked out again without hashes.
Stretches found under several periods keep the smallest, of which the others are multiples.

Defined results: texts are handled whole, one at a time, and pairs in slices of ``PAIRS``, so memory follows the
longest text. A null or empty text has no runs and an empty text left. Words are compared by their bytes and left
joined by one space. Rows that repeat get equal results; all other columns stay, and a new column whose name is taken
gets a number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import WORD_PATTERN, flat_map, free_fields, mix

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Pairs of period and grid point that are handled in one step.
PAIRS = 1 << 20
#: Odd multiplier of the prefix hashes, modulo 2 ** 64.
MULTIPLIER = 0xD1342543DE82EF95

_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words alone."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


class PrefixHash:
    """Hashes of all spans of a sequence of numbers: spans are compared as if both began at the later place."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        steps = np.full(n + 1, MULTIPLIER, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(steps)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix(ids + 1) * self.power[:n], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` from ``a`` and from ``b`` (not before ``a``) hash alike."""
        with np.errstate(over="ignore"):
            return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that follow alike from ``a`` and ``b`` on, at most ``most``."""
        return self._search(lambda k: self.equal(a, b, k), most)

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words alike before ``a`` and ``b``, at most ``most``."""
        return self._search(lambda k: self.equal(a - k, b - k, k), most)

    @staticmethod
    def _search(holds, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            fits = holds(middle)
            low = np.where(fits & open_, middle, low)
            high = np.where(fits | ~open_, high, middle - 1)
        return low


def grid(n: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and the grid points of each, in slices of about ``PAIRS``."""
    periods = np.arange(1, n // min_exponent + 1, dtype=np.int64)
    steps = (min_exponent - 1) * periods
    counts = (n - periods - 1) // steps + 1
    ends = np.cumsum(counts)
    first = 0
    while first < len(periods):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        part = slice(first, last)
        q = np.repeat(periods[part], counts[part])
        place = np.arange(len(q)) - np.repeat(ends[part] - counts[part] - (ends[first - 1] if first else 0), counts[part])
        yield q, place * np.repeat(steps[part], counts[part])
        first = last


def hashed_runs(ids: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Distinct rows (start, end, period) that the hashes find; some may be too long, none is missed."""
    n = len(ids)
    hashes = PrefixHash(ids)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q, x in grid(n, min_exponent):
        alike = ids[x] == ids[x + q]
        q, x = q[alike], x[alike]
        if not len(q):
            continue
        start = x - hashes.backward(x, x + q, x)
        end = x + q + hashes.forward(x, x + q, n - x - q)
        long = end - start >= np.maximum(min_length, min_exponent * q)
        found.append(np.unique(np.column_stack((start[long], end[long], q[long])), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def plain_runs(ids: np.ndarray, q: int, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, end, period) of one period, by comparing all words ``q`` apart."""
    breaks = np.concatenate(([-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]))
    start, end = breaks[:-1] + 1, breaks[1:] + q
    long = end - start >= max(min_length, min_exponent * q)
    return np.column_stack((start[long], end[long], np.full(long.sum(), q)))


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """All runs of a sequence of numbers as rows (start, end, smallest period), by start, then period."""
    if len(ids) < max(min_length, min_exponent):
        return np.zeros((0, 3), dtype=np.int64)
    found = hashed_runs(ids, min_length, min_exponent)
    while True:
        # Sorted by start, end and period, so the first of equal stretches has the smallest period.
        first = np.ones(len(found), dtype=bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        runs = found[first]
        wrong = {int(q) for s, e, q in runs if not np.array_equal(ids[s : e - q], ids[s + q : e])}
        if not wrong:
            break
        rest = found[~np.isin(found[:, 2], list(wrong))]
        found = np.unique(np.concatenate([rest, *(plain_runs(ids, q, min_length, min_exponent) for q in sorted(wrong))]), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def text_runs(text: str | None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, the runs as (start, length, period), and the text without each run's words after its first period."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    runs = find_runs(word_ids(words), min_length, min_exponent)
    if not len(runs):
        return len(words), [], b" ".join(words).decode("utf-8", "surrogatepass")
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 1], -1)
    kept = [words[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0)]
    return len(words), [(int(s), int(e - s), int(q)) for s, e, q in runs], b" ".join(kept).decode("utf-8", "surrogatepass")


def collapse_runs(df: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The other columns of ``df`` with ``n_words``, ``runs`` (start, length, period) and the ``collapsed`` text."""
    keep = [c for c in df.columns if c != text_col]

    def make():
        return lambda text: [text_runs(text, min_length, min_exponent)]

    return flat_map(df, text_col, keep, free_fields(keep, FIELDS), make)


def longest_first(a: Column, b: Column) -> Column:
    """Order of runs: by length, the longest first, then start and period."""
    order = lambda r: F.struct(-r["length"], r["start"], r["period"])
    return F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)


def with_planted_run(text: Column, seed: Column) -> Column:
    """The text with its end replaced by copies of a few of its own words, in one of ten rows by ``seed``; to test with.

    With n words and g = floor(seed / 10), rows whose seed is a multiple of ten repeat the ``1 + floor((n - a) / (3 + g % 8))``
    words from word ``a = g % n`` on to the end. Other rows keep their text; so do those without words or seed.
    """
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n, g = F.size(words).cast("long"), F.floor(seed / 10)
    at = lambda w: F.struct(w.alias("w"), (g % F.size(w)).alias("a"))

    def repeated(x: Column) -> Column:
        w, a = x["w"], x["a"]
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        head, block = F.slice(w, F.lit(1), a.cast("int")), F.slice(w, (a + 1).cast("int"), p.cast("int"))
        copies = F.ceil((F.size(w) - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(block, copies)), F.lit(1), (F.size(w) - a).cast("int"))
        return F.array_join(F.concat(head, tail), " ")

    planted = F.element_at(F.transform(F.array(at(words)), repeated), 1)
    return F.when((seed % 10 == 0) & (n > 0), planted).otherwise(text)
