"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character of a text, and its end, from the four characters before it. Words are joined by one
space each and grams run across word borders, so that words in senseless order cost more than words in their places.
It is trained on four in five trusted documents, chosen by hash; the others are held out and set the thresholds.

One pass over all documents gives, for each task, its distinct grams with their counts in the training text (0 where a
gram occurs in other text only); summed up by gram they are both the training counts and the list of what must be
scored. Counts of all orders, sums by context, and interpolated probabilities are joins of tables hash-partitioned by
gram, context and suffix. Gram probabilities go back to the documents in one of two ways that give the same values: as
a broadcast table if there are at most ``broadcast_grams``; otherwise documents and the distinct grams of each block of
about ``block_bytes`` of text are joined block by block. Documents look grams up by 64-bit hashes.

A document is kept if its perplexity is at most the given quantile of held-out documents in its language. Languages
with fewer than ``min_trusted`` held-out documents share the quantile of all held-out ones; if no document is held out,
as in tables of a few rows, the trusted ones take their place.

Defined results: a null or empty text has no perplexity and isn't kept. A null language is a language of its own. Labels
that are null or name no document are passed over. Without trusted text every gram is equally likely, and nothing is
kept, since there is no quantile; they are equally likely, too, if all trusted texts are held out. Rows that are equal are scored alike. An empty table gives an empty result. The
characters 0 and 2 count as U+FFFD. Columns of the input that clash with ``trusted``, ``perplexity``, ``threshold`` or
``kept`` keep their names if they are in ``keep``; the result columns get a numbered suffix.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import free_name, materialize, mix, quoted

ORDER = 5
START = "\x02"
#: Characters that a task works on at a time, and distinct grams that it holds.
STRETCH, HELD = 2_000_000, 500_000


def points_of(text: str | None) -> np.ndarray | None:
    """Code points of a text behind ``ORDER`` - 1 starts, with one space after each word; nothing without words."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    if blank.all():
        return None
    points = np.where((points == 0) | (points == ord(START)), 0xFFFD, np.where(blank, 32, points))
    points = points[~(blank & np.concatenate(([True], blank[:-1])))]
    end = [] if points[-1] == 32 else [32]
    return np.concatenate(([ord(START)] * (ORDER - 1), points, end)).astype(np.uint32)


def grams_of(text: str) -> list[str]:
    """The grams that predict each character of a text and the space after its last word."""
    points = points_of(text)
    return [] if points is None else ["".join(map(chr, points[k : k + ORDER])) for k in range(len(points) - ORDER + 1)]


def stretches(texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts with words, some at a time: their places, all code points, and where grams and each text's grams begin."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def joined() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        whole = np.ones(ends[-1], dtype=bool)
        for k in range(1, ORDER):
            whole[ends - k] = False
        own = lengths - (ORDER - 1)
        return rows, np.concatenate(parts), np.flatnonzero(whole), np.cumsum(own) - own

    for k, text in enumerate(texts):
        points = points_of(text)
        if points is not None:
            rows.append(k)
            parts.append(points)
            size += len(points)
        if size >= STRETCH:
            yield joined()
            rows, parts, size = [], [], 0
    if parts:
        yield joined()


def keys_of(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams that begin at these places."""
    p = points.astype(np.uint64)
    step = np.uint64(21)
    left = (((p[:-4] << step) | p[1:-3]) << step) | p[2:-2]
    right = (p[3:-1] << step) | p[4:]
    return mix(mix(left[at]) ^ right[at])


class Grams:
    """Distinct grams with counts."""

    def __init__(self) -> None:
        self.keys, self.codes, self.n = np.zeros(0, dtype=np.uint64), np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def add(self, points: np.ndarray, at: np.ndarray, weight: int) -> None:
        keys, first, n = np.unique(keys_of(points, at), return_index=True, return_counts=True)
        codes = points[at[first][:, None] + np.arange(ORDER)]
        both, first, place = np.unique(np.concatenate((self.keys, keys)), return_index=True, return_inverse=True)
        self.n = np.bincount(place, np.concatenate((self.n, n * weight)), len(both)).astype(np.int64)
        self.keys, self.codes = both, np.concatenate((self.codes, codes))[first]

    def take(self) -> tuple[list[str], np.ndarray]:
        names, n = np.ascontiguousarray(self.codes).view(f"<U{ORDER}").ravel().tolist(), self.n
        self.__init__()
        return names, n


# --- Counting -------------------------------------------------------------------------------------------------------


def gram_counts(df: DataFrame, text_col: str, trusted_col: str) -> DataFrame:
    """(gram, n) with n the occurrences in trusted text. A task adds grams up, and lets go of them at ``HELD``."""
    source = df.select(quoted(text_col).alias("text"), quoted(trusted_col).cast("boolean").alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Grams()

        def flush() -> Iterator[pa.RecordBatch]:
            names, n = held.take()
            for k in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 50_000], pa.string()), pa.array(n[k : k + 50_000])], ["gram", "n"])

        for batch in batches:
            texts, trusted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for weight in (1, 0):
                for _, points, at, _ in stretches(t for t, good in zip(texts, trusted, strict=True) if bool(good) == bool(weight)):
                    held.add(points, at, weight)
                    if len(held.keys) > HELD:
                        yield from flush()
        yield from flush()

    return source.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams that occur once to four times."""
    row = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(row[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratio = lambda a, b: a / b if b else 0.0
    raw = (1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3))
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, logp) of every gram of ``grams`` (gram, n), trained on those with n > 0.

    Below the highest order a gram counts the different characters it follows; one that begins with the start of a
    text has none before it but the start, and keeps its plain count.
    """
    counts = {ORDER: grams.where("n > 0")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        n = F.when(F.substring(F.first("gram"), 2, 1) == START, F.sum("n")).otherwise(F.count(F.lit(1)))
        counts[k] = materialize(counts[k + 1].groupBy(shorter.alias("short")).agg(n.alias("n")).withColumnRenamed("short", "gram"), f"counts-{k}")
    alphabet = counts[1].count() + 1  # and one for any other character
    wanted = {ORDER: grams.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        d = discounts(counts[k])
        context = F.substring("gram", 1, k - 1)
        sums = counts[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("taken"))
        rated = wanted[k].join(counts[k], "gram", "left").withColumn("context", context).join(sums, "context", "left")
        rated = rated.withColumn("suffix", F.substring("gram", 2, k - 1))
        if lower is None:
            rated = rated.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            rated = rated.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        own = F.greatest(F.coalesce(F.col("n"), F.lit(0)) - _discount(F.coalesce(F.col("n"), F.lit(0)), d), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((own + F.col("taken") * F.col("lower")) / F.col("total"))
        lower = materialize(rated.select("gram", p.alias("p")), f"probabilities-{k}")
    return lower.select("gram", F.log("p").alias("logp"))


# --- Scoring --------------------------------------------------------------------------------------------------------


class Scores:
    """Log probabilities by hash of the gram."""

    def __init__(self, grams: Sequence[str], logp: Sequence[float]) -> None:
        points = np.array(grams, dtype=f"<U{ORDER}").view(np.uint32)
        keys = keys_of(points, np.arange(len(grams)) * ORDER) if len(grams) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], np.asarray(logp, dtype=np.float64)[order]

    def perplexities(self, texts: Sequence[str | None]) -> np.ndarray:
        """NaN for a text without words."""
        out = np.full(len(texts), np.nan)
        for rows, points, at, begins in stretches(texts):
            keys, place = np.unique(keys_of(points, at), return_inverse=True)
            total = np.add.reduceat(self.logp[np.searchsorted(self.keys, keys)][place], begins)
            n = np.diff(np.append(begins, len(at)))
            out[rows] = np.exp(np.minimum(700.0, -total / n))
        return out


def score_by_broadcast(df: DataFrame, text_col: str, logp: DataFrame, out: str) -> DataFrame:
    table = logp.toArrow()
    shared = df.sparkSession.sparkContext.broadcast(Scores(table["gram"].to_pylist(), table["logp"].to_numpy()))

    @F.pandas_udf(T.DoubleType())
    def perplexity(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.perplexities(texts.tolist()), dtype="float64")

    return df.withColumn(out, F.nanvl(perplexity(quoted(text_col)), F.lit(None).cast("double")))


def score_by_blocks(df: DataFrame, text_col: str, logp: DataFrame, out: str, blocks: int) -> DataFrame:
    """Documents are dealt into blocks by a hash of their text; each block meets the probabilities of its own grams."""
    block = free_name(df, "block")
    dealt = df.withColumn(block, F.pmod(F.xxhash64(quoted(text_col), *[quoted(c) for c, t in df.dtypes if t == "bigint"]), F.lit(blocks)).cast("int"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Grams] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for b, grams in sorted(held.items()):
                names, _ = grams.take()
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(names), pa.int32()), pa.array(names, pa.string())], ["block", "gram"])
            held.clear()

        for batch in batches:
            texts, where = batch.column(1).to_pylist(), np.asarray(batch.column(0))
            for b in np.unique(where).tolist():
                for _, points, at, _ in stretches(texts[k] for k in np.flatnonzero(where == b)):
                    held.setdefault(b, Grams()).add(points, at, 0)
                    if sum(len(g.keys) for g in held.values()) > HELD:
                        yield from flush()
        yield from flush()

    grams = dealt.select(quoted(block), quoted(text_col)).mapInArrow(needed, "block int, gram string").distinct().join(logp, "gram")

    def score(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        texts[out] = Scores(table["gram"].tolist(), table["logp"].to_numpy()).perplexities(texts[text_col].tolist())
        return texts.drop(columns=[block])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    scored = dealt.groupBy(block).cogroup(grams.groupBy("block")).applyInPandas(score, schema)
    return scored.withColumn(out, F.nanvl(quoted(out), F.lit(None).cast("double")))


def rate_by_perplexity(
    df: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    keep: Sequence[str] = (),
    label_col: str = "quality",
    quantile: float = 0.99,
    min_trusted: int = 30,
    broadcast_grams: int = 1_500_000,
    broadcast_labels: int = 500_000,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Id, language and ``keep`` columns of each row with ``trusted``, ``perplexity``, ``threshold`` (null without
    trusted text) and ``kept``.

    Documents with a positive label are trusted.
    """
    fields = list(dict.fromkeys([id_col, lang_col, *keep]))
    names = {n: free_name(df, n) for n in ("trusted", "perplexity", "threshold", "kept")}
    good = labels.where(quoted(label_col) > 0).select(quoted(id_col).alias("good_id")).where(F.col("good_id").isNotNull()).distinct()
    if good.count() <= broadcast_labels:
        good = F.broadcast(good)
    marked = df.join(good, quoted(id_col) == F.col("good_id"), "left").withColumn(names["trusted"], F.col("good_id").isNotNull()).drop("good_id")
    held, learned = free_name(marked, "held_out"), free_name(marked, "learned")
    marked = marked.withColumn(held, quoted(names["trusted"]) & (F.pmod(F.xxhash64(quoted(id_col)), F.lit(5)) == 0))
    grams = materialize(gram_counts(marked.withColumn(learned, quoted(names["trusted"]) & ~quoted(held)), text_col, learned), "grams")
    logp = probabilities(grams)
    n = logp.count()
    if n <= broadcast_grams:
        scored = score_by_broadcast(marked, text_col, logp, names["perplexity"])
    else:
        scored = score_by_blocks(marked, text_col, logp, names["perplexity"], max(2, (marked.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0) // block_bytes))
    lean = scored.select(*[quoted(c) for c in fields], quoted(names["trusted"]), quoted(held), quoted(names["perplexity"]))
    return threshold_by_language(materialize(lean, "perplexities"), lang_col, names, held, quantile, min_trusted).drop(held)


def threshold_by_language(scored: DataFrame, lang_col: str, names: dict[str, str], held: str, quantile: float, min_trusted: int) -> DataFrame:
    ppl, lang = quoted(names["perplexity"]), quoted(lang_col)
    judges = scored.where(quoted(held) & ppl.isNotNull())
    if judges.isEmpty():
        judges = scored.where(quoted(names["trusted"]) & ppl.isNotNull())
    at = F.percentile_approx(ppl, F.lit(quantile), F.lit(100_000))
    by_lang = {r[0]: (r[1], r[2]) for r in judges.groupBy(lang).agg(at.alias("q"), F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    overall = judges.agg(at.alias("q")).first()[0]
    limit = F.lit(overall).cast("double")
    for name, (q, n) in by_lang.items():
        if n >= min_trusted:
            limit = F.when(lang.eqNullSafe(F.lit(name)), F.lit(q)).otherwise(limit)
    rated = scored.withColumn(names["threshold"], limit)
    return rated.withColumn(names["kept"], F.coalesce(ppl <= quoted(names["threshold"]), F.lit(False)))
