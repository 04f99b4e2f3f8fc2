"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

Features are the words of a text, and their first PREFIX letters for inflected and compound forms; a feature's value
is the logarithm of one more than its count. The labels only say toxic or not. A grade is made of them: 0 for a clean
document, and 1 to 3 for a toxic one, by the terciles of its number of markers, which are words with a feature that the
labels show to be far more frequent in toxic documents. The regression has one weight a feature, shared by all
thresholds:

    P(grade <= k) = logistic(threshold[k] - score),    threshold[0] < threshold[1] < threshold[2]

It is fitted on a bounded sample, the ``max_rows`` labelled documents with the smallest hash of their id; the sample's
words, not its texts, reach the driver. All documents are scored, each as a whole.

Defined results: a null text counts as empty; a text without a known word gets the score 0. Labels that are null or
name no document are passed over, and a document with several labels is used once for each. Without any toxic or any
clean label no word is known, and every document gets grade 0. Equal texts get equal results. An empty table gives an
empty result. Result columns that clash with input columns get a numbered suffix.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import flat_map, free_name, materialize, quoted

LETTERS = re.compile(r"[^\W\d_]+")
GRADES = 4
PREFIX = 4


def words_of(text: str) -> list[str]:
    """Runs of letters, as ``\\p{L}+`` has them: numbers that are no digits (``²``, ``Ⅷ``) are no letters."""
    found = LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, a word or ``^`` and a prefix, and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> float:
        total = 0.0
        known = self.weights
        counts: Counter[str] = Counter()
        for word, n in Counter(words_of((text or "").lower())).items():
            if word in known:
                counts[word] += n
            if len(word) >= PREFIX and (start := "^" + word[:PREFIX]) in known:
                counts[start] += n
        for feature in sorted(counts):
            total += known[feature] * math.log1p(counts[feature])
        return total

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... in columns."""
        return sigmoid(scores[:, None] - np.asarray(self.thresholds)[None, :])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_words: int, penalty: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by Adam over all rows.

    Thresholds are the first one and the logarithms of the gaps to the next ones, so that they stay in order.
    """
    n, k = len(grades), GRADES - 1
    shares = np.array([(grades >= j + 1).mean() for j in range(k)])
    start = -np.log(np.clip(shares, 1e-3, 1 - 1e-3) / (1 - np.clip(shares, 1e-3, 1 - 1e-3)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate((np.zeros(n_words), start[:1], gaps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    index = np.arange(n)
    for step in range(1, steps + 1):
        w, width = x[:n_words], np.exp(x[n_words + 1 :])
        theta = np.concatenate((x[n_words : n_words + 1], x[n_words] + np.cumsum(width)))
        score = np.bincount(rows, weights=values * w[cols], minlength=n)
        # Cumulative probabilities with the ends 0 and 1, and their slopes.
        below = np.concatenate((np.zeros((n, 1)), sigmoid(theta[None, :] - score[:, None]), np.ones((n, 1))), axis=1)
        slope = below * (1 - below)
        p = np.maximum(below[index, grades + 1] - below[index, grades], 1e-12)
        up, down = slope[index, grades + 1] / p, slope[index, grades] / p
        by_score = (up - down) / n  # of the negative log likelihood
        by_theta = np.array([(down[grades == j + 1].sum() - up[grades == j].sum()) / n for j in range(k)])
        g = np.concatenate((np.bincount(cols, weights=values * by_score[rows], minlength=n_words) + penalty * w, [by_theta.sum()], [by_theta[j:].sum() * width[j - 1] for j in range(1, k)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_words], np.concatenate((x[n_words : n_words + 1], x[n_words] + np.cumsum(np.exp(x[n_words + 1 :]))))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = 20_000, max_words: int = 2_000, min_docs: int = 5, min_gain: float = 8.0) -> Ordinal:
    """Fit on at most ``max_rows`` labelled documents and the ``max_words`` words that tell most about the label.

    A word's gain is its log odds ratio times the root of its documents; chance words stay near 3, with ``min_gain``
    well above that.
    """
    picked = labels.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull()).select(quoted(id_col).alias("label_id"), (quoted(label_col) > 0).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(max_rows)
    texts = docs.select(quoted(id_col).alias("label_id"), quoted(text_col).alias("label_text")).join(F.broadcast(picked), "label_id")  # max_rows rows
    words = F.filter(F.split(F.lower(F.coalesce("label_text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    starts = F.transform(F.filter(words, lambda w: F.length(w) >= PREFIX), lambda w: F.concat(F.lit("^"), F.substring(w, 1, PREFIX)))
    words = F.concat(words, starts)
    counted = materialize(texts.select("label_id", "toxic", F.xxhash64("label_text").alias("label_hash"), words.alias("words")), "toxicity-sample")
    rows = counted.withColumn("word", F.explode("words")).groupBy("label_id", "label_hash", "toxic", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(True) or not totals.get(False):
        return Ordinal({}, (40.0, 41.0, 42.0))
    toxic, clean = float(totals[True]), float(totals[False])
    seen = rows.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).where(F.col("t") + F.col("c") >= min_docs)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = seen.select("word", odds.alias("odds"), (F.abs(odds) * F.sqrt(F.col("t") + F.col("c"))).alias("gain")).where(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "word").limit(max_words).collect()
    place = {r["word"]: k for k, r in enumerate(best)}
    markers = {r["word"] for r in best if r["odds"] >= 3}

    # A row for each labelled document, max_rows at most, with the places and counts of its known words.
    key = F.xxhash64("label_id", "label_hash", "toxic").alias("key")
    once = counted.dropDuplicates(["label_id", "label_hash", "toxic"]).select(key, F.col("toxic").cast("int").alias("toxic"), "words")

    def make() -> Callable[[Any], Iterable[tuple]]:
        def row(words: list[str]) -> Iterable[tuple]:
            found = Counter(place[w] for w in words if w in place)
            order = sorted(found)
            return [(np.asarray(order, dtype=np.int32), np.asarray([found[k] for k in order], dtype=np.int32))]

        return row

    numbers = T.ArrayType(T.IntegerType())
    every = flat_map(once, "words", ["key", "toxic"], [T.StructField("places", numbers), T.StructField("counts", numbers)], make).orderBy("key").toArrow()
    keys, grades = every["key"].to_numpy(), every["toxic"].to_numpy().astype(np.int64)
    filled = [len(x) for x in every["places"].to_pylist()]
    r = np.repeat(np.arange(len(keys)), filled)
    c, n = (np.concatenate([*map(np.asarray, every[f].to_pylist()), np.zeros(0)]).astype(np.int64) for f in ("places", "counts"))
    names = list(place)
    marks = np.array([w in markers and (w[0] == "^" or "^" + w[:PREFIX] not in markers) for w in names] + [False])
    dose = np.bincount(r, weights=n * marks[c], minlength=len(keys))
    found = dose[grades == 1]
    cuts = np.quantile(found, [1 / 3, 2 / 3])
    grades[grades == 1] += np.searchsorted(cuts, found, side="right")
    w, theta = fit_ordinal(r, c, np.log1p(n), grades, len(place))
    return Ordinal({word: float(w[k]) for word, k in place.items()}, tuple(float(t) for t in theta))


RESULT = T.StructType([T.StructField("expected_severity", T.DoubleType()), T.StructField("severity", T.IntegerType()), T.StructField("p_toxic", T.DoubleType())])


def grade(df: DataFrame, model: Ordinal, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``expected_severity`` (0 to 3), ``severity`` (the likeliest grade), ``p_toxic`` and ``toxic``."""

    @F.pandas_udf(RESULT)
    def rate(texts: pd.Series) -> pd.DataFrame:
        above = model.at_least(np.array([model.score(t) for t in texts], dtype=np.float64))
        steps = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
        return pd.DataFrame({"expected_severity": above.sum(axis=1), "severity": (steps[:, :-1] - steps[:, 1:]).argmax(axis=1).astype("int32"), "p_toxic": above[:, 0]})

    tmp = free_name(df, "toxicity")
    rated = df.withColumn(tmp, rate(quoted(text_col)))
    names: Sequence[str] = [free_name(df, n) for n in ("expected_severity", "severity", "p_toxic", "toxic")]
    s = quoted(tmp)
    return rated.select(*[quoted(c) for c in df.columns], *(s[f].alias(n) for f, n in zip(("expected_severity", "severity", "p_toxic"), names, strict=False)), (s["p_toxic"] >= threshold).alias(names[3]))
