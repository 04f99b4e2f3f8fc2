"""Quality rules as weak supervision.

Each rule looks at counts of one text and votes good (1) or bad (-1), or abstains (0). No rule is trusted by itself:
expectation-maximisation over the votes of all documents estimates how often each rule is right about good and about
bad texts, and the posterior probability that a text is good replaces "must pass every rule".

The votes of a corpus are summed up exactly by the number of documents with each combination of votes. There are at
most 3 ** len(RULES) combinations, whatever the number of documents, so only that table reaches the driver.

Defined results: a null text counts as an empty one; no text or no words gives zero counts and fails the base rules.
Equal texts get equal results, so ties and repeated rows need no order. An empty table gives an empty result, with the
model left at its starting values. Columns of the input that clash with a result column keep their name; the result
column then gets a numbered suffix.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import WORD, free_name, quoted

SYMBOLS = "#*$%&|<>"
_PUNCTUATION = string.punctuation
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_ASCII = bytes(range(128))
STAT_FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_ends", "n_marks", "n_upper", "n_letters")
STATS_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in STAT_FIELDS])


def repeated_words(words: Sequence[str]) -> int:
    """Words that lie in a window of three consecutive words found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: words before this place are counted
    for k, window in enumerate(windows):
        if counts[window] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def text_counts(text: str | None) -> tuple[int, ...]:
    """The STAT_FIELDS of one whole text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    data = text.encode("utf-8", "surrogatepass")
    ends = marks = 0
    counts = Counter(words)
    for word, count in counts.items():
        if word[-1] in _PUNCTUATION:
            ends += count if word[-1] in ".!?" else 0
            marks += count if not word.strip(_PUNCTUATION) else 0
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = len(data) - len(data.translate(None, _LETTERS))
    ascii_bytes = len(data) - len(data.translate(None, _ASCII))
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(counts),
        ends,
        marks,
        upper,
        letters + len(text) - ascii_bytes,
    )


@F.pandas_udf(STATS_TYPE)
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=list(STAT_FIELDS), dtype="int64")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rule_votes(s: dict[str, Column]) -> dict[str, Column]:
    """A vote of each rule. Every bound is a ratio of integers, compared without division."""
    n = s["n_words"]
    return {
        "length": _vote(n < 20, n >= 200),
        "word_length": _vote((s["word_chars"] < 2 * n) | (s["word_chars"] > 14 * n), (s["word_chars"] >= 4 * n) & (s["word_chars"] <= 10 * n)),
        "symbols": _vote(s["n_symbols"] * 10 > n, s["n_symbols"] * 50 < n),
        "line_repeats": _vote(s["n_dup_lines"] * 2 > s["n_lines"], (s["n_dup_lines"] == 0) & (s["n_lines"] >= 2)),
        "word_repeats": _vote(s["n_repeat_words"] * 10 > 3 * n, s["n_repeat_words"] * 20 < n),
        "capitals": _vote(s["n_upper"] * 5 > 2 * s["n_letters"], s["n_upper"] * 6 < s["n_letters"]),
        "sentence_ends": _vote((s["n_ends"] * 50 < n) | (s["n_ends"] * 3 > 2 * n), (s["n_ends"] * 25 >= n) & (s["n_ends"] * 3 <= n)),
        "variety": _vote(s["n_distinct"] * 5 < n, s["n_distinct"] * 3 >= n),
        "letters": _vote(s["n_letters"] * 10 < 7 * s["word_chars"], s["n_letters"] * 20 >= 17 * s["word_chars"]),
        "marks": _vote(s["n_marks"] * 10 > n, s["n_marks"] * 50 < n),
    }


RULES = ("length", "word_length", "symbols", "line_repeats", "word_repeats", "capitals", "sentence_ends", "variety", "letters", "marks")


#: Where the accuracies start: a rule clears 97 of 100 good texts and catches 3 of 10 bad ones.
START_GOOD, START_BAD = 0.97, 0.3


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts. right_good[j], right_bad[j]: how often rule j, where it votes, is right about them."""

    prior: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]
    rounds: int

    def log_odds(self, votes: Sequence[int]) -> float:
        z = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(votes, self.right_good, self.right_bad, strict=True):
            z += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
        return z

    def posterior(self, votes: Sequence[int]) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.log_odds(votes)))))


def fit_votes(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 200, tolerance: float = 1e-10) -> VoteModel:
    """Expectation-maximisation over counts of vote combinations.

    Bad texts come in kinds, and a rule knows one or two of them: it seldom condemns a good text, but it passes most
    bad ones. So a rule has two accuracies, and they start at START_GOOD and START_BAD. The expectation step takes
    each combination's posterior; the maximisation step re-estimates the share of good texts and the accuracies. Ten
    pseudo-votes at the start values keep rules that seldom vote finite. A rule never gets worse than chance (its two
    accuracies add up to more than 1), so that the two labels cannot swap.
    """
    model = VoteModel(0.8, (START_GOOD,) * n_rules, (START_BAD,) * n_rules, 0)
    total = sum(patterns.values())
    if not total:
        return model
    for k in range(1, rounds + 1):
        good_all = 0.0
        good, bad = [[10 * START_GOOD, 10.0] for _ in range(n_rules)], [[10 * START_BAD, 10.0] for _ in range(n_rules)]
        for votes, count in sorted(patterns.items()):
            p = model.posterior(votes)
            good_all += p * count
            for j, v in enumerate(votes):
                if v:
                    good[j][0] += p * count * (v > 0)
                    good[j][1] += p * count
                    bad[j][0] += (1 - p) * count * (v < 0)
                    bad[j][1] += (1 - p) * count
        right_good = tuple(min(max(x / n, 0.5), 0.999) for x, n in good)
        right_bad = tuple(min(max(x / n, 1.01 - g), 0.999) for (x, n), g in zip(bad, right_good, strict=True))
        new = VoteModel(min(max(good_all / total, 0.001), 0.999), right_good, right_bad, k)
        moved = max(abs(a - b) for a, b in zip((model.prior, *model.right_good, *model.right_bad), (new.prior, *new.right_good, *new.right_bad), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def _votes_of(stats: Column) -> list[Column]:
    votes = rule_votes({f: stats[f] for f in STAT_FIELDS})
    return [votes[r] for r in RULES]


def learn(df: DataFrame, stats: str) -> VoteModel:
    """Fit the rules' accuracies to the votes of every row of ``df``; ``stats`` names the struct of counts."""
    code = F.lit(0)
    for v in _votes_of(quoted(stats)):
        code = code * 3 + v + 1
    patterns: dict[tuple[int, ...], int] = {}
    for c, count in df.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most 3 ** 10 rows
        digits = []
        for _ in RULES:
            digits.append(c % 3 - 1)
            c //= 3
        patterns[tuple(reversed(digits))] = count
    return fit_votes(patterns, len(RULES))


def posterior_of(stats: Column, model: VoteModel) -> Column:
    z = F.lit(math.log(model.prior / (1 - model.prior)))
    for v, g, b in zip(_votes_of(stats), model.right_good, model.right_bad, strict=True):
        z = z + F.when(v > 0, F.lit(math.log(g / (1 - b)))).when(v < 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def base_failed(stats: Column, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_repeat_percent * stats["n_words"])


def with_stats(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` and a struct of counts over each whole text, and the struct's name."""
    name = free_name(df, "rule_stats")
    return df.withColumn(name, stats_of(quoted(text_col))), name


def rate_quality(df: DataFrame, text_col: str = "text", threshold: float = 0.5, stats: str | None = None) -> DataFrame:
    """``df`` with the struct of counts and ``quality_posterior``, ``base_failed`` and ``kept``.

    ``stats`` names a struct of counts that ``df`` already has. Counting then runs once; otherwise it runs once to fit
    the rules and once to rate. A text is kept if it passes the base rules and its posterior is at least ``threshold``.
    """
    if stats is None:
        df, stats = with_stats(df, text_col)
    model = learn(df, stats)
    s = quoted(stats)
    out = {}
    for name, value in (("quality_posterior", posterior_of(s, model)), ("base_failed", base_failed(s))):
        out[name] = free_name(df, name)
        df = df.withColumn(out[name], value)
    kept = free_name(df, "kept")
    return df.withColumn(kept, ~quoted(out["base_failed"]) & (quoted(out["quality_posterior"]) >= threshold))
