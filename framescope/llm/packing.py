"""Packing tokenised documents into sequences by minimum bin slack.

Only the lengths of the pieces matter, and there are at most ``capacity`` different ones. Spark counts the pieces of
each length; that table plans all bins. For each bin the largest piece left is fixed, and a subset-sum dynamic program
over bitsets finds the fullest combination of the other lengths that are left. The combination is taken away as often
as the counts allow, so that the plan takes about as many steps as there are lengths, not as there are bins.

Pieces then look up their place. A piece's rank among those of its length is a prefix sum over (length, salt) plus a
row number inside that group, so that a length shared by a third of all pieces is spread over many tasks.

Defined results: a null text counts as empty, and an empty text is one piece with the end id alone. A text is cut only
if its ids exceed the capacity. Rows that are equal in every column get different places. An empty table gives an empty
result. Carried columns keep their names; result columns that clash with them get a numbered suffix.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import flat_map, free_name, materialize, quoted

CAPACITY = 2048
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_500_000


#: How the tokenizer must normalise and split texts for ids to be those of the words in turn.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
END_OF_WORD = "</w>"


class WordEncoder:
    """Ids of whole texts, from a cache of the ids of their words.

    A tokenizer with the rules above splits at white space and between letters and marks, so ids of a text are those
    of its words in turn. Words are looked up as bytes of little-endian 32-bit ids. The cache is emptied when it holds
    ``limit`` words (about 150 bytes each). Texts go whole to a tokenizer with other rules.
    """

    MARKS = b".,;:!?|#%&$*"

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a piece
        self.last[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = rules["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": SPLITTER} and rules["model"].get("end_of_word_suffix") == END_OF_WORD and not rules["post_processor"]

    @staticmethod
    def letters(word: bytes) -> bool:
        """Whether the tokenizer sees letters alone: lower case may bring marks, as that of a dotted capital I does."""
        if word.isalpha():  # of ASCII alone
            return True
        text = word.decode("utf-8", "replace")
        return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()

    def stem(self, word: bytes) -> bytes:
        """``word`` without the marks behind it, if what is left ends in an ASCII letter or digit, or is letters alone."""
        stem = word.rstrip(self.MARKS)
        return stem if stem[-1:].isalnum() or self.letters(stem) else word

    def word(self, word: bytes) -> bytes:
        found = self.known.get(word)
        if found is None:
            stem = self.stem(word)
            if len(stem) < len(word):
                found = self.word(stem) + self.word(word[len(stem) :])
            elif word.isascii() and (small := word.lower()) != word and b"<" not in word:
                found = self.word(small)
            else:
                ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
                found = np.asarray(ids, dtype="<u4").tobytes()
            self.known[word] = found
        return found

    def learn(self, words: set[bytes]) -> None:
        """Encode the new words that are letters alone in one go: each is one piece, which an ending id closes."""
        new = set()
        for word in words:
            stem = self.stem(word)
            stem = stem.lower() if stem.isascii() else stem
            if stem not in self.known and self.letters(stem):
                new.add(stem.decode("utf-8", "replace"))
        order = sorted(new)
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) == len(part):  # otherwise they are encoded one by one
                data, start = ids.tobytes(), 0
                for letters, end in zip(part, ends.tolist(), strict=True):
                    self.known[letters.encode()] = data[start:end]
                    start = end

    def text(self, text: str) -> bytes:
        if not self.by_word:
            whole = text.encode("utf-8", "replace").decode("utf-8")
            return np.asarray(self.tokenizer.encode(whole, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) > self.limit:
            self.known.clear()
        words = text.encode("utf-8", "replace").split()
        get = self.known.get
        found = list(map(get, words))
        if None in found:
            self.learn({w for w, x in zip(words, found, strict=True) if x is None})
            found = [self.word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)  # type: ignore[arg-type]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def tokenize(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), capacity: int = CAPACITY, end_id: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """The ``keep`` columns with ``piece``, ``start``, ``length`` and ``ids`` (little-endian 32-bit) of each piece.

    ``cache_words`` bounds a worker's memory, at about 150 bytes a word; results don't depend on it.
    """
    width = 4 * capacity
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def make() -> Callable[[Any], Iterable[tuple]]:
        key = (tokenizer_path, cache_words)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, WordEncoder(*key))

        def pieces(text: str | None) -> Iterable[tuple]:
            ids = encoder.text(text or "") + end
            for k in range(0, len(ids), width):
                part = ids[k : k + width]
                yield k // width, k // 4, len(part) // 4, part

        return pieces

    names = {n: free_name(df, n) if n in {k.lower() for k in keep} else n for n in ("piece", "start", "length", "ids")}
    kinds = (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()))
    return flat_map(df, text_col, keep, [T.StructField(names[n], t) for n, t in kinds], make)


@dataclass(frozen=True)
class Bins:
    """``count`` bins that all hold ``uses[length]`` pieces of each length."""

    uses: tuple[tuple[int, int], ...]
    count: int


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths and their numbers with the largest sum up to ``room``; of equal sums, that with the larger lengths."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(x for x in counts if x <= room):
        steps.append((length, reach))
        left, part = min(counts[length], room // length), 1
        while left:  # multiples by powers of two
            take = min(part, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
    total, out = reach.bit_length() - 1, {}
    for length, below in reversed(steps):
        used, most = 0, min(counts[length], total // length)
        for k in range(most, -1, -1):
            if below >> (total - k * length) & 1:
                used = k
                break
        if used:
            out[length] = used
            total -= used * length
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for ``counts`` pieces of each length, largest pieces first, each as full as the pieces left allow."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        largest = max(left)
        others = {k: v - (k == largest) for k, v in left.items() if v - (k == largest) > 0}
        uses = fullest(capacity - largest, others) if capacity > largest else {}
        uses[largest] = uses.get(largest, 0) + 1
        times = min(left[k] // n for k, n in uses.items())
        plan.append(Bins(tuple(sorted(uses.items(), reverse=True)), times))
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


@dataclass(frozen=True)
class Places:
    """Where the piece with a given length and rank goes: runs of ranks, sorted, each inside one kind of bins."""

    base: np.ndarray  # first global rank of each length
    start: np.ndarray
    first_bin: np.ndarray
    uses: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        run = np.searchsorted(self.start, at, side="right") - 1
        k = at - self.start[run]
        return self.first_bin[run] + k // self.uses[run], self.offset[run] + (k % self.uses[run]) * length


def places_of(plan: Sequence[Bins], counts: dict[int, int], capacity: int = CAPACITY) -> Places:
    base = np.zeros(capacity + 2, dtype=np.int64)
    for length in range(1, capacity + 1):
        base[length + 1] = base[length] + counts.get(length, 0)
    given: dict[int, int] = dict.fromkeys(counts, 0)
    runs, first = [], 0
    for bins in plan:
        offset = 0
        for length, uses in bins.uses:
            runs.append((base[length] + given[length], first, uses, offset))
            given[length] += uses * bins.count
            offset += uses * length
        first += bins.count
    table = np.array(sorted(runs) or [(0, 0, 1, 0)], dtype=np.int64)
    return Places(base, *(np.ascontiguousarray(table[:, k]) for k in range(4)))


def pack(pieces: DataFrame, length_col: str = "length", order_by: Sequence[str] = (), capacity: int = CAPACITY, salts: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths are 1 to ``capacity``; ``pieces`` is read more than once,
    so it should be a table."""
    spark = pieces.sparkSession
    rank, salt, group, of_length, of_salt = (free_name(pieces, n) for n in ("pack_rank", "pack_salt", "pack_before", "group_length", "group_salt"))
    names = [free_name(pieces, n) for n in ("sequence_id", "offset")]
    keys = [quoted(c) for c in order_by or pieces.columns]
    length = quoted(length_col)
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    groups = salted.groupBy(length.alias(of_length), F.col(salt).alias(of_salt)).agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "pack-groups")
    counts = {int(r[0]): int(r[1]) for r in groups.groupBy(of_length).agg(F.sum("n")).collect()}  # a row per length
    places = spark.sparkContext.broadcast(places_of(plan_bins(counts, capacity), counts, capacity))

    before = Window.partitionBy(of_length).orderBy(of_salt).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.select(of_length, of_salt, (F.sum("n").over(before) - F.col("n")).alias(group))
    inside = Window.partitionBy(length, F.col(salt)).orderBy(*keys)
    ranked = salted.withColumn(rank, F.row_number().over(inside) - 1)
    ranked = ranked.join(groups, (length == F.col(of_length)) & (F.col(salt) == F.col(of_salt)))
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(kind)
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        bins, offsets = places.value.of(lengths.to_numpy(np.int64), ranks.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    placed = ranked.withColumn(rank, place(length, F.col(group) + F.col(rank)))
    return placed.select(*[quoted(c) for c in pieces.columns], F.col(f"{rank}.sequence_id").alias(names[0]), F.col(f"{rank}.offset").alias(names[1]))
