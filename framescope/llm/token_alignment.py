"""Alignment of two tokenizers' tokens over a corpus: each distinct segment of text is tokenised and aligned once.

A byte-level BPE (A) and a sentence-piece BPE (B) cut the same bytes into tokens. Texts are cut before runs of white
space into segments across which neither can merge: no token of either vocabulary holds a character that isn't white
space followed by the white space that begins a segment, which ``Borders`` verifies from the vocabularies (A's splitting
rule also never joins the two). Tokens of a text are thus those of its segments, one after the other, and so are the
groups (bytes between offsets at which tokens of both end) and the links (tokens that share bytes).

1. Blocks of texts are written as numbers of the block's distinct segments, with that list and its counts.
2. Counts are summed by segment; every distinct segment is tokenised and aligned once.
3. Links are counted by pair of ids over the corpus, which gives each segment the sums over its own links.
4. The segments' alignments are joined back to the blocks, where documents are put together from numbers.

What moves between tasks is the distinct segments of each block, not the words of each text. Links are looked up in a
broadcast if there are at most ``BROADCAST_PAIRS`` pairs of ids, otherwise joined.

Defined results: a null or empty text, and one whose tokens don't give its bytes back, has no tokens, so zeros and an
empty list of groups. Strings of special tokens are plain text. Texts are handled whole. Rows that repeat count each.
The ``keep`` columns stay, and a new column whose name is taken gets a number. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framescope.llm.common import free_fields, materialize, quoted

#: Code points of text in a block and of segments in one call of a tokenizer, pairs of ids that are broadcast at most (24
#: bytes each), and aligned segments that are dealt out to blocks at a time.
BLOCK_CHARS, CALL_CHARS, BROADCAST_PAIRS, DEALT = 32 << 20, 1 << 14, 2_000_000, 200_000
SPACE = "▁"
_PAIR = 20  # bits of B's id in a pair's number


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of each token, and the pattern of the segments."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        if self.a.normalizer is not None:
            raise ValueError("the byte-level tokenizer must leave texts as they are")
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        if sum(map(self.b.is_byte, range(len(pieces)))) != 256 or {x for x in self.bytes_a if len(x) == 1} != {bytes([k]) for k in range(256)}:
            raise ValueError("both vocabularies must have all bytes")
        self.space = self.b.piece_to_id(SPACE)
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.segments = Borders([x.decode(errors="replace") for x in self.bytes_a], [p.replace(SPACE, " ") for k, p in enumerate(pieces) if not self.b.is_byte(k)])

    def survives(self, text: str) -> bool:
        """Whether B's normal form of the text, and thus its pieces, has the bytes of the text."""
        return self.b.normalize(text) == (" " + text).replace(" ", SPACE) and SPACE not in text

    def encode(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other.

        Segments are strung together as far as borders allow, since a call for each costs more than its tokens. B puts a
        space in front of a text, which takes the place of its own first space or else is left out.
        """
        strings: list[list[str]] = []
        size = CALL_CHARS
        for s in segments:
            if size >= CALL_CHARS or strings[-1][-1][-1].isspace() or strings[-1][-1][-1] in self.segments.unsafe:
                strings.append([])
                size = 0
            strings[-1].append(s)
            size += len(s)
        texts = ["".join(x) for x in strings]
        ids_a = [k for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for k in e.ids]
        ids_b: list[int] = []
        for text in texts:
            own = self.b.encode(text[1:] if text[0] == " " else text) if text != " " else [self.space]
            if text[0] != " " and own[:1] != [self.space]:
                raise ValueError("a token crosses a segment's border")
            ids_b += own if text[0] == " " else own[1:]
        return np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)


class Borders:
    """Cuts texts where no token of either vocabulary can stand across: before white space behind another character.

    A space may begin a segment; so may other ASCII white space that no piece of B holds, since B can then merge nothing
    with it. A character that a token holds before such white space ends no segment.
    """

    def __init__(self, tokens_a: Sequence[str], pieces_b: Sequence[str]) -> None:
        held = {c for p in pieces_b for c in p}
        self.first = " " + "".join(c for c in "\n\t\r\x0b\x0c" if c not in held)
        inside = re.compile(rf"(\S)(?=[{re.escape(self.first)}])")
        self.unsafe = frozenset(c for t in (*tokens_a, *pieces_b) for c in inside.findall(t))
        self.pattern = re.compile(rf"\s+\S*(?:[^\S{re.escape(self.first)}]\s*\S*)*")

    def __call__(self, text: str) -> list[str]:
        """Segments of a space and the text."""
        found = self.pattern.findall(" " + text)
        if not self.unsafe:
            return found
        out = found[:1]
        for s in found[1:]:
            if out[-1][-1] in self.unsafe:
                out[-1] += s
            else:
                out.append(s)
        return out


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens that share bytes, by A's place, from the offsets at which tokens end."""
    # Each token of A meets those of B from the one that holds its first byte to the one that holds its last.
    first = np.searchsorted(ends_b, ends_a - np.diff(ends_a, prepend=0), side="right")
    n = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    return np.repeat(np.arange(len(ends_a)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Alignment:
    """Alignments of many segments, worked out together: their bytes one after the other are one text, whose groups never
    reach across segments, since tokens of both end there."""

    def __init__(self, t: Tokenizers, segments: Sequence[str]) -> None:
        ids_a, ids_b = t.encode(segments)
        self.a, self.b = ids_a, ids_b
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        ends_a, ends_b = np.cumsum(t.length_a[ids_a]), np.cumsum(t.length_b[ids_b])
        borders = np.cumsum([len(x) for x in raw])
        joined = b"".join(raw)
        if b"".join([t.bytes_a[k] for k in ids_a.tolist()]) != joined or b"".join([t.bytes_b[k] for k in ids_b.tolist()]) != joined:
            raise ValueError("tokens don't give the bytes of their segments back")
        # Numbers of tokens, groups and links up to the end of each segment.
        self.upto_a, self.upto_b = (np.searchsorted(e, borders, side="right") for e in (ends_a, ends_b))
        if not (np.array_equal(ends_a[self.upto_a - 1], borders) and np.array_equal(ends_b[self.upto_b - 1], borders)):
            raise ValueError("a token crosses a segment's border")
        self.common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.upto_groups = np.searchsorted(self.common, borders, side="right")
        at_a, at_b = _overlaps(ends_a, ends_b)
        self.pairs = (ids_a[at_a] << _PAIR) | ids_b[at_b]
        self.upto_links = np.searchsorted(at_a, self.upto_a, side="left")
        self.ends = (ends_a, ends_b)

    def texts(self) -> list[str]:
        """Each segment's groups as ``a1,a2|b1;a3|b2``."""
        closed = [np.isin(e, self.common) for e in self.ends]  # tokens that end a group
        group = [np.searchsorted(self.common, e, side="left") for e in self.ends]
        side = np.concatenate([np.zeros(len(self.a), dtype=np.int8), np.ones(len(self.b), dtype=np.int8)])
        order = np.lexsort((side, np.concatenate(group)))  # stable, so tokens of a side keep their order
        marks = np.concatenate([np.where(closed[0], "|", ","), np.where(closed[1], ";", ",")])[order].tolist()
        ids = np.concatenate([self.a, self.b])[order].tolist()
        parts = [f"{k}{m}" for k, m in zip(ids, marks, strict=True)]
        ends = (self.upto_a + self.upto_b).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


def _packed(codes: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: segments are numbered as they come, so most have few low bytes."""
    planes = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _batch(columns: Sequence[Sequence], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], schema.names)


def encoded_blocks(df: DataFrame, text_col: str, keep: Sequence[str], paths: tuple[str, str], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a block: its texts as numbers of its distinct segments, these with their counts, and the kept columns.

    ``sizes`` holds each text's number of segments, ``codes`` those of all texts. The columns kept are arrays.
    """
    n = len(keep)
    source = df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keep)], quoted(text_col).cast("string").alias("text"))
    kept = [T.StructField(f"k{i}", T.ArrayType(df.schema[k].dataType)) for i, k in enumerate(keep)]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*paths)
        task = TaskContext.get().partitionId() << 32
        block = 0
        numbers: dict[str, int] = {}
        codes: list[np.ndarray] = []
        values: list[list[pa.Array]] = [[] for _ in keep]
        sizes: list[int] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
            counts = np.bincount(every, minlength=len(numbers))
            columns: list[Any] = [[task + block], [len(sizes)], [_packed(np.array(sizes))], [_packed(every)], [list(numbers)], [counts]]
            arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=False)]
            for x, f in zip(values, kept, strict=True):
                items = pa.concat_arrays(x)
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items).cast(to_arrow_type(f.dataType)))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            first = 0
            for k, value in enumerate(batch.column(n)):
                text = value.as_py()
                found = t.segments(text) if text and t.survives(text) else []
                codes.append(np.fromiter((numbers.setdefault(s, len(numbers)) for s in found), dtype=np.int64, count=len(found)))
                sizes.append(len(found))
                chars += len(text or "")
                if chars >= block_chars:
                    for x, c in zip(values, batch.columns, strict=False):
                        x.append(c.slice(first, k + 1 - first))
                    yield flush()
                    first, block, chars, sizes = k + 1, block + 1, 0, []
                    numbers, codes, values = {}, [], [[] for _ in keep]
            for x, c in zip(values, batch.columns, strict=False):
                x.append(c.slice(first))
        if sizes:
            yield flush()

    return source.mapInArrow(run, schema)


_ALIGNED = [T.StructField("n_a", T.IntegerType()), T.StructField("n_b", T.IntegerType()), T.StructField("n_groups", T.IntegerType()), T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType())]


def aligned_segments(segments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``segment`` and ``count`` with the alignment; ``links`` holds the numbers of the linked id pairs."""
    schema = T.StructType([*segments.schema.fields, *_ALIGNED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*paths)
        for whole in batches:
            for k in range(0, len(whole), 4096):
                batch = whole.slice(k, 4096)
                x = Alignment(t, batch.column(0).to_pylist())
                own = lambda upto: np.diff(upto, prepend=0).astype(np.int32)
                links = x.pairs.astype("<i8").tobytes()
                ends = (8 * x.upto_links).tolist()
                made = (own(x.upto_a), own(x.upto_b), own(x.upto_groups), x.texts(), [links[i:j] for i, j in zip([0, *ends], ends, strict=False)])
                arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(made, _ALIGNED, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return segments.select("segment", "count").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Over the corpus, how many links hold each id ``pair``, and whether none with its B id has more."""
    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            links = [np.frombuffer(x, dtype=np.int64) for x in batch.column(0).to_pylist()]
            weight = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(x) for x in links])
            pairs, place = np.unique(np.concatenate(links), return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, place, weight)
            yield _batch((pairs, total), schema)

    counts = aligned.select("links", "count").mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << _PAIR) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def with_sums(aligned: DataFrame, pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Segments with ``n_links``, ``n_best`` (links whose pair none with the same B id exceeds) and ``count_sum``."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")]
    if pairs.count() > broadcast_pairs:
        schema = T.StructType([aligned.schema["segment"], T.StructField("pair", T.LongType())])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, len(whole), 4096):
                    batch = whole.slice(k, 4096)
                    links = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
                    at = np.repeat(np.arange(len(links)), [len(x) for x in links])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(links))], schema.names)

        links = aligned.select("segment", "links").mapInArrow(spread, schema)
        sums = links.join(pairs, "pair").groupBy("segment").agg(F.count(F.lit(1)).alias("n_links"), F.sum("best").cast("long").alias("n_best"), F.sum("n").alias("count_sum"))
        return aligned.drop("links").join(sums, "segment")

    known = pairs.orderBy("pair").toPandas()
    shared = aligned.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int64)))
    columns = [c for c in aligned.columns if c != "links"]
    schema = T.StructType([*(aligned.schema[c] for c in columns), *fields])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            if not len(batch):
                continue
            links = [np.frombuffer(x, dtype=np.int64) for x in batch.column(len(columns)).to_pylist()]
            sizes = np.array([len(x) for x in links])
            at = np.searchsorted(pair, np.concatenate(links))
            starts = np.cumsum(sizes) - sizes
            sums = (sizes, np.add.reduceat(best[at], starts), np.add.reduceat(n[at], starts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums)], schema.names)

    return aligned.select(*columns, "links").mapInArrow(look_up, schema)


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
FIELDS = [*(T.StructField(c, T.LongType()) for c in SUMS), T.StructField("groups", T.StringType())]
_DEALT = T.StructType([T.StructField("block", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("sums", T.BinaryType()), T.StructField("groups", T.BinaryType())])


def dealt_out(found: DataFrame, most: int = DEALT) -> DataFrame:
    """Aligned segments of blocks as packed rows, one for each block and about ``most`` segments of a task."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        block = rows.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        codes = rows.column(1).to_numpy()[order]
        sums = np.stack([rows.column(2 + k).to_numpy()[order].astype("<i8") for k in range(len(SUMS))])
        groups = rows.column(2 + len(SUMS)).take(pa.array(order)).to_pylist()
        starts = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
            row = (int(block[order[i]]), _packed(codes[i:j]), zstandard.compress(sums[:, i:j].tobytes()), zstandard.compress("\n".join(groups[i:j]).encode()))
            yield _batch([[v] for v in row], _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= most:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return found.select("block", "code", *SUMS, "groups").mapInArrow(run, _DEALT)


def composed(blocks: DataFrame, segments: DataFrame, keep: Sequence[T.StructField], digest: bool = False, limit: int = 4 << 20) -> DataFrame:
    """Documents put together from the alignments of their segments; they leave in batches of about ``limit`` bytes."""
    parts = blocks.select("block", F.posexplode("segments").alias("code", "segment"))
    found = dealt_out(parts.join(segments, "segment")).withColumn("kind", F.lit(0))
    whole = blocks.drop("segments", "counts").withColumn("kind", F.lit(1))
    kept = [f"k{i}" for i in range(len(keep))]
    # A block's segments come first, then its texts.
    dealt = found.unionByName(whole, allowMissingColumns=True).select("block", "kind", "codes", "sums", "groups", "sizes", *kept).repartition("block").sortWithinPartitions("block", "kind")
    fields = free_fields([f.name for f in keep], FIELDS)
    schema = T.StructType([*keep, *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def documents(codes: np.ndarray, sizes: np.ndarray, kept: list[pa.Array], sums: np.ndarray, groups: list[str]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        made: list[list] = [[] for _ in fields]
        size = start = done = 0
        for k, end in enumerate(ends):
            own = codes[start:end]
            for x, v in zip(made, sums[:, own].sum(axis=1).tolist(), strict=False):
                x.append(v)
            text = ";".join([groups[c] for c in own.tolist()])
            made[-1].append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
            start, size = end, size + len(made[-1][-1]) + 8 * len(fields)
            if size > limit or k == len(ends) - 1:
                yield pa.RecordBatch.from_arrays([*(x.slice(done, k + 1 - done) for x in kept), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], schema.names)
                made, size, done = [[] for _ in fields], 0, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
        for batch in batches:
            for k in range(len(batch)):
                row = [c[k] for c in batch.columns]
                codes = _unpacked(row[2].as_py())
                if not row[1].as_py():
                    sums = np.frombuffer(zstandard.decompress(row[3].as_py()), dtype="<i8").reshape(len(SUMS), -1)
                    held.append((codes, sums, zstandard.decompress(row[4].as_py()).decode().split("\n")))
                    continue
                n = sum(len(c) for c, _, _ in held)
                sums, groups = np.zeros((len(SUMS), n), dtype=np.int64), [""] * n
                while held:
                    at, values, texts = held.pop()
                    sums[:, at] = values
                    for c, text in zip(at.tolist(), texts, strict=True):
                        groups[c] = text
                yield from documents(codes, _unpacked(row[5].as_py()), [x.values for x in row[6:]], sums, groups)

    return dealt.mapInArrow(run, schema)


def align_tokens(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), digest: bool = False, block_chars: int = BLOCK_CHARS, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The ``keep`` columns with numbers of tokens, groups and links, corpus-wide counts of links, and ``groups``.

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2``; with ``digest`` the SHA-256 of that list takes its place. Tables in
    between are written to the shared folder and stay until it is cleared.
    """
    paths = (path_a, path_b)
    blocks = materialize(encoded_blocks(df, text_col, keep, paths, block_chars), "token-blocks")
    counted = blocks.select(F.explode(F.arrays_zip("segments", "counts")).alias("x")).groupBy(F.col("x.segments").alias("segment")).agg(F.sum("x.counts").alias("count"))
    aligned = materialize(aligned_segments(counted, paths), "aligned-segments")
    pairs = materialize(pair_counts(aligned), "pair-counts")
    segments = with_sums(aligned, pairs, broadcast_pairs)
    return composed(blocks, segments, [df.schema[k] for k in keep], digest)
