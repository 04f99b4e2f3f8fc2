"""Jaccard self-join on word shingles by PartEnum signatures, and the groups that its links form.

A text's set holds the 64-bit hashes of its distinct shingles. Two sets of sizes a <= b with similarity of at least
4 / 5 have b <= 5 a / 4 and differ in at most (a + b) / 9 elements. Sizes fall into bands; a set takes part in its own
band, and in the one below if a set of that band can be similar to it.

In a band, the feature domain is cut into partitions, and a signature is the digest of all that a set has in one of
them. If two sets differ in at most k elements, at most k of either's signatures are missing in the other. So whatever
common order signatures are put in, the first one that both sets have is among the first k + 1 of each. The order is
chosen to make signatures telling: partitions with many elements come first, since a passage that two texts share
seldom fills a whole partition; and signatures of more than ``LIGHT`` sets come last. A set that has k + 1 others
leaves these out altogether, so that common passages do not make candidates of all texts that hold them.

Up to ``LIGHT`` sets with a common signature are compared pair by pair. Larger buckets get a hub, the member with most
common signatures: in a cluster of copies that is the text nearest to what they were made from. All members are
compared with it, and what hangs together by then needs no further comparison, since only groups are asked for. The
members that share a hub form its family; a family that still holds several groups is compared whole, block by block,
in tasks of at most two blocks each, which return only pairs that may be similar.

Before whole sets are fetched and compared, a pair is sifted by parity sketches: bit c of a sketch says whether the set
has an odd number of elements in cell c of the domain. Two sets differ in at least as many elements as their sketches
in bits, so that a pair with too many different bits cannot be similar; no similar pair is lost. Links are verified on
whole sets, and spread to groups by repeated minimum with pointer jumping.

Equal sets are one node, named by a 64-bit digest, before anything else is done; copies cost no comparison.

Defined results: a null text counts as empty; without words the set is empty and its document stays alone. A group is
named by its smallest id; null ids don't count unless a group has no other, and then its name is null. Rows with equal
ids are ordinary members. An empty table gives an empty result. Carried columns that clash with ``n_shingles`` or
``component_id`` keep their names; the result columns get a numbered suffix.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import SpanHash, discard, flat_map, flat_map_arrays, free_name, materialize, mix, normal_words, quoted

SHINGLE = 5
#: Sets with a common signature up to which the signature ranks as it stands and all of them are compared.
LIGHT = 8
#: Members of a family, and bytes of their sketches, that make a block. A member goes out once for each block of its
#: family, so large blocks keep rows few; two blocks are what a task holds.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Rows of representatives up to which they are broadcast (24 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Bits of the numbers that are packed into a signature's place: how late it is, and how many can be left out.
_BITS = 28
_MASK, _HALF = (1 << _BITS) - 1, 1 << (_BITS - 1)


class Shingles:
    """The sorted hashes of a text's distinct shingles."""

    def __init__(self, width: int = SHINGLE) -> None:
        self.width = width
        self.hash = SpanHash(7)

    def __call__(self, text: str | None) -> np.ndarray:
        data, starts, ends = normal_words(text)
        n = len(starts)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        w = min(self.width, n)
        prefix = self.hash.prefix(data)
        return np.unique(self.hash.spans(prefix, starts[: n - w + 1], ends[w - 1 :]))


def node_of(elements: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).view(np.int64))


def sketch_of(elements: np.ndarray) -> bytes:
    """Parity bits of about four to eight cells an element, a power of two."""
    cells = 1 << max(6, int(4 * len(elements) - 1).bit_length())
    odd = np.bincount((mix(elements) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def different_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the other's length first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def most_differences(size: int) -> int:
    """Elements in which a set of this size and any similar set, smaller or larger, can differ at most."""
    return (size + 5 * size // 4) // 9


class Bands:
    """Lower ends of the size bands. Smaller sets than 4 are similar to equal sets only."""

    def __init__(self, ratio: float = 2.0) -> None:
        self.ratio = ratio
        self.low = [4]

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.ratio)))
        return bisect_right(self.low, size) - 1

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, differences to allow for) of each band that a set takes part in."""
        if size < 4:
            return []
        own = self.of(size)
        out = [(own, most_differences(size))]
        below = self.low[own] - 1  # the largest set of the band below
        if own and 4 * size <= 5 * below:
            out.append((own - 1, (below + size) // 9))
        return out

    def most(self, band: int) -> int:
        """Differences to allow for between any two sets of a band."""
        return most_differences(self.low[band + 1] - 1)


class Signatures:
    """Signatures of a set, and the place of each.

    A place packs band, slack and lateness. Lateness is the rank less k, so that the first k + 1 are not late; slack is
    how many signatures there are beyond k + 1. Sets with too few filled partitions also use the empty ones, and then
    none of their signatures can be left out: none is late, and slack is 0.
    """

    def __init__(self, bands: Bands | None = None) -> None:
        self.bands = bands or Bands()

    def __call__(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._in_band(elements, b, k) for b, k in self.bands.roles(len(elements))]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]).view(np.int64), np.concatenate([p[1] for p in parts])

    def _in_band(self, elements: np.ndarray, band: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = 5 * (self.bands.most(band) + 1) // 4 + 4
        seed = mix(np.array([1 + band], dtype=np.uint64))[0]
        with np.errstate(over="ignore"):
            mixed = mix(elements ^ seed)
            cell = ((mixed >> np.uint64(16)) % np.uint64(n)).astype(np.uint16 if n < 1 << 16 else np.int64)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            found = cell[first].astype(np.uint64)
            sig = mix(np.add.reduceat(mix(mixed)[order], first) + mix(found + seed))
            if len(sig) > k:
                filled = np.diff(np.append(first, len(cell)))
                sig = sig[np.lexsort((sig, -filled))]
                late, slack = np.arange(len(sig)) - k, len(sig) - k - 1
            else:
                empty = np.setdiff1d(np.arange(n, dtype=np.uint64), found)
                sig = np.concatenate((sig, mix(mix(empty + seed) + np.uint64(1))))
                late, slack = np.minimum(np.arange(len(sig)) - k, 0), 0
        return sig, (band << 2 * _BITS) + (slack << _BITS) + late + _HALF


# --- Spark ----------------------------------------------------------------------------------------------------------


def describe(df: DataFrame, text_col: str, keep: Sequence[str], width: int) -> DataFrame:
    """A lean row for each row: ``keep``, ``n_shingles`` and ``node`` (null for an empty set)."""

    def make() -> Callable[[Any], Iterable[tuple]]:
        shingles = Shingles(width)

        def row(text: str | None) -> Iterable[tuple]:
            elements = shingles(text)
            return [(len(elements), node_of(elements) if len(elements) else None)]

        return row

    return flat_map(df, text_col, keep, [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())], make)


def text_signatures(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """(sig, node, place) for each text; a task leaves out sets that it has just seen."""

    def make() -> Callable[[Any], tuple[np.ndarray, ...]]:
        shingles, signatures = Shingles(width), Signatures()
        seen: set[int] = set()
        none = (np.zeros(0, dtype=np.int64),) * 3

        def row(text: str | None) -> tuple[np.ndarray, ...]:
            elements = shingles(text)
            if not len(elements):
                return none
            node = node_of(elements)
            if node in seen:
                return none
            if len(seen) > 50_000:
                seen.clear()
            seen.add(node)
            sig, place = signatures(elements)
            return sig, np.full(len(sig), node, dtype=np.int64), place

        return row

    return flat_map_arrays(df, text_col, [], [T.StructField(n, T.LongType()) for n in ("sig", "node", "place")], make)


def shared_signatures(rows: DataFrame, light: int) -> DataFrame:
    """(sig, node, common, typical): the signatures that each set is compared by, as far as another set has them too.

    ``common`` says whether more than ``light`` sets have the signature. A set uses its first k + 1, common ones last;
    ``typical`` is how many of these are common. All frames slide, so that no bucket is held in memory.
    """
    bucket = Window.partitionBy("sig").orderBy("node")
    once = rows.withColumn("before", F.lag("node").over(bucket)).where("before IS NULL OR before <> node").drop("before")
    around = F.count(F.lit(1)).over(bucket.rowsBetween(-light, light))  # above light exactly where the bucket is
    shared = once.withColumn("around", around).where("around > 1").select("sig", "node", (F.col("around") > light).cast("int").alias("common"), "place")
    late = F.col("place").bitwiseAND(F.lit(_MASK)) - F.lit(_HALF)
    role = F.shiftright("place", _BITS)
    shared = shared.select("sig", "node", "common", late.alias("late"), role.alias("role"), role.bitwiseAND(F.lit(_MASK)).alias("slack"))
    of_set = Window.partitionBy("node", "role")
    upto = of_set.orderBy("late", "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shared.withColumn("before", F.sum("common").over(upto) - F.col("common")).withColumn("typical", F.sum("common").over(of_set) - F.col("slack"))
    used = F.when(F.col("common") == 1, F.col("before") < F.col("typical")).otherwise(F.col("late") <= F.col("before"))
    return placed.where(used).select("sig", "node", (F.col("common") == 1).alias("common"), "typical")


def light_pairs(shared: DataFrame, light: int) -> DataFrame:
    """Distinct (a, b) of the sets of each bucket of at most ``light``."""
    few = shared.where("NOT common").groupBy("sig").agg(F.sort_array(F.collect_set("node")).alias("g")).where(F.size("g") > 1)
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, light), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return few.select(F.inline(pairs)).distinct()


def families_of(shared: DataFrame) -> DataFrame:
    """Distinct (node, hub) of the members of larger buckets; a bucket's hub is its most typical member."""
    common = shared.where("common")
    hubs = common.groupBy("sig").agg(F.max(F.struct("typical", "node")).alias("top")).select("sig", F.col("top.node").alias("hub"))
    return common.join(hubs, "sig").where("node <> hub").select("node", "hub").distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, from the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("shared"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sizes"))
    return both.where(5 * F.col("shared") >= 4 * (F.col("sizes") - F.col("shared"))).select("a", "b")


@F.pandas_udf(T.LongType())
def _different(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([different_bits(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def sift(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by their sketches."""
    left = sketches.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(left, "a").join(right, "b").where("5 * size_a >= 4 * size_b AND 5 * size_b >= 4 * size_a")
    return both.where(9 * _different("sketch_a", "sketch_b") <= F.col("size_a") + F.col("size_b")).select("a", "b")


def near_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of different groups that may be similar: one side from block i, the other from block j."""
    block = block.reset_index(drop=True)
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    node, root, size = (block[c].to_numpy() for c in ("node", "root", "size"))
    bits = [np.frombuffer(x, dtype=np.uint64) for x in block["sketch"]]
    length = np.array([len(x) for x in bits])
    left, right = np.flatnonzero(block["block"] == i), np.flatnonzero(block["block"] == j)

    def to_length(rows: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bitwise_xor.reduce(bits[r].reshape(-1, n), axis=0) for r in rows])

    found: list[tuple[int, int]] = []
    for short in np.unique(length):
        # Each pair is met at the length of its shorter sketch.
        over = right[(length[right] >= short) & (length[right] <= 2 * short)]
        if not len(over):
            continue
        folded = to_length(over, short)
        for x in left[(length[left] >= short) & (length[left] <= 2 * short)]:
            fit = (root[over] != root[x]) & (5 * size[over] >= 4 * size[x]) & (4 * size[over] <= 5 * size[x])
            fit &= (length[over] == short) | (length[x] == short)
            if i == j:
                fit &= node[over] > node[x]
            if not fit.any():
                continue
            mine = np.bitwise_xor.reduce(bits[x].reshape(-1, short), axis=0)
            apart = np.bitwise_count(folded[fit] ^ mine).sum(axis=1, dtype=np.int64)
            near = over[fit][9 * apart <= size[over][fit] + size[x]]
            found += [(int(node[x]), int(node[y])) for y in near]
    return pd.DataFrame({"a": pd.Series([a for a, _ in found], dtype="int64"), "b": pd.Series([b for _, b in found], dtype="int64")})


def family_pairs(families: DataFrame, sketches: DataFrame, roots: DataFrame, rows: int, size: int = BLOCK_BYTES) -> DataFrame:
    """Distinct (a, b) of different groups in one family that may be similar.

    A family of several groups is dealt into blocks, and each pair of blocks is one group of rows: a row goes out once
    for each block, and a task holds two blocks at most.
    """
    known = families.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sketches, "node")
    totals = known.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sketch")).alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = totals.where("low < high").select("hub", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / size)).alias("blocks"))
    dealt = known.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.select("hub", "i", "j", "block", "node", "root", "size", "sketch").groupBy("hub", "i", "j").applyInPandas(near_in_block, "a long, b long").distinct()


def groups_of(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches."""
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "group-edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "group-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = materialize(lower.join(jump, "root").select("node", "old", F.least("root", "further").alias("root")), "group-labels")
        settled = new.where(F.col("old") != F.col("root")).isEmpty()
        discard(labels)
        labels = new.select("node", "root")
        if settled:
            discard(edges)
            return labels


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = (), width: int = SHINGLE, light: int = LIGHT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Id and ``keep`` columns of each row with ``n_shingles`` and ``component_id``.

    ``light`` and ``block_rows`` set how candidates are compared, not which texts are linked.
    """
    names = [free_name(df.select(*[quoted(c) for c in (id_col, *keep)]), n) for n in ("n_shingles", "component_id")]
    fields = list(dict.fromkeys([id_col, *keep]))
    prepared = df.select(quoted(id_col).alias("row_id"), F.xxhash64(quoted(text_col)).alias("row_hash"), quoted(text_col).alias("row_text"), F.struct(*[quoted(c) for c in fields]).alias("row"))
    rows = materialize(describe(prepared, "row_text", ["row_id", "row_hash", "row"], width), "shingle-rows")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("row_id").alias("first_id"), F.min(F.struct("row_id", "row_hash")).alias("rep"))
    nodes = materialize(nodes, "shingle-nodes")

    links = _links(prepared, nodes, width, light, block_rows)
    roots = groups_of(links)
    named = nodes.select("node", "first_id").join(roots, "node", "left")
    smallest = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = named.join(smallest, "root", "left").select("node", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("group_id")).alias("group_id"))
    named = materialize(named, "shingle-groups")
    discard(nodes, links, roots)
    alone = F.col("node").isNull()
    key = F.coalesce(F.col("node"), F.xxhash64("row_id"))  # empty sets are dealt out by their ids
    out = rows.withColumn("key", key).join(named.withColumnRenamed("node", "group_node"), F.col("key") == F.col("group_node"), "left")
    component = F.when(alone, F.col("row_id")).otherwise(F.col("group_id"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in fields], F.col("n_shingles").alias(names[0]), component.alias(names[1]))


def fetch(prepared: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, fields: Sequence[T.StructField], what: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``node`` and what a function makes of its set, for both ends of ``pairs``, from the texts of their representatives."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(ends.join(nodes, "node").select(F.col("node").alias("rep_node"), F.col("rep.row_id").alias("rep_id"), F.col("rep.row_hash").alias("rep_hash")), "wanted-nodes")
    reps = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    picked = prepared.select("row_id", "row_hash", "row_text").join(reps, F.col("row_id").eqNullSafe(F.col("rep_id")) & (F.col("row_hash") == F.col("rep_hash")))

    def make() -> Callable[[Any], Iterable[tuple]]:
        shingles = Shingles(width)

        def row(text: str) -> Iterable[tuple]:
            elements = shingles(text)
            return [(node_of(elements), *what(elements))]

        return row

    found = flat_map(picked, "row_text", ["rep_node"], [T.StructField("node", T.LongType()), *fields], make).where("node = rep_node").drop("rep_node")
    found = materialize(found.dropDuplicates(["node"]), "sets")
    discard(wanted)
    return found


def _links(prepared: DataFrame, nodes: DataFrame, width: int, light: int, block_rows: int) -> DataFrame:
    """(a, b) of verified links that connect all that any links connect."""
    shared = materialize(shared_signatures(text_signatures(prepared, "row_text", width), light), "shared-signatures")
    families = materialize(families_of(shared), "families")
    pairs = materialize(light_pairs(shared, light).unionByName(families.select(F.col("node").alias("a"), F.col("hub").alias("b"))), "candidates")
    discard(shared)
    fields = [T.StructField("size", T.LongType()), T.StructField("sketch", T.BinaryType())]
    sketches = fetch(prepared, nodes, pairs, width, fields, lambda x: (len(x), sketch_of(x)))

    def confirm(pairs: DataFrame, label: str) -> DataFrame:
        sets = fetch(prepared, nodes, pairs, width, [T.StructField("elements", T.ArrayType(T.LongType()))], lambda x: (x.view(np.int64),))
        links = materialize(verify(pairs, sets), label)
        discard(sets, pairs)
        return links

    links = confirm(materialize(sift(pairs, sketches), "sifted-pairs"), "links")
    roots = groups_of(links)
    more = materialize(family_pairs(families, sketches, roots, block_rows), "family-pairs")
    links = links.unionByName(confirm(more, "family-links"))
    discard(pairs, families, sketches, roots)
    return links
