"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. The ratio of target to size says how often its documents are wanted. The
whole part of that is taken for certain; for the rest, documents of a source are ranked by

    (u / (1 - u)) / (w p / (1 - p)),    u random, p the wanted fraction and w a document's weight,

random odds over inclusion odds, and the ranking is cut where the words taken come nearest to the target. ``u`` comes
from a hash of seed, id and text, so that reruns agree. Weights are relative to their mean in the source, by words;
without a weight column all documents of a source have the same odds.

No source is sorted as a whole. The rank q is first mapped to the unit interval as q r / (1 + q r), r being p / (1 - p):
for equal weights that is u itself, so that equal slices hold equally many rows. Sums of words by source and slice tell
which single slice holds the cut, and only its rows are ordered, to find the last one that is taken. Whether a row is
taken then depends on the row and on that one place for each source, so that texts are never moved.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
after all others. Ties in rank are ordered by id and a digest of the text; rows equal in both share one decision. A
null weight, or one of 0 or less, counts as a millionth. An empty table gives an empty result. Result columns that
clash with input columns get a suffix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.common import free_name, materialize, quoted, word_count


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    target: float


def share_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0) -> list[Share]:
    """Targets of sources: ``total_share`` of all sizes by weight, none above ``cap`` times its size.

    Sources come in the order of their code points, null last, and take the weights in turn. What a source cannot take
    is shared again among those below their cap, by weight, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[k % len(weights)]) for k, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_ = total_share * sum(size.values()), [s for s, _ in order]
    target: dict[str | None, float] = {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * size[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = cap * size[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return [Share(s, size[s], target[s]) for s, _ in order]


def uniform_of(seed: int, *cols: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("~")) for c in cols))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def plan_shares(sized: DataFrame, source: str, size: str, weight: str, **options: object) -> tuple[list[Share], dict[str | None, float]]:
    """Sum sizes by source, and share the targets; also each source's mean weight. One row per source reaches the driver."""
    rows = sized.groupBy(source).agg(F.sum(size).alias("total"), F.sum(F.col(weight) * F.col(size)).alias("weighted")).collect()
    means = {r[0]: float(r["weighted"]) / float(r["total"]) if r["total"] else 1.0 for r in rows}
    return share_targets([(r[0], int(r["total"] or 0)) for r in rows], **options), means  # type: ignore[arg-type]


def mix_sources(
    df: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weight_col: str | None = None,
    size_col: str | None = None,
    weights: Sequence[float] = (3, 1, 2),
    total_share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    buckets: int = 4096,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Id, source and ``keep`` columns with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` for each row.

    ``copies`` is how often the mix takes the row's document; ``taken`` is that times its size. ``size_col`` names a column
    with the number of words, if they are counted already. Without ``keep``, texts are read once only.
    """
    spark = df.sparkSession
    fields = list(dict.fromkeys([id_col, source_col, *keep]))
    carried = df.select(*[quoted(c) for c in fields])
    names = {n: free_name(carried, n) for n in ("size", "source_size", "target", "copies", "taken")}
    given = quoted(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = df.select(
        F.struct(*[quoted(c) for c in fields]).alias("row"),
        (quoted(size_col).cast("long") if size_col else word_count(quoted(text_col))).alias("size"),
        quoted(source_col).cast("string").alias("source"),
        quoted(id_col).alias("key"),
        F.md5(quoted(text_col)).alias("digest"),
        F.when(given > 0, given).otherwise(F.lit(1e-6)).alias("weight"),
    )
    sized = materialize(rows.drop("row") if keep else rows, "mix-sizes")  # without texts
    rows = rows if keep else sized
    shares, means = plan_shares(sized, "source", "size", "weight", weights=weights, total_share=total_share, cap=cap)
    table = spark.createDataFrame([(s.source, s.size, s.target, s.target / s.size if s.size else 0.0, means[s.source]) for s in shares], "of string, source_size long, target double, ratio double, mean double")

    def ranked(rows: DataFrame) -> DataFrame:
        """``rows`` with ``whole`` copies taken for certain, ``rank`` (null if no more are wanted) and its ``slice``."""
        joined = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of")))  # one row per source
        p = F.col("ratio") - F.floor("ratio")
        u = uniform_of(seed, F.col("key"), F.col("digest"))
        rank = (u / (1 - u)) / (p / (1 - p) * (F.col("weight") / F.col("mean")))
        spread = F.col("rank") * p / (1 - p)
        return (
            joined.withColumn("whole", F.when(F.col("size") > 0, F.floor("ratio")).otherwise(F.lit(0)).cast("long"))
            .withColumn("rank", F.when((p > 0) & (F.col("size") > 0), rank))
            .withColumn("slice", F.least(F.floor(spread / (1 + spread) * buckets), F.lit(buckets - 1)).cast("int"))
        )

    # Where the cut lies: words by source and slice, summed up slice by slice (at most `buckets` rows a source).
    sums = ranked(sized).groupBy("source", "slice").agg(
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(F.lit(0))).alias("words"),
        F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.first("target").alias("target"),
    )
    by_source = Window.partitionBy("source")
    upto = by_source.orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (
        sums.withColumn("want", F.col("target") - F.sum("certain").over(by_source))
        .withColumn("upto", F.sum("words").over(upto))
        .where(F.col("slice").isNotNull() & (F.col("upto") - F.col("words") <= F.col("want")) & (F.col("upto") > F.col("want")))
    )
    cuts = materialize(sums.select(F.col("source").alias("cut_of"), F.col("slice").alias("cut_slice"), (F.col("want") - (F.col("upto") - F.col("words"))).alias("rest")), "mix-cuts")

    # The last row taken of the slice with the cut: the row that crosses the rest is taken if that leaves the sum nearer.
    place = F.struct("rank", "key", "digest")
    order = Window.partitionBy("source").orderBy("rank", "key", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ranked(sized).join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("cut_of")) & (F.col("slice") == F.col("cut_slice")))
    edge = edge.withColumn("before", F.sum("size").over(order) - F.col("size")).where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))
    lasts = edge.groupBy("source").agg(F.max(place).alias("last")).select(F.col("source").alias("last_of"), "last")
    ends = cuts.join(lasts, F.col("cut_of").eqNullSafe(F.col("last_of")), "left").select("cut_of", "cut_slice", "last")
    ends = materialize(ends, "mix-ends")

    # No cut: the fractions of the whole source fit, so all are taken, unless none is wanted.
    out = ranked(rows).join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("cut_of")), "left")  # one row per source
    inside = F.coalesce((F.col("slice") < F.col("cut_slice")) | ((F.col("slice") == F.col("cut_slice")) & (place <= F.col("last"))), F.lit(False))
    extra = F.when(F.col("rank").isNotNull() & (F.col("cut_slice").isNull() | inside), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col("whole") + extra).cast("long")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in fields],
        F.col("size").alias(names["size"]),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
        copies.alias(names["copies"]),
        (copies * F.col("size")).alias(names["taken"]),
    )
