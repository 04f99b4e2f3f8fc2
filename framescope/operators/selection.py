"""Choosing rows: latest, first by priority, novel, sampled by stratum, balanced, assigned in turn."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *cols: str) -> list[Column]:
    """A reproducible shuffled order: the MD5 of seed and columns, so that SQL can have it too, then the columns."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols))), *map(F.col, cols)]


def hash_number(seed: int, col: str, below: int) -> Column:
    """A reproducible number from 0 to ``below`` - 1 for each value: 52 bits of the MD5 of seed and value."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(col).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(below))


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def by_priority(rows: DataFrame, keys: Sequence[str], source: str, priority: Sequence[str], *ties: Column) -> DataFrame:
    """One row for each key from the first source in ``priority`` that has one."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    return latest(rows.where(rank > 0), keys, rank, *ties)


def time_bucket(rows: DataFrame, ts: str, seconds: float, name: str = "bucket") -> DataFrame:
    return rows.withColumn(name, F.floor(F.col(ts) / seconds).cast("long"))


def novel(rows: DataFrame, keys: Sequence[str], quality: str, kinds: dict[str, int], tie: str, keep: int = 3) -> DataFrame:
    """Up to ``keep`` rows of each bucket, with their ``pick`` from 1: the best first, then those with the most new kinds;
    ties by quality, then ``tie``.

    ``kinds`` gives what a new value of a column is worth. What a row is worth depends on its kinds alone, so only the
    first ``keep`` rows of each combination of them can be picked: tasks leave the others before buckets are dealt out,
    and a bucket's choice is made from at most that many rows for each combination.
    """
    place = F.row_number().over(Window.partitionBy(*keys, *kinds).orderBy(quality, tie))
    first = rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
    entry = F.struct(F.col(quality).alias("q"), F.col(tie).alias("t"), *(F.col(c).alias(f"k{n}") for n, c in enumerate(kinds)), F.struct(*rows.columns).alias("row"))
    buckets = first.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    every = F.col("_all")

    def choose(taken: Column, _: Column) -> Column:
        seen = lambda n, x: F.exists(taken, lambda i: F.get(every, i)[f"k{n}"] == x[f"k{n}"])
        worth = lambda x: sum((F.when(seen(n, x), 0).otherwise(v) for n, v in enumerate(kinds.values())), F.lit(0))
        # The array is in order of quality, so the first of the greatest worth is the one.
        rated = F.transform(every, lambda x, i: F.when(~F.array_contains(taken, i), F.struct((-worth(x)).alias("w"), i.alias("i"))))
        return F.concat(taken, F.coalesce(F.array(F.array_min(F.array_compact(rated))["i"]), F.array().cast("array<int>")))

    chosen = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(keep), F.size(every))), F.array().cast("array<int>"), choose)
    picks = buckets.select("_all", F.posexplode(chosen).alias("_pick", "_at"))
    return picks.select((F.col("_pick") + 1).alias("pick"), F.get(F.col("_all"), F.col("_at"))["row"].alias("_row")).select("_row.*", "pick")


def allocate(pools: dict, target: int, floor: int = 0, cap: int | None = None) -> dict:
    """Rows to take from each stratum: in proportion (rounded half to even), with floor and cap, then moved to the
    target one by one, largest strata first. Works on the strata's sizes alone."""
    total = sum(pools.values())
    if not total:
        return dict.fromkeys(pools, 0)
    most = {k: min(n, cap) if cap is not None else n for k, n in pools.items()}
    out = {k: min(max(round(target * n / total), min(floor, n)), most[k]) for k, n in pools.items()}
    order = sorted(pools, key=lambda k: (-pools[k], str(k)))
    for _ in range(20 * len(order)):
        drift = target - sum(out.values())
        if not drift:
            break
        for k in order:
            if drift > 0 and out[k] < most[k]:
                out[k] += 1
                drift -= 1
            elif drift < 0 and out[k] > min(floor, pools[k]):
                out[k] -= 1
                drift += 1
            if not drift:
                break
    return out


def stratified(rows: DataFrame, stratum: str, target: int, order: Sequence[Column], floor: int = 0, cap: int | None = None) -> DataFrame:
    """A stratified sample. Only the strata's sizes, a row for each, reach the driver."""
    pools = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    shares = allocate(pools, target, floor, cap)
    if not shares:
        return rows.limit(0)
    table = rows.sparkSession.createDataFrame([(k, n) for k, n in shares.items()], f"_stratum {dict(rows.dtypes)[stratum]}, _take int")
    w = Window.partitionBy(stratum).orderBy(*order)
    # The literal bound lets every task keep its first rows of a stratum before they are dealt out by stratum.
    first = rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= max(shares.values()))
    ranked = first.join(F.broadcast(table), F.col(stratum).eqNullSafe(F.col("_stratum")))
    return ranked.where("_place <= _take").drop("_place", "_stratum", "_take")


def two_level(rows: DataFrame, key: str, outer: str, inner: str, target: int, order: Sequence[Column], least: int, most: int | None = None) -> DataFrame:
    """About ``target`` rows with each value of ``outer`` covered, and ``inner`` in proportion inside each.

    Every outer value gets max(least, target div number of values) rows, at most ``most``, or all it has. What that is
    above the target is cut in ``order``; what is below is filled in proportion to ``inner`` from the rest, whatever its
    outer value. Nulls are values like others. Only the sizes of (outer, inner) reach the driver; ``key`` is unique.
    """
    kinds = dict(rows.dtypes)
    sizes: dict = {}
    for r in rows.groupBy(outer, inner).count().collect():
        sizes.setdefault(r[0], {})[r[1]] = r[2]
    if not sizes or target <= 0:
        return rows.limit(0)
    each = max(least, target // len(sizes))
    each = each if most is None else min(each, most)
    takes = [(o, i, n) for o, pools in sizes.items() for i, n in allocate(pools, min(each, sum(pools.values()))).items()]
    table = rows.sparkSession.createDataFrame(takes, f"_outer {kinds[outer]}, _inner {kinds[inner]}, _take int")
    place = F.row_number().over(Window.partitionBy(outer, inner).orderBy(*order))
    first = rows.withColumn("_place", place).where(F.col("_place") <= max(n for _, _, n in takes))
    here = F.col(outer).eqNullSafe(F.col("_outer")) & F.col(inner).eqNullSafe(F.col("_inner"))
    picked = first.join(F.broadcast(table), here).where("_place <= _take").drop("_place", "_outer", "_inner", "_take")
    have = sum(n for _, _, n in takes)
    if have >= target:
        return picked.orderBy(*order).limit(target)
    rest = rows.join(picked.select(key), key, "left_anti").select(rows.columns)
    return picked.unionByName(stratified(rest, inner, target - have, order))


def tier_split(first: DataFrame, second: DataFrame, stratum: str, size: int, share: float, order: Sequence[Column]) -> DataFrame:
    """``size`` rows, of which ``share`` from the second tier, each by stratum; what the second lacks the first gives."""
    wanted = round(size * share)
    n = min(wanted, second.limit(wanted).count()) if wanted > 0 else 0
    tiers = ((first, size - n, "A"), (second, n, "B"))
    parts = [stratified(rows, stratum, k, order).withColumn("tier", F.lit(name)) for rows, k, name in tiers]
    return parts[0].unionByName(parts[1])


def balanced(rows: DataFrame, label: str, size: int, order: Sequence[Column], existing: DataFrame | None = None) -> DataFrame:
    """``size`` rows taken from the classes in turn, those with the fewest existing rows first in each turn."""
    w = Window.partitionBy(label).orderBy(*order)
    ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size)  # more of a class are never taken
    if existing is not None:
        ranked = ranked.join(existing.select(F.col(label), F.col("n").alias("_have")), label, "left")
    else:
        ranked = ranked.withColumn("_have", F.lit(0))
    return ranked.orderBy("turn", F.coalesce("_have", F.lit(0)), label, *order).limit(size).drop("_have")


def fill_levels(pools: dict, budget: int, order: Sequence) -> dict:
    """``budget`` given out in rounds of one each, in ``order``, to those that have any left: a common level for all, and
    one more for the first of those that have it. Worked out from the sizes, not round by round."""
    left = sorted(pools, key=lambda k: pools[k])
    level = spent = 0
    for i, k in enumerate(left):
        step = (pools[k] - level) * (len(left) - i)
        if spent + step > budget:
            rise = (budget - spent) // (len(left) - i)
            level, spent = level + rise, spent + rise * (len(left) - i)
            break
        level, spent = pools[k], spent + step
    out = {k: min(n, level) for k, n in pools.items()}
    for k in order:
        if spent < budget and pools[k] > out[k]:
            out[k] += 1
            spent += 1
    return out


def curated_takes(pools: dict, unclassified: int, size: int, existing: dict, targets: dict | None = None, least: int = 0, discovery: int = 0, prioritize: Sequence = ()) -> dict:
    """Rows to take of each class (None: without a class) by step: ``target``, ``minimum``, ``discovery``, ``deficit``, ``fill``.

    Targets come first, in their order; then other classes get ``least`` rows, by name; then ``discovery`` rows without a
    class; then classes take turns, those that lack most of an equal share of existing and new rows first, prioritised
    ones before them; what is left goes to rows without a class. Works on the classes' sizes alone.
    """
    targets = targets or {}
    classes = sorted(set(pools) | set(existing))
    takes = {c: {} for c in [*classes, None]}
    budget = size
    wanted = [(c, "target", n) for c, n in targets.items()] + [(c, "minimum", least) for c in classes if c not in targets]
    for c, step, n in wanted:
        got = max(0, min(n, pools.get(c, 0), budget))
        if got:
            takes[c][step] = got
        budget -= got
    found = min(discovery, budget, unclassified)
    budget -= found
    share = (sum(existing.values()) + size) / max(len(classes), 1)
    lack = {c: max(0, share - existing.get(c, 0) - sum(takes[c].values())) + (budget if c in prioritize else 0) for c in classes}
    rest = {c: pools.get(c, 0) - sum(takes[c].values()) for c in classes}
    for c, n in fill_levels(rest, budget, sorted(classes, key=lambda c: -lack[c])).items():
        if n:
            takes[c]["deficit"] = n
        budget -= n
    takes[None] = {k: n for k, n in (("discovery", found), ("fill", min(budget, unclassified - found))) if n > 0}
    return takes


def curated(rows: DataFrame, label: str, size: int, order: Sequence[Column], existing: DataFrame | None = None, **rules) -> DataFrame:
    """``size`` rows as ``curated_takes`` says, with the ``step`` that takes them; inside a class by ``order``.

    Null and empty labels are no class. ``existing`` has ``label`` and ``n``. Only the classes' sizes reach the driver.
    """
    kind = F.nullif(F.col(label), F.lit(""))
    pools = {r[0]: r[1] for r in rows.groupBy(kind).count().collect()}
    have = {r[0]: r[1] for r in existing.select(label, "n").collect() if r[0]} if existing is not None else {}
    takes = curated_takes({k: n for k, n in pools.items() if k is not None}, pools.get(None, 0), size, have, **rules)
    bounds, most = [], 0
    for c, steps in takes.items():
        upto = 0
        for step, n in steps.items():
            bounds.append((c, upto, upto + n, step))
            upto += n
        most = max(most, upto)
    table = rows.sparkSession.createDataFrame(bounds, f"_kind {dict(rows.dtypes)[label]}, _from long, _upto long, step string")
    place = F.row_number().over(Window.partitionBy("_class").orderBy(*order))
    first = rows.withColumn("_class", kind).withColumn("_place", place).where(F.col("_place") <= most)
    here = F.col("_class").eqNullSafe(F.col("_kind")) & (F.col("_place") > F.col("_from")) & (F.col("_place") <= F.col("_upto"))
    return first.join(F.broadcast(table), here).drop("_class", "_place", "_kind", "_from", "_upto")


def split_in_halves(rows: DataFrame, stratum: str, target: int, order: Sequence[Column]) -> DataFrame:
    """A stratified sample of even size with a condition: one half sees suggestions, the other doesn't."""
    w = Window.partitionBy(stratum).orderBy(*order)
    sample = stratified(rows, stratum, target - target % 2, order)
    return sample.withColumn("condition", F.when(F.row_number().over(w) % 2 == 1, "anchored").otherwise("blind"))


def decoys(rows: DataFrame, id_col: str, label: str, labels: Sequence[str], share: float = 0.10, seed: int = 5) -> DataFrame:
    """A hash sample of rows with a wrong label to show."""
    pick = hash_number(seed, id_col, 1_000_000) < int(share * 1_000_000)
    wrong = F.filter(F.array(*map(F.lit, labels)), lambda x: x != F.col(label))
    return rows.where(pick).withColumn("shown", F.element_at(wrong, (F.pmod(hash_number(seed + 1, id_col, 1_000_000), F.size(wrong)) + 1).cast("int")))


def numbered(rows: DataFrame, coarse: Column, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in a global order, without sorting all rows in one task.

    ``coarse`` is a number that never falls along ``order``, with moderately many rows for each value: rows are numbered
    inside each value, and the values' counts are added up, first inside blocks of 10,000 values and then over blocks,
    so that no task sees more than one row for each block.
    """
    placed = rows.withColumn("_coarse", coarse)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_coarse").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("_coarse") / 10_000))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_all"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_all").over(earlier(Window.orderBy("_block"))), F.lit(0)).alias("_start"))
    in_block = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("_block").orderBy("_coarse"))), F.lit(0))
    counts = counts.withColumn("_before", in_block).join(blocks, "_block").select("_coarse", (F.col("_before") + F.col("_start")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_coarse").orderBy(*order)) - 1
    return placed.withColumn(name, inside).join(counts, "_coarse").withColumn(name, F.col(name) + F.col("_before")).drop("_coarse", "_before")


def in_turn(rows: DataFrame, workers: Sequence[str], place: str, copies: int = 1, name: str = "worker") -> DataFrame:
    """Assign numbered rows to workers in turn; with ``copies``, to the next ones too."""
    who = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.element_at(F.array(*map(F.lit, workers)), (F.pmod(F.col(place) + c, F.lit(len(workers))) + 1).cast("int")))
    return rows.withColumn(name, F.explode(who))


def audit_sample(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], share: float | Column, least: int | Column) -> DataFrame:
    """For each key the first max(least, floor(share n)) rows; small groups whole. Both may depend on the key.

    Keys are counted first, so that the largest number to take bounds what tasks keep of a key before it is dealt out.
    """
    number = lambda v: v if isinstance(v, Column) else F.lit(v)
    take = F.greatest(number(least), F.floor(F.col("count") * number(share))).alias("_take")
    sizes = rows.groupBy(*keys).count().select(*(F.col(k).alias(f"_{k}") for k in keys), take)
    most = sizes.agg(F.max("_take")).first()[0] or 0
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= most)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return first.join(sizes, on).where("_place <= _take").drop("_place", "_take", *(f"_{k}" for k in keys))


def verification_sample(rows: DataFrame, order: Sequence[Column], share: float = 0.08, most: int = 400) -> DataFrame:
    """At least one row, a share of all, at most ``most``."""
    n = rows.count()
    return rows.orderBy(*order).limit(min(most, max(1, math.floor(share * n)))) if n else rows


def in_order_takes(pools: dict, size: int) -> dict:
    """Rows to verify of each stratum: in proportion (rounded half to even), at least one, as far as the budget lasts in the
    strata's order."""
    total, left, out = sum(pools.values()), size, {}
    for k in sorted(pools, key=lambda k: tuple((v is not None, v) for v in k)):
        out[k] = min(max(1, round(pools[k] / total * size)), pools[k], left)
        left -= out[k]
    return out


def stratified_verification(rows: DataFrame, strata: Sequence[str], order: Sequence[Column], share: float = 0.08, most: int = 400) -> DataFrame:
    """A verification sample by strata, the first of each in ``order``; the budget may end before the last strata have any.
    Only the strata's sizes reach the driver."""
    pools = {tuple(r[k] for k in strata): r["count"] for r in rows.groupBy(*strata).count().collect()}
    takes = {k: n for k, n in in_order_takes(pools, max(1, min(most, math.floor(share * sum(pools.values()))))).items() if n} if pools else {}
    if not takes:
        return rows.limit(0)
    kinds = dict(rows.dtypes)
    table = rows.sparkSession.createDataFrame([(*k, n) for k, n in takes.items()], ", ".join(f"_{k} {kinds[k]}" for k in strata) + ", _take int")
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    first = rows.withColumn("_place", place).where(F.col("_place") <= max(takes.values()))
    on = F.col("_place") <= F.col("_take")
    for k in strata:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.join(F.broadcast(table), on).select(rows.columns)


def with_band(rows: DataFrame, *bands: tuple[Column, int], default: int = 9) -> DataFrame:
    """The first band whose condition holds; low bands come first in a queue."""
    out = F.lit(default)
    for cond, b in reversed(bands):
        out = F.when(cond, b).otherwise(out)
    return rows.withColumn("band", out)


def match_people(a: Column, b: Column, score) -> Column:
    """Greedy matching inside a row: for each element of array ``a`` the index of its match in ``b``, or -1.

    Both arrays belong to one clip and are short; ``score`` maps two elements to a number.
    """

    def take(done: Column, x: Column) -> Column:
        rated = F.transform(b, lambda y, i: F.struct((-score(x, y)).alias("s"), i.alias("i")))
        free = F.array_sort(F.filter(rated, lambda z: ~F.array_contains(done, z["i"])))
        return F.array_append(done, F.coalesce(F.get(free, F.lit(0))["i"], F.lit(-1)))

    return F.aggregate(a, F.array().cast("array<int>"), take)
