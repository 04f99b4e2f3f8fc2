"""Differences of nested records of any shape: which paths changed, from what to what."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.operators.replies import with_once


def _known(v: Column) -> Column:
    """JSON null counts as missing."""
    return F.when(~F.is_variant_null(v), v)


def _plain(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def _as_set(v: Column) -> Column:
    """A list as one text of its distinct elements in order, so that it is compared as a set."""
    items = F.try_variant_get(v, "$", "array<string>")
    return F.when(items.isNotNull(), F.array_join(F.array_sort(F.array_distinct(F.array_compact(items))), "|").cast("variant")).otherwise(v)


class _Number(NamedTuple):
    """A number as it is written, so that it is equal to no text and no truth value."""

    text: str


def _object(fields: list[tuple[str, Any]]) -> dict[str, Any]:
    if len(found := dict(fields)) < len(fields):
        raise ValueError("a name stands twice")
    return found


def _constant(name: str) -> Any:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_constant, object_pairs_hook=_object)


def _value(text: str | None) -> Any:
    try:
        return None if text is None else _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None


def _text(v: Any) -> str | None:
    """The JSON text of a part; null counts as missing only for the part itself."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_text(x) or 'null'}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(_text(x) or "null" for x in v) + "]"
    return v.text if isinstance(v, _Number) else None if v is None else json.dumps(v)


def _parts(path: str, a: Any, b: Any, sets: frozenset[str], depth: int) -> Iterator[tuple[str, Any, Any, bool]]:
    """(path, a, b, whether lists are sets) of the parts of two values that may differ."""
    if a == b:
        return
    like = lambda kind: depth > 0 and all(x is None or isinstance(x, kind) for x in (a, b))
    if like(dict):
        a, b = a or {}, b or {}
        for k in {**a, **b}:
            u, v, inside = a.get(k), b.get(k), f"{path}.{k}" if path else k
            if k in sets and (isinstance(u, list) or isinstance(v, list)):
                if u != v:
                    yield inside, u, v, True
            else:
                yield from _parts(inside, u, v, sets, depth - 1)
    elif like(list):
        a, b = a or [], b or []
        for k, (u, v) in enumerate(zip(a, b, strict=False)):
            yield from _parts(f"{path}[{k}]", u, v, sets, depth - 1)
        if len(a) != len(b):
            yield f"{path}.length", _Number(str(len(a))), _Number(str(len(b))), False
    else:
        yield path, a, b, False


def changed_paths(rows: DataFrame, before: str, after: str, keep: Sequence[str], sets: Sequence[str] = (), depth: int = 6) -> DataFrame:
    """The ``keep`` columns with ``path``, ``before`` and ``after`` of each value that differs, as texts.

    ``before`` and ``after`` are columns of JSON texts; what is no JSON counts as missing, and so do null fields. Lists are
    compared place by place, with a path ``.length`` if they differ in that, or as sets if their field is among ``sets``.
    Both records are taken apart together and equal parts dropped at once, row by row in the tasks, so nothing is shuffled;
    what is left is compared as VARIANT. Parts below ``depth`` levels are compared whole.
    """
    as_sets, kept = frozenset(sets), list(keep)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row, (x, y) in enumerate(zip(batch["_before"].to_pylist(), batch["_after"].to_pylist(), strict=True)):
                if x != y:
                    for path, a, b, is_set in _parts("", _value(x), _value(y), as_sets, depth):
                        at.append(row)
                        out.append((path.encode("utf-8", "replace").decode(), _text(a), _text(b), is_set))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)]
            own = batch.select(kept).take(pa.array(at, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*own, *made], [*kept, "path", "_a", "_b", "_set"])

    given = rows.select(*kept, F.col(before).alias("_before"), F.col(after).alias("_after"))
    schema = T.StructType([*(given.schema[c] for c in kept), *T.StructType.fromDDL("path string, _a string, _b string, _set boolean")])
    parts = given.mapInArrow(split, schema)
    values = [_known(F.try_parse_json(c)) for c in ("_a", "_b")]
    if sets:
        values = [F.when(F.col("_set"), _as_set(v)).otherwise(v) for v in values]
    x = with_once(parts, "_x", F.struct(*(v.alias(c) for v, c in zip(values, "ab", strict=True))))
    return x.where(~F.to_json("_x.a").eqNullSafe(F.to_json("_x.b"))).select(*kept, "path", _plain(F.col("_x.a")).alias("before"), _plain(F.col("_x.b")).alias("after"))


def field_of(path: Column) -> Column:
    """A path without places."""
    return F.regexp_replace(path, r"\[\d+\]", "")


def place_of(path: Column) -> Column:
    """The first place in a path, else null."""
    return F.nullif(F.regexp_extract(path, r"\[(\d+)\]", 1), F.lit("")).cast("int")


def change_histogram(changes: DataFrame) -> DataFrame:
    """How often each field changed, by place, and over all places (``place`` null, ``all_places`` true)."""
    x = changes.select(field_of(F.col("path")).alias("field"), place_of(F.col("path")).alias("place"))
    sums = x.groupingSets([["field", "place"], ["field"]], "field", "place").agg(F.count(F.lit(1)).alias("n"), F.grouping("place").alias("_all"))
    return sums.select("field", "place", (F.col("_all") == 1).alias("all_places"), "n")
