"""The domain's functions for SQL text: registered as SQL expressions, which the optimizer inlines; no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from framescope.functions.taxonomy import ACTIONS, GROUPS


def _case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{code}'" for test, code in pairs) + " END"


def _normalize() -> str:
    """The cascade of ``columns.action_code``: code, code in brackets, name, last part of a name, prefix, part of a name."""
    upper, lower = "upper(trim(value))", "lower(trim(value))"
    codes = ", ".join(f"'{c}'" for c in ACTIONS)
    flat = {c: n.replace(".", "_") for c, n in ACTIONS.items()}
    short = {c: n.split(".", 1)[1].replace(".", "_") for c, n in ACTIONS.items()}
    steps = [
        f"CASE WHEN {upper} = 'X1' OR contains({lower}, 'unlisted') THEN 'X1' END",
        rf"CASE WHEN regexp_extract({upper}, '\\(([A-FX]\\d)\\)', 1) IN ({codes}) THEN regexp_extract({upper}, '\\(([A-FX]\\d)\\)', 1) END",
        f"CASE WHEN {upper} IN ({codes}) THEN {upper} END",
        _case([(f"{lower} = '{n}'", c) for c, n in ACTIONS.items()]),
        _case([(f"replace({lower}, '_', '.') = '{n}'", c) for c, n in ACTIONS.items()]),
        _case([(f"replace({lower}, '.', '_') = '{flat[c]}' OR {lower} = '{short[c]}'", c) for c in ACTIONS]),
        _case([(f"startswith({upper}, '{c}')", c) for c in ACTIONS]),
        _case([(f"contains('{n}', {lower}) OR contains({lower}, '{n}')", c) for c, n in ACTIONS.items()]),
        "trim(value)",
    ]
    return f"CASE WHEN value IS NULL OR value = '' THEN '' ELSE coalesce({', '.join(steps)}) END"


def _bound(sign: str) -> str:
    p, zz = "(k / n)", "(1.96D * 1.96D)"
    half = f"1.96D * sqrt(({p} * (1 - {p}) + {zz} / (4 * n)) / n)"
    return f"CASE WHEN n > 0 THEN ({p} + {zz} / (2 * n) {sign} {half}) / (1 + {zz} / n) ELSE 0D END"


_GROUPS = ", ".join(f"'{g}'" for g in GROUPS)
FUNCTIONS = {
    "wilson_low(k DOUBLE, n DOUBLE) RETURNS DOUBLE": _bound("-"),
    "wilson_high(k DOUBLE, n DOUBLE) RETURNS DOUBLE": _bound("+"),
    "taxonomic_distance(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN a = b THEN 0D WHEN left(a, 1) = left(b, 1) THEN 0.33D "
    f"ELSE least(1D, 0.5D + 0.1D * abs(array_position(array({_GROUPS}), left(a, 1)) - array_position(array({_GROUPS}), left(b, 1)))) END",
    "normalize_action(value STRING) RETURNS STRING": _normalize(),
}
#: Segments of equal length of a stretch of time; a last shorter one stays if it is at least ``least`` long.
SLICES = """slices(begin DOUBLE, stop DOUBLE, length DOUBLE, least DOUBLE) RETURNS TABLE (slice_start DOUBLE, slice_end DOUBLE) RETURN
SELECT begin + step * length, least(begin + step * length + length, stop) FROM (SELECT explode(sequence(0, greatest(0, CAST(floor((stop - begin) / length) AS INT)))) AS step)
WHERE least(begin + step * length + length, stop) - (begin + step * length) >= slices.least AND least(begin + step * length + length, stop) > begin + step * length"""


def register(spark: SparkSession) -> None:
    """Make ``wilson_low``, ``wilson_high``, ``taxonomic_distance``, ``normalize_action`` and the table function ``slices``
    known to the session's SQL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {SLICES.replace('slices.least', 'shortest').replace('least DOUBLE)', 'shortest DOUBLE)')}")
