"""Scalar functions as column expressions: gates, tags, parsers, normalisers and small arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope.functions.taxonomy import ACTIONS, GROUPS, NO_VIOLATION, PROTECTION, PROTECTION_WORDS, SCENE_NAMES, SEVERITY


def _keep(*options: tuple[Column, Column | str]) -> Column:
    """Values whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in options)))


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small dictionary, else ``default`` (else null)."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(entries, value)
    return found if default is None else F.coalesce(found, default)


# --- quality tiers --------------------------------------------------------------------------------------------------


def gate_failures(ratio: Column, area: Column, confidence: Column, duration: Column, min_ratio: float = 0.40, min_area: float = 0.005, min_confidence: float = 0.45, min_duration: float = 8.0) -> Column:
    """Names of the quality gates that a segment fails; a missing value fails."""
    low = lambda c, t: F.coalesce(c < t, F.lit(True))
    return _keep((low(ratio, min_ratio), "detection_ratio"), (low(area, min_area), "bbox_area"), (low(confidence, min_confidence), "confidence"), (low(duration, min_duration), "duration"))


def tier(failures: Column) -> Column:
    return F.when(F.size(failures) == 0, "A").otherwise("B")


def condition_tags(intensity: Column, noise: Column, least: Column, most: Column, ratio: Column, largest: Column) -> Column:
    """Condition tags: low light, noise, changing occlusion, distance, several people; ``clean`` if none applies."""
    degraded = _keep(
        ((intensity >= 0) & (intensity < 60), "low_light"),
        (noise > 60, "low_quality"),
        ((most > 0) & (least == 0) & (ratio > 0.2) & (ratio < 0.7), "occlusion_dynamic"),
        ((largest > 0) & (largest < 0.01), "distant_scene"),
    )
    tags = F.concat(degraded, _keep((most >= 2, "multi_worker")), _keep((F.size(degraded) >= 2, "multi_degradation")))
    return F.when(F.size(tags) == 0, F.array(F.lit("clean"))).otherwise(tags)


def severity(tags: Column) -> Column:
    """The worst severity of an array of tags, 0 to 4."""
    return F.coalesce(F.array_max(F.transform(tags, lambda t: lookup(t, SEVERITY, F.lit(0)))), F.lit(0))


def low_light(intensity: Column, threshold: float = 60) -> Column:
    return F.when(intensity < threshold, "low_light").otherwise("normal")


def luma(blue: Column, green: Column, red: Column) -> Column:
    return 0.114 * blue + 0.587 * green + 0.299 * red


def crowd(mean_people: Column) -> Column:
    return F.when(mean_people <= 1.5, "low").when(mean_people <= 4, "medium").otherwise("high")


# --- names, ids, paths ----------------------------------------------------------------------------------------------


def source_kind(folder: Column) -> Column:
    """A if the folder has an ``@``; B if a part between underscores has three dots; otherwise A."""
    dotted = F.exists(F.split(folder, "_"), lambda p: F.length(p) - F.length(F.replace(p, F.lit("."), F.lit(""))) == 3)
    return F.when(folder.contains("@"), "A").when(dotted, "B").otherwise("A")


def segment_id(camera: Column, date: Column, start_seconds: Column, sequence: Column) -> Column:
    """``clip_{camera}_{yyyymmdd}_{HHMMSS}_{0000}``; hours above 99 and sequences above 9999 keep all their digits."""
    s = F.floor(start_seconds).cast("long")
    wide = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.lit(n), F.length(c.cast("string"))), F.lit("0"))
    two = lambda c: wide(c, 2)
    clock = F.concat(two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))
    return F.concat_ws("_", F.lit("clip"), camera, F.replace(date, F.lit("-"), F.lit("")), clock, wide(sequence, 4))


def canonical(name: Column, spellings: dict[str, str]) -> Column:
    """Trimmed name, replaced where a spelling is listed."""
    return lookup(F.trim(name), spellings, F.trim(name))


def file_parts(name: Column) -> Column:
    """(site, area, camera, date, start) of ``site-area_camera_yyyymmdd_HHMMSS.ext``; null parts where it doesn't match."""
    pattern = r"^([^-_]+)-([^_]+)_([^_]+)_(\d{8})_(\d{6})"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    day = part(4)
    return F.struct(part(1).alias("site"), part(2).alias("area"), part(3).alias("camera"), F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)).alias("date"), part(5).alias("start"))


def video_parts(name: Column, folder: Column) -> Column:
    """(site, area, camera, date, start) of a video's file name, in either form of names.

    ``Site_Work area_main_20240102030405.mp4`` tells all by itself. A name without ``_main_`` gives the first of its parts
    that begins with eight digits as the start; site and area then come from the folder's last part, without what follows
    an ``@`` and without a trailing time, unless that is a date alone. The camera is the name of the place, blanks as
    underscores, or the file's own name where the folder gives none.
    """
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    main = stem.contains("_main_")
    prefix = F.regexp_replace(stem, r"_main_((?!_main_).)*$", "")
    last = F.coalesce(F.element_at(F.split(F.regexp_replace(folder, "/+$", ""), "/"), -1), F.lit(""))
    place = F.regexp_replace(F.substring_index(last, "@", 1), r"_\d{8}[^_]*$", "")
    place = F.when(main, prefix).when(last.rlike(r"^\d{8}$"), "").otherwise(place)
    timed = F.filter(F.split(stem, "_"), lambda p: p.rlike(r"^\d{8}"))
    start = F.when(main, F.substring_index(stem, "_main_", -1)).otherwise(F.coalesce(F.get(timed, F.lit(0)), F.lit("")))
    date = F.when(F.length(start) >= 8, F.concat_ws("-", F.substring(start, 1, 4), F.substring(start, 5, 2), F.substring(start, 7, 2))).otherwise("")
    area = F.when(place.contains("_"), F.regexp_replace(place, "^[^_]*_", "")).otherwise("")
    camera = F.replace(F.when(place != "", F.when(area != "", place).otherwise(F.substring_index(place, "_", 1))).otherwise(stem), F.lit(" "), F.lit("_"))
    return F.struct(F.substring_index(place, "_", 1).alias("site"), area.alias("area"), camera.alias("camera"), date.alias("date"), start.alias("start"))


def signature(record: Column, length: int = 8) -> Column:
    """The first digits of the MD5 of a JSON record with its keys in order at every level, whatever order they are given in."""
    return F.substring(F.md5(F.to_json(F.try_parse_json(record))), 1, length)


def safe_id(value: Column, length: int = 64) -> Column:
    return F.substring(F.regexp_replace(value, "[^a-zA-Z0-9_-]", "_"), 1, length)


def failure_kind(error: Column) -> Column:
    """Kind of a failure, by the first pattern its text holds."""
    e = F.lower(error)
    has = lambda *words: F.greatest(*(e.contains(w) for w in words), F.lit(False))
    return (
        F.when(error.isNull(), "unknown")
        .when(has("parse"), "parse_fail")
        .when(has("429", "rate", "throttl"), "rate_limit")
        .when(has("timeout"), "timeout")
        .when(has("safety", "block"), "safety_block")
        .when(has("token", "length"), "token_limit")
        .otherwise("other")
    )


def error_group(error: Column) -> Column:
    """Error text with person numbers masked, for grouping."""
    return F.regexp_replace(error, r"\bP\d+", "P*")


# --- geometry and offsets -------------------------------------------------------------------------------------------


def box_position(left: Column, right: Column, width: Column) -> Column:
    centre = (left + right) / 2
    return F.when(centre < width / 3, "left").when(centre < 2 * width / 3, "center").otherwise("right")


def box_depth(top: Column, bottom: Column, height: Column) -> Column:
    return F.when((bottom - top) / height > 0.3, "foreground").otherwise("background")


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, share: float = 0.2) -> Column:
    dx, dy = F.floor((x1 - x0) * share), F.floor((y1 - y0) * share)
    return F.struct(F.greatest(x0 - dx, F.lit(0)).alias("x0"), F.greatest(y0 - dy, F.lit(0)).alias("y0"), F.least(x1 + dx, width).alias("x1"), F.least(y1 + dy, height).alias("y1"))


def even_places(n: Column, k: int) -> Column:
    """``k`` evenly spaced places among 0 to n - 1, first and last included."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("long"))


def middle_offsets(start: Column, duration: Column, k: int) -> Column:
    """Middles of ``k`` equal parts of a stretch of time."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: start + duration * (2 * i + 1) / (2 * k))


# --- labels ---------------------------------------------------------------------------------------------------------


def action_code(value: Column) -> Column:
    """An action code from free text: a cascade from exact code to part of a name; what matches nothing stays.

    All but the last step are lookups of one form of the text each, so that a value costs a few comparisons.
    """
    s = F.trim(value)
    upper, lower = F.upper(s), F.lower(s)
    codes = {c: c for c in ACTIONS}
    names = {n: c for c, n in ACTIONS.items()}
    flat = {n.replace(".", "_"): c for n, c in names.items()}
    parts = {n.split(".", 1)[1].replace(".", "_"): c for n, c in names.items()}
    part_of = F.coalesce(*(F.when(F.lit(n).contains(lower) | lower.contains(n), c) for n, c in names.items()))
    return F.when(value.isNull() | (value == ""), "").otherwise(
        F.coalesce(
            F.when((upper == "X1") | lower.contains("unlisted"), "X1"),
            F.when(s.contains("("), lookup(F.regexp_extract(upper, r"\(([A-FX]\d)\)", 1), codes)),
            lookup(upper, codes),
            lookup(lower, names),
            lookup(F.replace(lower, F.lit("_"), F.lit(".")), names),
            lookup(F.replace(lower, F.lit("."), F.lit("_")), flat),
            lookup(lower, parts),
            lookup(F.substring(upper, 1, 2), codes),
            part_of,
            s,
        )
    )


def scene_code(value: Column) -> Column:
    """Scene type without spacing and dashes; common long names map to codes. ``SA-X`` thus becomes ``SAX``."""
    s = F.regexp_replace(F.upper(F.trim(value)), "[-_ ]", "")
    return lookup(s, SCENE_NAMES, s)


def protection_state_or(value: Column, default: Column) -> Column:
    return lookup(F.lower(F.trim(value)), {w: state for state, words in PROTECTION_WORDS.items() for w in words}, default)


def protection_state(value: Column, default: str) -> Column:
    """State of a protective item from free wording."""
    return protection_state_or(value, F.lit(default))


def protection_word(value: Column) -> Column:
    """A state's usual word for free wording; what isn't known stays, in lower case."""
    return protection_state_or(value, F.lower(F.trim(value)))


def confidence(value: Column) -> Column:
    """A confidence from text: percentages are divided, values clamped to [0, 1]; 0.5 if it is no number."""
    x = value.try_cast("double")
    return F.when(x.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))))


def layer(people: Column) -> Column:
    return F.when(F.coalesce(people.try_cast("int"), F.lit(0)) <= 5, 2).otherwise(1)


def is_violation(value: Column, use: str = "scoring") -> Column:
    """Whether a label names a violation, under the vocabulary of one use; null never does."""
    return F.coalesce(~F.lower(F.trim(value)).isin(*NO_VIOLATION[use]), F.lit(False))


def label_distance(a: Column, b: Column) -> Column:
    """0 for equal codes, 0.33 in one group, else 0.5 and 0.1 for each group between, at most 1."""
    place = lambda c: F.array_position(F.array(*map(F.lit, GROUPS)), F.substring(c, 1, 1))
    return F.when(a == b, 0.0).when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.33).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * F.abs(place(a) - place(b))))


def route(score: Column, high: float | None = None, low: float | None = None) -> Column:
    """Confidence route. A threshold of 0 counts as not given, as the defaults then apply."""
    return F.when(score >= (high or 0.80), "high").when(score >= (low or 0.50), "medium").otherwise("low")


def overall_protection(states: Column) -> Column:
    """Roll-up of an array of item states, items that don't apply aside."""
    n = lambda v: F.size(F.filter(states, lambda x: x == v))
    counted = F.size(F.filter(states, lambda x: x != "not_applicable"))
    return F.when((n("absent") == 0) & (n("present") > 0), "compliant").when((n("absent") > 0) & (2 * n("absent") >= counted), "non_compliant").when(n("absent") > 0, "partial").otherwise("cannot_determine")


def protection_states(record: Column) -> Column:
    return F.array(*(record[i] for i in PROTECTION))


# --- agreement of two labels or sets --------------------------------------------------------------------------------


def action_agreement(a: Column, b: Column, normal: bool = False) -> Column:
    """1 for equal codes, 0.5 for codes of one group; an empty or missing code agrees with nothing. Texts are brought to
    codes first, unless they are ``normal`` already."""
    if not normal:
        a, b = action_code(a), action_code(b)
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).when(a == b, 1.0).when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.5).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def wilson(k: Column, n: Column, clamp: bool = False, z: float = 1.96) -> Column:
    """Wilson interval of k successes in n trials; (0, 0) without trials."""
    p, zz = k / n, z * z
    centre, half = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    low, high = (centre - half) / (1 + zz / n), (centre + half) / (1 + zz / n)
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


# --- text and JSON --------------------------------------------------------------------------------------------------


def json_in_text(text: Column) -> Column:
    """The JSON object in free text: the whole, a ```json fence, any fence, or from the first to the last brace."""
    options = (text, F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.regexp_extract(text, r"(?s)```\s*(.*?)\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.coalesce(*(F.when(F.try_parse_json(o).isNotNull() & (F.trim(o) != ""), o) for o in options))


def changed_fields(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """Names of the fields that differ between two records; null equals null."""
    return _keep(*((~a.eqNullSafe(b), name) for name, a, b in pairs))


def queue_items(raw: Column) -> Column:
    """Ids of the clips in a queue item: a plain id, ``{"clip_id": ...}``, or such objects in ``{"items": [...]}``."""
    inside = F.transform(F.from_json(F.get_json_object(raw, "$.items"), "array<struct<clip_id:string>>"), lambda x: x["clip_id"])
    one = F.get_json_object(raw, "$.clip_id")
    return F.coalesce(inside, F.when(one.isNotNull(), F.array(one)), F.array(raw))
