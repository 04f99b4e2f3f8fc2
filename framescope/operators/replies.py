"""Replies of labelling models: repaired, filled, normalised and checked, as column expressions on nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions import columns as C
from framescope.functions.taxonomy import ACTIONS, OCCLUSION, PROTECTION, PROTECTION_MAY_NOT_APPLY, PROTECTION_VALUES

# Text fields of a person, other names of protective items, and what an empty required field becomes.
TEXT_FIELDS = (
    "id", "position", "physical_description", "action_class", "action_code", "action_group", "unlisted_description", "role_in_coordination",
    "occlusion_level", "unsafe_act", "group_flag", "closest_existing_class", "closest_existing_label", "why_not_existing",
    "free_text_description", "tool_or_equipment", "industry_specific", "taxonomy_layer",
)
SCENE_TEXTS = ("group_activity", "scene_description", "visibility", "visible_equipment")
ITEM_NAMES = {
    "helmet": ("hard_hat", "helmet", "safety_helmet"),
    "high_vis_vest": ("safety_vest", "high_vis_vest", "vest", "hi_vis_vest", "reflective_vest"),
    "welding_protection": ("welding_protection", "welding_mask", "face_shield", "welding_shield"),
    "harness": ("harness", "safety_harness", "fall_protection"),
    "safety_shoes": ("safety_shoes", "safety_boots", "boots", "steel_toe", "footwear"),
    "gloves": ("gloves", "safety_gloves"),
}
REQUIRED = {
    "position": "",
    "action_class": "",
    "confidence": 0.5,
    "ppe": {},
    "spatial_context": ["ground_level"],
    "free_text_description": "",
    "group_flag": "solo",
    "occlusion_level": "fully_visible",
    "unsafe_act": "none",
}
BASIC_SCENES = ("SA", "MAI", "MAC", "SEQ")
MOST_PEOPLE = 30


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is worked out once a row, however many expressions use it later: the rows pass a
    generator, which the optimizer doesn't merge expressions across."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


# --- repair -----------------------------------------------------------------------------------------------------------


def _elements(value: Column) -> Column:
    """The elements of a JSON list as texts; a lone object or text becomes a list of one, anything else an empty list."""
    v = F.trim(value)
    return F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.startswith("{"), F.array(v)).when(v != "", F.array(v)).otherwise(F.array().cast("array<string>"))


def _named(text: Column) -> Column:
    """The fields of a JSON object as a map, with keys in lower case and underscores for blanks; null fields are left out."""
    entries = F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: e["value"].isNotNull())
    return _last_of_key(F.transform(entries, lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value"))))


def _person(named: Column, fields: Sequence[str] | None = None) -> Column:
    """A person's known fields from a map of texts, or those of ``fields``; other fields are dropped."""
    get = lambda k: F.try_element_at(named, F.lit(k))
    texts = {f: get(f) for f in TEXT_FIELDS}
    other = F.nullif(F.coalesce(get("action"), get("primary_action")), F.lit(""))
    texts["action_class"] = F.coalesce(texts["action_class"], F.when(texts["action_code"].isNull(), other))
    certainty = get("confidence")
    items = F.map_entries(_named(get("ppe")))
    spelling = {w: item for item, words in ITEM_NAMES.items() for w in words}

    def item(e: Column) -> Column:
        return F.struct(C.lookup(e["key"], spelling, e["key"]).alias("key"), C.protection_word(e["value"]).alias("value"))

    every = texts | {
        "confidence": F.when(certainty.isNotNull(), F.round(C.confidence(certainty), 3)),
        "ppe": _last_of_key(F.transform(items, item)),
        "spatial_context": _elements(get("spatial_context")),
        "occlusion_source": _elements(get("occlusion_source")),
        "coordinated_with": _elements(get("coordinated_with")),
    }
    return F.struct(*(v.alias(f) for f, v in every.items() if fields is None or f in fields))


def _last_of_key(entries: Column) -> Column:
    """A map of entries; of equal keys, which other spellings can bring about, the last one counts."""

    def kept(all_: Column) -> Column:
        later = lambda i: F.slice(all_["key"], i + 2, F.size(all_))
        last = F.filter(all_, lambda e, i: ~F.array_contains(later(i), e["key"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(all_["key"])) == F.size(all_), all_).otherwise(last))

    return F.coalesce(_once(entries, kept), F.create_map().cast("map<string,string>"))


_TOP = ", ".join(f"{f} string" for f in ("scene_type", "workers", "persons", "total_workers", "num_workers", "action_transition", *SCENE_TEXTS, "visibility_conditions"))


def _readable(reply: Column) -> Column:
    return F.trim(reply).startswith("{") & F.try_parse_json(reply).isNotNull()


def _people(top: Column) -> Column:
    """The people's JSON objects, under either name, of a list or alone; other entries are left out."""
    raw = F.trim(F.coalesce(top["workers"], top["persons"]))
    listed = F.when(raw.startswith("[") | raw.startswith("{"), _elements(raw)).otherwise(F.array().cast("array<string>"))
    return F.filter(listed, lambda x: F.trim(x).startswith("{"))


def _total(top: Column, people: Column) -> Column:
    return F.coalesce(top["total_workers"].try_cast("int"), top["num_workers"].try_cast("int"), F.size(people))


def _scene(top: Column, people: Column) -> dict[str, Column]:
    """The fields of a repaired scene but its people, by name."""
    moved = F.from_json(F.when(F.trim(top["action_transition"]).startswith("{"), top["action_transition"]), "detected boolean, transitions string")
    transition = F.struct(F.coalesce(moved["detected"], F.lit(False)).alias("detected"), _elements(moved["transitions"]).alias("transitions"))
    fields = {
        "scene_type": C.scene_code(F.coalesce(top["scene_type"], F.lit("SA"))),
        "total_workers": _total(top, people),
        "action_transition": transition,
        **{f: top[f] for f in SCENE_TEXTS},
        "visibility_conditions": F.when(top["visibility_conditions"].isNotNull(), _elements(top["visibility_conditions"])),
    }
    return {f: c.alias(f) for f, c in fields.items()}


def repaired(reply: Column) -> Column:
    """A reply's JSON text as a struct of scene type, number of people, people and the scene's other fields; null if it is
    no JSON object.

    People may be named workers or persons, and be a list or one object; entries that are no objects are left out. Texts
    and numbers in place of lists become lists of one. A transition that is no object is none.
    """

    def build(top: Column) -> Column:
        people = _people(top)
        fields = _scene(top, people)
        first = ("scene_type", "total_workers")
        return F.struct(*(fields[f] for f in first), F.transform(F.transform(people, _named), lambda p: _person(p)).alias("persons"), *(c for f, c in fields.items() if f not in first))

    return F.when(_readable(reply), _once(F.from_json(reply, _TOP), build))


def _scenes(rows: DataFrame, reply: str) -> DataFrame:
    """Rows of readable replies with their ``_top`` fields and the texts of their ``_people``, each worked out once."""
    tops = with_once(rows.where(_readable(F.col(reply))), "_top", F.from_json(reply, _TOP))
    return with_once(tops, "_people", _people(F.col("_top")))


def people_of(rows: DataFrame, reply: str, keep: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """The people of readable replies as rows: the ``keep`` columns, ``scene_type``, ``total_workers``, ``place`` (from 0) and
    ``p`` as in ``repaired``; one row with nulls for a reply without people. ``p`` holds only ``fields``, if given.

    A person is worked out as columns of a row, which are compiled, not inside an array, which isn't.
    """
    scene = C.scene_code(F.coalesce(F.col("_top.scene_type"), F.lit("SA"))).alias("scene_type")
    texts = _scenes(rows, reply).select(*keep, scene, _total(F.col("_top"), F.col("_people")).alias("total_workers"), F.posexplode_outer("_people").alias("place", "_text"))
    named = with_once(texts, "_named", F.when(F.col("_text").isNotNull(), _named(F.col("_text"))))
    return named.select(*keep, "scene_type", "total_workers", "place", F.when(F.col("_text").isNotNull(), _person(F.col("_named"), fields)).alias("p"))


def scenes_of(rows: DataFrame, reply: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of readable replies with a struct ``norm`` of the fields of the normal form that don't depend on
    what is said of each person. People are counted, not read."""
    scenes = _scenes(rows, reply)
    record = with_once(scenes.select(*keep, "_top", "_people"), "_record", F.struct(*_scene(F.col("_top"), F.col("_people")).values()))
    return record.select(*keep, F.struct(*_scene_form(F.col("_record")).values()).alias("norm"))


# --- defaults ---------------------------------------------------------------------------------------------------------


def missing_fields(person: Column) -> Column:
    """Names of required fields that are null, empty texts or empty lists; an empty map is no gap."""
    lists = ("spatial_context",)
    gap = lambda f: (F.coalesce(F.size(person[f]), F.lit(0)) <= 0) if f in lists else person[f].isNull() if f in ("confidence", "ppe") else F.coalesce(person[f], F.lit("")) == ""
    return F.array_compact(F.array(*(F.when(gap(f), F.lit(f)) for f in REQUIRED)))


def filled(person: Column) -> Column:
    """A person with defaults in place of required fields that are missing."""
    out = person
    for f, v in REQUIRED.items():
        if isinstance(v, dict):
            out = out.withField(f, F.coalesce(person[f], F.create_map().cast("map<string,string>")))
        elif isinstance(v, list):
            out = out.withField(f, F.when(F.coalesce(F.size(person[f]), F.lit(0)) > 0, person[f]).otherwise(F.array(*map(F.lit, v))))
        else:
            out = out.withField(f, F.coalesce(person[f] if f == "confidence" else F.nullif(person[f], F.lit("")), F.lit(v)))
    return out


# --- normal form ------------------------------------------------------------------------------------------------------


def mean_confidence(people: Column, without: float) -> Column:
    """Mean of the people's confidences that aren't null, to three digits; ``without`` where there is none."""
    known = F.array_compact(F.transform(people, lambda p: p["confidence"]))
    return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.size(known), 3)).otherwise(F.lit(without))


def _wearing(ppe: Column, item: str) -> Column:
    """State of an item in the words that records use."""
    unsaid = "not_applicable" if item in PROTECTION_MAY_NOT_APPLY else "cannot_determine"
    words = {"present": "worn", "absent": "not_worn", **{w: w for w in (*PROTECTION_VALUES, "not_applicable")}}
    return C.lookup(F.try_element_at(ppe, F.lit(item)), words, F.lit(unsaid))


def normalised_person(p: Column, i: Column) -> Column:
    """A person in normal form; ``i`` is the place, from 0."""
    text = lambda f, default="": F.coalesce(p[f], F.lit(default))
    none = F.array().cast("array<string>")
    said = F.coalesce(F.nullif(p["action_code"], F.lit("")), p["action_class"], F.lit(""))
    unlisted = F.struct(
        F.coalesce(p["closest_existing_class"], p["closest_existing_label"], F.lit("")).alias("closest_existing_class"),
        text("why_not_existing").alias("why_not_existing"),
        F.coalesce(p["free_text_description"], p["unlisted_description"], F.lit("")).alias("free_text_description"),
        text("tool_or_equipment").alias("tool_or_equipment"),
        F.coalesce(p["industry_specific"].try_cast("boolean"), F.lit(True)).alias("industry_specific"),
    )
    return _once(
        _once(said, C.action_code),
        lambda code: F.struct(
            F.coalesce(p["id"], F.concat(F.lit("P"), (i + 1).cast("string"))).alias("person_id"),
            p["position"].alias("position"),
            text("physical_description").alias("physical_description"),
            code.alias("action_code"),
            F.when(code == "X1", 2).otherwise(F.coalesce(p["taxonomy_layer"].try_cast("int"), F.lit(1))).alias("taxonomy_layer"),
            p["confidence"].alias("confidence"),
            F.struct(*(_wearing(p["ppe"], i).alias(i) for i in PROTECTION)).alias("ppe"),
            p["spatial_context"].alias("spatial_context"),
            text("occlusion_level", OCCLUSION[0]).alias("occlusion_level"),
            F.coalesce(p["occlusion_source"], none).alias("occlusion_source"),
            p["unsafe_act"].alias("unsafe_act"),
            F.lit("none_visible").alias("interaction"),
            text("group_flag", "solo").alias("group_flag"),
            F.coalesce(p["coordinated_with"], none).alias("coordinated_with"),
            text("role_in_coordination").alias("role_in_coordination"),
            text("free_text_description").alias("free_text_description"),
            text("tool_or_equipment").alias("tool_or_equipment"),
            F.when(code == "X1", unlisted).alias("unlisted_action"),
        ),
    )


def _alone(p: Column, i: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(i == 0, p.withField("group_flag", F.lit("solo")).withField("coordinated_with", none).withField("role_in_coordination", F.lit(""))).otherwise(p)


def _scene_form(record: Column) -> dict[str, Column]:
    """The fields of a record's normal form that don't depend on what is said of each person, by name."""
    n = record["total_workers"]
    text = lambda f, default="": F.coalesce(record[f], F.lit(default))
    seen = F.coalesce(record["visibility_conditions"], F.array().cast("array<string>"))
    fields = {
        "scene_type": F.when((n == 1) & (record["scene_type"] != ""), "SA").otherwise(record["scene_type"]),
        "num_workers": n,
        "annotation_layer": F.when(n > 5, 1).otherwise(2),
        "visibility": text("visibility", "clear"),
        "visibility_conditions": F.when(F.size(seen) > 0, seen).otherwise(F.array(text("visibility", "clear"))),
        "visible_equipment": text("visible_equipment"),
        "action_transition": record["action_transition"],
        "group_activity": text("group_activity"),
        "scene_description": text("scene_description"),
    }
    return {f: c.alias(f) for f, c in fields.items()}


def normalised(record: Column, people: Column) -> Column:
    """The normal form of a repaired record, given its people in normal form.

    A scene with one person is SA, and a person in a scene of another type that has but one is alone in it; up to five
    people make layer 2, more layer 1. Fields without people have defaults.
    """
    n = record["total_workers"]
    big, one = n > 5, (n == 1) & (record["scene_type"] != "")
    people = F.when(one & (record["scene_type"] != "SA"), F.transform(people, _alone)).otherwise(people)
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(people, lambda p: p["action_code"]), lambda c: F.coalesce(c, F.lit("")) != "")))
    states = F.flatten(F.transform(people, lambda p: F.array(*(p["ppe"][i] for i in PROTECTION))))
    first = F.get(people, F.lit(0))
    scene = _scene_form(record)
    return F.struct(
        *(scene[f] for f in ("scene_type", "num_workers", "annotation_layer")),
        (big & (F.size(people) > 0)).alias("bonus_per_person"),
        *(scene[f] for f in ("visibility", "visibility_conditions", "visible_equipment", "action_transition", "group_activity", "scene_description")),
        F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("X1"))).alias("dominant_actions"),
        C.overall_protection(F.transform(states, lambda v: C.lookup(v, {"worn": "present", "not_worn": "absent"}, v))).alias("overall_ppe_compliance"),
        mean_confidence(people, 0.5).alias("annotator_confidence"),
        people.alias("persons"),
        F.coalesce(first["action_code"], F.lit("")).alias("action_class"),
        F.coalesce(first["unsafe_act"], F.lit("")).alias("unsafe_act"),
        first["spatial_context"].alias("spatial_context"),
        first["ppe"].alias("ppe"),
        F.coalesce(first["interaction"], F.lit("")).alias("interaction"),
    )


def with_norm(rows: DataFrame, fixed: str = "fixed", norm: str = "norm") -> DataFrame:
    """Repaired records with their normal forms, each worked out once."""
    people = with_once(rows, "_people", F.transform(F.col(fixed)["persons"], normalised_person))
    return with_once(people, norm, F.when(F.col(fixed).isNotNull(), normalised(F.col(fixed), F.col("_people")))).drop("_people")


def codes_by_layer(norm: Column) -> Column:
    """A record's action codes: those of the scene on layer 1, else one for each person that has one."""
    own = F.filter(F.transform(norm["persons"], lambda p: p["action_code"]), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.when(norm["annotation_layer"] == 1, norm["dominant_actions"]).otherwise(F.coalesce(own, F.array().cast("array<string>")))


def compared_fields(norm: Column) -> list[Column]:
    """The scalars by which two versions of a record are compared."""
    first = F.get(norm["persons"], F.lit(0))
    return [
        *(norm[f].alias(f) for f in ("scene_type", "num_workers", "annotation_layer", "overall_ppe_compliance", "annotator_confidence")),
        F.get(norm["dominant_actions"], F.lit(0)).alias("dominant_action_0"),
        F.size(norm["persons"]).alias("n_persons"),
        first["action_code"].alias("primary_person_action"),
        first["unsafe_act"].alias("primary_person_unsafe"),
    ]


def prefill(success: Column, model: Column, norm: Column) -> Column:
    """What an annotator sees first: (source, annotation); null unless the model succeeded with a normal form."""
    return F.when(F.coalesce(success, F.lit(False)) & norm.isNotNull(), F.struct(F.coalesce(model, F.lit("unknown")).alias("source"), norm.alias("annotation")))


def human_person(p: Column) -> Column:
    """A person as a human's form saves it: no unsafe act is "none", nothing hides who is fully visible, and only
    coordinated people have partners and a role."""
    together = p["group_flag"] == "coordinated"
    none = F.array().cast("array<string>")
    return F.struct(
        p["action_code"].alias("action_code"),
        F.when(p["action_code"] == "X1", 2).otherwise(1).alias("taxonomy_layer"),
        F.coalesce(F.nullif(F.trim(p["unsafe_act"]), F.lit("")), F.lit("none")).alias("unsafe_act"),
        F.when(p["occlusion_level"] == OCCLUSION[0], none).otherwise(F.coalesce(p["occlusion_source"], none)).alias("occlusion_source"),
        F.coalesce(p["group_flag"], F.lit("solo")).alias("group_flag"),
        F.when(together, F.coalesce(p["coordinated_with"], none)).otherwise(none).alias("coordinated_with"),
        F.when(together, F.coalesce(p["role_in_coordination"], F.lit(""))).otherwise("").alias("role_in_coordination"),
    )


# --- checks -----------------------------------------------------------------------------------------------------------


def _issue(name: str, value: Column | None = None) -> Column:
    return F.lit(name) if value is None else F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("None")))


def _some(*checks: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks)))


def _unknown(values: Column, known, name: str) -> Column:
    return F.coalesce(F.transform(F.filter(values, lambda v: ~F.coalesce(v.isin(*known), F.lit(False))), lambda v: _issue(name, v)), F.array().cast("array<string>"))


def person_issues(people: Column) -> Column:
    """Issues of all people, each with the person's place from 0."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    states = (*PROTECTION_VALUES, "not_applicable")

    def one(p: Column, i: Column) -> Column:
        worn = [(~none(p["ppe"][x]) & ~p["ppe"][x].isin(*states), _issue(f"invalid_ppe_{x}", p["ppe"][x])) for x in ("helmet", "safety_shoes", "high_vis_vest")]
        found = _some(
            (none(p["action_code"]), _issue("missing_action_code")),
            (~none(p["action_code"]) & ~p["action_code"].isin(*ACTIONS), _issue("invalid_action", p["action_code"])),
            (p["confidence"].isNull(), _issue("missing_confidence")),
            (~p["confidence"].between(0, 1), _issue("confidence_out_of_range", p["confidence"])),
            (p["ppe"].isNull(), _issue("missing_ppe")),
            *worn,
            (F.coalesce(F.size(p["spatial_context"]), F.lit(0)) <= 0, _issue("missing_spatial_context")),
            (~none(p["occlusion_level"]) & ~p["occlusion_level"].isin(*OCCLUSION), _issue("invalid_occlusion", p["occlusion_level"])),
            (p["unsafe_act"].isNull(), _issue("missing_unsafe_act_field")),
        )
        return F.transform(found, lambda t: F.concat(F.lit("p["), i.cast("string"), F.lit("]_"), t))

    return F.coalesce(F.flatten(F.transform(people, one)), F.array().cast("array<string>"))


def prediction_issues(norm: Column, parsed: Column) -> Column:
    """Issues of a successful prediction: labels, ranges and gaps of the scene, then those of its people.

    Without a normal form that is the only issue. Scene types with an X suffix don't count as valid here.
    """
    n, layer, sure = norm["num_workers"], norm["annotation_layer"], norm["annotator_confidence"]
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    none = F.array().cast("array<string>")
    scene = F.concat(
        _some(
            (parsed.isNull(), _issue("no_parsed_output")),
            (~F.coalesce(norm["scene_type"], F.lit("")).isin(*BASIC_SCENES), _issue("invalid_scene_type", norm["scene_type"])),
            (F.coalesce(n, F.lit(0)) == 0, _issue("num_workers=0")),
            ((n < 0) | (n > MOST_PEOPLE), _issue("num_workers_out_of_range", n)),
            (~F.coalesce(layer.isin(1, 2), F.lit(False)), _issue("invalid_layer", layer)),
            (empty(norm["dominant_actions"]), _issue("empty_dominant_actions")),
        ),
        _unknown(norm["dominant_actions"], ACTIONS, "invalid_dominant_action"),
        _some(
            (empty(norm["visibility_conditions"]), _issue("missing_visibility_conditions")),
            (F.coalesce(norm["overall_ppe_compliance"], F.lit("")) == "", _issue("missing_overall_ppe_compliance")),
            (sure.isNull(), _issue("missing_annotator_confidence")),
            (~sure.between(0, 1), _issue("confidence_out_of_range", sure)),
            ((layer == 2) & empty(norm["persons"]), _issue("layer2_but_no_persons")),
        ),
        person_issues(norm["persons"]),
    )
    return F.when(norm.isNull(), F.array(F.lit("no_normalized_output"))).otherwise(F.coalesce(scene, none))


def issue_kind(issue: Column) -> Column:
    """An issue without its value; people keep their places."""
    return F.substring_index(issue, "=", 1)
