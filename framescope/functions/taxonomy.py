"""Fixed values of the annotation domain, and small dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Action codes and names. The letter of a code is its group.
ACTIONS = {
    "A1": "locomotion.walking",
    "A2": "locomotion.climbing_up",
    "A3": "locomotion.climbing_down",
    "A4": "locomotion.carrying_walking",
    "A5": "locomotion.pushing_pulling",
    "B1": "work.standing_operation_tool_use",
    "B2": "work.standing_panel_operation",
    "B3": "work.hot_work_welding",
    "B4": "work.hot_work_non_welding",
    "B5": "work.crouching_floor_work",
    "B6": "work.overhead_reaching",
    "B7": "work.inspection_stationary",
    "B8": "work.lifting_placing",
    "B9": "work.sitting_operation",
    "C1": "crane.signalling",
    "C2": "crane.hook_interaction",
    "C3": "crane.guiding_load",
    "C4": "vehicle.operating",
    "D1": "material.manual_team_carry",
    "D2": "material.loading_unloading",
    "D3": "material.cylinder_handling",
    "E1": "social.communicating",
    "E2": "social.supervising",
    "F1": "idle.standing",
    "F2": "idle.sitting",
    "X1": "other.unlisted_action",
}
# Groups of codes, in their order.
GROUPS = ("A", "B", "C", "D", "E", "F", "X")
# Severity of a condition tag; a tag that isn't listed counts as 0.
SEVERITY = {"clean": 0, "dust_light": 1, "low_light": 1, "low_quality": 1, "distant_scene": 1, "dust_heavy": 2, "steam": 2, "occlusion_static": 2, "occlusion_dynamic": 3, "multi_degradation": 4}
# What counts as "no violation", by use.
NO_VIOLATION = {
    "scoring": ("none",),
    "quality_control": ("", "none"),
    "routing": ("", "none", "none_visible"),
    "bias": ("none", "n/a", "", "safe"),
    "agreement": ("",),
}
# Vocabularies of scenes, visibility, protection and people.
SCENES = ("SA", "MAI", "MAC", "SEQ", "SA-X", "MAI-X", "MAC-X")
SCENE_NAMES = {"SINGLE": "SA", "SINGLEACTOR": "SA", "MULTI": "MAI", "MULTIACTORINDEPENDENT": "MAI", "MULTIACTORCOORDINATED": "MAC", "SEQUENTIAL": "SEQ"}
# Words for the state of a protective item.
PROTECTION_WORDS = {
    "present": ("present", "yes", "true", "1", "worn", "visible", "detected", "wearing"),
    "absent": ("absent", "no", "false", "0", "not_worn", "missing", "not_visible", "not_wearing", "none"),
    "cannot_determine": ("cannot_determine", "unknown", "unsure", "unclear", "indeterminate", "partially_visible", "obscured"),
    "not_applicable": ("not_applicable", "n/a", "na"),
}
# Conditions by which the accuracy of a source degrades.
DEGRADING = ("clear", "low_light", "dust", "glare", "steam", "smoke")
# Visibility of a scene, and its conditions.
VISIBILITY = ("clear", "moderate", "harsh")
CONDITIONS = ("clear", "steam", "dust", "smoke", "rain", "glare", "low_light")
# Items of protection, their states, and those that may not apply.
PROTECTION = ("helmet", "high_vis_vest", "welding_protection", "harness", "safety_shoes")
PROTECTION_VALUES = ("worn", "not_worn", "cannot_determine")
PROTECTION_MAY_NOT_APPLY = ("welding_protection", "harness")
# Roll-ups of a scene's protection.
OVERALL_PROTECTION = ("compliant", "partial", "non_compliant", "cannot_determine")
# Tags of places.
SPATIAL_TAGS = ("ground_level", "elevated", "vehicle_area", "crane_zone", "furnace_zone", "confined_space", "restricted", "near_machinery", "walkway", "storage_area", "locomotive_area", "hot_area")
# How far a person is hidden, and in what company.
OCCLUSION = ("fully_visible", "partially_occluded", "heavily_occluded")
COMPANY = ("solo", "coordinated", "concurrent")
# Reasons of flags, and states of protection as rules name them.
FLAG_CATEGORIES = ("vlm_count_wrong", "image_unclear", "missing_frames", "ambiguous_scene", "wrong_content", "other")
PROTECTION_STATES = ("compliant", "partial", "non_compliant", "cannot_determine", "not_applicable")


def action_table(spark: SparkSession) -> DataFrame:
    """(code, name, group, group_rank, place) of every action; at most a few dozen rows, fit to be broadcast."""
    rows = [(c, n, c[0], GROUPS.index(c[0]), k) for k, (c, n) in enumerate(ACTIONS.items())]
    return spark.createDataFrame(rows, "code string, name string, group string, group_rank int, place int")
