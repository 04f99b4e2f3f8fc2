"""Joins of sites and cameras with rule books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.columns import is_violation


def zone_flagged(rows: DataFrame, zones: DataFrame, key: str, flagged: list[str]) -> DataFrame:
    """Rows whose camera has a flagged zone. ``zones`` is (key, zones array), a small table of cameras."""
    hit = zones.where(F.arrays_overlap("zones", F.array(*map(F.lit, flagged)))).select(key).distinct()
    return rows.join(hit, key, "left_semi")


def applicable(sites: DataFrame, departments: DataFrame, zones: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, rule_id): rules of departments whose site equals or contains the site's name, or is contained in it;
    without such a department, of those that share a zone; general rules always.

    ``departments`` (dept, dept_site), ``zones`` (dept, zone) and ``rules`` (dept, rule_id; dept null for general ones)
    are hand-written dimension tables of at most hundreds of rows, so they are broadcast.
    """
    a, b = F.lower("site"), F.lower("dept_site")
    named = sites.join(F.broadcast(departments), (a == b) | a.contains(b) | b.contains(a)).select("site", "dept").distinct()
    rest = sites.join(named, "site", "left_anti").select("site", F.explode("zones").alias("zone"))
    by_zone = rest.join(F.broadcast(zones), "zone").select("site", "dept").distinct()
    special = named.unionByName(by_zone).join(F.broadcast(rules.where("dept is not null")), "dept").select("site", "rule_id")
    general = sites.select("site").crossJoin(F.broadcast(rules.where("dept is null").select("rule_id")))
    return special.unionByName(general).distinct()


def rule_text(site_rules: DataFrame, rules: DataFrame) -> DataFrame:
    """One block of text a site: its rules in order of their ids."""
    lines = site_rules.join(F.broadcast(rules.select("rule_id", "description")), "rule_id").select("site", F.concat_ws(": ", "rule_id", "description").alias("line"))
    return lines.groupBy("site").agg(F.concat_ws("\n", F.array_sort(F.collect_set("line"))).alias("block"))


def rule_rows(book: DataFrame, general: DataFrame) -> DataFrame:
    """(dept, rule_id, description): a book of (dept, observations), a map of each department's rules, as rows, and the
    ``general`` rules (rule_id, description) without a department."""
    special = book.select("dept", F.explode("observations").alias("rule_id", "description"))
    return special.unionByName(general.select(F.lit(None).cast("string").alias("dept"), "rule_id", "description"))


def flagged_people(people: Column) -> Column:
    """The people of a record with an unsafe act: (person_id, action_code, unsafe_act), named by their places from P1."""
    placed = F.transform(people, lambda p, i: F.struct(F.concat(F.lit("P"), (i + 1).cast("string")).alias("person_id"), p["action_code"].alias("action_code"), F.trim(p["unsafe_act"]).alias("unsafe_act")))
    return F.coalesce(F.filter(placed, lambda p: is_violation(p["unsafe_act"], "routing")), F.array().cast("array<struct<person_id:string,action_code:string,unsafe_act:string>>"))


def messages(site: Column, block: Column, frames: Column) -> Column:
    """A JSON list of messages: the site's rules, then what to look at."""
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("Rules of "), site, F.lit(":\n"), block).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Look at "), frames.cast("string"), F.lit(" frames.")).alias("content"))
    return F.to_json(F.array(system, user))
