"""Constraint checks as DataFrames: rules over wide joins become typed violation rows, and a gate fails a read on them.

A violation is one row (rule, raised, subject, item): the rule's name, whether it stops the work or is only listed,
and what it was found on. A list of rules costs one pass over its rows; nothing is collected."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import reference
from quillwork.functions import text as tx
from quillwork.functions import validation as va
from quillwork.functions import version as vs
from quillwork.operators.lineage import written


def violations(rows: DataFrame, rules: dict[str, Column], subject: Column, item: Column | None = None, raised: bool = True) -> DataFrame:
    """One row per row and rule that it breaks; a rule whose condition is unknown is broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    found = rows.select(F.explode(broken).alias("rule"), subject.cast("string").alias("subject"), (F.lit("") if item is None else F.coalesce(item.cast("string"), F.lit(""))).alias("item"))
    return found.select("rule", F.lit(raised).alias("raised"), "subject", "item")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows, or an error that names a rule as soon as they are read, if a raised violation was found."""
    first = found.where("raised").agg(F.min(F.concat_ws(" ", "rule", "subject", "item"))).scalar()
    return rows.where(F.when(first.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("violated: "), first)).cast("boolean")))


def repeated(rows: DataFrame, keys: list[str], rule: str, subject: str, item: str | None = None) -> DataFrame:
    """A violation per key that more than one row has."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return violations(many, {rule: F.lit(True)}, F.col(subject), None if item is None else F.col(item))


def guarded(rows: DataFrame, column: str, allowed: str) -> DataFrame:
    """rows, or an error as soon as one is read that is of another partition: nothing of another may be shown to a search."""
    return rows.where(F.when(F.col(column).eqNullSafe(F.lit(allowed)), True).otherwise(F.raise_error(F.concat(F.lit(f"only {allowed} may be read, not "), F.coalesce(column, F.lit("null")))).cast("boolean")))


# --- profiles ---

TERM = "struct<vendor:string,product:string,exact:string,lower:string,upper:string,lower_inclusive:boolean,upper_inclusive:boolean>"


class Limits(NamedTuple):
    """What a profile must keep: least and most components and candidates, least share of distractors."""

    components: tuple[int, int] = (6, 10)
    candidates: tuple[int, int] = (15, 25)
    distractors: float = 0.30


def _named(t: Column, c: Column) -> Column:
    return (t["vendor"] == c["vendor"]) & (t["product"] == c["product"])


def _keyed(t: Column) -> Column:
    """A term as it is compared: names in lower case, bounds as order keys."""
    ends = [vs.version_key(t[c]).alias(c) for c in ("exact", "lower", "upper")]
    return F.struct(F.lower(t["vendor"]).alias("vendor"), F.lower(t["product"]).alias("product"), *ends, t["lower_inclusive"].alias("lower_inclusive"), t["upper_inclusive"].alias("upper_inclusive"))


def _within(t: Column, c: Column) -> Column:
    return F.coalesce(vs.in_range(c["key"], t["exact"], t["lower"], t["upper"], t["lower_inclusive"], t["upper_inclusive"]), F.lit(False))


def _branches(terms: Column, product: Column) -> Column:
    """(major, minor) of the bounds that the (keyed) terms of a product name, without 0."""
    bounds = F.flatten(F.transform(F.filter(terms, lambda t: _named(t, product)), lambda t: F.array(t["exact"], t["lower"], t["upper"])))
    keys = F.filter(F.array_compact(bounds), lambda k: (F.size(k) > 1) | (F.get(k, F.lit(0))["d"] != "0"))
    return F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.concat_ws(".", F.get(k, F.lit(0))["d"], F.coalesce(F.get(k, F.lit(1))["d"], F.lit("0"))))))


#: What a nested profile holds of its rows, its components and its candidates beside their source records.
_HEAD = ("partition", "stratum", "text", "expected", "distractors", "pair")
_COMPONENT = ("position", "vendor", "product", "version", "style")
_CANDIDATE = ("cve", "terms", "matches", "year", "assigned", "unchanged", "reproduced")


def sourced(statements: DataFrame) -> DataFrame:
    """Statements (sha256, terms, published) beside their source records (body, matches) with what does not depend on a profile: year, unchanged,
    reproduced; sha256, published and body are done with."""
    again = F.transform("matches", va.criterion_term)
    facts = {
        "year": F.substring("published", 1, 4).cast("int"), "unchanged": F.coalesce(F.sha2("body", 256) == F.col("sha256"), F.lit(False)),
        "reproduced": F.coalesce(again == F.col("terms"), F.lit(False)),
    }
    return statements.withColumns(facts).drop("sha256", "published", "body")


def nested(profiles: DataFrame, components: DataFrame, candidates: DataFrame, advisories: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row a profile: profile, profiles (its rows), components, candidates (arrays, null if there are none)."""
    told = sourced(candidates.join(advisories, "cve", "left").join(assigned, "cve", "left"))
    lists = lambda df, name, columns: df.groupBy("profile").agg(F.collect_list(F.struct(*columns)).alias(name))
    return lists(profiles, "profiles", _HEAD).join(lists(components, "components", _COMPONENT), "profile", "left").join(lists(told, "candidates", _CANDIDATE), "profile", "left")


def _broken(rules: dict[str, Column], item: Column, raised: bool = True) -> Column:
    """Array of (rule, raised, item) of the rules that are broken; a rule whose condition is unknown is."""
    one = lambda name, bad: F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.lit(raised).alias("raised"), F.coalesce(item, F.lit("")).alias("item")))
    return F.array_compact(F.array(*[one(name, bad) for name, bad in rules.items()]))


def judged(whole: DataFrame, limits: Limits = Limits(), heading: str = "Public synthetic system inventory:") -> DataFrame:
    """Nested profiles (nested()) by all rules that one profile decides, without any shuffle: profile, found (array of rule, raised,
    item), and what rules across profiles need: partition, cves, products; n_candidates, n_profiles, n_positive. Written once."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    names = lambda x: F.struct(F.lower(x["vendor"]).alias("vendor"), F.lower(x["product"]).alias("product"))
    each = lambda c: F.struct(F.lower(c["vendor"]).alias("vendor"), F.lower(c["product"]).alias("product"), vs.version_key(c["version"]).alias("key"), reference.padded(c["version"]).alias("at"))
    line = lambda c: F.concat(F.lit("- "), tx.inventory_name(c["style"], c["vendor"], c["product"], c["version"]))
    ready = whole.select(
        "profile", "profiles", "candidates", F.get("profiles", F.lit(0)).alias("head"), F.transform("components", each).alias("held"),
        F.array_join(F.transform(F.array_sort("components"), line), "\n").alias("lines"),
    )

    def decided(c: Column) -> Column:
        # Bounds are only looked at where a name is held.
        near = F.filter(c["terms"], lambda t: F.exists("held", lambda x: _named(names(t), x)))
        hit = lambda keyed: F.exists(keyed, lambda t: F.exists("held", lambda x: _named(t, x) & _within(t, x)))
        return va.let(near, lambda t: F.struct(
            *[c[x].alias(x) for x in ("cve", "year")], F.coalesce(c["assigned"] == F.col("head.partition"), F.lit(False)).alias("own"), c["unchanged"].alias("unchanged"), c["reproduced"].alias("reproduced"),
            F.transform(c["terms"], names).alias("products"), F.coalesce(F.size(t) > 0, F.lit(False)).alias("related"),
            F.coalesce(va.let(F.transform(t, _keyed), hit), F.lit(False)).alias("production"), reference.applies(F.transform(reference.near(c["matches"], F.col("held")), reference.read), F.col("held")).alias("reference"),
            F.when(F.array_contains("head.pair", c["cve"]), F.transform(c["terms"], _keyed)).alias("paired"),
        ))

    known = ready.withColumn("candidates", F.transform("candidates", decided))
    listed = lambda bad: F.array_sort(F.array_compact(F.transform(F.filter("candidates", bad), lambda c: c["cve"])))
    sums = known.withColumns({
        "n": F.nullif(F.array_size("candidates"), F.lit(0)), "n_held": F.nullif(F.array_size("held"), F.lit(0)), "n_distinct": F.array_size(F.array_distinct(F.array_compact(F.transform("candidates", lambda c: c["cve"])))),
        "far": listed(lambda c: ~c["related"]), "checked": listed(lambda c: c["reference"]),
        "paired": F.array_compact(F.transform("candidates", lambda c: c["paired"])), "installed": F.array_distinct(F.transform("held", names)),
    })
    paired = lambda i: F.get("paired", F.lit(i))
    both = lambda p: F.exists(paired(0), lambda t: _named(t, p)) & F.exists(paired(1), lambda t: _named(t, p))
    apart = (F.array_size("paired") == 2) & F.exists("installed", lambda p: both(p) & (_branches(paired(0), p) != _branches(paired(1), p)))
    kept = F.col("n_held").between(*limits.components) & F.col("n").between(*limits.candidates) & (F.array_size("far") / F.col("n") >= limits.distractors)
    told = sums.withColumns({"apart": apart, "kept": kept})
    panel = F.col("head.partition")

    def of_candidate(c: Column) -> Column:
        year = c["year"]
        raised = _broken({
            "candidate_of_another_partition": ~c["own"], "source_differs_from_its_digest": ~c["unchanged"], "terms_do_not_follow_from_the_source": ~c["reproduced"],
            "temporal_before_2025": (panel == "temporal") & (year != 2025), "year_outside_development": ~panel.isin("temporal", "product_heldout") & ~year.isin(2023, 2024),
        }, c["cve"])
        return F.concat(raised, _broken({"decisions_disagree": c["production"] != c["reference"]}, c["cve"], raised=False))

    def of_profile(p: Column) -> Column:
        raised = _broken({
            "candidate_twice": F.col("n") != F.col("n_distinct"),
            "text_differs_from_components": p["text"] != F.concat_ws("\n", F.lit(heading), "lines"),
            "difficulty_contract": ~(F.col("kept") & (F.col("far") == F.array_sort(p["distractors"]))),
            "hard_without_branches": (p["stratum"] == "hard") & ~F.col("apart"),
        }, F.lit(""))
        return F.concat(raised, _broken({"stored_labels_disagree": F.array_sort(p["expected"]) != F.col("checked")}, F.array_join("checked", ","), raised=False))

    kind = "struct<rule:string,raised:boolean,item:string>"
    all_of = lambda column, rules: F.coalesce(F.flatten(F.transform(column, rules)), none(kind))
    used = lambda products, partition: F.transform(products, lambda p: F.struct(partition.alias("partition"), p["vendor"].alias("vendor"), p["product"].alias("product")))
    candidates = used(F.array_distinct(F.flatten(F.filter(F.transform("candidates", lambda c: c["products"]), lambda p: p.isNotNull()))), panel)
    installed = F.flatten(F.transform("profiles", lambda p: used(F.col("installed"), p["partition"])))
    use = "struct<partition:string,vendor:string,product:string>"
    return written(told.select(
        "profile", F.concat(all_of("candidates", of_candidate), all_of("profiles", of_profile), _broken({"profile_twice": F.size("profiles") > 1}, F.lit(""))).alias("found"),
        panel.alias("partition"), F.transform("candidates", lambda c: c["cve"]).alias("cves"), F.array_distinct(F.concat(F.coalesce(candidates, none(use)), F.coalesce(installed, none(use)))).alias("products"),
        F.coalesce("n", F.lit(0)).alias("n_candidates"), F.size("profiles").alias("n_profiles"), F.size(F.filter("profiles", lambda p: F.size(p["expected"]) > 0)).alias("n_positive"),
    ), "judged")


def profile_violations(
    profiles: DataFrame, components: DataFrame, candidates: DataFrame, advisories: DataFrame, assigned: DataFrame, groups: DataFrame, limits: Limits = Limits(), heading: str = "Public synthetic system inventory:"
) -> DataFrame:
    """Ten invariants of a benchmark and its three lists of disagreements and overlaps, as violation rows.

    profiles: profile, partition, stratum, text, expected, distractors, pair (arrays of ids). components: profile, position, vendor,
    product, version, style. candidates: profile, cve, sha256, terms (array of TERM), published. advisories: cve,
    body, matches (array of MATCH). assigned: cve, assigned. groups: vendor, product, product_group."""
    return violations_of(judged(nested(profiles, components, candidates, advisories, assigned), limits, heading), groups)


def violations_of(known: DataFrame, groups: DataFrame) -> DataFrame:
    """Violation rows of judged() profiles, with the rules that go across profiles."""
    own = known.select("profile", F.explode("found").alias("f")).select("f.rule", "f.raised", F.col("profile").cast("string").alias("subject"), "f.item")
    # Dealt by advisory before they are grouped: few repeat within a task, and rows are smaller than sets.
    pools = known.select("partition", F.explode("cves").alias("cve")).repartition("cve").groupBy("cve").agg(F.array_sort(F.collect_set("partition")).alias("in"))
    overlap = violations(pools, {"advisory_in_partitions": F.size("in") > 1}, F.col("cve"), F.array_join("in", ","), raised=False)
    leaked = violations(product_pools(known, groups), {"held_out_group_in_partitions": F.array_contains("in", "product_heldout") & (F.size("in") > 1)}, F.col("product_group"), F.array_join("in", ","), raised=False)
    return union([own, overlap, leaked])


def product_pools(known: DataFrame, groups: DataFrame) -> DataFrame:
    """product_group, in: the partitions whose judged() profiles hold a product of the group, installed or in a candidate."""
    used = known.select(F.explode("products").alias("p")).select("p.*").distinct()
    return used.join(groups, ["vendor", "product"]).groupBy("product_group").agg(F.array_sort(F.collect_set("partition")).alias("in"))


def profile_counts(known: DataFrame, found: DataFrame) -> DataFrame:
    """One row: checked_decisions, profiles, positive_profiles (of judged() profiles), raised, listed, passed."""
    # One row each; found is read once, as it is the whole audit.
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    held = known.agg(total("n_candidates").alias("checked_decisions"), total("n_profiles").alias("profiles"), total("n_positive").alias("positive_profiles"))
    broken = found.agg(F.count_if("raised").alias("raised"), F.count_if(~F.col("raised")).alias("listed"), (F.count(F.lit(1)) == 0).alias("passed"))
    return held.crossJoin(broken)


# --- fixtures ---


def holding(components: Column, advisories: Column) -> Column:
    """Ids of the advisories (id and TERM fields) that hold any of the components (vendor, product, version), within one row; null if there are none of them."""
    have = F.transform(components, lambda c: F.struct(F.lower(c["vendor"]).alias("vendor"), F.lower(c["product"]).alias("product"), c["version"].alias("version")))
    key = lambda x: va.let(vs.version_key(x), lambda k: F.struct(k.alias("key")))

    def holds(a: Column, held: Column) -> Column:
        name = F.struct(F.lower(a["vendor"]).alias("vendor"), F.lower(a["product"]).alias("product"))
        near = F.filter(held, lambda c: F.exists(F.array(name), lambda n: _named(n, c)))
        # Versions and bounds are only looked at where the names are one.
        return va.let(near, lambda m: (F.size(m) > 0) & F.exists(F.array(_keyed(a)), lambda t: F.exists(F.transform(m, lambda c: key(c["version"])), lambda c: _within(t, c))))

    return va.let(have, lambda held: F.transform(F.filter(advisories, lambda a: F.coalesce(holds(a, held), F.lit(False))), lambda a: a["id"]))


def fixture_violations(profiles: DataFrame) -> DataFrame:
    """Fourteen rules of a nested fixture: profile, partition, semantics, components (vendor, product, version),
    advisories (id, product terms as TERM fields), expected (array of ids), as violation rows.

    Labels are computed again within each profile, and an advisory may serve one partition only."""
    known = ("optimization", "validation", "test")
    lists = {c: F.coalesce(c, F.array().cast(dict(profiles.dtypes)[c])) for c in ("components", "advisories", "expected")}
    filled = profiles.withColumns(lists)
    spread = filled.select("profile", "partition", F.explode("advisories").alias("a")).select("profile", "partition", "a.*")
    parts = filled.select("profile", F.explode("components").alias("c")).select("profile", "c.*")
    key = lambda c: vs.version_key(F.col(c))
    odd = lambda c: F.col(c).isNotNull() & key(c).isNull()
    same = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    whole = violations(filled, {
        "semantics": ~F.col("semantics").eqNullSafe(F.lit("v1")),
        "profile_id": ~F.col("profile").rlike("^[a-z0-9_-]+$"),
        "partition": ~F.col("partition").isin(*known),
        "no_inputs": (F.size("components") == 0) | (F.size("advisories") == 0),
        "candidate_twice": same(F.transform("advisories", lambda a: a["id"])),
        "label_twice": same(F.col("expected")),
    }, F.col("profile"))
    of_parts = violations(parts, {"component_version": key("version").isNull()}, F.col("profile"), F.concat_ws(" ", "vendor", "product", "version"))
    ends = [F.col("lower"), F.col("upper")]
    of_advisories = violations(spread, {
        "advisory_id": ~F.col("id").rlike("^CVE-[0-9]{4}-[0-9]{4,}$"),
        "exact_and_range": F.col("exact").isNotNull() & F.coalesce(*ends).isNotNull(),
        "bound_version": odd("exact") | odd("lower") | odd("upper"),
        "inclusivity": F.col("lower_inclusive").isNull() | F.col("upper_inclusive").isNull(),
        "inverted_range": F.coalesce(key("lower") > key("upper"), F.lit(False)),
    }, F.col("profile"), F.col("id"))
    # Dealt by id before they are grouped: rows are smaller than sets.
    split = spread.select("id", "partition").repartition("id").groupBy("id").agg(F.array_sort(F.collect_set("partition")).alias("in"))
    leaks = violations(split, {"advisory_in_partitions": F.size("in") > 1}, F.col("id"), F.array_join("in", ","))
    again = filled.select("profile", "expected", F.array_sort(F.array_distinct(F.array_compact(holding(F.col("components"), F.col("advisories"))))).alias("computed"))
    labels = violations(again, {"labels_disagree": F.array_sort(F.array_distinct("expected")) != F.col("computed")}, F.col("profile"), F.array_join("computed", ","))
    present = filled.where(F.col("partition").isin(*known)).agg(F.count_distinct("partition").alias("n"), F.count(F.lit(1)).alias("rows"))
    all_three = violations(present, {"partition_missing": F.col("n") < len(known)}, F.lit("fixture"))
    return union([repeated(profiles, ["profile"], "profile_twice", "profile"), whole, of_parts, of_advisories, leaks, labels, all_three])


# --- sheets and reviews ---


def sheet_violations(sheet: DataFrame, committed: DataFrame, header: list[str], answers: tuple[str, ...] = ("yes", "no", "unsure")) -> DataFrame:
    """Rules of a returned sheet against the committed one.

    sheet: place (0 is the header), cells (array); its columns are header, then label and note. committed: place, id, sha256 (of the
    cells before the label, by newline). Rows must be the committed ones in their order, with an answer each."""
    names = [*header, "label", "note"]
    head = sheet.where("place = 0").agg(F.count_if(F.col("cells") == F.array(*map(F.lit, names))).alias("good"))
    rows = sheet.where("place > 0").select(
        "place", "cells", F.get("cells", F.lit(0)).alias("id"), F.sha2(F.array_join(F.slice("cells", 1, len(header)), "\n"), 256).alias("own"), F.lower(F.trim(F.get("cells", F.lit(len(header))))).alias("label")
    )
    content = rows.join(committed.select("place", F.col("id").alias("told"), "sha256"), "place", "full_outer")
    return union([
        violations(head, {"header": F.col("good") != 1}, F.lit("sheet")),
        violations(rows, {"cells": F.size("cells") != len(names), "answer": ~F.col("label").isin(*answers)}, F.col("place"), F.col("id")),
        repeated(rows, ["id"], "row_twice", "id"),
        violations(content, {"content": ~(F.col("own") == F.col("sha256"))}, F.col("place"), F.coalesce("id", "told")),
    ])


def review_violations(selected: DataFrame, reviews: DataFrame, quarantine: DataFrame, cohort: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The gate between screening and generation.

    selected, quarantine: cve. reviews: cve, status, rationale. cohort: cve, text (all statements of a record), body, sha256 (of the body as it
    was screened). artifacts: name, body, sha256 (as the manifest has it)."""
    held = quarantine.select("cve", F.lit(True).alias("held")).distinct()
    read = selected.select("cve").distinct().join(reviews, "cve", "left").join(held, "cve", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    missing = F.col("status").isNull()
    flagged = F.size(tx.scope_cues(F.col("text"))) > 0
    free = cohort.join(held, "cve", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return union([
        violations(artifacts, {"artifact_changed": F.sha2("body", 256) != F.col("sha256")}, F.col("name")),
        violations(read, {
            "review_missing": missing,
            "no_disposition": ~missing & ~(F.col("status").isin("corroborated", "quarantined") & (F.coalesce("rationale", F.lit("")) != "")),
            "quarantine_disagrees": ~missing & ((F.col("status") == "quarantined") != F.col("held")),
        }, F.col("cve")),
        violations(free, {"record_changed": F.sha2("body", 256) != F.col("sha256"), "cues_unresolved": ~F.col("held") & F.coalesce(flagged, F.lit(False))}, F.col("cve"), F.array_join(tx.scope_cues(F.col("text")), ",")),
    ])


def approved(cohort: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The records that pass the gate."""
    return cohort.join(quarantine.select("cve").distinct(), "cve", "left_anti")


def prompt_violations(selected: DataFrame, recorded: DataFrame) -> DataFrame:
    """Selections whose prompt is absent from the record, or is not the text that was recorded.

    selected: name, prompt, sha256. recorded: prompt, text."""
    both = selected.join(recorded.select("prompt", F.sha2("text", 256).alias("own"), F.lit(True).alias("there")), "prompt", "left")
    return violations(both, {"prompt_missing": F.col("there").isNull(), "prompt_changed": F.col("there").isNotNull() & ~F.coalesce(F.col("own") == F.col("sha256"), F.lit(False))}, F.col("name"), F.col("prompt"))


def by_prompt(selected: DataFrame) -> DataFrame:
    """sha256, names: who selected the same text."""
    return selected.groupBy("sha256").agg(F.array_sort(F.collect_set("name")).alias("names"))
