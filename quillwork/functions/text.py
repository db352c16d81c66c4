"""Names, inventory lines, clauses, keys and text features. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.validation import let

#: Fixed value: the pattern of words that tie a statement to an environment.
CUES = (
    r"\b(?:windows|linux|macos|mac os|android|ios|aarch64|arm(?:64)?|x86|x64|amd64|(?:32|64)[ -]bit|platforms?|architectures?|bindings?|plugins?|modules?|"
    r"configuration|configured|enabled|disabled|optional|settings?|compiled|fips|non[ -]default|kernel|drivers?|requires?|prerequisites?)\b"
)
#: Patterns counted in instructions.
KEYWORD_FAMILIES = {
    "boundary_terms": r"inclusive|exclusive|endpoint|boundar|equal",
    "alias_terms": r"alias|normali[sz]|prefix|suffix|package.?manager|distro",
    "uncertainty_include": r"[^.]*\b(ambiguous|unsure|uncertain|in doubt)\b[^.]*\binclu[^.]*\.",
    "uncertainty_exclude": r"[^.]*\b(ambiguous|unsure|uncertain|in doubt)\b[^.]*\b(exclude|omit)[^.]*\.",
}


def family(name: Column) -> Column:
    """Lower-case letters and digits of a name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"(?U)[\s\-_/@.,]+", "")


def inventory(text: Column) -> Column:
    """Lines of an inventory as (name, version): name@version, else - name version; version null if absent."""
    line = lambda x: F.regexp_replace(F.trim(x), r"^-\s*", "")
    at, last = r"^(.*)@([^@\s]+)$", r"^(.*)\s(\S+)$"

    def parsed(x: Column) -> Column:
        pick = lambda i: F.when(x.rlike(at), F.regexp_extract(x, at, i)).when(x.rlike(last), F.regexp_extract(x, last, i))
        return F.struct(F.coalesce(pick(1), x).alias("name"), pick(2).alias("version"))

    return F.transform(F.filter(F.transform(F.split(text, "\n"), line), lambda x: x != ""), parsed)


#: Vendors whose written name does not follow from their key.
TITLES = {"nozominetworks": "Nozomi Networks"}
INVENTORY_STYLES = ("vendor_stripped", "package_manager", "repo", "title_case", "underscore_to_space")


def inventory_name(style: Column, vendor: Column, product: Column, version: Column) -> Column:
    """A component as an inventory of a style writes it; null for an unknown style."""
    spaced = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    dashed = lambda x: F.replace(x, F.lit("_"), F.lit("-"))
    title = F.initcap(spaced(vendor))
    for key, name in TITLES.items():
        title = F.when(vendor == key, name).otherwise(title)
    named = F.when(F.length(product) <= 4, F.upper(product)).otherwise(F.initcap(spaced(product)))
    return (
        F.when(style == "vendor_stripped", F.concat_ws(" ", product, version))
        .when(style == "package_manager", F.concat(dashed(vendor), F.lit("-"), dashed(product), F.lit(" "), version))
        .when(style == "repo", F.concat(vendor, F.lit("/"), product, F.lit("@"), version))
        .when(style == "title_case", F.concat_ws(" ", title, named, version))
        .when(style == "underscore_to_space", F.concat_ws(" ", spaced(vendor), spaced(product), version))
    )


def clause_conditions(clause: Column) -> Column:
    """Conditions of an OR-free clause as (op, version): '>= 1.2 and < 1.10', or 'versions prior to 4.2'; null if not understood."""
    prior = r"(?:versions? )?(?:prior to|before) ([0-9][0-9.]*[0-9]|[0-9])"
    parts = F.split(clause, " and ")
    one = r"^\s*(>=|<=|>|<|=)\s*(\S+)\s*$"
    good = F.forall(parts, lambda p: p.rlike(one))
    read = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, one, 1).alias("op"), F.regexp_extract(p, one, 2).alias("version")))
    return F.when(good, read).when(clause.rlike(prior), F.array(F.struct(F.lit("<").alias("op"), F.regexp_extract(clause, prior, 1).alias("version"))))


def rendered_clause(vendor: Column, product: Column, exact: Column, lower: Column, upper: Column, lower_inclusive: Column, upper_inclusive: Column) -> Column:
    ends = F.concat_ws(
        " and ",
        F.concat(F.when(lower_inclusive, ">= ").otherwise("> "), lower),
        F.concat(F.when(upper_inclusive, "<= ").otherwise("< "), upper),
    )
    said = F.when(exact.isNotNull(), F.concat(F.lit("version = "), exact)).when(ends == "", "all numeric versions").otherwise(F.concat(F.lit("version "), ends))
    return F.concat(vendor, F.lit("/"), product, F.lit(": "), said)


def scope_cues(text: Column, cues: str = CUES) -> Column:
    """Distinct cues in a text, lower-cased and sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit(cues), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def keyword_counts(text: Column, families: dict[str, str] = KEYWORD_FAMILIES) -> list[Column]:
    return [F.regexp_count(F.lower(text), F.lit(pattern)).cast("long").alias(name) for name, pattern in families.items()]


def rule_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^(?:[-*]|[0-9]+[.)])\s"))).cast("long")


def split_key(key: Column) -> Column:
    """(arm, executor, tier, repetition, stage, panel) of a record key, absent ones empty.

    Executors may hold slashes, so fields are counted from the right, or from the first T<tier>/R<repetition>. Keys:
    main, gepa and reference: arm/executor/T1/R1/stage.../item; sealed: arm/executor/panel/x/item; selection:
    arm/executor/x/item (panel validation); ceiling: arm/executor/panel/item; calibration and scaffolding:
    arm/executor/stage/item; real_record: arm/executor/prompt/item. Other arms have no further fields."""
    parts, empty = F.split(key, "/"), F.lit("")
    arm, n = F.get(parts, F.lit(0)), F.size(F.split(key, "/"))
    joined = lambda first, length: F.array_join(F.slice(parts, first, F.greatest(length, F.lit(0))), "/")
    right = lambda k: F.coalesce(F.get(parts, n - k), empty)
    anchors = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.get(parts, i).rlike("^T[0-9]+$") & F.get(parts, i + 1).startswith("R"))
    at = F.get(anchors, F.lit(0))
    anchored, known = arm.isin("main", "gepa", "reference"), arm.isin("selection", "ceiling", "calibration", "scaffolding", "real_record")
    executor = F.when(anchored, joined(F.lit(2), at - 1)).when(arm == "sealed", joined(F.lit(2), n - 4)).when(known, joined(F.lit(2), n - 3))
    tail = lambda i: F.when(anchored, F.substring(F.get(parts, i), 2, 1_000))
    stage = F.when(anchored, joined(at + 3, n - at - 3)).when(arm.isin("calibration", "scaffolding"), right(2))
    panel = F.when(arm == "sealed", right(3)).when(arm == "selection", "validation").when(arm == "ceiling", right(2)).when(arm == "real_record", "real_record")
    named = {"arm": arm, "executor": executor, "tier": tail(at), "repetition": tail(at + 1), "stage": stage, "panel": panel}
    return F.struct(*[F.coalesce(v, empty).alias(k) for k, v in named.items()])


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def fixed_digits(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", value)


def signed_digits(value: Column, digits: int = 4) -> Column:
    return F.format_string(f"%+.{digits}f", value)


def run_time(name: Column) -> Column:
    """The timestamp in a run name like tag-20240131T235959Z; null if there is none."""
    return F.try_to_timestamp(F.regexp_extract(name, r"([0-9]{8}T[0-9]{6})Z", 1), F.lit("yyyyMMdd'T'HHmmss"))


#: The fields of an entry that are rendered in words; all others are rendered as they are, by name.
_TOLD = ("vendor", "product", "defaultStatus", "versions")
_CHANGE = "struct<at:string,status:string>"
_ENTRY = f"struct<vendor:string,product:string,defaultStatus:string,versions:array<struct<status:string,version:string,lessThan:string,lessThanOrEqual:string,versionType:string,changes:array<{_CHANGE}>>>>"
_RECORD = "struct<containers:struct<cna:struct<affected:array<string>>,adp:array<struct<affected:array<string>>>>>"


def rendered_entry(raw: Column, origin: Column) -> Column:
    """One affected entry (JSON) as a line: status and versions in words, then every other field by name, whatever it is called."""
    some = lambda x: F.coalesce(x, F.lit("None"))
    full = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))

    def version(v: Column) -> Column:
        changes = F.transform(v["changes"], lambda c: F.concat(some(c["status"]), F.lit(" at "), some(c["at"])))
        return F.concat(
            some(v["status"]), F.lit(": "), some(v["version"]),
            F.coalesce(F.concat(F.lit(" up to, not including, "), v["lessThan"]), F.lit("")), F.coalesce(F.concat(F.lit(" up to and including "), v["lessThanOrEqual"]), F.lit("")),
            F.coalesce(F.concat(F.lit(" ("), full(v["versionType"]), F.lit(")")), F.lit("")),
            F.when(F.size(v["changes"]) > 0, F.concat(F.lit("; changes: "), F.array_join(changes, ", "))).otherwise(""),
        )

    def line(read: Column) -> Column:
        entry, every, empty = read["entry"], read["every"], F.array().cast("array<string>")
        others = F.filter(F.sort_array(F.map_keys(every)), lambda k: ~k.isin(*_TOLD) & F.coalesce(~F.element_at(every, k).isin("", "[]", "null"), F.lit(False)))
        value = lambda x: F.coalesce(F.array_join(F.from_json(F.when(x.startswith("["), x), "array<string>"), ", "), x)
        parts = F.concat(
            F.array_compact(F.array(F.concat(F.lit("default status: "), full(entry["defaultStatus"])))),
            F.coalesce(F.transform(entry["versions"], version), empty), F.coalesce(F.transform(others, lambda k: F.concat(k, F.lit(": "), let(F.element_at(every, k), value))), empty),
        )
        named = lambda c: F.coalesce(full(entry[c]), F.lit("n/a"))
        told = let(F.array_join(parts, "; "), lambda x: F.coalesce(full(x), F.lit("no version data")))
        return F.concat(origin, named("vendor"), F.lit(" / "), named("product"), F.lit(": "), told)

    # Read once as its known fields and once as fields of any name, not once a use.
    return let(F.struct(F.from_json(raw, _ENTRY).alias("entry"), F.from_json(raw, "map<string,string>").alias("every")), line)


def rendered_entries(raw: Column) -> Column:
    """The affected entries of a record (JSON), one line each: the producer's own first, then those that others added."""
    empty = F.array().cast("array<string>")

    def lines(read: Column) -> Column:
        own = F.transform(F.coalesce(read["cna"]["affected"], empty), lambda e: rendered_entry(e, F.lit("")))
        added = F.flatten(F.transform(F.coalesce(read["adp"], F.array().cast("array<struct<affected:array<string>>>")), lambda a: F.coalesce(a["affected"], empty)))
        return F.array_join(F.concat(own, F.transform(added, lambda e: rendered_entry(e, F.lit("(ADP enrichment) ")))), "\n")

    return let(F.from_json(raw, _RECORD)["containers"], lines)
