"""Validation of source records: product names, match criteria, advisories, producer entries. All are native expressions.

The names of the reasons are fixed values of the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions import version as vs

#: A backslash and the ASCII sign behind it, and the characters that stand for themselves, in a CPE 2.3 name.
_ESCAPED = r"\\[\x00-\x7F&&[^A-Za-z0-9\s\x1c-\x1f*?]]"
_PLAIN = r"[A-Za-z0-9_.\-*?:]"
_FIELDS = r"(?s)((?:\\.|[^:\\])*+):"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x computed once: inside lambdas Spark shares no common expressions."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _cpe(name: Column) -> Column:
    """(reason, fields) of a name: why it is no CPE 2.3 name of 13 parts, or its 11 fields without backslashes."""
    read = F.struct(
        F.regexp_replace(name, rf"(?s)^(?:{_ESCAPED}|{_PLAIN})*+", "").alias("rest"), F.regexp_extract_all(F.concat(name, F.lit(":")), F.lit(_FIELDS), F.lit(1)).alias("parts")
    )

    def judged(x: Column) -> Column:
        shape = (F.size(x["parts"]) == 13) & (F.get(x["parts"], F.lit(0)) == "cpe") & (F.get(x["parts"], F.lit(1)) == "2.3")
        reason = (
            F.when(name.isNull() | (F.length(name) > 2048) | (x["rest"] == "\\"), "invalid_cpe").when(x["rest"].startswith("\\"), "unsupported_cpe_escape")
            .when(x["rest"] != "", "invalid_cpe_character").when(~shape, "invalid_cpe")
        )
        return F.struct(reason.alias("reason"), F.transform(F.slice(x["parts"], 3, 11), lambda f: F.regexp_replace(f, r"(?s)\\(.)", "$1")).alias("fields"))

    return let(read, judged)


def cpe_reason(name: Column) -> Column:
    """Why a name is no CPE 2.3 name of 13 parts; null if it is one. The first fault in reading order decides."""
    return _cpe(name)["reason"]


def cpe_fields(name: Column) -> Column:
    """The 11 fields behind cpe:2.3:, without their backslashes; null for what is no such name."""
    return let(_cpe(name), lambda x: F.when(x["reason"].isNull(), x["fields"]))


MATCH = "struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>"


def criterion_reason(match: Column) -> Column:
    """Why a match criterion has no label under the rules; null if it has one. The first rule that fails decides.

    An open end is null. Versions are compared by their order keys."""
    lows, highs = [match["versionStartIncluding"], match["versionStartExcluding"]], [match["versionEndIncluding"], match["versionEndExcluding"]]
    vague = lambda x: (x == "") | (x == "-") | x.contains("*") | x.contains("?")
    closed = lows[0].isNotNull() & highs[0].isNotNull()

    def named(x: Column) -> Column:
        part, vendor, product, exact = (F.get(x["fields"], F.lit(i)) for i in range(4))
        own = (
            F.when(x["reason"].isNotNull(), x["reason"]).when(part != "a", "nonapplication_cpe").when(vague(vendor) | vague(product), "nonliteral_product")
            .when(F.exists(F.slice(x["fields"], 5, 7), lambda f: f != "*"), "additional_cpe_constraints")
            .when((lows[0].isNotNull() & lows[1].isNotNull()) | (highs[0].isNotNull() & highs[1].isNotNull()), "conflicting_range_endpoints")
        )
        ends = F.struct(F.coalesce(*lows).alias("low"), F.coalesce(*highs).alias("high"), F.when(exact != "*", exact).alias("exact"))
        return F.coalesce(own, let(ends, lambda e: let(F.struct(e.alias("v"), *[vs.version_key(e[k]).alias(k) for k in ("low", "high", "exact")]), bounded)))

    def bounded(k: Column) -> Column:
        v = k["v"]
        odd = lambda c: v[c].isNotNull() & k[c].isNull()
        return (
            F.when(odd("low") | odd("high"), "unsupported_numeric_version").when(v["exact"].isNotNull() & (v["low"].isNotNull() | v["high"].isNotNull()), "exact_plus_range")
            .when(odd("exact"), "unsupported_numeric_version").when((k["low"] > k["high"]) | ((k["low"] == k["high"]) & ~closed), "empty_or_inverted_range")
        )

    return F.coalesce(F.when(~F.coalesce(match["vulnerable"], F.lit(False)), "nonvulnerable_or_prerequisite"), let(_cpe(match["criteria"]), named))


def criterion_term(match: Column) -> Column:
    """The normalised term of an accepted criterion; null for a rejected one."""

    def term(fields: Column) -> Column:
        exact = F.get(fields, F.lit(3))
        return F.struct(
            F.lower(F.get(fields, F.lit(1))).alias("vendor"), F.lower(F.get(fields, F.lit(2))).alias("product"), F.when(exact != "*", exact).alias("exact"),
            F.coalesce(match["versionStartIncluding"], match["versionStartExcluding"]).alias("lower"), F.coalesce(match["versionEndIncluding"], match["versionEndExcluding"]).alias("upper"),
            match["versionStartIncluding"].isNotNull().alias("lower_inclusive"), match["versionEndIncluding"].isNotNull().alias("upper_inclusive"),
        )

    return F.when(criterion_reason(match).isNull(), let(cpe_fields(match["criteria"]), term))


NODE = f"struct<operator:string,negate:boolean,nested:boolean,cpeMatch:array<{MATCH}>>"
ADVISORY = (
    "struct<id:string,vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,published:string,lastModified:string,"
    f"configurations:array<struct<operator:string,negate:boolean,flat:boolean,nodes:array<{NODE}>>>>"
)


def english(descriptions: Column) -> Column:
    """The first English description, or an empty text."""
    return F.coalesce(F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit(""))


def advisory_reason(a: Column, most: Column | int = 16) -> Column:
    """Why an advisory is not taken; null if it is. Rules are tried in order; within the configurations the first
    fault in reading order decides.

    most: how many terms are held to be too many beyond (null: any number is taken). flat: a configuration that holds matches or children itself; nested: a node that holds children or nodes."""
    absent = lambda x: x.isNull() | (F.size(x) == 0)
    no = lambda x: F.coalesce(x, F.lit(False))

    def node(n: Column) -> Column:
        own = (
            F.when((F.coalesce(n["operator"], F.lit("")) != "OR") | no(n["negate"]), "non_or_or_negated_node")
            .when(no(n["nested"]), "nested_nodes").when(absent(n["cpeMatch"]), "missing_cpe_matches")
        )
        return F.concat(F.array(own), F.coalesce(F.transform(n["cpeMatch"], criterion_reason), F.array().cast("array<string>")))

    def configuration(c: Column) -> Column:
        own = (
            F.when(no(c["flat"]), "unsupported_configuration_layout").when(absent(c["nodes"]), "missing_nodes")
            .when(no(c["negate"]) | (F.coalesce(c["operator"], F.lit("OR")) != "OR"), "non_or_or_negated_configuration")
            .when(c["operator"].isNull() & (F.size(c["nodes"]) != 1), "implicit_operator_multiple_nodes")
        )
        return F.concat(F.array(own), F.coalesce(F.flatten(F.transform(c["nodes"], node)), F.array().cast("array<string>")))

    inside = F.get(F.array_compact(F.flatten(F.transform(a["configurations"], configuration))), F.lit(0))
    terms = F.size(F.flatten(F.flatten(F.transform(a["configurations"], lambda c: F.transform(c["nodes"], lambda n: n["cpeMatch"])))))
    text = english(a["descriptions"])
    before = (
        F.when(~F.coalesce(a["id"].rlike("^CVE-[0-9]{4}-[0-9]{4,}$"), F.lit(False)), "invalid_cve_id")
        .when(a["vulnStatus"].isin("Rejected", "Deferred"), "rejected_or_deferred")
        .when(F.trim(text) == "", "missing_english_description")
        .when(F.length(text) > 4000, "description_over_4000_characters")
        .when(absent(a["configurations"]), "missing_configurations")
    )
    undated = (F.coalesce(a["published"], F.lit("")) == "") | (F.coalesce(a["lastModified"], F.lit("")) == "")
    return F.coalesce(before, inside, F.when(terms > most, "more_than_16_or_terms").when(undated, "missing_source_dates"))


def entry_matches(entry: Column, version: Column) -> Column:
    """Whether a producer's entry (version, lessThan, lessThanOrEqual) holds a version: that version alone if it has
    no upper end, else from it to the end; * is no end."""
    upper, key = F.coalesce(entry["lessThan"], entry["lessThanOrEqual"]), vs.version_key(version)
    start, end = vs.version_key(entry["version"]), vs.version_key(F.coalesce(entry["lessThan"], entry["lessThanOrEqual"]))
    below = (upper == "*") | F.coalesce(key < end, F.lit(False)) | F.coalesce(entry["lessThanOrEqual"].isNotNull() & (key == end), F.lit(False))
    return F.coalesce(F.when(upper.isNull(), key == start).otherwise((key >= start) & below), F.lit(False))


def status_for(entries: Column, default: Column, version: Column) -> Column:
    """(status, reason): the status of the one entry that holds a version, else the default or unknown; two entries are a fault."""
    held = F.filter(entries, lambda e: entry_matches(e, version))
    status = F.when(F.size(held) == 1, F.get(held, F.lit(0))["status"]).when(F.coalesce(F.size(held), F.lit(0)) < 1, F.coalesce(default, F.lit("unknown")))
    return F.struct(status.alias("status"), F.when(F.size(held) > 1, "cna_overlapping_version_entries").alias("reason"))


def probes(bounds: Column) -> Column:
    """Versions that meet every stretch between bounds: 0 and each bound, one inside every gap, one behind the last.

    bounds: array of strict versions; those of equal order are one."""
    keyed = lambda v: F.struct(vs.version_key(v).alias("key"), F.regexp_replace(v, r"(\.0)+$", "").alias("v"))
    ordered = F.array_sort(F.array_distinct(F.transform(F.concat(F.array(F.lit("0")), F.array_compact(bounds)), keyed)))

    def listed(ordered: Column) -> Column:
        def behind(x: Column, i: Column) -> Column:
            gap = F.size(F.get(ordered, i + 1)["key"]) - F.size(x["key"])
            return F.concat(x["v"], F.repeat(F.lit(".0"), F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0))), F.lit(".1"))

        return F.concat(F.transform(ordered, lambda x: x["v"]), F.transform(ordered, behind))

    return let(ordered, listed)


def corroborated(term: Column, entries: Column, default: Column) -> Column:
    """Whether a term and a producer's entries give every probe the same answer."""
    keys = [vs.version_key(term[c]) for c in ("exact", "lower", "upper")]
    ends = F.transform(entries, lambda e: F.array(e["version"], F.nullif(e["lessThan"], F.lit("*")), F.nullif(e["lessThanOrEqual"], F.lit("*"))))
    points = probes(F.concat(F.array(term["exact"], term["lower"], term["upper"]), F.flatten(ends)))
    agree = lambda p: vs.in_range(vs.version_key(p), *keys, term["lower_inclusive"], term["upper_inclusive"]) == (status_for(entries, default, p)["status"] == "affected")
    return F.forall(points, lambda p: F.coalesce(agree(p), F.lit(False)))


#: What stands for no version, and words that make a version text a range.
NO_VERSION = ("", "n/a", "unspecified", "0", "*")
RANGE_WORDS = r"through|thru|before|prior|\bto\b|[<>≤]"


def denies(verdict: Column, status: Column, entries: Column) -> Column:
    """Whether a producer's row excludes a version: decided so, or undecided beside a default of unaffected and exact affected
    versions alone. A range in words is no exact version."""
    written = lambda e: F.coalesce(e["version"], F.lit(""))
    exact = lambda e: (
        (e["status"] == "affected") & e["lessThan"].isNull() & e["lessThanOrEqual"].isNull()
        & ~F.lower(F.trim(written(e))).isin(*NO_VERSION) & ~written(e).rlike(RANGE_WORDS)
    )
    listed = F.coalesce(F.size(entries) > 0, F.lit(False)) & F.coalesce(F.forall(entries, lambda e: F.coalesce(exact(e), F.lit(False))), F.lit(False))
    return F.coalesce(~verdict, (status == "unaffected") & listed, F.lit(False))


def wrong_product(component: Column, vendor: Column, product: Column, pairs: list[tuple[str, str]], vendors: dict[str, list[str]]) -> Column:
    """Whether a component was matched with a product that only looks like it: pairs of component and product prefix; for some
    components only under the named vendors."""
    bad = F.lit(False)
    for name, prefix in pairs:
        under = F.lower(F.coalesce(vendor, F.lit(""))).isin(vendors[name]) if name in vendors else F.lit(True)
        bad = bad | ((component == name) & F.coalesce(product, F.lit("")).startswith(prefix) & under)
    return bad
