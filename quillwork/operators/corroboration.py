"""Corroboration of advisories by their producers' records: structure, product identity, then answers on every probe.

A record's entries are judged by ordered rules; entries resolve to products by the CPE names they list or else by
folded names through alias tables; each product's bounds become probes that meet every stretch between them, and
both sides must give each probe the same answer. Records and advisories are nested rows, as they are published, and meet in one
join on their id; the rules are expressions over the two. The names of the reasons are fixed values of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as tx
from quillwork.functions import validation as va
from quillwork.functions import version as vs

#: Folded producer names and products that stand for others.
VENDOR_ALIASES = {"apachesoftwarefoundation": "apache", "oraclecorporation": "oracle", "sickag": "sick"}
PRODUCT_ALIASES = {
    ("apache", "apachesuperset"): "superset",
    ("apache", "apachecloudstack"): "cloudstack",
    ("apache", "apacheairflowapachehiveprovider"): "apacheairflowprovidersapachehive",
}
VERSION_TYPES = ("semver", "custom")
MOST_ENTRIES = 32

ENTRY = "struct<version:string,lessThan:string,lessThanOrEqual:string,versionType:string,status:string,changes:boolean>"
AFFECTED = f"struct<vendor:string,product:string,cpes:array<string>,defaultStatus:string,constraints:boolean,versions:array<{ENTRY}>>"


def entry_reason(e: Column) -> Column:
    """Why a version entry (ENTRY; changes: it has some) is not taken; null if it is."""
    ends = [e["lessThan"], e["lessThanOrEqual"]]
    upper = F.coalesce(*ends)

    def keyed(k: Column) -> Column:
        start, end = k["start"], k["end"]
        return (
            F.when(~F.coalesce(e["status"] == "affected", F.lit(False)) | F.coalesce(e["changes"], F.lit(False)), "cna_explicit_status_override_or_unknown")
            .when(start.isNull(), "unsupported_numeric_version")
            .when(ends[0].isNotNull() & ends[1].isNotNull(), "cna_conflicting_upper_bounds")
            .when(upper.isNotNull() & ~F.coalesce(e["versionType"].isin(*VERSION_TYPES), F.lit(False)), "cna_unsupported_version_type")
            .when(upper.isNotNull() & (upper != "*") & end.isNull(), "unsupported_numeric_version")
            .when((start > end) | ((start == end) & ends[0].isNotNull()), "cna_empty_or_inverted_range")
        )

    return va.let(F.struct(vs.version_key(e["version"]).alias("start"), vs.version_key(upper).alias("end")), keyed)


def affected_reason(p: Column) -> Column:
    """Why an affected product (AFFECTED; constraints: it names platforms, modules, files or routines) is not taken."""
    first = F.get(F.array_compact(F.transform(p["versions"], entry_reason)), F.lit(0))
    own = (
        F.when(F.coalesce(p["defaultStatus"], F.lit("unknown")) != "unaffected", "cna_unknown_or_nonnegative_default")
        .when(F.coalesce(p["constraints"], F.lit(False)), "cna_additional_platform_or_component_constraints")
        .when(p["versions"].isNull() | (F.size(p["versions"]) == 0) | (F.size(p["versions"]) > MOST_ENTRIES), "cna_missing_or_excessive_versions")
    )
    return F.coalesce(own, first)


def cpe_identity(cpes: Column) -> Column:
    """(reason, pairs) of the CPE names of a product: distinct (vendor, product), lower-cased, if all names are plain."""

    def plain(f: Column) -> Column:
        part = lambda i: F.get(f, F.lit(i))
        literal = lambda x: ~x.contains("*") & ~x.contains("?")
        return (part(0) == "a") & literal(part(1)) & literal(part(2)) & F.forall(F.slice(f, 4, 8), lambda x: x == "*")

    def judged(names: Column) -> Column:
        faults = F.transform(names, lambda x: F.coalesce(x["reason"], F.when(~F.coalesce(plain(x["fields"]), F.lit(False)), "cna_cpe_constraints")))
        pairs = F.array_distinct(F.transform(names, lambda x: F.struct(F.lower(F.get(x["fields"], F.lit(1))).alias("vendor"), F.lower(F.get(x["fields"], F.lit(2))).alias("product"))))
        return va.let(F.get(F.array_compact(faults), F.lit(0)), lambda reason: F.struct(reason.alias("reason"), F.when(reason.isNull(), pairs).alias("pairs")))

    return va.let(F.transform(cpes, lambda c: F.struct(va.cpe_reason(c).alias("reason"), va.cpe_fields(c).alias("fields"))), judged)


def folded(products: Column) -> Column:
    """products (array of vendor, product) with their folded names, for identity(): an array of (pair, vendor, product)."""
    return F.transform(products, lambda x: F.struct(F.struct(x["vendor"].alias("vendor"), x["product"].alias("product")).alias("pair"), tx.family(x["vendor"]).alias("vendor"), tx.family(x["product"]).alias("product")))


def identity(named: Column, own: Column, vendors: dict[str, str] = VENDOR_ALIASES, names: dict[tuple[str, str], str] = PRODUCT_ALIASES) -> Column:
    """(reason, pairs): the products that a name (vendor, product, cpes) is, a sorted array of (vendor, product), null if there are none;
    reason is null if it is resolved. own: folded() products of the advisory, null if there is none.

    CPE names decide if there are any: all must be the advisory's. Else one product of the advisory, no more,
    must have the folded names."""
    some = lambda pairs: F.when(F.size(pairs) > 0, F.array_sort(pairs))

    def by_cpe(cpe: Column) -> Column:
        met = some(F.filter(cpe["pairs"], lambda x: F.exists(own, lambda o: F.coalesce(o["pair"] == x, F.lit(False)))))
        reason = lambda pairs: F.coalesce(cpe["reason"], F.when(F.coalesce(F.size(pairs), F.lit(0)) < F.size(cpe["pairs"]), "cna_cpe_product_mismatch"))
        return va.let(met, lambda pairs: F.struct(reason(pairs).alias("reason"), pairs.alias("pairs")))

    def by_name(key: Column) -> Column:
        met = some(F.transform(F.filter(own, lambda o: F.coalesce((o["vendor"] == key["vendor"]) & (o["product"] == key["product"]), F.lit(False))), lambda o: o["pair"]))
        absent = key["vendor"].isNull() | key["product"].isNull()
        reason = lambda pairs: F.when(absent, "cna_missing_product_identity").when(F.coalesce(F.size(pairs), F.lit(0)) != 1, "cna_product_identity_not_confirmed")
        return va.let(met, lambda pairs: F.struct(reason(pairs).alias("reason"), pairs.alias("pairs")))

    def aliased(x: Column) -> Column:
        vendor = F.coalesce(F.create_map(*[F.lit(x) for pair in vendors.items() for x in pair])[x["vendor"]], x["vendor"]) if vendors else x["vendor"]
        return F.struct(vendor.alias("vendor"), x["product"].alias("product"))

    def respelt(x: Column) -> Column:
        spelt = F.create_map(*[x for (a, b), c in names.items() for x in (F.lit(f"{a}/{b}"), F.lit(c))])[F.concat_ws("/", x["vendor"], x["product"])] if names else F.lit(None)
        return F.struct(x["vendor"].alias("vendor"), F.coalesce(spelt, x["product"]).alias("product"))

    key = F.struct(tx.family(named["vendor"]).alias("vendor"), tx.family(named["product"]).alias("product"))
    told = va.let(va.let(va.let(key, aliased), respelt), by_name)
    return F.when(F.size(named["cpes"]) > 0, va.let(cpe_identity(named["cpes"]), by_cpe)).otherwise(told)


def resolved(named: DataFrame, products: DataFrame, vendors: dict[str, str] = VENDOR_ALIASES, names: dict[tuple[str, str], str] = PRODUCT_ALIASES) -> DataFrame:
    """named with the products that they are: pairs (array of vendor, product) and identity_reason (null if resolved).

    named: cve, row (its number in the record), vendor, product, cpes. products: cve, vendor, product (those of the advisory, lower-cased)."""
    own = products.groupBy("cve").agg(F.collect_set(F.struct("vendor", "product")).alias("_own")).withColumn("_own", folded(F.col("_own")))
    found = named.join(own, "cve", "left").withColumn("_found", identity(F.struct("vendor", "product", "cpes"), F.col("_own"), vendors, names))
    return found.withColumns({"pairs": F.col("_found.pairs"), "identity_reason": F.col("_found.reason")}).drop("_own", "_found")


BOUNDS = ("exact", "lower", "upper", "lower_inclusive", "upper_inclusive")


def corroborate(records: DataFrame, terms: DataFrame) -> DataFrame:
    """cve, reason (null if corroborated), probes (how many were answered alike): one row per record.

    records: cve, kind, state, told (the id that the record gives itself), affected (array of AFFECTED). terms: cve, vendor, product, exact, lower, upper,
    lower_inclusive, upper_inclusive. The first rule that fails decides, products in the record's order; answers are compared where no other rule has failed."""
    head = (
        F.when(~(F.col("kind").eqNullSafe(F.lit("CVE_RECORD")) & F.col("told").eqNullSafe(F.col("cve")) & F.col("state").eqNullSafe(F.lit("PUBLISHED"))), "cna_identity_or_publication_state")
        .when(F.col("affected").isNull() | (F.size("affected") == 0), "cna_missing_affected")
    )
    lower = terms.withColumns({c: F.lower(c) for c in ("vendor", "product")})
    advisories = lower.groupBy("cve").agg(F.collect_set(F.struct("vendor", "product", *BOUNDS)).alias("terms"))
    products = F.array_distinct(F.transform("terms", lambda t: F.struct(t["vendor"].alias("vendor"), t["product"].alias("product"))))
    met = records.select("cve", head.alias("head"), F.when(head.isNull(), F.col("affected")).alias("affected")).join(advisories.withColumn("own", folded(products)), "cve", "left")

    def judged(a: Column) -> Column:
        # Identity is asked of a product that is sound in itself.
        known = va.let(identity(a, F.col("own")), lambda x: F.struct(x["reason"].alias("reason"), F.when(x["reason"].isNull(), x["pairs"]).alias("pairs"), a["versions"].alias("entries")))
        fault = lambda own: F.struct(own.alias("reason"), F.lit(None).cast("array<struct<vendor:string,product:string>>").alias("pairs"), F.lit(None).cast(f"array<{ENTRY}>").alias("entries"))
        return va.let(affected_reason(a), lambda own: F.when(own.isNotNull(), fault(own)).otherwise(known))

    rows = met.select("cve", "head", "terms", F.size("own").alias("products"), F.transform("affected", judged).alias("rows"))
    # Products with their rows, sorted: one that an earlier row of the record has already puts the later row at fault.
    scopes = F.array_sort(F.flatten(F.transform("rows", lambda r, i: F.coalesce(F.transform(r["pairs"], lambda x: F.struct(x.alias("pair"), i.alias("row"))), F.array().cast("array<struct<pair:struct<vendor:string,product:string>,row:int>>")))))
    again = va.let(scopes, lambda s: F.array_min(F.transform(s, lambda x, i: F.when(F.get(s, i - 1)["pair"] == x["pair"], x["row"]))))
    fault = F.array_min(F.transform("rows", lambda r, i: F.when(r["reason"].isNotNull(), i)))
    found = rows.withColumns({"again": again, "fault": fault, "covered": F.aggregate("rows", F.lit(0), lambda n, r: n + F.coalesce(F.size(r["pairs"]), F.lit(0)))})
    ruled = F.coalesce(
        "head", F.when(F.col("again") < F.coalesce("fault", F.size("rows")), "cna_duplicate_product_scopes"), F.get("rows", F.col("fault"))["reason"],
        F.when(F.col("covered") < F.col("products"), "cna_incomplete_product_coverage"),
    )
    same = lambda t, x: F.coalesce((t["vendor"] == x["vendor"]) & (t["product"] == x["product"]), F.lit(False))
    answered = F.flatten(F.transform("rows", lambda r: F.transform(r["pairs"], lambda x: answers(r["entries"], F.filter("terms", lambda t: same(t, x))))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("agree"))
    total = F.aggregate(answered, none, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["agree"] + x["agree"]).alias("agree")))
    asked = found.withColumn("ruled", ruled).select("cve", "ruled", F.when(F.col("ruled").isNull(), total).alias("x"))
    reason = F.coalesce("ruled", F.when(F.col("x.agree") < F.col("x.n"), "nvd_cna_numeric_predicate_disagreement"))
    return asked.select("cve", reason.alias("reason"), F.when(reason.isNull(), F.col("x.n")).otherwise(0).alias("probes"))


def answers(entries: Column, terms: Column) -> Column:
    """(n, agree) of a product: its probes, and those on which the producer's status and the terms agree.

    entries: array of ENTRY. terms: array with BOUNDS. A probe that two entries hold, or that is neither affected nor unaffected, does not agree."""
    star = lambda x: F.nullif(x, F.lit("*"))
    key = vs.version_key
    upper = lambda e: F.coalesce(e["lessThan"], e["lessThanOrEqual"])

    def keyed(terms: Column) -> Column:
        # Keys once an entry, term and probe.
        ends = F.flatten(F.transform(terms, lambda t: F.array(t["exact"], t["lower"], t["upper"])))
        told = F.flatten(F.transform(entries, lambda e: F.array(e["version"], star(e["lessThan"]), star(e["lessThanOrEqual"]))))
        kept_terms = F.transform(terms, lambda t: F.struct(*[key(t[c]).alias(c) for c in ("exact", "lower", "upper")], t["lower_inclusive"].alias("lower_inclusive"), t["upper_inclusive"].alias("upper_inclusive")))
        kept_entries = F.transform(entries, lambda e: F.struct(
            key(e["version"]).alias("start"), key(upper(e)).alias("end"), upper(e).isNull().alias("alone"), (upper(e) == "*").alias("open"), e["lessThanOrEqual"].isNotNull().alias("closed"), e["status"].alias("status"),
        ))
        return F.struct(kept_terms.alias("t"), kept_entries.alias("e"), F.transform(va.probes(F.concat(ends, told)), key).alias("at"))

    def compared(x: Column) -> Column:
        return F.struct(F.size(x["at"]).cast("long").alias("n"), F.size(F.filter(x["at"], lambda at: agrees(at, x["t"], x["e"]))).cast("long").alias("agree"))

    return va.let(va.let(terms, keyed), compared)


def agrees(at: Column, terms: Column, entries: Column) -> Column:
    """Whether keyed terms and entries answer the probe with key at alike."""
    below = lambda e: e["open"] | F.coalesce(at < e["end"], F.lit(False)) | F.coalesce(e["closed"] & (at == e["end"]), F.lit(False))
    within = lambda e: F.coalesce(F.when(e["alone"], at == e["start"]).otherwise((at >= e["start"]) & below(e)), F.lit(False))
    status = lambda hits: F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["status"]).when(F.size(hits) == 0, "unaffected")
    applies = F.exists(terms, lambda t: F.coalesce(vs.in_range(at, t["exact"], t["lower"], t["upper"], t["lower_inclusive"], t["upper_inclusive"]), F.lit(False)))
    told = va.let(F.filter(entries, within), status)
    return va.let(told, lambda x: F.coalesce(x.isin("affected", "unaffected") & (applies == (x == "affected")), F.lit(False)))


def statuses(components: DataFrame, scopes: DataFrame, candidates: DataFrame) -> DataFrame:
    """profile, cve, statuses (one per component, in order), applicable (any is affected).

    components: profile, position, vendor, product, version. candidates: profile, cve. A component that the record does not
    name is unrelated_product; two entries that hold it are overlapping."""
    named = components.withColumns({c: F.lower(c) for c in ("vendor", "product")})
    pairs = candidates.join(named, "profile").join(scopes, ["cve", "vendor", "product"], "left")
    found = va.status_for(F.col("entries"), F.lit("unaffected"), F.col("version"))
    told = F.when(F.col("entries").isNull(), "unrelated_product").otherwise(F.coalesce(found["status"], F.lit("overlapping")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "vendor", "product", "version", told.alias("status")))), lambda x: x["status"])
    return pairs.groupBy("profile", "cve").agg(listed.alias("statuses")).withColumn("applicable", F.array_contains("statuses", "affected"))


def prose_bounds(terms: DataFrame, descriptions: DataFrame) -> DataFrame:
    """cve, phrase: a phrase that says in words what an advisory's only term says: versions before an excluded upper end, and no lower end but 0.

    descriptions: cve, place, text (English ones). The first phrase in order with no denial within the 24 characters before it."""
    single = terms.groupBy("cve").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("exact", "lower", "upper", "lower_inclusive", "upper_inclusive")).alias("t")).where("n = 1").select("cve", "t.*")
    zero = F.col("lower").isNull() | ((vs.version_key(F.col("lower")) == vs.version_key(F.lit("0"))) & F.col("lower_inclusive"))
    spoken = single.where(F.col("exact").isNull() & F.col("upper").isNotNull() & ~F.coalesce("upper_inclusive", F.lit(False)) & zero).select("cve", "upper")
    said = F.regexp_replace("upper", r"\.", r"\\.")
    words = F.concat(F.lit(r"(?i)\b(?:before|prior to|earlier than|below)\s+(?:version\s+)?v?"), said, F.lit(r"(?![\d.])"))
    # Every phrase with up to 24 characters before it, by the texts between the phrases.
    found = descriptions.join(spoken, "cve").withColumn("words", words).withColumn("phrases", F.regexp_extract_all("text", F.col("words"), F.lit(0))).where("size(phrases) > 0")
    return _first_plain(found)


#: Words that deny what follows, and how near they must stand.
DENIALS, DENIAL_WINDOW = r"(?i)\b(?:not|unaffected|fixed)\b", 24


def _first_plain(found: DataFrame) -> DataFrame:
    """cve, phrase from cve, place, text, words, phrases: offsets are the lengths of the parts between phrases."""
    parts = F.split("text", F.col("words"))

    def walk(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(parts, i))
        phrase = F.get("phrases", i)
        return F.struct((start + F.length(phrase)).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size("phrases") - 1), none, walk)["starts"]
    spread = found.withColumn("starts", starts).select("cve", "place", "text", F.posexplode("phrases").alias("i", "phrase"), "starts").withColumn("start", F.get("starts", F.col("i")))
    first = F.greatest(F.col("start") - DENIAL_WINDOW, F.lit(0))
    before = F.substring("text", first + 1, F.col("start") - first)
    plain = spread.where(~before.rlike(DENIALS))
    return plain.groupBy("cve").agg(F.min_by("phrase", F.struct("place", "start")).alias("phrase"))


def token_sets(name: Column) -> Column:
    """The token sets of a list of names cut at commas: sorted distinct lower-case words, firmware left out; empty if there is one name only."""
    words = lambda x: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")))
    return F.when(F.size(F.split(name, ",")) > 1, F.array_distinct(F.transform(F.split(name, ","), words))).otherwise(F.array().cast("array<array<string>>"))


def unsplit_lists(components: DataFrame, rows: DataFrame) -> DataFrame:
    """Components whose product is one of several that a record names in one field: distinct profile, cve, product, version.

    components: profile, vendor, product, version. rows: cve, vendor, product (maybe a list), entries, status (default). A component's token
    set must equal one of the list's, the vendors share a word, and the row must hold the version. The join is on the sets, one row a
    name of a list: an inverted index, no comparison of all pairs."""
    sets = rows.select("cve", "entries", "status", F.col("vendor").alias("told"), F.explode(token_sets(F.col("product"))).alias("key")).where("size(key) > 0")
    words = lambda x: F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    own = F.array_sort(F.array_distinct(F.filter(words(F.col("product")), lambda w: w != "firmware")))
    asked = components.select("profile", "vendor", "product", "version", own.alias("key")).where("size(key) > 0").distinct()
    met = asked.join(sets, "key").where(F.arrays_overlap(words(F.col("vendor")), words(F.col("told"))))
    hit = va.status_for(F.col("entries"), F.col("status"), F.col("version"))["status"] == "affected"
    return met.where(F.coalesce(hit, F.lit(False))).select("profile", "cve", "product", "version").distinct()
