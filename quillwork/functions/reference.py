"""A second reading of match criteria, which shares no code with the first: cross-checks are worth what their independence is.

Versions are compared as padded texts here, by (digit count, digits) there; names are cut at unescaped colons
here, read field by field there. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a segment that a padded text has room for.
WIDTH = 100


def padded(version: Column) -> Column:
    """Segments of a dotted version without trailing zeros, padded to one width; arrays of these order as versions do."""
    return F.transform(F.split(F.regexp_replace(version, r"(?:\.0+)+$", ""), r"\."), lambda s: F.lpad(s, WIDTH, "0"))


def named(criteria: Column) -> Column:
    """(vendor, product, version) of a CPE 2.3 name, lower-cased, without backslashes; version null if any."""
    parts = F.transform(F.slice(F.split(criteria, r"(?<!\\):"), 4, 3), lambda p: F.lower(F.regexp_replace(p, r"\\(.)", "$1")))
    fields = lambda x: F.struct(F.get(x, F.lit(0)).alias("vendor"), F.get(x, F.lit(1)).alias("product"), F.nullif(F.get(x, F.lit(2)), F.lit("*")).alias("version"))
    # The parts are cut once for all three.
    return F.get(F.transform(F.array(parts), fields), F.lit(0))


def read(match: Column) -> Column:
    """A criterion as it is compared: names, exact version and bounds as padded texts."""
    own = named(match["criteria"])
    bounds = ("versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding")
    whole = lambda own: F.struct(own["vendor"].alias("vendor"), own["product"].alias("product"), padded(own["version"]).alias("exact"), *[padded(match[b]).alias(b) for b in bounds])
    return F.get(F.transform(F.array(named(match["criteria"])), whole), F.lit(0))


def near(matches: Column, components: Column) -> Column:
    """The criteria whose names some component (vendor and product in lower case) has: the others hold none, so their bounds need not be read."""
    held = lambda own: F.exists(components, lambda c: (own["vendor"] == c["vendor"]) & (own["product"] == c["product"]))
    return F.filter(matches, lambda m: F.exists(F.array(named(m["criteria"])), held))


def applies(criteria: Column, components: Column) -> Column:
    """Whether any criterion (as read() gives them) of a record holds any component (vendor and product in lower case, at: the padded version)."""

    def holds(m: Column, c: Column) -> Column:
        at = c["at"]
        within = (
            (m["exact"].isNull() | (at == m["exact"])) & (m["versionStartIncluding"].isNull() | (at >= m["versionStartIncluding"])) & (m["versionStartExcluding"].isNull() | (at > m["versionStartExcluding"]))
            & (m["versionEndIncluding"].isNull() | (at <= m["versionEndIncluding"])) & (m["versionEndExcluding"].isNull() | (at < m["versionEndExcluding"]))
        )
        return F.coalesce((m["vendor"] == c["vendor"]) & (m["product"] == c["product"]) & within, F.lit(False))

    return F.coalesce(F.exists(criteria, lambda m: F.exists(components, lambda c: holds(m, c))), F.lit(False))
