"""Dotted numeric versions: order keys, comparison, range predicates. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments without leading zeros, ASCII digits only.
STRICT = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"
LENIENT = r"^[0-9]+(\.[0-9]+)*$"
MOST_CHARS = 100


def _key(trimmed: Column) -> Column:
    # (digits, text) orders unbounded integers without a cast.
    return F.transform(F.split(trimmed, r"\."), lambda s: F.struct(F.length(s).alias("n"), s.alias("d")))


def version_key(version: Column) -> Column:
    """Order key of a strict version; null if unsupported. Trailing zero segments do not count."""
    ok = version.rlike(STRICT) & (F.length(version) <= MOST_CHARS)
    return F.when(ok, _key(F.regexp_replace(version, r"(\.0)+$", "")))


def lenient_key(version: Column) -> Column:
    """Order key that also takes leading zeros and any length."""
    plain = F.regexp_replace(version, r"(^|\.)0+(?=[0-9])", "$1")
    return F.when(version.rlike(LENIENT), _key(F.regexp_replace(plain, r"(\.0+)+$", "")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either version is unsupported."""
    ka, kb = version_key(a), version_key(b)
    return F.when(ka < kb, -1).when(ka > kb, 1).when(ka == kb, 0)


def in_range(version: Column, exact: Column, lower: Column, upper: Column, lower_inclusive: Column, upper_inclusive: Column) -> Column:
    """Whether a version key lies in a range of keys; absent ends are open. Null for an unsupported version."""
    low = lower.isNull() | (version > lower) | (lower_inclusive & (version == lower))
    high = upper.isNull() | (version < upper) | (upper_inclusive & (version == upper))
    return F.when(version.isNull(), F.lit(None).cast("boolean")).when(exact.isNotNull(), version == exact).otherwise(low & high)


def on_inclusive_bound(version: Column, lower: Column, upper: Column, lower_inclusive: Column, upper_inclusive: Column) -> Column:
    return F.coalesce((lower_inclusive & (version == lower)) | (upper_inclusive & (version == upper)), F.lit(False))


def position(version: Column, lower: Column, upper: Column, lower_inclusive: Column, upper_inclusive: Column) -> Column:
    """Place relative to the bounds: the first bound that equals or excludes decides, else the side of the first."""
    on = lambda inclusive: F.when(inclusive, "on_inclusive").otherwise("on_exclusive")
    return (
        F.when(version == lower, on(lower_inclusive))
        .when(version < lower, "below")
        .when(version == upper, on(upper_inclusive))
        .when(version > upper, "above")
        .when(lower.isNotNull(), "above")
        .when(upper.isNotNull(), "below")
    )


def all_conditions(verdicts: Column) -> Column:
    """Conjunction that is null as soon as any part is null, even beside a false one."""
    return F.when(F.exists(verdicts, lambda v: v.isNull()), F.lit(None).cast("boolean")).otherwise(F.forall(verdicts, lambda v: v))


def any_verdict(verdict: Column) -> Column:
    """Aggregate disjunction in three-valued logic: true, else unknown if any is, else false."""
    return F.when(F.bool_or(verdict), True).when(F.count_if(verdict.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(False)


def near_misses(lower: Column, upper: Column) -> Column:
    """Probe versions around two bounds, as an array of (kind, version)."""

    def bumped(v: Column, by: int) -> Column:
        head, last = F.regexp_extract(v, r"^(.*\.)?([0-9]+)$", 1), F.regexp_extract(v, r"([0-9]+)$", 1)
        return F.concat(head, (last.cast("long") + by).cast("string"))

    last = lambda v: F.regexp_extract(v, r"([0-9]+)$", 1).cast("long")
    probes = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), value.alias("version"))
            for name, v in (("lower", lower), ("upper", upper))
            for kind, value in (
                (f"on_{name}", v), (f"{name}_plus", bumped(v, 1)), (f"{name}_minus", F.when(last(v) > 0, bumped(v, -1))),
                (f"{name}_zero", F.concat(v, F.lit(".0"))), (f"{name}_one", F.concat(v, F.lit(".1"))), (f"{name}_trap", F.concat(v, F.lit("0"))),
            )
        ]
    )
    return F.filter(probes, lambda p: p["version"].isNotNull())
