"""Joins of inventories with version ranges, and the other joins of the evaluation data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import text as tx
from quillwork.functions import version as vs
from quillwork.operators.ordered import ranged


def applicability(components: DataFrame, terms: DataFrame) -> DataFrame:
    """(profile, cve, applies) for every pair that shares a vendor and product: any component in any range.

    components: profile, part, vendor, product, version. terms: cve, vendor, product, exact, lower,
    upper, lower_inclusive, upper_inclusive. The join is on names, so it stays a hash or sort-merge
    join with the range as residual; repeated components are combined before it."""
    have = components.where("part = 'a'").select(
        "profile", F.lower("vendor").alias("v"), F.lower("product").alias("p"), vs.version_key(F.col("version")).alias("key")
    ).distinct()
    want = terms.select(
        "cve", F.lower("vendor").alias("v"), F.lower("product").alias("p"), "lower_inclusive", "upper_inclusive",
        *[vs.version_key(F.col(c)).alias(c) for c in ("exact", "lower", "upper")],
    )
    hit = vs.in_range(*[F.col(c) for c in ("key", "exact", "lower", "upper", "lower_inclusive", "upper_inclusive")])
    return have.join(want, ["v", "p"]).groupBy("profile", "cve").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("applies"))


def applicability_of(asked: DataFrame, components: DataFrame, terms: DataFrame) -> DataFrame:
    """(profile, cve, applies) for the asked pairs (profile, cve) whose names meet: as applicability(), but only the components of a pair's own
    profile meet the terms of its own cve, so the work grows with the pairs and not with all records of a name."""
    have = components.where("part = 'a'").select("profile", F.lower("vendor").alias("v"), F.lower("product").alias("p"), vs.version_key(F.col("version")).alias("key"))
    want = terms.select(
        "cve", F.lower("vendor").alias("v"), F.lower("product").alias("p"), "lower_inclusive", "upper_inclusive",
        *[vs.version_key(F.col(c)).alias(c) for c in ("exact", "lower", "upper")],
    )
    hit = vs.in_range(*[F.col(c) for c in ("key", "exact", "lower", "upper", "lower_inclusive", "upper_inclusive")])
    met = asked.select("profile", "cve").distinct().join(want, "cve").join(have, ["profile", "v", "p"])
    return met.groupBy("profile", "cve").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("applies"))


def named_either_way(items: DataFrame, clauses: DataFrame) -> DataFrame:
    """Items (profile, name, version) with clauses (cve, vendor, product, conditions) whose product, or
    vendor and product, has the item's normalised name.

    The disjunction becomes one row per spelling, so the join keeps an equality key."""
    spelt = clauses.select(
        "*", F.explode(F.array_distinct(F.array(tx.normalised_name(F.concat("vendor", "product")), tx.normalised_name(F.col("product"))))).alias("key")
    )
    return items.withColumn("key", tx.normalised_name(F.col("name"))).join(spelt, "key")


def clause_verdict(version: Column, conditions: Column) -> Column:
    """Three-valued verdict of a version on conditions (op, version): unknown if any version is unsupported."""
    sign = lambda c: vs.compare(version, c["version"])

    def one(c: Column) -> Column:
        s = sign(c)
        return (
            F.when(c["op"] == ">=", s >= 0).when(c["op"] == "<=", s <= 0).when(c["op"] == ">", s > 0).when(c["op"] == "<", s < 0).when(c["op"] == "=", s == 0)
        )

    return F.when(conditions.isNull(), F.lit(None).cast("boolean")).otherwise(vs.all_conditions(F.transform(conditions, one)))


def distractors(available: DataFrame, held: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of available without any, and with some, partner in held."""
    keys = held.select(*on).distinct()
    return available.join(keys, on, "left_anti"), available.join(keys, on, "left_semi")


def branch_pairs(branches: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) of one product with other signatures and other, non-empty branches.

    branches: product, id, signature, branches (array). An equality join within the product."""
    side = lambda n: branches.where(F.size("branches") > 0).select("product", *[F.col(c).alias(f"{c}_{n}") for c in ("id", "signature", "branches")])
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("signature_a") != F.col("signature_b")) & (F.col("branches_a") != F.col("branches_b"))
    return side("a").join(side("b"), "product").where(apart).select("product", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def paired(rows: DataFrame, on: list[str], tier: str, left, right, value: str) -> DataFrame:
    """on, delta: the value at one tier minus the value at another, where both exist."""
    a = rows.where(F.col(tier) == left).select(*on, F.col(value).alias("left_value"))
    b = rows.where(F.col(tier) == right).select(*on, F.col(value).alias("right_value"))
    return a.join(b, on).withColumn("delta", F.col("left_value") - F.col("right_value"))


def pareto(rows: DataFrame, up: str, down: str) -> DataFrame:
    """Rows that no other row beats on one measure without losing on the other.

    Only the best value of up per value of down can dominate, so a running maximum over the distinct
    values of down decides, in place of comparing all pairs; it runs within ranges of down, with the highest
    value of the ranges before carried in."""
    best = ranged(rows.groupBy(down).agg(F.max(up).alias("_best")), [F.col(down)])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = best.groupBy("_part").agg(F.max("_best").alias("_most")).select("_part", F.max("_most").over(earlier).alias("_carry"))
    before = F.max("_best").over(Window.partitionBy("_part").orderBy(down).rowsBetween(Window.unboundedPreceding, -1))
    walked = best.join(F.broadcast(carried), "_part").withColumn("_before", F.greatest(before, "_carry")).drop("_part", "_carry")
    kept = rows.join(walked, down).where((F.col(up) == F.col("_best")) & (F.col("_before").isNull() | (F.col(up) > F.col("_before"))))
    return kept.drop("_best", "_before")
