"""Aggregations over scores, measures and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import contracts
from quillwork.functions.score import CATEGORIES, metrics
from quillwork.operators import ordered as od


def by_stratum(rows: DataFrame, panel: str, stratum: str) -> DataFrame:
    """Metrics of each panel as a whole (null stratum) and of each of its strata, in one pass."""
    return rows.groupingSets([[F.col(panel)], [F.col(panel), F.col(stratum)]], F.col(panel), F.col(stratum)).agg(*metrics())


def category_counts(rows: DataFrame, by: list[str], categories: str = "categories") -> DataFrame:
    """Count of every category, zeros included: one conditional count each, no join."""
    spread = rows.select(*by, F.explode(categories).alias("c"))
    return spread.groupBy(*by).agg(*[F.count_if(F.col("c") == c).alias(c) for c in CATEGORIES])


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """known, missing, total (null if any is missing), known_total, mean_known, p90 (nearest rank). Groups may be of any size: the rank
    is looked up among placed rows, so no task holds a group's values."""
    x = F.col(value)
    sums = rows.groupBy(*by).agg(
        F.count(x).alias("known"), F.count_if(x.isNull()).alias("missing"),
        F.round(F.when(F.count_if(x.isNull()) == 0, F.sum(x)), 6).alias("total"), F.round(F.sum(x), 6).alias("known_total"), F.round(F.avg(x), 6).alias("mean_known"),
    )
    return sums.join(od.at_ranks(rows.where(x.isNotNull()), by, value, {"p90": F.ceil(F.col("_n") * 0.9) - 1}), by, "left")


def medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by and the median of a value, of groups of any size."""
    ends = od.at_ranks(rows.where(F.col(value).isNotNull()), by, value, {"_low": F.expr("(_n - 1) div 2"), "_high": F.expr("_n div 2")})
    return ends.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def floor_rank(share: float) -> Column:
    """0-based rank max(1, floor(share n)) - 1, for at_ranks."""
    return F.greatest(F.floor(F.col("_n") * share), F.lit(1)) - 1


def clamped_rank(share: float) -> Column:
    """0-based rank int(share n), the last at most, for at_ranks."""
    return F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)


def macro_f1(cells: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Mean F1 over the units that have any truth, beside pooled F2, precision and recall."""
    from quillwork.functions.score import f1, f2, ratio

    per = cells.groupBy(*by, unit).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    c = lambda n: F.col(n)
    s = lambda n: F.sum(n)
    r = lambda x, name: F.round(x, 6).alias(name)
    own = F.when(c("tp") + c("fn") > 0, f1(c("tp"), c("fp"), c("fn")))
    return per.groupBy(*by).agg(
        r(F.avg(own), "macro_f1"), F.count(own).alias("units"), r(f2(s("tp"), s("fp"), s("fn")), "f2"),
        r(ratio(s("tp"), s("tp") + s("fp")), "precision"), r(ratio(s("tp"), s("tp") + s("fn")), "recall"),
    )


def costs(cells: DataFrame, by: list[str], ratios: tuple[int, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """Expected cost (k fn + fp) / n for each ratio k: sums once, then one row per ratio."""
    sums = cells.groupBy(*by).agg(F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    spread = sums.withColumn("k", F.explode(F.array(*map(F.lit, ratios))))
    return spread.select(*by, "k", F.round((F.col("k") * F.col("fn") + F.col("fp")) / F.col("n"), 6).alias("cost"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two annotators; null where chance agreement is complete."""
    table = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ma, mb = table.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("na")), table.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, "v").agg(F.sum(F.col("na") * F.col("nb")).alias("same")).withColumn("one", F.lit(1))
    seen = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed")).withColumn("one", F.lit(1))
    po, pe = F.col("agreed") / F.col("n"), F.coalesce("same", F.lit(0)) / (F.col("n") * F.col("n"))
    return seen.join(chance, "one").select(F.col("n").cast("long").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def ledger(attempts: DataFrame) -> DataFrame:
    """One row per provider: attempts, known cost and reservations still open, as decimals.

    attempts: request, provider, cost (decimal, null while unknown), reserved. The same request in
    several records is one attempt; its known cost takes the place of its reservation."""
    once = attempts.groupBy("request", "provider").agg(F.max("cost").alias("cost"), F.max("reserved").alias("reserved"))
    return once.groupBy("provider").agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("reserved"))), F.lit(0)).alias("reserved"),
    )


def weighted_share(strata: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """by, strata, estimate, low, high: the share of a population from shares of its strata, by weight.

    strata: by, weight, k, n (one row each). The ends are the weighted ends of the strata's exact limits at
    alpha over their number, so that all of them hold together."""
    sized = strata.join(strata.groupBy(*by).agg(F.count(F.lit(1)).alias("strata"), F.sum("weight").alias("total")), by)
    limits = sized.withColumn("x", contracts.exact_limits(F.col("k"), F.col("n"), F.lit(alpha) / F.col("strata")))
    part = lambda value: F.sum(F.col("weight") / F.col("total") * value)
    r = lambda c, name: F.round(c, 6).alias(name)
    return limits.groupBy(*by).agg(F.max("strata").alias("strata"), r(part(F.col("k") / F.col("n")), "estimate"), r(part(F.col("x.low")), "low"), r(part(F.col("x.high")), "high"))


def worker_timing(items: DataFrame) -> DataFrame:
    """scope, name, optimizer_s, executor_s, model_load_s, optimizer_calls: worker seconds by phase (the first part of a key), and of the main phase by
    trajectory (the next four) and role (a last part that begins with proposal is the optimizer's).

    items: key, worker_seconds, model_load_seconds. Both scopes come from one pass; sums are of decimals, so no order of rows changes them."""
    parts = F.split("key", "/")
    proposal = F.element_at(parts, -1).startswith("proposal")
    rows = items.select(
        F.get(parts, F.lit(0)).alias("phase"), F.when(F.get(parts, F.lit(0)) == "main", F.array_join(F.slice(parts, 2, 4), "/")).alias("trajectory"), proposal.alias("proposal"),
        F.col("worker_seconds").cast("decimal(18,6)").alias("s"), F.col("model_load_seconds").cast("decimal(18,6)").alias("load"),
    )
    both = rows.groupingSets([[F.col("phase")], [F.col("trajectory")]], F.col("phase"), F.col("trajectory")).agg(
        F.grouping("phase").alias("by_trajectory"), F.sum(F.when(F.col("proposal"), F.col("s")).otherwise(0)).alias("optimizer_s"),
        F.sum(F.when(F.col("proposal"), 0).otherwise(F.col("s"))).alias("executor_s"), F.sum("load").alias("model_load_s"), F.count_if("proposal").alias("optimizer_calls"),
    )
    named = both.where("by_trajectory = 0 or trajectory is not null")
    r = lambda c: F.round(c, 3).cast("double").alias(c)
    return named.select(F.when(F.col("by_trajectory") == 0, "phase").otherwise("trajectory").alias("scope"), F.coalesce("trajectory", "phase").alias("name"), r("optimizer_s"), r("executor_s"), r("model_load_s"), "optimizer_calls")
