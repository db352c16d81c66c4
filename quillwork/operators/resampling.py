"""Bootstrap intervals with draws from digests, so that any engine gives the same replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.hashing import draw
from quillwork.functions.score import T_975, f1
from quillwork.operators.lineage import checkpointed, dealt
from quillwork.operators.ordered import placed


def replicates(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """rows times replicate 0..n-1. n is a parameter, not data. Rows are dealt over all partitions first, as adaptive execution
    would leave the short rows in one task, which then makes n times as many."""
    return dealt(rows).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("seed", F.lit(seed))


def ends(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The 2.5 % ends of a bootstrap: ranks int(.025 R) + 1 and int(.975 R) of the sorted replicates."""
    s = F.array_sort(F.collect_list(value))
    n = F.size(s)
    return values.groupBy(*by).agg(
        F.round(F.get(s, F.floor(n * 0.025).cast("int")), 6).alias("low"), F.round(F.get(s, F.floor(n * 0.975).cast("int") - 1), 6).alias("high")
    )


def mean_interval(deltas: DataFrame, by: list[str], unit: str, value: str, n: int, seed: str) -> DataFrame:
    """by, low, high: resample the units of each group with replacement and take the mean."""
    w = Window.partitionBy(*by).orderBy(unit)
    numbered = deltas.withColumn("i", F.row_number().over(w) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    drawn = replicates(numbered, n, seed).withColumn("pick", draw(F.col("of"), F.col("seed"), F.col("replicate"), F.col("i")))
    source = numbered.select(*by, F.col("i").alias("pick"), F.col(value).alias("v"))
    means = drawn.join(source.hint("merge"), [*by, "pick"]).groupBy(*by, "replicate").agg(F.avg("v").alias("mean"))
    return ends(means, by, "mean")


def weights(units: DataFrame, unit: str, n: int, seed: str, name: str) -> DataFrame:
    """(replicate, unit, weight): how often each unit is drawn in each replicate."""
    numbered = checkpointed(placed(units.select(unit).distinct(), [F.col(unit)], "i"))
    total = numbered.count()
    drawn = replicates(numbered.select("i"), n, seed).withColumn("pick", draw(total, F.col("seed"), F.col("replicate"), F.col("i")))
    counted = drawn.groupBy("replicate", "pick").agg(F.count(F.lit(1)).alias(name))
    # The sides of these joins are as many as the units: they are merged, as adaptive execution would send compressed ones to the driver.
    return counted.join(numbered.withColumnRenamed("i", "pick").hint("merge"), "pick").select("replicate", unit, name)


def pigeonhole(cells: DataFrame, a: str, b: str, n: int, seed: str) -> DataFrame:
    """low, high of the pooled F1 when both sides of a cell are resampled: a cell counts by the product of its weights."""
    wa, wb = weights(cells, a, n, f"{seed}a", "wa"), weights(cells, b, n, f"{seed}b", "wb")
    summed = cells.groupBy(a, b).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = lambda c: F.sum(F.col("wa") * F.col("wb") * F.col(c))
    each = summed.join(wa.hint("merge"), a).join(wb.hint("merge"), [b, "replicate"]).groupBy("replicate").agg(f1(s("tp"), s("fp"), s("fn")).alias("f1"))
    return ends(each, [], "f1")


def joint(cells: DataFrame, unit: str, side: str, left, right, n: int, seed: str) -> DataFrame:
    """low, high of F1(left) - F1(right) when units are resampled once for both sides."""
    w = weights(cells, unit, n, seed, "w")
    summed = cells.groupBy(unit, side).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = lambda c, v: F.sum(F.when(F.col(side) == v, F.col("w") * F.col(c)).otherwise(0))
    score = lambda v: f1(s("tp", v), s("fp", v), s("fn", v))
    return ends(summed.join(w.hint("merge"), unit).groupBy("replicate").agg((score(left) - score(right)).alias("delta")), [], "delta")


def t_interval(deltas: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd, low, high by Student's t, for 2 to 12 units; null ends beyond."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    t = F.element_at(F.array(*map(F.lit, T_975)), F.when(n.between(2, 12), n - 1).otherwise(1).cast("int"))
    half = F.when(n.between(2, 12), t * sd / F.sqrt(n.cast("double")))
    r = lambda c, name: F.round(c, 6).alias(name)
    return deltas.groupBy(*by).agg(n.alias("n"), r(mean, "mean"), r(sd, "sd"), r(mean - half, "low"), r(mean + half, "high"))


def nested_weights(cells: DataFrame, system: str, sub: str, cell: str, n: int, seed: str) -> DataFrame:
    """replicate, system, sub, cell, weight: systems are drawn, sub-profiles within every draw of a system, and cells within every
    draw of a sub-profile. Two draws of one system take sub-profiles of their own, so the stages are draws of draws; what
    is counted at the end is how often each cell came out."""
    numbered = lambda rows, by, unit, i, of: rows.withColumn(i, F.row_number().over(Window.partitionBy(*by).orderBy(unit)) - 1).withColumn(of, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    systems = checkpointed(placed(cells.select(system).distinct(), [F.col(system)], "g"))
    total = systems.count()
    subs = numbered(cells.select(system, sub).distinct(), [system], sub, "s", "of_s")
    held = numbered(cells.select(system, sub, cell).distinct(), [system, sub], cell, "c", "of_c")
    first = replicates(systems.select(F.col("g").alias("i")), n, seed).withColumn("g", draw(total, F.col("seed"), F.col("replicate"), F.col("i")))
    # (replicate, i) is one draw of a system; i and j one of a sub-profile.
    drawn = first.join(systems.hint("merge"), "g").select("replicate", "seed", "i", system)
    second = drawn.join(subs.select(system, F.col("s").alias("j"), "of_s").hint("merge"), system).withColumn("s", draw(F.col("of_s"), F.col("seed"), F.col("replicate"), F.col("i"), F.col("j")))
    chosen = second.join(subs.select(system, sub, "s").hint("merge"), [system, "s"]).select("replicate", "seed", "i", "j", system, sub)
    third = chosen.join(held.select(system, sub, F.col("c").alias("k"), "of_c").hint("merge"), [system, sub]).withColumn("c", draw(F.col("of_c"), F.col("seed"), F.col("replicate"), F.col("i"), F.col("j"), F.col("k")))
    counted = third.groupBy("replicate", system, sub, "c").agg(F.count(F.lit(1)).alias("weight"))
    return counted.join(held.select(system, sub, cell, "c").hint("merge"), [system, sub, "c"]).select("replicate", system, sub, cell, "weight")


def three_stage(cells: DataFrame, system: str, sub: str, cell: str, n: int, seed: str) -> DataFrame:
    """low, high of the pooled F1 when systems, their sub-profiles and the cells of these are resampled."""
    summed = cells.groupBy(system, sub, cell).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = lambda c: F.sum(F.col("weight") * F.col(c))
    weighted = nested_weights(summed, system, sub, cell, n, seed).join(summed.hint("merge"), [system, sub, cell])
    return ends(weighted.groupBy("replicate").agg(f1(s("tp"), s("fp"), s("fn")).alias("f1")), [], "f1")
