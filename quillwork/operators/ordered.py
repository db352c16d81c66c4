"""Ordered operators: first-wins choices, interleaving, batches, lags, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators.lineage import checkpointed


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def argmax_first(rows: DataFrame, by: list[str], value: str, place: str, keep: list[str]) -> DataFrame:
    """Per group the row of the highest value; of ties the first by place. An aggregate, not a sort."""
    best = F.max_by(F.struct(*keep), F.struct(F.col(value), -F.col(place))).alias("_best")
    return rows.groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}").alias(c) for c in keep])


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _part, the number of the range of the order that they are in; written, so that it stays what it is."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in an order of all rows. Rows are numbered within ranges, and ranges by their
    sizes (one row each), so no task sees more than its range."""
    parts = ranged(rows, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + own - 1).drop("_part", "_start")


def placed_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "turn") -> DataFrame:
    """rows with their place, from 0, within their group; a group may be of any size. Groups are few enough to be joined."""
    all_rows = checkpointed(placed(rows, [*map(F.col, by), *order], "_place"))
    first = all_rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return all_rows.join(first, same).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first", *[f"_{c}" for c in by])


def interleaved(rows: DataFrame, bucket: list[str], order: list[Column], batch: int) -> DataFrame:
    """place and batch after taking one row of each bucket in turn, in bucket order, until all are used."""
    numbered = placed(placed_within(rows, bucket, order), [F.col("turn"), *map(F.col, bucket)])
    return numbered.withColumn("batch", F.expr(f"place div {batch}"))


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by and, for each name, the value at a 0-based rank that is given as an expression of the group's size _n."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # A frequent value is spread over ranges by row number; which of equal values has which place does not matter.
    spread = rows.select(*by, value, F.xxhash64(F.monotonically_increasing_id()).alias("_tie"))
    numbered = placed_within(spread, by, [F.col(value), F.col("_tie")]).join(sizes, by)
    return numbered.groupBy(*by).agg(*[F.max(F.when(F.col("turn") == rank, F.col(value))).alias(name) for name, rank in ranks.items()])


def chained(frames: DataFrame, by: list[str], sequence: str, digest: str, previous: str) -> DataFrame:
    """The frames that break the chain: a gap in the sequence, or a previous digest that is not the one before."""
    w = Window.partitionBy(*by).orderBy(sequence)
    seen = frames.withColumn("_d", F.lag(digest).over(w)).withColumn("_n", F.row_number().over(w) - 1)
    return seen.where((F.col(sequence) != F.col("_n")) | ~F.col(previous).eqNullSafe(F.col("_d"))).drop("_d", "_n")


def energy(frames: DataFrame, sensor: str, at: str, power: str, sequence: str, most_gap: float) -> DataFrame:
    """Per sensor: energy by the trapezium rule over adjacent frames no further apart than most_gap
    seconds, the time they cover, and their number. A null power, or a missing frame, breaks a pair."""
    w = Window.partitionBy(sensor).orderBy(sequence)
    gap = F.col(at) - F.lag(at).over(w)
    pairs = frames.withColumn("_gap", gap).withColumn("_p", F.lag(power).over(w)).withColumn("_s", F.lag(sequence).over(w))
    ok = (F.col("_s") == F.col(sequence) - 1) & F.col(power).isNotNull() & F.col("_p").isNotNull() & (F.col("_gap") > 0) & (F.col("_gap") <= most_gap)
    return pairs.groupBy(sensor).agg(
        F.round(F.coalesce(F.sum(F.when(ok, (F.col(power) + F.col("_p")) / 2 * F.col("_gap"))), F.lit(0.0)), 3).alias("joules"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("_gap"))), F.lit(0.0)), 3).alias("covered_s"),
        F.count_if(ok).alias("pairs"),
        F.max(power).alias("peak"),
    )
