"""Connected components with the smallest member as root, and pool assignment on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators.lineage import checkpointed, parted


def stars(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b): every member of a group with the group's least member b, so that its members are connected."""
    placed = parted(rows.select(group, member), rows.count(), group)
    return placed.select(F.col(member).alias("a"), F.min(member).over(Window.partitionBy(group)).alias("b"))


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(node, root): root is the smallest node that is connected with node.

    Each round takes the least label among neighbours and then that label's label, so long chains
    halve; checkpoint() cuts the lineage of every round. rows: how many edges there are, at least about; they are counted without it.

    Edges lie in as many parts as they need, by their end y. Labels, one row a node, are the built side of the hash joins, so that neither the
    edges of a part nor the many nodes of one label are sorted."""
    rows = 2 * (edges.count() if rows is None else rows)
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = checkpointed(parted(ends.union(ends.select("y", "x")), rows, "y").distinct())
    labels = checkpointed(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        seen = labels.select(F.col("node").alias("y"), F.col("root").alias("seen"))
        heard = parted(both, rows, "y").join(seen.hint("shuffle_hash"), "y").groupBy(F.col("x").alias("node")).agg(F.min("seen").alias("seen"))
        via = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("via"))
        further = labels.select(F.col("node").alias("via"), F.col("root").alias("further"))
        step = checkpointed(via.join(further.hint("shuffle_hash"), "via").select("node", "old", F.least("via", "further").alias("root")))
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels
