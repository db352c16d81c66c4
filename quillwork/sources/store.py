"""Stores of verified records: what does not fit its digest, count or reference stops the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.sources import readers


def _sure(df: DataFrame, condition: str, message: str) -> DataFrame:
    """df, whose computation fails at the first row that does not meet the condition."""
    return df.where(F.assert_true(F.coalesce(F.expr(condition), F.lit(False)), F.concat(F.lit(message), F.lit(": "), F.coalesce(F.col("file"), F.lit("?")))).isNull())


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and the payload's columns of a folder or glob of checksummed envelopes; a wrong digest is an error."""
    rows = _sure(readers.envelopes(spark, path), "intact", "digest differs")
    return rows.select("file", F.from_json("payload", schema, {"mode": "FAILFAST"}).alias("p")).select("file", "p.*")


def put(df: DataFrame, path: str) -> bool:
    """Write a table once: True if it was written, False if the same rows are there; other rows are an error."""
    from pyspark.errors import AnalysisException

    try:
        there = df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return True
    if there.exceptAll(df).isEmpty() and df.exceptAll(there).isEmpty():
        return False
    raise ValueError(f"{path} holds other rows")


MANIFEST = "file string, sha256 string, rows bigint"


def verified_lines(spark: SparkSession, folder: str, manifest: DataFrame, schema: str) -> DataFrame:
    """file and columns of the JSON-lines files that a manifest (file, sha256, rows) names. Digests and row counts are checked
    before any row is given out; files beside the manifest are not read. A file is at most 2 GB, as its digest is
    taken at once; larger tables are many files."""
    name = F.element_at(F.split("path", "/"), -1)
    names = [r.file for r in manifest.select("file").collect()]
    paths = [f"{folder}/{f}" for f in names]
    if not paths:
        return spark.createDataFrame([], f"file string, {schema}")
    found = readers.digests(spark, paths).select(name.alias("file"), F.col("sha256").alias("own"))
    lines = readers.jsonl(spark, paths, schema).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "*")
    counted = lines.groupBy("file").agg(F.count(F.lit(1)).alias("own_rows"))
    wrong = manifest.join(found, "file", "left").join(counted, "file", "left").where("not (own <=> sha256) or coalesce(own_rows, 0) <> rows")
    bad = wrong.select("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file} differs from the manifest")
    return lines


def restored(profiles: DataFrame, advisories: DataFrame, key: str = "profile_id", listed: str = "advisories", ref: str = "id") -> DataFrame:
    """profiles whose advisory ids are replaced by the advisories, in their order; an id without advisory is an error.

    A join per id, so neither side is gathered in one place. Advisories are unique by ref."""
    spread = profiles.select(key, F.posexplode(listed).alias("pos", ref))
    full = spread.join(advisories.withColumn("_known", F.lit(True)), ref, "left")
    sure = full.where(F.assert_true(F.coalesce("_known", F.lit(False)), F.concat(F.lit("no advisory "), F.col(ref))).isNull())
    whole = sure.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*advisories.columns).alias("a")))).alias("x"))
    held = whole.select(F.col(key).alias("_key"), F.col("x.a").alias("_held"))
    none = F.array().cast(T.ArrayType(advisories.schema))
    return profiles.join(held, F.col(key) == F.col("_key"), "left").withColumn(listed, F.coalesce("_held", none)).drop("_key", "_held")


def panel(cells: DataFrame, count: int, unique: list[str]) -> DataFrame:
    """The cells of a panel, which must be so many and unique; its stated size is part of its identity."""
    seen = cells.agg(F.count(F.lit(1)).alias("n")).first().n
    again = cells.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if seen != count or not again.isEmpty():
        raise ValueError(f"a panel of {seen} cells, of which {count} unique ones are stated")
    return cells
