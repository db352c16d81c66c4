"""Sources: line-split JSON, checksummed envelopes, tolerant unwrapping, string CSV, feeds, metadata."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions import text as tx
from quillwork.functions.contracts import canonical, strict_json


def jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON records split at \\n alone: other line separators inside strings are data. A bad line is an error."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


@F.pandas_udf(T.StringType())
def envelope_payload(raw: pd.Series) -> pd.Series:
    """The canonical payload of {payload, sha256}; null if the digest does not fit."""

    def one(x: str | None) -> str | None:
        try:
            value = strict_json(x)
            payload = canonical(value["payload"])
            return payload if set(value) == {"payload", "sha256"} and hashlib.sha256(payload.encode()).hexdigest() == value["sha256"] else None
        except (ValueError, TypeError, KeyError, RecursionError):
            return None

    return raw.map(one)


def envelopes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, payload, intact) of a folder or glob of JSON envelopes, one record a file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", envelope_payload("value").alias("payload")).withColumn("intact", F.col("payload").isNotNull())


SCORE = "struct<profile_id:string,prediction:array<string>,valid:boolean>"


def evaluations(spark: SparkSession, root: str, sections: list[str], arm: str = "sealed", panel: str = "test") -> DataFrame:
    """section, place (of the section in the list), executor, prompt, item, row (SCORE): the evaluations of an arm and panel below
    {root}/{section}/evaluations, one envelope a file. A damaged envelope ends the read."""
    read = envelopes(spark, [f"{root}/{s}/evaluations" for s in sections])
    whole = read.where(F.when(F.col("intact"), True).otherwise(F.raise_error(F.concat(F.lit("a damaged envelope: "), F.col("file"))).cast("boolean")))
    told = whole.select("file", F.from_json("payload", f"struct<key:string,prompt_sha256:string,row:{SCORE}>").alias("p")).withColumn("k", tx.split_key(F.col("p.key")))
    section = F.regexp_extract("file", r"/([^/]+)/evaluations/[^/]*$", 1)
    kept = told.where((F.col("k.arm") == arm) & (F.col("k.panel") == panel))
    return kept.select(section.alias("section"), (F.array_position(F.array(*map(F.lit, sections)), section) - 1).alias("place"), "k.executor", F.col("p.prompt_sha256").alias("prompt"), F.element_at(F.split("p.key", "/"), -1).alias("item"), "p.row")


def once_scored(rows: DataFrame) -> DataFrame:
    """executor, prompt, item, row, same: the first section's row of each evaluation; same is false if another section scored it otherwise."""
    verdict = F.to_json(F.struct(F.col("row.prediction").alias("p"), F.col("row.valid").alias("v")))
    return rows.groupBy("executor", "prompt", "item").agg(F.min_by("row", "place").alias("row"), (F.min(verdict) == F.max(verdict)).alias("same"))


def unwrapped(raw: Column) -> Column:
    """The payload of an envelope, or the record itself if it is bare."""
    return F.coalesce(F.get_json_object(raw, "$.payload"), raw)


def strings_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all values as text; the header must be the given columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)


def feed(spark: SparkSession, path: str, item_schema: str, total: str = "totalResults", items: str = "vulnerabilities") -> DataFrame:
    """Records of (gzip) feeds {total, items: [...]}; a feed whose count is wrong stops the query."""
    whole = spark.read.schema(f"{total} bigint, {items} array<{item_schema}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = whole.withColumn("ok", F.assert_true(F.col(total) == F.size(items), F.lit("feed count differs")))
    return checked.where(F.col("ok").isNull()).select(F.explode(items).alias("item"))


def metadata(raw: Column) -> Column:
    """key:value lines as a map; a repeated key stops the query (the map's own rule)."""
    return F.str_to_map(F.regexp_replace(F.regexp_replace(raw, "\r", ""), "\n+$", ""), F.lit("\n"), F.lit(":"))


def digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length, sha256) of files as they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def partitioned(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame:
    """A table laid out by partition; only the named partitions are read."""
    return spark.read.parquet(path).where(F.col("partition").isin(partitions))
