"""A corpus pipeline over documents: quality rules, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of docs. Between stages the rows are written as Parquet and read again, so a lost executor
never costs more than one stage.

Rows are matched with their decisions by (doc_id, hash of the text), null ids included: ids may
repeat. Every stage takes an empty table, null and very long texts and extra columns of any name, which stand in
one struct while rows are matched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from quillwork.llm._shared import cut, drop_scratch, scratch_mark, table, text_of

def _keep(docs: DataFrame, decisions: DataFrame, once: bool) -> DataFrame:
    """The rows of docs that decisions (doc_id, text_key, kept) keep; of repeated rows one, if once."""
    by_key = cut(decisions.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "decisions")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text_of()).alias("own_text"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_text") == F.col("text_key"))
    rest = rows.join(by_key.where("not kept"), same, "left_anti")
    again = by_key.where("kept and n > 1")
    if once and not again.isEmpty():
        # Combined before the shuffle, so a row that is repeated without end costs one row a task.
        first = rest.join(again, same, "left_semi").groupBy("own_id", "own_text").agg(F.first("row").alias("row"))
        rest = rest.join(again, same, "left_anti").select("row").unionByName(first.select("row"))
    return rest.select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject and takes the boilerplate lines out of the rest. A row's
    host is part of its verdict, so one text under two hosts and one id stays if either host keeps it."""
    verdicts = cut(quality_rules.quality(docs), "verdicts")
    return quality_rules.cleaned(_keep(docs, verdicts.withColumnRenamed("sig", "text_key"), once=False), verdicts)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return _keep(docs, exact_dedup.exact_duplicates(docs), once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates."""
    return _keep(docs, near_dedup.near_duplicates(docs), once=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind; null texts stay null, n_chars follows the text."""
    weights = pii.trained()

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else pii.redacted(t, weights))

    text = F.pandas_udf(clean, "string")(F.col("text"))
    cleaned = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(kind))
    return cleaned.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; returns the pieces."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("personal_data", personal_data), ("packed", packed)]

#: Packing and the trained field are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(mark, keep_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
