"""Quality rules: base text measures and cross-document line frequency.

Lines are normalised (white space collapsed, lower case) and hashed; per host (the source of a
document) the distinct documents holding a line are counted, copies of one text counting once.
A line is boilerplate when at least MIN_DOCS documents and at least 1 in MIN_SHARE documents of
its host hold it. Boilerplate lines are removed, and a document left with less than three tenths of
its words is depleted and rejected.

Only DataFrame functions run here. Per row, the scan keeps measures and line hashes only; all
counting combines before its shuffles, and no host, line or document is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import SPACE, cut, row_ids, table, text_of

MIN_WORDS = 50
MIN_DOCS = 5
MIN_SHARE = 50
KEEP_TENTHS = 3


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " ")))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """row_id, doc_id, host, sig, the base measures and lines (array of hash and word count), written once.

    n_repeat_words: the 3-word windows are sorted by hash, the starts of those equal to a neighbour
    kept, and the union of these windows added up."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), text_of(text_col).alias("t"))
    words = text.withColumn("words", F.array_remove(F.split("t", f"[{SPACE}]+"), "")).withColumn("n_words", F.size("words").cast("long"))
    hashed = words.withColumn(
        "h",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.slice("words", F.lit(1), (F.col("n_words") - 2).cast("int")),
                lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    placed = hashed.withColumn(
        "p",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    starts = placed.withColumn(
        "s",
        F.sort_array(
            F.filter(
                F.transform(
                    "p",
                    lambda x, k: F.when(
                        x["h"].eqNullSafe(F.get("p", k - 1)["h"]) | x["h"].eqNullSafe(F.get("p", k + 1)["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    lines = starts.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    return cut(
        row_ids(
            lines,
            F.col("doc_id"),
            F.col("host"),
            F.xxhash64("t").alias("sig"),
            F.col("n_words"),
            F.char_length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            F.aggregate(
                F.transform("s", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("s", k + 1) - i, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ).alias("n_repeat_words"),
            F.transform(
                F.transform("l", _normal), lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))
            ).alias("lines"),
        ),
        "measures",
    )


def boilerplate(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: int = MIN_SHARE) -> DataFrame:
    """(host, line) of the lines above the limits."""
    per_line = (
        rows.select("host", "sig", F.explode(F.array_distinct("lines.line")).alias("line"))
        .groupBy("host", "line", "sig")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= min_docs)
    )
    per_host = rows.groupBy("host", "sig").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return per_line.join(per_host, "host").where(F.col("docs") * min_share >= F.col("host_docs")).select("host", "line")


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    min_share: int = MIN_SHARE,
) -> DataFrame:
    """One row per row of docs: row_id, doc_id, the measures, base_failed, removed_words, kept;
    host and removed_lines (hashes of its lines above the limits, null if none) are for cleaned().

    Null texts count as empty, so they fail the base rules; long ones are read whole; a null host is the host ''. Repeated
    rows get a row each. An empty table gives an empty result; other columns are never read."""
    rows = measures(docs, id_col, text_col, host_col)
    removed = (
        rows.select("row_id", "host", F.explode("lines").alias("x"))
        .select("row_id", "host", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
        .join(boilerplate(rows, min_docs, min_share), ["host", "line"])
        .groupBy("row_id")
        .agg(F.sum("words").alias("removed"), F.collect_set("line").alias("removed_lines"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    depleted = (F.col("n_words") - F.col("removed_words")) * 10 < F.col("n_words") * KEEP_TENTHS
    return (
        rows.join(removed, "row_id", "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .select(
            "row_id", "doc_id", "sig", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), "removed_words", (~failed & ~depleted).alias("kept"), "host", "removed_lines",
        )
    )


def cleaned(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs with the lines above the limits taken out of their texts; verdicts: the result of quality().

    Other lines and their breaks stay as they are, as do texts without such lines; n_chars follows
    the text if there is one. The columns of docs stand in one struct meanwhile, so any names may clash."""
    lines = verdicts.where("removed_lines is not null").select("doc_id", "sig", "host", "removed_lines").dropDuplicates(["doc_id", "sig", "host"])
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_sig"), F.coalesce(F.col(host_col), F.lit("")).alias("own_host")
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sig") == F.col("sig")) & (F.col("own_host") == F.col("host"))
    text, touched = F.col("row")[text_col], F.col("removed_lines").isNotNull()
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("removed_lines", F.xxhash64(_normal(x)))), "\n")
    both = keyed.join(lines, same, "left").select("row", F.when(touched, rest).otherwise(text).alias("clean"))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("clean").alias(name)
        own = F.col("row")[name]
        if name != "n_chars":
            return own.alias(name)
        changed = ~F.col("clean").eqNullSafe(text)
        return F.when(changed, F.char_length("clean").cast(docs.schema[name].dataType)).otherwise(own).alias(name)

    return both.select(*[column(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("row_id", "sig", "host", "removed_lines")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
lines AS (
  SELECT rid, host, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
bad AS (
  SELECT host, line FROM lines JOIN d USING (rid, host)
  GROUP BY host, line
  HAVING count(DISTINCT t) >= {MIN_DOCS}
     AND count(DISTINCT t) * {MIN_SHARE} >= (SELECT count(DISTINCT e.t) FROM d e WHERE e.host = lines.host)),
gone AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS n FROM lines SEMI JOIN bad USING (host, line) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (n_words - removed_words) * 10 < n_words * {KEEP_TENTHS} AS kept
FROM m
"""
