"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; a row's fractional rank is its
place in its source on a scale from 0 to 1. All rows are sorted by fractional rank and cut into
runs of equal length, so that every shard has the mixture of the whole. Law: rows (shard counts
differ by one at most).

Both rankings are made in buckets of the ranked value: bucket counts (one small row each) are
summed up to offsets, and rows are numbered within a bucket only. A source with a third of all
rows is spread over all its buckets. Rows draw their place by their id; an id that more rows have
than a bucket is meant to hold (or a null id) draws by row number too, so its rows are spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm._shared import cut, table, text_of

SHARDS = 24
SEED = "2024"
#: Rows that one bucket is meant to hold.
BUCKET_ROWS = 50_000
_BITS = 60


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    Null texts are empty (size 8), and long ones are read whole; a null source is a stratum of its own. Rows
    that agree in id and text may take each other's place. With fewer rows than shards, some shards are empty; an empty
    table gives an empty result. Other columns are never read."""
    text = text_of(text_col)
    draw = lambda key: F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, _BITS // 4), 16, 10).cast("long")
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.when(F.col(stratum_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(stratum_col).cast("string"))).alias("stratum"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            draw(F.concat_ws(":", F.lit(seed), F.col(id_col))).alias("u"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "shard-rows",
    )
    total = slim.count()
    # At most total / bucket_rows of them.
    often = slim.groupBy("u").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > bucket_rows).select("u", F.lit(True).alias("often"))
    slim = slim.join(often, "u", "left").withColumn("u", F.when(F.col("often"), draw(F.concat_ws(":", F.lit(seed), "u", "row_id"))).otherwise(F.col("u"))).drop("often", "row_id")
    buckets = max(64, -(-total // bucket_rows))
    width = (1 << _BITS) // buckets + 1
    dealt = slim.withColumn("b", F.expr(f"u div {width}"))
    before = Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("n")).select(
        "stratum", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("of")
    )
    own = Window.partitionBy("stratum", "b").orderBy("u", "doc_id", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(own)
    ranked = cut(
        dealt.join(offsets, ["stratum", "b"])
        .withColumn("f", (rank - 0.5) / F.col("of"))
        .select("doc_id", "stratum", "size", "text_crc32", "u", "f", F.floor(F.col("f") * buckets).alias("c")),
        "shard-ranks",
    )
    starts = ranked.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(
        "c", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("c").orderBy("f", "stratum", "u", "doc_id", "text_crc32", "size")
    placed = ranked.join(starts, "c").withColumn("pos", F.col("start") + F.row_number().over(within) - 1)
    return placed.withColumn("shard", F.expr(f"pos * {shards} div {max(total, 1)}").cast("int")).select(
        "doc_id", "size", "text_crc32", "shard",
        F.expr(f"pos - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}").cast("long").alias("slot"),
    )


def _crc32(hexadecimal: str) -> str:
    """DuckDB SQL for the CRC-32 of the bytes behind an upper-case hexadecimal text, four bits a step."""
    steps = []
    for low in range(16):
        for _ in range(4):
            low = low >> 1 ^ 0xEDB88320 * (low & 1)
        steps.append(low)
    nibbles = f"list_transform(string_split(regexp_replace({hexadecimal}, '(.)(.)', '\\2\\1', 'g'), ''), lambda x: instr('0123456789ABCDEF', x)::BIGINT - 1)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, CASE WHEN {hexadecimal} = '' THEN []::BIGINT[] ELSE {nibbles} END), lambda c, x: xor(c >> 4, list_extract({steps}, (xor(c, x) & 15) + 1)::BIGINT)))"


#: Ids are taken to be unique; with fewer copies of an id than a bucket holds it is right for them too.
SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id)), 1, {_BITS // 4}))::BIGINT AS u FROM documents),
k AS (SELECT doc_id, stratum, size, u, {_crc32('h')} AS text_crc32 FROM d),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY u, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS f,
         count(*) OVER () AS total FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY f, stratum, u, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * {SHARDS} // total)::INT AS shard, pos - (pos * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard FROM p
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
