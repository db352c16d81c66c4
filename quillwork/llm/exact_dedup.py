"""Exact deduplication by content-defined chunk recipes.

A text is normalised (white space deleted) and cut where its own content says so, so equal
texts give equal cuts wherever they lie. Every chunk becomes an identifier; a document becomes
the ordered list of its identifiers (its recipe), and documents are compared by recipe alone.

* Identifiers are verified: the chunk store groups chunks by (hash, bytes); a hash under which
  the store finds more than one chunk is ambiguous, and its chunks are identified by their bytes.
  Equal recipes therefore mean equal texts, whatever the hash does.
* Texts move once, in the shuffle of the chunk store, with copies combined before it. Everything
  after it moves identifiers only.

Only DataFrame functions run here: no Python, Arrow or RDD code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import SPACE, cut, discard, row_ids, table, text_of

#: Least and most characters of a chunk, and the share 1 in SPARSE of Latin characters in each class of BOUNDARY.
LEAST, MOST, SPARSE = 192, 8192, 5
#: Ranges of other scripts in the three classes: Greek, Cyrillic, Hebrew, Arabic, Devanagari, kana, Han, Hangul.
#: Few ranges, because every one of them is tried for every character.
OTHERS = (
    r"\x{3b1}-\x{3b5}\x{430}-\x{435}\x{5d0}-\x{5d5}\x{627}-\x{62c}\x{915}-\x{91d}\x{3041}-\x{3055}\x{30a1}-\x{30b5}\x{4e00}-\x{5fff}\x{ac00}-\x{b4ff}",
    r"\x{3b6}-\x{3ba}\x{436}-\x{43c}\x{5d6}-\x{5db}\x{62d}-\x{633}\x{91e}-\x{927}\x{3056}-\x{306a}\x{30b6}-\x{30ca}\x{6000}-\x{71ff}\x{b500}-\x{bdff}",
    r"\x{3bb}-\x{3c1}\x{43d}-\x{442}\x{5dc}-\x{5e1}\x{634}-\x{640}\x{928}-\x{930}\x{306b}-\x{307e}\x{30cb}-\x{30de}\x{7200}-\x{83ff}\x{be00}-\x{c6ff}",
)


def _class(which: int) -> str:
    """A character class that holds about 1 in SPARSE characters up to U+00FF, spread by multiplication, and ranges of other scripts."""
    held = [c for c in range(0x21, 0x100) if ((c * 2654435761 & 0xFFFFFFFF) >> 16) % SPARSE == which]
    return "[" + "".join(f"\\x{{{c:x}}}" for c in held) + OTHERS[which] + "]"


#: A chunk ends behind the first three characters of these classes after LEAST characters. Where a text is cut
#: depends on what stands there alone, so a change moves the cuts near it and no others.
BOUNDARY = _class(0) + _class(1) + _class(2)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def chunks(norm: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The content-defined chunks of a text, in order; none for an empty text."""
    pattern = rf"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: row_id, doc_id, text_key, n_code_points, text_sha256, recipe (verified identifiers).

    recipe is array<bigint> while no hash is ambiguous, array<string> otherwise. hash_bits exists
    so that tests can provoke ambiguous hashes."""
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("raw"))
    cut_up = text.withColumn("norm", normalised(F.col("raw"))).withColumn("chunk", chunks(F.col("norm")))
    # Texts are cut once: the chunks are a column of the rows' table that only the store reads.
    written = cut(
        row_ids(
            cut_up,
            F.col("doc_id"),
            F.xxhash64("raw").alias("text_key"),
            F.char_length("raw").cast("long").alias("n_code_points"),
            F.sha2(F.col("norm"), 256).alias("text_sha256"),
            F.transform("chunk", lambda c: chunk_hash(c, hash_bits)).alias("recipe"),
            F.col("chunk").alias("chunks"),
        ),
        "recipes",
    )
    slim = written.drop("chunks")
    # The chunk store: one row per distinct chunk, combined before the shuffle. No hash is kept
    # beside its chunk; grouping by bytes verifies it.
    store = (
        written.select(F.explode("chunks").alias("chunk"))
        .groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    ambiguous = cut(
        store.groupBy(chunk_hash(F.col("chunk"), hash_bits).alias("hash"))
        .agg(F.count(F.lit(1)).alias("meanings"))
        .where("meanings > 1")
        .select("hash"),
        "ambiguous",
    )
    if ambiguous.isEmpty():
        slim = cut(slim, "recipes")
        discard(written)
        return slim
    # Rare: spell the chunks behind ambiguous hashes out. Rows are matched by content, so
    # two rows with one text get the same list.
    parts = (
        written.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk"))
        .distinct()
        .withColumn("hash", chunk_hash(F.col("chunk"), hash_bits))
        .join(ambiguous.withColumn("unsure", F.lit(True)), "hash", "left")
        .groupBy("text_sha256")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("pos", F.when(F.col("unsure"), F.concat(F.lit("="), "chunk")).otherwise(F.concat(F.lit("#"), F.col("hash").cast("string"))).alias("part"))
                )
            ).alias("parts")
        )
        .select("text_sha256", F.col("parts.part").alias("spelt"))
    )
    return slim.join(parts, "text_sha256", "left").select(
        "row_id", "doc_id", "text_key", "n_code_points", "text_sha256", F.coalesce("spelt", F.array().cast("array<string>")).alias("recipe")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: row_id, doc_id, text_key, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts, the one with the most code points, then the smallest
    doc_id stays (a null id comes last; of repeated rows exactly one stays). Null and empty texts,
    and texts of white space alone, are one group. Texts of any length are compared whole. An empty table gives an empty result. Other
    columns of docs are never read."""
    slim = recipes(docs, id_col, text_col, hash_bits)
    order = F.struct("n_code_points", (-F.col("doc_id")).alias("by_id"), (-F.col("row_id")).alias("by_row"))
    # Written, so that both sides of the join have a shuffle of their own and a hot recipe can be split.
    groups = cut(
        slim.groupBy("recipe")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best"))
        .select("recipe", "group_size", (-F.col("best.by_id")).alias("keep_id"), (-F.col("best.by_row")).alias("keep_row")),
        "groups",
    )
    return slim.join(groups, "recipe").select(
        "row_id", "doc_id", "text_key", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
