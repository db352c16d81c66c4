"""Mixing sources to target weights, in blocks of words drawn by multinomial counts per output shard.

Sources weigh 5, 2, 1, repeating, in the order of their names. A target stops at 3 times its source's size
and what is over goes to the others by weight: that is one level for all sources that do not stop, found in one
pass over the sources in order of the level at which each would stop.

Each source's documents, in a pseudorandom order, are one stream of words, cut into blocks of BLOCK words (the last
one may be shorter). The mix is a row of slots for one block each, SHARD_SLOTS of them an output shard. Every slot draws its source
with the odds of the targets, so a shard's counts by source are multinomial. A source's draws are numbered over
all shards and mapped through a pseudorandom permutation of its own (a coprime step, then swap-or-not rounds, which
permute any number of places). Places below the source's quota of blocks are block indices, modulo
its number of blocks; the few draws over quota, which the permutation spreads over all shards, go to the sources that
were drawn too seldom. So quotas hold exactly, no block is used more than 3 times, and shards keep their random counts.
Slots and blocks meet in a join by (source, index).

Places in a stream are sums within cells of the order plus sums over cells, so a source with a third of
all rows is as many cells as its rows need. Rows equal in id, text and source are counted before the shuffle and
laid out in runs of COPIES at most. All draws are digests of the seed, the row or the slot: reruns agree,
whatever the partitions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm._shared import SPACE, cut, table, text_of

WEIGHTS = (5, 2, 1)
#: A source is used this many times at most.
MOST_TIMES = 3
#: Words of a block, slots of an output shard.
BLOCK, SHARD_SLOTS = 64, 4096
SEED = "2025"
#: Rounds of the permutation, the prime that its bits are computed by, and steps of which one at least is coprime to any
#: number of places below 10 ** 18.
ROUNDS, PRIME, STEPS = 8, 2147483647, (1000003, 1000033, 1000037)
#: Rows that a cell of an order is meant to hold, cells that a draw's range is looked up by, equal rows of one run.
CELL_ROWS, CELLS, COPIES = 50_000, 4096, 1000
#: Slots that a task is meant to place.
TASK_SLOTS = 500_000
_BITS = 60


class Mix(NamedTuple):
    """documents: stratum, u, doc_id, size, n, start, place, source_size, target (n equal rows from a word of their source's stream on);
    sources: stratum, place, weight, source_size, target, blocks, quota; slots: place, block, shard."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame


def _draw(*key: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(SEED), *key), "UTF-8")), 1, _BITS // 4), 16, 10).cast("long")


def _running(rows: DataFrame, group: list[str], cell: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of a value over the rows before each in its group, by (cell, order); cells are in order."""
    sums = rows.groupBy(*group, cell).agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, cell, F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [*group, cell]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_before")


def _documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """stratum ('=' and the source, or '' for null), u (place in the stream), doc_id, size, n, words (of all n rows)."""
    text = text_of(text_col)
    slim = docs.select(
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("stratum"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        _draw(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.encode(text, "UTF-8"))).alias("u"),
    )
    counted = slim.groupBy("stratum", "u", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    runs = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long"))))
    return runs.select(
        "stratum",
        F.when(F.col("first") == 0, F.col("u")).otherwise(_draw(F.col("u").cast("string"), F.col("first").cast("string"))).alias("u"),
        "doc_id",
        "size",
        F.least(F.col("times") - F.col("first"), F.lit(COPIES)).alias("n"),
    ).withColumn("words", F.col("size") * F.col("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """stratum, place, weight, source_size, target, blocks, quota from stratum and source_size (one row a source)."""
    place = F.row_number().over(Window.orderBy(F.col("stratum") == "", "stratum")) - 1
    weighed = sizes.withColumn("place", place).withColumn("weight", F.get(F.lit(list(WEIGHTS)), F.col("place") % len(WEIGHTS)))
    # The level at which a source stops; up to it all sources are filled in proportion to their weights.
    stop = F.col("source_size").cast("double") * MOST_TIMES / F.col("weight")
    by_stop = Window.orderBy("stop", "place")
    below, above = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    levels = weighed.withColumn("stop", stop).withColumns({
        "words": F.sum("source_size").over(every) - MOST_TIMES * F.coalesce(F.sum("source_size").over(below), F.lit(0)),
        "weights": F.sum("weight").over(above),
        "nth": F.row_number().over(by_stop),
    })
    first = F.min(F.when(F.col("stop") >= F.col("words").cast("double") / F.col("weights"), F.struct("nth", "words", "weights"))).over(every)
    level = levels.withColumn("at", first).withColumn("words", F.col("at.words").cast("double")).withColumn("weights", F.col("at.weights"))
    target = F.when(F.col("nth") < F.col("at.nth"), (F.col("source_size") * MOST_TIMES).cast("double")).otherwise(F.col("words") * F.col("weight") / F.col("weights"))
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("long")
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long")
    return level.withColumn("target", target).withColumn("blocks", blocks).select("stratum", "place", "weight", "source_size", "target", "blocks", quota.alias("quota"))


def _keys(place: Column, of: Column) -> dict[str, Column]:
    """Columns of the permutation of a source's places 0 to of - 1: a step, a start, and three numbers a round."""
    of = F.greatest(of, F.lit(1))
    step = F.lit(1)
    for s in reversed(STEPS):
        step = F.when(of % s != 0, s).otherwise(step)
    numbers = lambda r: F.struct(*[(_draw(F.lit(name), place.cast("string"), r.cast("string")) % below).alias(name) for name, below in (("about", of), ("a", F.lit(PRIME)), ("b", F.lit(PRIME)))])
    return {"step": step.cast("long"), "first": _draw(F.lit("first"), place.cast("string")) % of, "rounds": F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), numbers)}


def _permuted(x: Column, of: Column) -> Column:
    """The place of x in the permutation of 0 to of - 1 that the columns of _keys() describe: a step modulo of, then rounds
    that swap a place with its mirror about a key, or do not."""

    def swap(x: Column, key: Column) -> Column:
        mirror = (key["about"] - x + of) % of
        high = F.greatest(x, mirror) % PRIME
        return F.when(F.shiftright((high + key["a"]) % PRIME * ((high + key["b"]) % PRIME) % PRIME, 11) % 2 == 1, mirror).otherwise(x)

    return F.aggregate("rounds", (F.col("first") + x * F.col("step")) % of, swap)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of docs. Null texts and texts without words are empty; a null source is a source of its own, the last
    in order; a null id stays null; repeated rows are documents each. An empty table, and one without words, gives no
    slots. Texts of any length are used whole; other columns are never read."""
    spark = docs.sparkSession
    rows = cut(_documents(docs, id_col, text_col, source_col), "mix-documents")
    sources = cut(targets(rows.groupBy("stratum").agg(F.sum("words").alias("source_size"))), "mix-sources")
    cells = max(6, (rows.count() // CELL_ROWS).bit_length())
    known = sources.select("stratum", "place", "source_size", "target")
    celled = rows.withColumn("cell", F.shiftright("u", _BITS - cells))
    documents = _running(celled, ["stratum"], "cell", ["u", "doc_id", "size"], "words", "start").join(known, "stratum").drop("cell", "words")
    total = sources.agg(F.sum("quota")).first()[0] or 0
    drawn = cut(_draws(spark, sources, total), "mix-draws")
    return Mix(documents, sources, _slots(sources, drawn, total))


def _draws(spark: SparkSession, sources: DataFrame, total: int) -> DataFrame:
    """shard, place, drawn: the multinomial counts of the sources in each shard."""
    width = max(1, -(-total // CELLS))
    to = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sources.withColumn("to", F.sum("quota").over(to)).withColumn("from", F.col("to") - F.col("quota")).where("quota > 0")
    looked = ranges.select("place", "from", "to", F.explode(F.sequence(F.expr(f"`from` div {width}"), F.expr(f"(`to` - 1) div {width}"))).alias("cell"))
    slots = spark.range(total).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), (_draw("id") % max(total, 1)).alias("at")).withColumn("cell", F.expr(f"at div {width}"))
    found = slots.join(looked, (slots.cell == looked.cell) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")))
    return found.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("drawn"))


def _slots(sources: DataFrame, drawn: DataFrame, total: int) -> DataFrame:
    """place, block, shard of every slot, from the counts."""
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(every), F.lit(0))
    totals = sources.join(drawn.groupBy("place").agg(F.sum("drawn").alias("total")), "place", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    settled = totals.withColumns({"over": F.greatest(F.col("total") - F.col("quota"), F.lit(0)), "short": F.greatest(F.col("quota") - F.col("total"), F.lit(0))})
    settled = settled.withColumns({"over_before": before("over"), "short_before": before("short")} | _keys(F.col("place"), F.col("total")))
    settled = cut(settled.drop("stratum", "weight", "source_size", "target"), "mix-settled")
    numbered = _running(drawn.withColumn("cell", F.expr("shard div 1024")), ["place"], "cell", ["shard"], "drawn", "start").join(settled, "place")
    # A row here is up to SHARD_SLOTS slots, so rows are dealt by their number, not by their size.
    spread = numbered.repartition(max(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_SLOTS), "place", "shard")
    spread = spread.select("*", F.explode(F.sequence("start", F.col("start") + F.col("drawn") - 1)).alias("k"))
    # Written, so that the two branches below do not compute it again for themselves and for their filters.
    placed = cut(spread.select("place", "shard", "blocks", "quota", "over_before", _permuted(F.col("k"), F.col("total")).alias("q")), "mix-slots")
    own = placed.where("q < quota").select("place", (F.col("q") % F.col("blocks")).alias("block"), "shard")
    # A few in all: as many as the draws of the sources miss the quotas by.
    spare = placed.where("q >= quota").select((F.col("over_before") + F.col("q") - F.col("quota")).alias("nth"), "shard")
    short = settled.where("short > 0").select("place", "blocks", "short_before", "total", F.explode(F.sequence("total", F.col("quota") - 1)).alias("q"))
    wanted = short.select((F.col("short_before") + F.col("q") - F.col("total")).alias("nth"), "place", (F.col("q") % F.col("blocks")).alias("block"))
    return own.unionByName(wanted.join(spare, "nth").select("place", "block", "shard"))


def pieces(mixed: Mix) -> DataFrame:
    """The contents of the shards: shard, place, block, doc_id, size, u, copy, first, length. A piece is words
    first to first + length - 1 of a document; a block's pieces are in the order of its stream."""
    copies = _copies(mixed.documents).where("size > 0")
    start = F.col("start") + F.col("copy") * F.col("size")
    blocks = copies.select("place", "doc_id", "size", "u", "copy", start.alias("start")).withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")))
    )
    first = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    length = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size")) - first
    held = blocks.select("place", "block", "doc_id", "size", "u", "copy", first.alias("first"), length.alias("length"))
    return mixed.slots.join(held, ["place", "block"])


def _copies(documents: DataFrame) -> DataFrame:
    return documents.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))


def taken(mixed: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, n_pieces, first_shard (null if nothing is taken)."""
    key = ["place", "u", "doc_id", "size", "copy"]
    none = lambda kind: F.lit(None).cast(kind)
    whole = _copies(mixed.documents).select(*key, "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n"), none("long").alias("shard"))
    found = pieces(mixed).groupBy(*key).agg(F.sum("length").alias("taken"), F.count(F.lit(1)).alias("n"), F.min("shard").alias("shard"))
    parts = found.select(*key, none("long").alias("source_size"), none("double").alias("target"), "taken", "n", "shard")
    summed = whole.unionByName(parts).groupBy(*key).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("n").alias("n_pieces"), F.min("shard").alias("first_shard")
    )
    return summed.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_shard")


def _sql_rounds() -> str:
    """The permutation as nested queries over place, total and x."""
    draw = lambda name, r, of: f"('0x' || substr(md5('{SEED}:{name}:' || place{r}), 1, {_BITS // 4}))::BIGINT % {of}"
    step = "CASE " + " ".join(f"WHEN total % {s} <> 0 THEN {s}" for s in STEPS) + " ELSE 1 END"
    kept = "place, shard, blocks, quota, over_before, total"
    own = f"SELECT {kept}, ({draw('first', '', 'total')} + x * {step}) % total AS x FROM k"
    for r in range(ROUNDS):
        mirror = f"SELECT *, ({draw('about', f" || ':{r}'", 'total')} - x + total) % total AS mirror FROM ({own})"
        high = f"SELECT *, greatest(x, mirror) % {PRIME} AS high, {draw('a', f" || ':{r}'", PRIME)} AS a, {draw('b', f" || ':{r}'", PRIME)} AS b FROM ({mirror})"
        own = f"SELECT {kept}, CASE WHEN (((high + a) % {PRIME}) * ((high + b) % {PRIME}) % {PRIME} >> 11) % 2 = 1 THEN mirror ELSE x END AS x FROM ({high})"
    return f"SELECT place, shard, blocks, quota, over_before, x AS q FROM ({own})"


#: Ids are taken to be unique. Targets by pouring the excess again and again.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, {_BITS // 4}))::BIGINT AS u FROM documents),
w AS (
  SELECT stratum, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY stratum = '', stratum) - 1 AS place FROM d GROUP BY 1),
v AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM w),
f AS (
  SELECT stratum, false AS full, 0 AS turn FROM v
  UNION ALL
  SELECT f.stratum, f.full OR {MOST_TIMES} * v.source_size <
           (sum(v.source_size) OVER () - {MOST_TIMES} * sum(CASE WHEN f.full THEN v.source_size ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN f.full THEN 0 ELSE v.weight END) OVER ())::DOUBLE * v.weight,
         f.turn + 1
  FROM f JOIN v ON v.stratum = f.stratum WHERE f.turn < (SELECT count(*) FROM v)),
t AS (
  SELECT v.*, CASE WHEN f.full THEN ({MOST_TIMES} * source_size)::DOUBLE
    ELSE (sum(source_size) OVER () - {MOST_TIMES} * sum(CASE WHEN f.full THEN source_size ELSE 0 END) OVER ())::DOUBLE * weight / (sum(CASE WHEN f.full THEN 0 ELSE weight END) OVER ())::BIGINT END AS target
  FROM v JOIN f ON f.stratum = v.stratum AND f.turn = (SELECT count(*) FROM v)),
b AS (SELECT *, ceil(source_size / {BLOCK})::BIGINT AS blocks FROM t),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size + 0.5)::BIGINT ELSE 0 END AS quota FROM b),
c AS (SELECT *, (sum(quota) OVER (ORDER BY place))::BIGINT AS till FROM s),
g AS (SELECT id, ('0x' || substr(md5('{SEED}:' || id), 1, {_BITS // 4}))::BIGINT % n AS ticket FROM (SELECT sum(quota)::BIGINT AS n FROM s), range(0, n) r(id)),
h AS (SELECT id // {SHARD_SLOTS} AS shard, place, row_number() OVER (PARTITION BY place ORDER BY id) - 1 AS x FROM g JOIN c ON ticket < till AND ticket >= till - quota),
o AS (SELECT s.*, coalesce(total, 0) AS total FROM s LEFT JOIN (SELECT place, count(*) AS total FROM h GROUP BY 1) USING (place)),
e AS (
  SELECT *, coalesce(sum(greatest(total - quota, 0)) OVER earlier, 0)::BIGINT AS over_before, coalesce(sum(greatest(quota - total, 0)) OVER earlier, 0)::BIGINT AS short_before
  FROM o WINDOW earlier AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT h.*, blocks, quota, total, over_before FROM h JOIN e USING (place)),
q AS ({_sql_rounds()}),
m AS (
  SELECT place, q % blocks AS block, shard FROM q WHERE q < quota
  UNION ALL
  SELECT x.place, x.i % x.blocks, q.shard FROM (SELECT place, blocks, i, short_before + i - total AS nth FROM e, range(total, quota) r(i)) x
  JOIN q ON q.q >= q.quota AND q.over_before + q.q - q.quota = x.nth),
z AS (SELECT d.*, s.place, s.source_size, s.target, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY u, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN s USING (stratum))
SELECT z.doc_id, z.size, z.source_size, z.target, coalesce(sum(least((m.block + 1) * {BLOCK}, start + size) - greatest(m.block * {BLOCK}, start)) FILTER (WHERE m.block IS NOT NULL), 0)::BIGINT AS taken,
       count(m.block) AS n_pieces, min(m.shard) AS first_shard
FROM z LEFT JOIN m ON m.place = z.place AND z.size > 0 AND m.block >= start // {BLOCK} AND m.block <= (start + size - 1) // {BLOCK}
GROUP BY z.place, z.u, z.doc_id, z.size, z.source_size, z.target, z.start
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))
