"""Filter interaction audit by the multilinear extension of the removal game.

Each document becomes a mask of the filters it fails; equal masks of a part are counted, so that
every part is at most 32 rows of counts (all documents, good ones, toxic ones). From these counts a part's removal
polynomial is formed: r(x) is the expected number of documents removed when filter i is applied with
probability x_i, a sum over masks of n * (1 - product of (1 - x_i)), multiplied out into one coefficient for each
set of filters. Its partial derivative along the diagonal x = (t, ..., t), integrated from 0 to 1 in exact
rationals, is a filter's Shapley value; times 120 it is the sum over all orders. Its value at a corner of the
cube is what the filters of that corner remove, and gives the survivors of every prefix of every order.

The one filter that looks beyond a document (identical to a smaller id's text) needs the smallest id of each
text. Rows are counted by (text digest, part, other filters, labels) before and after the shuffle, so a group of
copies with a third of all rows is a few rows, and rows never meet their group again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import SPACE, cut, table, text_of

FILTERS = "ABCDE"
#: Bits of the mask, in the order of FILTERS.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A: least words; B: least distinct words, C: most capitals, in percent; D: characters that fail a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def own_filters(text: Column) -> Column:
    """The mask of the filters that a text fails by itself (A to D)."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda fails, f: F.when(fails, BIT[f]).otherwise(0)
    return (
        F.transform(F.array(words), lambda w: bit(F.size(w) < LEAST_WORDS, "A") + bit(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), "B"))[0]
        + bit(100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text), "C")
        + bit(F.regexp_like(text, F.lit(MARKS)), "D")
    )


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by part and mask: part, mask, n, good, toxic.

    A null text is empty and a null part ''; of several labels of an id any 1 counts. A row without an id has no
    smaller id's text and is none itself. Rows that repeat an id and text are documents each, and none is a copy of the other."""
    text = text_of(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        own_filters(text).alias("own"),
    )
    # An id and text that is repeated without end is one row a task here; without an id, rows are dealt by their text.
    rows = slim.groupBy("digest", "id", "part", "own").agg(F.count(F.lit(1)).alias("n")).withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(0))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    labelled = rows.join(known.withColumn("deal", F.lit(0).cast("long")), ["id", "deal"], "left").select(
        "digest", "id", "part", "own", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    kinds = ["part", "own", "good", "toxic"]
    groups = cut(
        labelled.groupBy("digest", *kinds).agg(
            F.min("id").alias("first"),
            F.coalesce(F.min_by("n", "id"), F.lit(0).cast("long")).alias("n_first"),
            F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("n_null"),
            F.sum("n").alias("n"),
        ),
        "audit",
    )
    # A group that no other row of its digest has is its own first.
    firsts = groups.groupBy("digest").agg(F.min("first").alias("least"))
    stays = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = groups.join(firsts, "digest").select(*kinds, F.explode(F.array(F.struct(F.lit(0).alias("e"), stays.alias("n")), F.struct(F.lit(BIT["E"]).alias("e"), (F.col("n") - stays).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.groupBy("part", (F.col("own") + F.col("x.e")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficients of the removal polynomial by set of filters, from documents by mask."""
    out = [0] * SETS
    for mask, n in counts.items():
        some = mask
        while some:  # every set within the mask but the empty one
            out[some] += -n if some.bit_count() % 2 == 0 else n
            some = (some - 1) & mask
    return out


def corners(coefficients: list[int]) -> list[int]:
    """Values of the polynomial at all corners: what each set of filters removes."""
    out = list(coefficients)
    for f in range(len(FILTERS)):
        for at in range(SETS):
            if at >> f & 1:
                out[at] += out[at ^ 1 << f]
    return out


def shapley(coefficients: list[int], f: int) -> int:
    """The sum over all orders of what filter f removes: the partial derivative's integral along the diagonal, scaled."""
    value = sum((Fraction(c, some.bit_count()) for some, c in enumerate(coefficients) if some >> f & 1), Fraction(0))
    scaled = value * factorial(len(FILTERS))
    if scaled.denominator != 1:
        raise ArithmeticError(f"{scaled} is no whole number")
    return scaled.numerator


PARTS = "part string, total long, removed array<long>, good array<long>, toxic array<long>, fails array<long>, alone array<long>, shapley array<long>"


def _games(counts: DataFrame) -> DataFrame:
    """One row of PARTS per part: removed, good and toxic by set of filters, the rest by filter."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part, found in zip(batch["part"], batch["found"], strict=True):
                by = [{x["mask"]: x[c] for x in found} for c in ("n", "good", "toxic")]
                all_, good, toxic = map(polynomial, by)
                fails = [sum(n for m, n in by[0].items() if m >> f & 1) for f in range(len(FILTERS))]
                alone = [by[0].get(1 << f, 0) for f in range(len(FILTERS))]
                rows.append((part, sum(by[0].values()), corners(all_), corners(good), corners(toxic), fails, alone, [shapley(all_, f) for f in range(len(FILTERS))]))
            yield pd.DataFrame(rows, columns=["part", "total", "removed", "good", "toxic", "fails", "alone", "shapley"])

    # At most one row a mask: 32 in a part.
    found = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    return found.mapInPandas(solve, PARTS)


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    An empty table has no parts and gives an empty result; labels may be empty. Texts of any length are read
    whole; other columns are never read. See masks() for nulls and repeated rows."""
    games = _games(masks(docs, labels, part_col, id_col, text_col))
    steps = [f"{order}{k}" for order in ORDERS for k in range(len(FILTERS))]
    before = [sum(BIT[f] for f in order[:k]) for order in ORDERS for k in range(len(FILTERS))]
    filters = [FILTERS.index(order[k]) for order in ORDERS for k in range(len(FILTERS))]
    every = games.select("*", F.posexplode(F.lit(steps)).alias("place", "name"))
    every = every.withColumns({"prior": F.get(F.lit(before), F.col("place")), "f": F.get(F.lit(filters), F.col("place"))})
    every = every.withColumn("after", F.col("prior") + F.get(F.lit(list(BIT.values())), F.col("f")))
    of = lambda c, place: F.get(F.col(c), F.col(place))
    lost = lambda c: of(c, "after") - of(c, "prior")
    return every.select(
        "part",
        F.substring("name", 1, len(FILTERS)).alias("filter_order"),
        (F.substring("name", len(FILTERS) + 1, 1).cast("int") + 1).alias("step"),
        F.get(F.lit(list(FILTERS)), F.col("f")).alias("filter"),
        (F.col("total") - of("removed", "after")).alias("kept"),
        lost("removed").alias("removed"),
        (of("fails", "f") - lost("removed")).alias("redundant"),
        of("alone", "f").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        of("shapley", "f").alias("shapley"),
    )


_ORDERS = ", ".join(f"('{o}')" for o in ORDERS)
#: Counts of every step by comparison of masks, and the sum over orders by summing them: no polynomial.
SQL = f"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (
  SELECT part, (len(words) < {LEAST_WORDS}) AS a, (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words)) AS b,
         (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text)) AS c, regexp_matches(text, '{MARKS}') AS d, coalesce(w.doc_id > least, false) AS e,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
         count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
o AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS prior
      FROM (VALUES {_ORDERS}) v(filter_order), range(1, 6) r(step)),
x AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (WHERE NOT hit AND NOT contains(failed, f)) AS kept, sum(n) FILTER (WHERE NOT hit AND contains(failed, f)) AS removed,
         sum(n) FILTER (WHERE hit AND contains(failed, f)) AS redundant, sum(n) FILTER (WHERE failed = f) AS unique_fails,
         sum(good) FILTER (WHERE NOT hit AND contains(failed, f)) AS good_lost, sum(toxic) FILTER (WHERE NOT hit AND contains(failed, f)) AS toxic_lost
  FROM (SELECT *, failed <> '' AND prior <> '' AND translate(failed, prior, '') <> failed AS hit FROM g, o) GROUP BY 1, 2, 3, 4),
y AS (SELECT part, filter_order, step, f, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
             coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost FROM x)
SELECT part, filter_order, step, f AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
