"""Queries of ordered operators: ties, interleaving, batches, lags, sampling, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions import hashing
from quillwork.operators import joins
from quillwork.operators import ordered as od
from quillwork.plans.base import Book, view

BOOK = Book()


@BOOK.add("argmax_first_wins", """
SELECT executor, repetition, tier, f1 FROM (SELECT *, row_number() OVER (PARTITION BY executor, repetition ORDER BY round(f1, 1) DESC, tier) AS k FROM tiers) WHERE k = 1""")
def argmax_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "tiers").withColumn("score", F.round("f1", 1)).withColumn("place", F.substring("tier", 1, 1).cast("int"))
    return od.argmax_first(rows, ["executor", "repetition"], "score", "place", ["tier", "f1"])


@BOOK.add("top2_per_cell", """
WITH g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(['long', 'short']) AS shape)),
d AS (SELECT lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS shape, doc_id,
             row_number() OVER (PARTITION BY lang, n_chars > 2000 ORDER BY sha256('admit/' || doc_id), doc_id) AS k FROM documents)
SELECT g.lang, g.shape, d.doc_id FROM g LEFT JOIN d ON d.lang = g.lang AND d.shape = g.shape AND d.k <= 2""")  # fmt: skip
def top2_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("shape"))
    grid = docs.select("lang").distinct().withColumn("shape", F.explode(F.array(F.lit("long"), F.lit("short"))))
    order = [F.sha2(F.concat(F.lit("admit/"), F.col("doc_id").cast("string")), 256), F.col("doc_id")]
    return grid.join(od.top_k(docs, ["lang", "shape"], order, 2), ["lang", "shape"], "left").select("lang", "shape", "doc_id")


@BOOK.add("round_robin_batches", """
WITH b AS (SELECT profile, stratum, tp + fn > 0 AS positive FROM score_rows),
t AS (SELECT *, row_number() OVER (PARTITION BY stratum, positive ORDER BY sha256('batch/' || profile) DESC, profile) AS turn FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY turn, stratum, positive) - 1 AS place FROM t)
SELECT profile, place, place // 6 AS batch FROM p""")  # fmt: skip
def round_robin_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "score_rows").select("profile", "stratum", (F.col("tp") + F.col("fn") > 0).alias("positive"))
    order = [F.sha2(F.concat(F.lit("batch/"), F.col("profile").cast("string")), 256).desc(), F.col("profile")]
    return od.interleaved(rows, ["stratum", "positive"], order, 6).select("profile", F.col("place").cast("long"), "batch")


BOOK.check("strict_interleave", """
SELECT profile, stratum, (place - 3 + 2 * n) % n AS place FROM (
  SELECT profile, stratum, CAST(row_number() OVER (ORDER BY turn, stratum) AS BIGINT) - 1 AS place, count(*) OVER () AS n
  FROM (SELECT profile, stratum, row_number() OVER (PARTITION BY stratum ORDER BY profile) AS turn FROM score_rows) t
  WHERE turn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM score_rows GROUP BY stratum) m)) p""")  # fmt: skip
BOOK.check("latin_rotation", """
SELECT profile, variant, (variant - profile % 5 + 5) % 5 AS place
FROM (SELECT DISTINCT l_suppkey AS profile, l_linenumber % 5 AS variant FROM lineitem) v""")


@BOOK.add("pareto_frontier", """
SELECT o_custkey, f1, p90 FROM (SELECT o_custkey, count(*) AS f1, max(o_totalprice) AS p90 FROM orders GROUP BY 1) a
WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_custkey, count(*) AS f1, max(o_totalprice) AS p90 FROM orders GROUP BY 1) b
                  WHERE b.f1 >= a.f1 AND b.p90 <= a.p90 AND (b.f1 > a.f1 OR b.p90 < a.p90))""")  # fmt: skip
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("f1"), F.max("o_totalprice").alias("p90"))
    return joins.pareto(rows, "f1", "p90").select("o_custkey", "f1", "p90")


BOOK.check("family_promotion", """
SELECT family, id, p90 FROM (
  SELECT *, row_number() OVER (ORDER BY p90, id) AS place FROM (
    SELECT family, id, p90, row_number() OVER (PARTITION BY family ORDER BY p90, id) AS k
    FROM (SELECT c_mktsegment AS family, c_custkey AS id, c_acctbal AS p90 FROM customer WHERE c_acctbal > 0) c) f WHERE k = 1) g WHERE place <= 2""")  # fmt: skip
BOOK.check("ranked_order", """
SELECT repetition, tier, CAST(rank() OVER (PARTITION BY repetition ORDER BY round(f1, 2) DESC, n DESC, tier, executor) AS BIGINT) AS place, executor FROM tiers""")


@BOOK.add("sensor_energy", """
WITH p AS (SELECT gpu, power, at_s - lag(at_s) OVER w AS gap, lag(power) OVER w AS before FROM frames WINDOW w AS (PARTITION BY gpu ORDER BY sequence))
SELECT gpu, round(coalesce(sum((power + before) / 2 * gap) FILTER (ok), 0), 3) AS joules, round(coalesce(sum(gap) FILTER (ok), 0), 3) AS covered_s,
       count(*) FILTER (ok) AS pairs, max(power) AS peak
FROM (SELECT *, coalesce(power IS NOT NULL AND before IS NOT NULL AND gap > 0 AND gap <= 86400, false) AS ok FROM p) GROUP BY gpu""")  # fmt: skip
def sensor_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.energy(view(spark, sf_dir, "frames"), "gpu", "at_s", "power", "sequence", 86400.0)


@BOOK.add("chain_violations", """
WITH f AS (SELECT gpu, sequence, sha256('f' || event_id) AS d, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE lag(sha256('f' || event_id)) OVER (PARTITION BY gpu ORDER BY sequence) END AS p FROM frames)
SELECT gpu, count(*) AS frames, count(*) FILTER (bad) AS broken
FROM (SELECT *, p IS DISTINCT FROM lag(d) OVER (PARTITION BY gpu ORDER BY sequence) AS bad FROM f) GROUP BY gpu""")  # fmt: skip
def chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("gpu").orderBy("sequence")
    f = view(spark, sf_dir, "frames").withColumn("d", F.sha2(F.concat(F.lit("f"), F.col("event_id").cast("string")), 256))
    f = f.withColumn("p", F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.lag("d").over(w)))
    broken = od.chained(f, ["gpu"], "sequence", "d", "p").groupBy("gpu").agg(F.count(F.lit(1)).alias("broken"))
    return f.groupBy("gpu").agg(F.count(F.lit(1)).alias("frames")).join(broken, "gpu", "left").select("gpu", "frames", F.coalesce("broken", F.lit(0)).alias("broken"))


BOOK.check("first_seen_dedupe", """
SELECT user_id, event_type, event_id FROM (
  SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) e WHERE k = 1""")


@BOOK.add("latest_checkpoint", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


BOOK.check("latest_by_completion", """
SELECT user_id, event_id, value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'zz') e WHERE k = 1""")
BOOK.check("latest_matching_record", """
SELECT l_suppkey, l_orderkey FROM (
  SELECT l.l_suppkey, l.l_orderkey, row_number() OVER (PARTITION BY l.l_suppkey ORDER BY l.l_orderkey DESC, l.l_linenumber) AS k
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_returnflag = 'A') r WHERE k = 1""")  # fmt: skip
BOOK.check("capped_relations", """
SELECT section, profile, k FROM (
  SELECT section, profile, CAST(row_number() OVER (PARTITION BY section ORDER BY profile) AS BIGINT) AS k FROM score_rows WHERE fp + fn > 0) r WHERE k <= 12""")
BOOK.check("round_series", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS round,
       round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS incumbent FROM events""")
BOOK.check("retry_ordinal", """
SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) - 1 AS retry FROM events""")


@BOOK.add("seeded_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('sample/' || doc_id), doc_id) AS k FROM documents) WHERE k <= 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple random sample without replacement: the 50 smallest digests (a bounded sort per task)."""
    d = view(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("sample/"), F.col("doc_id").cast("string")), 256).alias("h"))
    return d.orderBy("h", "doc_id").limit(50).select("doc_id")


@BOOK.add("weighted_draw", """
SELECT o_orderkey, CASE WHEN u < 50 THEN 'name' WHEN u < 80 THEN 'vendor_name' WHEN u < 95 THEN 'slash' ELSE 'title' END AS style
FROM (SELECT o_orderkey, ('0x' || substr(sha256('style/' || o_orderkey), 1, 8))::BIGINT % 100 AS u FROM orders)""")  # fmt: skip
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, out, at = hashing.draw(100, F.lit("style"), F.col("o_orderkey")), F.lit(None).cast("string"), 100
    for name, weight in reversed((("name", 50), ("vendor_name", 30), ("slash", 15), ("title", 5))):
        out = F.when(F.col("u") < at, name).otherwise(out)
        at -= weight
    return view(spark, sf_dir, "orders").select("o_orderkey", u.alias("u")).select("o_orderkey", out.alias("style"))


BOOK.check("quota_fill", """
SELECT source, CAST(count(*) AS BIGINT) AS quota FROM (
  SELECT source, k, row_number() OVER (ORDER BY k, source) AS place FROM (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) c) p WHERE place <= 75 GROUP BY source""")  # fmt: skip
BOOK.check("best_per_executor", """
SELECT executor, tier, repetition, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY executor ORDER BY f1 DESC, tier, repetition) AS k FROM tiers) t WHERE k = 1""")
BOOK.check("size_descending", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS BIGINT) AS place FROM documents")

_SIDES = "SELECT l_orderkey, l_linenumber AS x, bool_or(l_returnflag = 'A') AS a, bool_or(l_linestatus = 'F') AS b FROM lineitem GROUP BY l_orderkey, l_linenumber"


@BOOK.add("symmetric_difference", f"SELECT l_orderkey, coalesce(string_agg(x::VARCHAR, ',' ORDER BY x) FILTER (a <> b), '') AS differing, count(*) FILTER (a AND NOT b) = 0 AS subset FROM ({_SIDES}) GROUP BY 1")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("b")
    )
    both = F.array_sort(F.array_union(F.array_except("a", "b"), F.array_except("b", "a")))
    return sets.select("l_orderkey", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("differing"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@BOOK.add("column_shuffle", """
WITH r AS (SELECT s_suppkey, s_name, s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS i, row_number() OVER (ORDER BY sha256('n/' || s_suppkey)) AS j,
                  row_number() OVER (ORDER BY sha256('k/' || s_suppkey)) AS k FROM supplier)
SELECT a.s_suppkey, b.s_name, c.s_nationkey, a.s_name = b.s_name AND a.s_nationkey = c.s_nationkey AS unchanged FROM r a JOIN r b ON a.i = b.j JOIN r c ON a.i = c.k""")  # fmt: skip
def column_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column permuted on its own: every column keeps its multiset, rows become novel."""
    s = view(spark, sf_dir, "supplier")
    at = lambda seed: F.sha2(F.concat(F.lit(seed), F.col("s_suppkey").cast("string")), 256)
    base = od.placed(s.select("s_suppkey", F.col("s_name").alias("n"), F.col("s_nationkey").alias("k")), [F.col("s_suppkey")], "i")
    names = od.placed(s.select("s_suppkey", "s_name"), [at("n/")], "i").drop("s_suppkey")
    nations = od.placed(s.select("s_suppkey", "s_nationkey"), [at("k/")], "i").drop("s_suppkey")
    same = (F.col("n") == F.col("s_name")) & (F.col("k") == F.col("s_nationkey"))
    return base.join(names, "i").join(nations, "i").select("s_suppkey", "s_name", "s_nationkey", same.alias("unchanged"))


@BOOK.add("novel_tuples", """
WITH t AS (SELECT l_orderkey % 50 AS request, l_linenumber, l_returnflag, l_linestatus, l_orderkey % 2 AS half FROM lineitem)
SELECT request, count(*) AS novel FROM (SELECT DISTINCT request, l_linenumber, l_returnflag, l_linestatus FROM t WHERE half = 1
  EXCEPT SELECT request, l_linenumber, l_returnflag, l_linestatus FROM t WHERE half = 0) GROUP BY request""")  # fmt: skip
def novel_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "lineitem").withColumn("request", F.col("l_orderkey") % 50)
    keys = ["request", "l_linenumber", "l_returnflag", "l_linestatus"]
    side = lambda h: t.where(F.col("l_orderkey") % 2 == h).select(*keys).distinct()
    return side(1).join(side(0), keys, "left_anti").groupBy("request").agg(F.count(F.lit(1)).alias("novel"))


BOOK.check("section_union", """
SELECT section, count(*) AS n, count(DISTINCT id) AS ids FROM (
  SELECT 'campaign' AS section, o_orderkey AS id FROM orders
  UNION ALL SELECT 'extension', l_orderkey FROM lineitem) u GROUP BY section""")  # fmt: skip
BOOK.check("component_sets_minus", """
SELECT profile, count(DISTINCT vendor) AS vendors FROM (SELECT c.profile, c.vendor FROM components c LEFT JOIN (SELECT DISTINCT vendor FROM terms WHERE lower_inclusive) t
  ON c.vendor = t.vendor WHERE t.vendor IS NULL) x GROUP BY profile""")  # fmt: skip


@BOOK.add("strict_interleave")
def strict_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each stratum in turn as long as all have one, rotated by 3. As turns are complete, a place follows from turn and stratum."""
    rows = od.placed_within(view(spark, sf_dir, "score_rows").select("profile", "stratum"), ["stratum"], [F.col("profile")])
    sizes = view(spark, sf_dir, "score_rows").groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    strata = sizes.agg(F.min("size").alias("turns"), F.array_sort(F.collect_set("stratum")).alias("strata")).select("turns", F.size("strata").cast("long").alias("s"), F.posexplode("strata").alias("at", "stratum"))
    whole, place = F.col("turns") * F.col("s"), F.col("turn") * F.col("s") + F.col("at")
    return rows.join(strata, "stratum").where("turn < turns").select("profile", "stratum", F.pmod(place - 3, whole).alias("place"))


@BOOK.add("latin_rotation")
def latin_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in an order that each profile begins one further on."""
    pairs = view(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("profile"), (F.col("l_linenumber") % 5).alias("variant")).distinct()
    return pairs.withColumn("place", F.pmod(F.col("variant") - F.col("profile"), F.lit(5)))


@BOOK.add("quota_fill")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """75 places go to the sources in turn, the smallest count first: at most 75 rows of a source can have one."""
    first = od.top_k(view(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 75)
    turns = first.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).orderBy("k", "source").limit(75)
    return turns.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))


@BOOK.add("size_descending")
def size_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = od.placed(view(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")])
    return rows.select("doc_id", (F.col("place") + 1).alias("place"))
