"""Queries of pools, profiles, requests, feedback, money, and record validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions import hashing
from quillwork.functions import version as vs
from quillwork.operators import generate, graph, joins
from quillwork.operators.lineage import dealt
from quillwork.plans.base import Book, view

BOOK = Book()

@BOOK.add("pool_assignment")
def pool_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out product groups first, then late records, then the digest of the record's own id."""
    lines = view(spark, sf_dir, "lineitem")
    groups = graph.components(graph.stars(lines, "l_orderkey", "l_partkey"), "a", "b", lines.count())
    number = lambda tag, c: hashing.bucket(F.concat(F.lit(tag), F.col(c).cast("string")), 10 if tag == "g" else 100)
    pool = F.when(number("g", "root") == 0, "product_heldout").when(F.col("node") % 10 == 3, "temporal").otherwise(hashing.partition_of(number("i", "node")))
    return dealt(groups).select("node", pool.alias("pool"))


@BOOK.add("profile_generation")
def profile_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of pools of parts, so that there are as many as the parts need; tests hold them against their constraints."""
    pool = F.concat(F.lit("pool_"), F.expr("p_partkey div 200").cast("string"))
    cve = F.concat(F.lit("CVE-2024-"), (F.col("p_partkey") + 10000).cast("string"))
    pools = view(spark, sf_dir, "part").select(pool.alias("pool"), cve.alias("cve"), F.concat_ws("/", "p_brand", "p_type").alias("product"))
    return generate.profiles(pools, 24, 42)


@BOOK.add("error_relations", """
WITH k AS (SELECT version, lower, upper, lower_inclusive, upper_inclusive, c.profile, c.component, t.cve,
    string_split(regexp_replace(version, '(\\.0)+$', ''), '.')::BIGINT[] AS v, string_split(regexp_replace(lower, '(\\.0)+$', ''), '.')::BIGINT[] AS l,
    string_split(regexp_replace(upper, '(\\.0)+$', ''), '.')::BIGINT[] AS u FROM components c JOIN terms t USING (vendor, product)),
h AS (SELECT *, (v > l OR (lower_inclusive AND v = l)) AND (v < u OR (upper_inclusive AND v = u)) AS applies FROM k)
SELECT profile, cve, component, applies FROM (SELECT *, row_number() OVER (PARTITION BY profile, cve ORDER BY applies DESC, component) AS n FROM h) WHERE n = 1""".replace("\\\\", "\\"))  # fmt: skip
def error_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per decision the first component that applies, else the first that matches."""
    pairs = view(spark, sf_dir, "components").join(view(spark, sf_dir, "terms"), ["vendor", "product"])
    key = lambda c: vs.version_key(F.col(c))
    hit = vs.in_range(key("version"), key("exact"), key("lower"), key("upper"), F.col("lower_inclusive"), F.col("upper_inclusive"))
    w = Window.partitionBy("profile", "cve").orderBy(F.col("applies").desc(), "component")
    return pairs.withColumn("applies", hit).withColumn("n", F.row_number().over(w)).where("n = 1").select("profile", "cve", "component", "applies")


@BOOK.add("provider_rule", """
SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN count(*) FILTER (gold) WHEN 1 THEN count(*) ELSE 1 END::INT AS answered
FROM (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'A') AS gold FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")  # fmt: skip
def provider_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber").cast("string")
    sets = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(line)).alias("c"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "A", line))).alias("g"))
    prompt = F.element_at(F.array(F.lit("be exact"), F.lit("list all"), F.lit("guess")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return sets.select("l_orderkey", F.size(generate.provider_answer(prompt, F.col("c"), F.col("g"))).alias("answered"))


@BOOK.add("executor_input", """
SELECT cve, '{"profile":1,"inventory":"' || product || '","advisories":[{"id":"' || cve || '","affected":"' || CASE WHEN lower_inclusive THEN 'prose' ELSE lower END || '"}]}' AS shown FROM terms""")
def executor_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(F.struct(F.col("cve").alias("id"), F.col("lower").alias("affected")))
    prose = F.when(F.col("lower_inclusive"), F.create_map("cve", F.lit("prose"))).otherwise(F.create_map(F.lit("-"), F.lit("-")))
    prose = F.map_filter(prose, lambda k, v: k != "-")
    return view(spark, sf_dir, "terms").select("cve", generate.executor_input(F.lit(1), F.col("product"), listed, F.transform_values(prose, lambda k, v: v)).alias("shown"))


@BOOK.add("tiered_feedback", """
SELECT tier, CASE tier WHEN 1 THEN '{"micro_f1":0.5,"counts":' || n || '}' WHEN 2 THEN '{"micro_f1":0.5,"counts":' || n || ',"relations":' || fp || '}' ELSE '{"micro_f1":0.5,"counts":' || n || ',"relations":' || fp || ',"examples":' || fn || '}' END AS feedback
FROM (SELECT tier, count(*) AS n, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cells GROUP BY tier)""")  # fmt: skip
def tiered_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = view(spark, sf_dir, "cells").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.select("tier", generate.feedback(F.col("tier"), F.lit(0.5), F.col("n"), F.col("fp"), F.col("fn")).alias("feedback"))


@BOOK.add("condition_expansion", """
SELECT s_suppkey, m AS mode FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['on', 'off'] ELSE ['off'] END) AS m FROM supplier WHERE s_suppkey % 7 <> 0)""")
def condition_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by thinking mode; a model that lacks a required parameter has no condition."""
    supported = F.when(F.col("s_suppkey") % 7 == 0, F.array(F.lit("seed"))).otherwise(F.array(F.lit("seed"), F.lit("temperature")))
    models = view(spark, sf_dir, "supplier").where(F.size(F.array_except(F.array(F.lit("seed"), F.lit("temperature")), supported)) == 0)
    modes = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("on"), F.lit("off"))).otherwise(F.array(F.lit("off")))
    return models.select("s_suppkey", F.explode(modes).alias("mode"))


@BOOK.add("equal_but_tariff", """
SELECT count(*) AS pairs, count(*) FILTER (a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority) AS tariff_only
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice""")  # fmt: skip
def equal_but_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's records with other prices, and those of them that are equal but for the price: counted by
    the sizes of the groups that share a signature, never listed."""
    orders = view(spark, sf_dir, "orders")
    pairs = lambda name, *keys: orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name)).withColumn("one", F.lit(1))
    bare = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    counts = pairs("a", "o_custkey").join(pairs("b", "o_custkey", "o_totalprice"), "one").join(pairs("c", *bare), "one").join(pairs("d", *bare, "o_totalprice"), "one")
    return counts.select((F.col("a") - F.col("b")).alias("pairs"), (F.col("c") - F.col("d")).alias("tariff_only"))


@BOOK.add("money_validation", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_totalprice::DECIMAL(18, 2) * 4096 + o_totalprice::DECIMAL(18, 2) * 512)::DOUBLE END AS reservation FROM orders""")
def money_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices come as text; what is no plain decimal is null, and so is its worst-case reservation."""
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    price = text.try_cast("decimal(18,2)")
    return view(spark, sf_dir, "orders").select("o_orderkey", (price * 4096 + price * 512).cast("double").alias("reservation"))


@BOOK.add("model_identity", "SELECT c_custkey, sha256(CASE WHEN c_mktsegment < 'seed 1' THEN c_mktsegment || chr(10) || 'seed 1' ELSE 'seed 1' || chr(10) || c_mktsegment END) AS identity FROM customer")
def model_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter lines are sorted before the digest, so their order does not matter."""
    lines = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("\n", F.lit("seed 1"), "c_mktsegment")).otherwise(F.concat_ws("\n", "c_mktsegment", F.lit("seed 1"), F.lit("")))
    return view(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.array_join(F.array_sort(F.filter(F.split(lines, "\n"), lambda x: x != "")), "\n"), 256).alias("identity"))


@BOOK.add("content_hash", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_returnflag || l_linestatus, '; ' ORDER BY l_linenumber, l_returnflag, l_linestatus)) AS digest FROM lineitem GROUP BY l_orderkey")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of fixed columns in row order; the list it is made of is the rendered component list."""
    item = F.struct("l_linenumber", "l_returnflag", "l_linestatus")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"], x["l_linestatus"]))
    return view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(listed, "; "), 256).alias("digest"))


@BOOK.add("nan_cleaning", "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE label::DOUBLE END AS clean FROM embeddings")
def nan_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("vec_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("label").cast("double"))
    return view(spark, sf_dir, "embeddings").select("vec_id", F.when(~F.isnan(x), x).alias("clean"))


BOOK.check("quarantine_filter", """
SELECT CAST(year(o.o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) q ON o.o_orderkey = q.l_orderkey
WHERE q.l_orderkey IS NULL GROUP BY CAST(year(o.o_orderdate) AS BIGINT)""")  # fmt: skip
BOOK.check("context_fit", """
SELECT split_part(key, '/T', 1) AS condition, count(*) AS n, CAST(max(tokens) AS BIGINT) AS most, count(*) - count(tokens) AS missing, max(tokens) + 512 <= 1500 AND count(*) = count(tokens) AS shown_to_fit FROM evaluations GROUP BY split_part(key, '/T', 1)""")
BOOK.check("label_bound_lookup", """
SELECT t.executor, t.tier, t.repetition, i.low FROM tiers t JOIN (SELECT executor, tier, min(f1) AS low FROM tiers GROUP BY executor, tier) i ON t.executor = i.executor AND t.tier = i.tier""")
BOOK.check("reconstruction_chain", """
SELECT count(*) AS specs, count(r.l_orderkey) AS answered, count(CASE WHEN r.n = s.want THEN 1 END) AS equal FROM (SELECT o_orderkey, o_orderkey % 7 AS want FROM orders) s
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) r ON s.o_orderkey = r.l_orderkey""")  # fmt: skip
BOOK.check("text_window_prefix", """
SELECT section, profile FROM (SELECT section, profile, row_number() OVER (PARTITION BY section ORDER BY profile) AS n FROM score_rows) p WHERE n <= 5""")
BOOK.check("label_sheet_assembly", """
SELECT 'decision' AS sample, CAST(count(*) AS BIGINT) AS n, count(DISTINCT profile) AS profiles FROM components JOIN terms USING (vendor, product)
UNION ALL SELECT 'panel', count(*), count(DISTINCT profile) FROM cells WHERE tier = 1""")


@BOOK.add("admitted_cohort", "SELECT count(*) FILTER (k IS NOT NULL) AS admitted, count(*) FILTER (k IS NULL) AS absent FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey")
def admitted_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, some = joins.distractors(view(spark, sf_dir, "orders"), view(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])
    both = some.select(F.lit(1).alias("a")).unionByName(none.select(F.lit(0).alias("a")))
    return both.agg(F.sum("a").alias("admitted"), F.count_if(F.col("a") == 0).alias("absent"))
