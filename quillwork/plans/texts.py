"""Queries of text functions: names, keys, features, cues, renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import text as tx
from quillwork.plans.base import Book, view

BOOK = Book()


@BOOK.add("name_normalise", r"""
SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_type), '[\s\-_/@.,]+', '', 'g') AS name, regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]', '', 'g') AS family FROM part""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", "p_type")
    return view(spark, sf_dir, "part").select("p_partkey", tx.normalised_name(name).alias("name"), tx.family(name).alias("family"))


@BOOK.add("inventory_lines", """
WITH l AS (SELECT profile, count(*) AS lines, count(*) FILTER (component % 5 <> 0) AS versions, min(vendor || ' ' || product) AS first_name FROM components GROUP BY profile)
SELECT profile, lines, versions, first_name FROM l""")  # fmt: skip
def inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories written in three styles and read back."""
    name = F.concat_ws(" ", "vendor", "product")
    style = F.when(F.col("component") % 5 == 0, F.regexp_replace(name, " ", " ")).when(F.col("component") % 2 == 0, F.concat(name, F.lit("@"), "version")).otherwise(F.concat(F.lit("- "), name, F.lit(" "), "version"))
    listed = view(spark, sf_dir, "components").groupBy("profile").agg(F.array_join(F.collect_list(style), "\n").alias("t"))
    item = listed.select("profile", F.explode(tx.inventory(F.col("t"))).alias("i"))
    return item.groupBy("profile").agg(
        F.count(F.lit(1)).alias("lines"), F.count("i.version").alias("versions"), F.min(F.regexp_replace("i.name", " ", " ")).alias("first_name")
    )


_ARMS = "['main', 'gepa', 'reference', 'sealed', 'selection', 'ceiling', 'calibration', 'scaffolding', 'real_record', 'other']"


@BOOK.add("key_split", f"""
WITH k AS (SELECT o_orderkey AS id, {_ARMS}[o_orderkey % 10 + 1] AS arm, o_orderkey % 10 AS a, 'model:' || o_custkey % 3 || CASE WHEN o_custkey % 2 = 0 THEN '/on' ELSE '' END AS executor FROM orders)
SELECT id, arm, CASE WHEN a < 9 THEN executor ELSE '' END AS executor, CASE WHEN a < 3 THEN (id % 3 + 1)::VARCHAR ELSE '' END AS tier, CASE WHEN a < 3 THEN (id % 5)::VARCHAR ELSE '' END AS repetition,
  CASE WHEN a < 3 THEN 'r' || id % 8 || '/T9' WHEN a IN (6, 7) THEN 'naive' ELSE '' END AS stage, CASE a WHEN 3 THEN 'test' WHEN 4 THEN 'validation' WHEN 5 THEN 'temporal' WHEN 8 THEN 'real_record' ELSE '' END AS panel FROM k""")  # fmt: skip
def key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every shape, whose executors may hold a slash and whose stages may look like a tier."""
    key = F.expr("""concat_ws('/', element_at(array('main', 'gepa', 'reference', 'sealed', 'selection', 'ceiling', 'calibration', 'scaffolding', 'real_record', 'other'), int(o_orderkey % 10 + 1)),
        concat('model:', o_custkey % 3, if(o_custkey % 2 = 0, '/on', '')),
        CASE o_orderkey % 10 WHEN 3 THEN 'test/x' WHEN 4 THEN 'x' WHEN 5 THEN 'temporal' WHEN 6 THEN 'naive' WHEN 7 THEN 'naive' WHEN 8 THEN 'abc' WHEN 9 THEN 'y' ELSE concat('T', o_orderkey % 3 + 1, '/R', o_orderkey % 5, '/r', o_orderkey % 8, '/T9') END,
        concat('item_', o_orderkey))""")
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tx.split_key(key).alias("k")).select("id", "k.*")


@BOOK.add("keyword_features", rf"""
SELECT conv_id, turn, length(text) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(?:[-*]|[0-9]+[.)])\s'))) AS rule_lines,
       {", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS {n}" for n, p in tx.KEYWORD_FAMILIES.items())}, ceil(length(text) / 4)::BIGINT AS tokens FROM conversations""")  # fmt: skip
def keyword_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return view(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.length(t).cast("long").alias("chars"), tx.rule_lines(t).alias("rule_lines"), *tx.keyword_counts(t), tx.estimated_tokens(t).alias("tokens")
    )


@BOOK.add("scope_cues", rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{tx.CUES}'))), ',') AS cues FROM documents""")
def scope_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.scope_cues(F.col("text")), ",").alias("cues"))


@BOOK.add("number_formats", "SELECT tier, executor, repetition, printf('%.3f', f1) AS fixed, printf('%+.4f', f1 - 0.5) AS signed FROM tiers")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tiers").select("tier", "executor", "repetition", tx.fixed_digits(F.col("f1")).alias("fixed"), tx.signed_digits(F.col("f1") - 0.5).alias("signed"))


@BOOK.add("chronology", "SELECT o_orderkey, strftime(o_orderdate, 'run-%Y%m%dT%H%M%SZ') AS run, date_trunc('second', o_orderdate) AS at FROM orders")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("Z")).alias("run"))
    return named.withColumn("at", tx.run_time(F.col("run")))


BOOK.check("alias_styles", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(lower(p_type), ' ', CAST(p_size AS STRING)) WHEN 1 THEN concat(lower(p_brand), '-', lower(p_type), ' ', CAST(p_size AS STRING))
  WHEN 2 THEN concat(lower(p_brand), '/', lower(p_type), '@', CAST(p_size AS STRING)) ELSE concat(p_brand, ' ', p_type, ' ', CAST(p_size AS STRING)) END AS line FROM part""")  # fmt: skip
BOOK.check("predicate_shape", """
SELECT vendor, CASE WHEN count(*) > 5 THEN 'multi_term_or' WHEN max(lower) = max(upper) THEN 'exact' ELSE 'single_range' END AS shape FROM terms GROUP BY vendor""")
BOOK.check("publication_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY CAST(year(o_orderdate) AS BIGINT)")


@BOOK.add("predicate_signature", "SELECT vendor, sha256(string_agg(lower || '..' || upper, ';' ORDER BY cve)) AS signature FROM terms GROUP BY vendor")
def predicate_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform(F.array_sort(F.collect_list(F.struct("cve", F.concat_ws("..", "lower", "upper").alias("s")))), lambda x: x["s"])
    return view(spark, sf_dir, "terms").groupBy("vendor").agg(F.sha2(F.array_join(spans, ";"), 256).alias("signature"))


@BOOK.add("interval_probes", """
WITH b AS (SELECT DISTINCT vendor, p FROM (SELECT vendor, string_split(lower, '.')[1]::INT AS p FROM terms UNION ALL SELECT vendor, string_split(upper, '.')[1]::INT FROM terms)),
n AS (SELECT vendor, p, lead(p) OVER (PARTITION BY vendor ORDER BY p) AS nxt FROM b)
SELECT vendor, 'bound' AS kind, p::DOUBLE AS probe FROM n UNION ALL SELECT vendor, 'inside', (p + nxt) / 2 FROM n WHERE nxt IS NOT NULL UNION ALL SELECT vendor, 'tail', p + 1.0 FROM n WHERE nxt IS NULL""")  # fmt: skip
def interval_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bound, a witness inside every gap, and a point behind the last bound."""
    from pyspark.sql import Window

    major = lambda c: F.split(c, r"\.")[0].cast("int")
    bounds = view(spark, sf_dir, "terms").select("vendor", F.explode(F.array(major("lower"), major("upper"))).alias("p")).distinct()
    nxt = bounds.withColumn("nxt", F.lead("p").over(Window.partitionBy("vendor").orderBy("p")))
    probe = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("probe"))
    p, n = F.col("p"), F.col("nxt")
    spread = nxt.select("vendor", F.explode(F.array(probe("bound", p), F.when(n.isNotNull(), probe("inside", (p + n) / 2)).otherwise(probe("tail", p + 1)))).alias("x"))
    return spread.select("vendor", "x.kind", "x.probe")


@BOOK.add("json_dialects", "SELECT event_id, event_type, round(value, 6) AS value, strlen(props) > 2 AS has_props FROM events")
def json_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record dialects read with their own schemas and brought to one."""
    e = view(spark, sf_dir, "events")
    a = e.where("event_id % 2 = 0").select(F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), "value", "props")).alias("j"))
    b = e.where("event_id % 2 = 1").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.struct("value", "props").alias("body"))).alias("j"))
    ra = a.select(F.from_json("j", "event_id bigint, kind string, value double, props string", {"mode": "FAILFAST"}).alias("r")).select("r.event_id", F.col("r.kind").alias("event_type"), "r.value", "r.props")
    rb = b.select(F.from_json("j", "id bigint, type string, body struct<value:double,props:string>", {"mode": "FAILFAST"}).alias("r")).select(
        F.col("r.id").alias("event_id"), F.col("r.type").alias("event_type"), "r.body.value", "r.body.props"
    )
    both = ra.unionByName(rb, allowMissingColumns=True)
    return both.select("event_id", "event_type", F.round("value", 6).alias("value"), (F.octet_length("props") > 2).alias("has_props"))
