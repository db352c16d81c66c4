"""Queries of version-range applicability: matching, baseline rules, cross-checks, derived names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions import score as sc
from quillwork.functions import text as tx
from quillwork.functions import version as vs
from quillwork.operators import graph, joins
from quillwork.operators.aggregates import by_stratum
from quillwork.plans.base import Book, view

BOOK = Book()

#: A version as a list of numbers without trailing zeros, in DuckDB.
_KEY = r"string_split(regexp_replace({0}, '(\.0)+$', ''), '.')::BIGINT[]"
_V, _L, _U = _KEY.format("version"), _KEY.format("lower"), _KEY.format("upper")
_HIT = f"(({_V}) > ({_L}) OR (lower_inclusive AND ({_V}) = ({_L}))) AND (({_V}) < ({_U}) OR (upper_inclusive AND ({_V}) = ({_U})))"
_DECISIONS = f"SELECT profile, cve, bool_or({_HIT}) AS applies FROM components JOIN terms USING (vendor, product) GROUP BY profile, cve"


@BOOK.add("applicability_range_join", _DECISIONS)
def applicability_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.applicability(view(spark, sf_dir, "components"), view(spark, sf_dir, "terms"))


_BASELINE = f"""
WITH said AS ({_DECISIONS}),
known AS (SELECT c.profile, t.cve FROM components c JOIN terms t ON c.vendor = t.vendor AND c.product = t.product GROUP BY ALL),
rows AS (
  SELECT k.profile, CASE WHEN k.profile % 3 = 0 THEN 'easy' WHEN k.profile % 3 = 1 THEN 'medium' ELSE 'hard' END AS stratum,
         count(*) FILTER (applies) AS tp, 0 AS fp, 0 AS fn FROM known k JOIN said USING (profile, cve) GROUP BY k.profile)
SELECT 'all' AS panel, stratum, count(*) AS scheduled, count(*) AS n_valid, 1.0::DOUBLE AS coverage, sum(tp)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn,
       CASE WHEN sum(tp) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS micro_f1, CASE WHEN sum(tp) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS micro_precision,
       CASE WHEN sum(tp) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS micro_recall, CASE WHEN sum(tp) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS valid_f1
FROM rows GROUP BY GROUPING SETS ((), (stratum))
"""


@BOOK.add("rule_baseline_or_join", _BASELINE)
def rule_baseline_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory text and clause text only: parse both, join by spelling, decide, score against the range join."""
    components, terms = view(spark, sf_dir, "components"), view(spark, sf_dir, "terms")
    line = F.concat(F.lit("- "), "vendor", F.lit(" "), "product", F.lit("@"), "version")
    listed = components.groupBy("profile").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    items = listed.select("profile", F.explode(tx.inventory(F.col("text"))).alias("i")).select("profile", "i.name", "i.version")
    clause = tx.rendered_clause(*[F.col(c) for c in ("vendor", "product", "exact", "lower", "upper", "lower_inclusive", "upper_inclusive")])
    spoken = terms.select("cve", "vendor", "product", tx.clause_conditions(F.regexp_extract(clause, "version (.*)$", 1)).alias("conditions"))
    decided = joins.named_either_way(items, spoken).withColumn("verdict", joins.clause_verdict(F.col("version"), F.col("conditions")))
    said = decided.groupBy("profile", "cve").agg(vs.any_verdict(F.col("verdict")).alias("verdict"))
    truth = joins.applicability(components, terms)
    answers = truth.join(said, ["profile", "cve"], "left").groupBy("profile").agg(
        F.collect_list("cve").alias("candidates"), F.collect_list(F.when(F.col("applies"), F.col("cve"))).alias("gold"),
        F.collect_list(F.when(F.coalesce("verdict", F.lit(False)), F.col("cve"))).alias("said"),
    )
    stratum = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("profile") % 3 + 1).cast("int"))
    rows = answers.select(F.lit("all").alias("panel"), stratum.alias("stratum"), F.lit(True).alias("valid"), sc.counts(F.col("candidates"), F.col("gold"), F.col("said")).alias("s"))
    return by_stratum(rows.select("panel", "stratum", "valid", "s.tp", "s.fp", "s.fn"), "panel", "stratum")


_SECOND = """
SELECT c.profile, t.cve, max(CASE WHEN
         (c.major > t.lmajor OR (c.major = t.lmajor AND (c.minor > 0 OR c.patch > 0 OR t.lower_inclusive)))
         AND (c.major < t.umajor OR (c.major = t.umajor AND (c.minor < 5 OR (c.minor = 5 AND c.patch = 0 AND t.upper_inclusive)))) THEN 1 ELSE 0 END) = 1 AS applies
FROM (SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS profile, p_brand, p_type, p_size AS major, p_partkey % 10 AS minor, p_partkey % 3 AS patch FROM part) c
JOIN (SELECT concat('CVE-2024-', CAST(min(p_partkey) AS STRING)) AS cve, p_brand, p_type, min(p_size) AS lmajor, CAST(floor((min(p_size) + max(p_size)) / 2) AS INT) AS umajor,
             min(p_partkey) % 2 = 0 AS lower_inclusive, min(p_partkey) % 3 = 0 AS upper_inclusive FROM part GROUP BY p_brand, p_type) t
  ON c.p_brand = t.p_brand AND c.p_type = t.p_type
GROUP BY c.profile, t.cve
"""


@BOOK.add("oracle_disagreements", f"SELECT count(*) AS decisions, count(*) FILTER (applies) AS positive, 0::BIGINT AS disagreements FROM ({_DECISIONS})")
def oracle_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range join against a second statement of the rule that shares nothing with it but the tables."""
    from quillwork.plans.base import expand

    first, second = applicability_range_join(spark, sf_dir), spark.sql(expand(_SECOND, sf_dir)).withColumnRenamed("applies", "again")
    both = first.join(second, ["profile", "cve"], "full_outer")
    return both.agg(F.count(F.lit(1)).alias("decisions"), F.count_if("applies").alias("positive"), F.count_if(~F.col("applies").eqNullSafe(F.col("again"))).alias("disagreements"))


@BOOK.add("distractor_anti_join", """
SELECT cve, count(*) FILTER (NOT hit) AS distractor_profiles, count(*) FILTER (hit) AS related_profiles
FROM (SELECT t.cve, p.profile, EXISTS (SELECT 1 FROM components c WHERE c.profile = p.profile AND c.vendor = t.vendor AND c.product = t.product) AS hit
      FROM terms t, (SELECT DISTINCT profile FROM components) p)
GROUP BY cve""")  # fmt: skip
def distractor_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    components, terms = view(spark, sf_dir, "components"), view(spark, sf_dir, "terms")
    profiles = components.agg(F.count_distinct("profile")).first()[0]
    none, some = joins.distractors(terms, components, ["vendor", "product"])
    held = some.join(components.select("vendor", "product", "profile").distinct(), ["vendor", "product"]).groupBy("cve").agg(F.count(F.lit(1)).alias("related_profiles"))
    return held.unionByName(none.select("cve", F.lit(0).cast("long").alias("related_profiles"))).select(
        "cve", (F.lit(profiles) - F.col("related_profiles")).cast("long").alias("distractor_profiles"), "related_profiles"
    )


@BOOK.add("branch_pairs", """
WITH b AS (SELECT vendor AS product, cve AS id, lower || '|' || upper AS signature,
                  list_distinct([regexp_extract(lower, '^[0-9]+\\.[0-9]+'), regexp_extract(upper, '^[0-9]+\\.[0-9]+')]) AS branches FROM terms)
SELECT x.product, x.id AS a, y.id AS b FROM b x JOIN b y ON x.product = y.product AND x.id < y.id AND x.signature <> y.signature
WHERE list_sort(x.branches) <> list_sort(y.branches)""".replace("\\\\", "\\"))  # fmt: skip
def branch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = lambda c: F.regexp_extract(c, r"^[0-9]+\.[0-9]+", 0)
    terms = view(spark, sf_dir, "terms").select(
        F.col("vendor").alias("product"), F.col("cve").alias("id"), F.concat_ws("|", "lower", "upper").alias("signature"),
        F.array_sort(F.array_distinct(F.array(branch("lower"), branch("upper")))).alias("branches"),
    )
    return joins.branch_pairs(terms)


@BOOK.add("version_order_grid", f"""
WITH v AS (SELECT DISTINCT version, {_V} AS k, string_split(version, '.')[1] AS head FROM components)
SELECT a.version, count(*) FILTER (b.k < a.k) AS below, count(*) FILTER (b.k = a.k) AS same FROM v a JOIN v b USING (head) GROUP BY a.version""")  # fmt: skip
def version_order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version's place among those of its major number, by their order keys; equal keys share a place."""
    v = view(spark, sf_dir, "components").select("version", vs.version_key(F.col("version")).alias("k")).distinct().withColumn("head", F.split("version", r"\.")[0])
    w = Window.partitionBy("head").orderBy("k")
    same = F.count(F.lit(1)).over(Window.partitionBy("head", "k"))
    return v.select("version", (F.rank().over(w) - 1).cast("long").alias("below"), same.alias("same"))


@BOOK.add("bound_position", f"""
SELECT profile, component, cve, CASE WHEN {_V} = {_L} THEN CASE WHEN lower_inclusive THEN 'on_inclusive' ELSE 'on_exclusive' END WHEN {_V} < {_L} THEN 'below'
         WHEN {_V} = {_U} THEN CASE WHEN upper_inclusive THEN 'on_inclusive' ELSE 'on_exclusive' END ELSE 'above' END AS place,
       coalesce((lower_inclusive AND {_V} = {_L}) OR (upper_inclusive AND {_V} = {_U}), false) AS on_bound
FROM components JOIN terms USING (vendor, product)""")  # fmt: skip
def bound_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [vs.version_key(F.col(c)) for c in ("version", "lower", "upper")]
    pairs = view(spark, sf_dir, "components").join(view(spark, sf_dir, "terms"), ["vendor", "product"])
    inclusive = [F.col("lower_inclusive"), F.col("upper_inclusive")]
    # Every version inside both bounds is above the first one.
    return pairs.select("profile", "component", "cve", F.coalesce(vs.position(*keys, *inclusive), F.lit("above")).alias("place"), vs.on_inclusive_bound(*keys, *inclusive).alias("on_bound"))


@BOOK.add("near_miss_probes", """
WITH b AS (SELECT cve, 'lower' AS e, lower AS v FROM terms UNION ALL SELECT cve, 'upper', upper FROM terms),
s AS (SELECT cve, e, v, string_split(v, '.')[1] AS head, string_split(v, '.')[2]::BIGINT AS tail FROM b)
SELECT cve, 'on_' || e AS kind, v AS version FROM s UNION ALL SELECT cve, e || '_plus', head || '.' || (tail + 1) FROM s
UNION ALL SELECT cve, e || '_minus', head || '.' || (tail - 1) FROM s WHERE tail > 0 UNION ALL SELECT cve, e || '_zero', v || '.0' FROM s
UNION ALL SELECT cve, e || '_one', v || '.1' FROM s UNION ALL SELECT cve, e || '_trap', v || '0' FROM s""")  # fmt: skip
def near_miss_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "terms").select("cve", F.explode(vs.near_misses(F.col("lower"), F.col("upper"))).alias("p")).select("cve", "p.kind", "p.version")


@BOOK.add("clause_rendering", """
SELECT cve, vendor || '/' || product || ': version ' || CASE WHEN lower_inclusive THEN '>= ' ELSE '> ' END || lower || ' and '
       || CASE WHEN upper_inclusive THEN '<= ' ELSE '< ' END || upper AS clause FROM terms""")  # fmt: skip
def clause_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "terms").select("cve", tx.rendered_clause(*[F.col(c) for c in ("vendor", "product", "exact", "lower", "upper", "lower_inclusive", "upper_inclusive")]).alias("clause"))


@BOOK.add("kleene_combine", """
SELECT l_orderkey, CASE WHEN count(*) FILTER (v) > 0 THEN true WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE false END AS verdict
FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag = 'A' END AS v FROM lineitem) GROUP BY l_orderkey""")  # fmt: skip
def kleene_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "A")
    return view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(vs.any_verdict(v).alias("verdict"))


@BOOK.add("identity_resolution", """
WITH alias AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS k, min(p_brand) AS vendor, count(DISTINCT p_brand) AS n FROM part GROUP BY 1)
SELECT s_suppkey, a.vendor FROM (SELECT s_suppkey, 'brand' || (s_suppkey % 60) AS k FROM supplier) s LEFT JOIN alias a ON a.k = s.k AND a.n = 1""")  # fmt: skip
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names folded on both sides; a folded name resolves only if exactly one vendor has it."""
    alias = view(spark, sf_dir, "part").groupBy(tx.family(F.col("p_brand")).alias("k")).agg(F.min("p_brand").alias("vendor"), F.count_distinct("p_brand").alias("n")).where("n = 1")
    named = view(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("brand"), (F.col("s_suppkey") % 60).cast("string")).alias("k"))
    return named.join(alias, "k", "left").select("s_suppkey", "vendor")


@BOOK.add("product_components")
def product_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order are connected; each order links its parts to its smallest one."""
    lines = view(spark, sf_dir, "lineitem")
    return graph.components(graph.stars(lines, "l_orderkey", "l_partkey"), "a", "b", lines.count())
