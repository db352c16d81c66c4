"""Report queries: roll-ups, pivots, ledgers, gates, audits as constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators import aggregates as ag
from quillwork.plans.base import Book, view

BOOK = Book()


@BOOK.add("panel_pivot", """
SELECT executor, repetition, round(max(f1) FILTER (tier = '1-URGENT'), 6) AS p1, round(max(f1) FILTER (tier = '2-HIGH'), 6) AS p2, round(max(f1) FILTER (tier = '3-MEDIUM'), 6) AS p3 FROM tiers GROUP BY ALL""")
def panel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"1-URGENT": "p1", "2-HIGH": "p2", "3-MEDIUM": "p3"}
    wide = view(spark, sf_dir, "tiers").groupBy("executor", "repetition").pivot("tier", list(names)).agg(F.first("f1"))
    return wide.select("executor", "repetition", *[F.round(F.col(f"`{k}`"), 6).alias(v) for k, v in names.items()])


BOOK.check("partition_rollup", """
SELECT section, count(*) AS profiles, CAST(sum(tp + fn) AS BIGINT) AS positives, round(CAST(sum(tp + fn) AS DOUBLE) / greatest(count(*), 1), 6) AS prevalence,
       count(DISTINCT n_chars) AS distinct_sizes, round(CAST(count(*) AS DOUBLE) / greatest(count(DISTINCT n_chars), 1), 6) AS mean_appearances
FROM score_rows GROUP BY section""")  # fmt: skip


@BOOK.add("value_count_maps", """
WITH c AS (SELECT section, stratum, count(*) AS n FROM score_rows GROUP BY ALL)
SELECT section, string_agg(stratum || '=' || n, ',' ORDER BY stratum) AS strata FROM c GROUP BY section""")
def value_count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = view(spark, sf_dir, "score_rows").groupBy("section", "stratum").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", "n")))).alias("m"))
    return maps.select("section", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("strata"))


BOOK.check("overlap_sets", """
SELECT key, sides FROM (SELECT l_partkey AS key, count(DISTINCT l_returnflag) AS sides FROM lineitem GROUP BY l_partkey) k WHERE sides > 1""")
BOOK.check("exclusion_reasons", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 20000 THEN 'too_small' ELSE 'admitted' END AS reason, count(*) AS n
FROM orders GROUP BY CAST(year(o_orderdate) AS BIGINT), CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 20000 THEN 'too_small' ELSE 'admitted' END""")  # fmt: skip
BOOK.check("cell_summary_population_sd", """
SELECT executor, tier, count(*) AS n, round(avg(f1), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(f1) END, 6) AS sd FROM tiers GROUP BY executor, tier""")
BOOK.check("tier_means_sample_sd", """
SELECT executor, tier, n, mean, sd FROM (
  SELECT CAST(executor AS STRING) AS executor, tier, count(*) AS n, round(avg(f1), 6) AS mean, round(coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(f1) END, 0), 6) AS sd FROM tiers GROUP BY executor, tier
  UNION ALL SELECT 'pooled', tier, count(*), round(avg(f1), 6), 0.0 FROM tiers GROUP BY tier) t""")  # fmt: skip
BOOK.check("trajectory_listing", "SELECT executor, tier, repetition, round(f1, 6) AS f1, n FROM tiers WHERE tier <> '5-LOW'")
BOOK.check("budget_range", """
SELECT l_returnflag, min(n) AS least_calls, max(n) AS most_calls, CAST(sum(n) AS BIGINT) AS calls FROM (
  SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_suppkey) s GROUP BY l_returnflag""")  # fmt: skip
BOOK.check("cost_by_lineage", """
SELECT p.o_custkey AS section, round(sum(p.o_totalprice), 2) AS seconds, count(c.l_orderkey) AS children FROM orders p
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') c ON p.o_orderkey = c.l_orderkey GROUP BY p.o_custkey""")  # fmt: skip


@BOOK.add("portability_lists", "SELECT executor, tier, string_agg(round(f1, 3)::VARCHAR, ' ' ORDER BY repetition) AS listed FROM tiers GROUP BY ALL")
def portability_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("repetition", F.round("f1", 3).cast("string").alias("v"))))
    return view(spark, sf_dir, "tiers").groupBy("executor", "tier").agg(F.array_join(F.transform(pairs, lambda p: p["v"]), " ").alias("listed"))


@BOOK.add("disclosure_volume", """
SELECT role, count(*) AS n, median(strlen(text))::DOUBLE AS median_bytes, min(strlen(text)) AS least, max(strlen(text)) AS most FROM conversations GROUP BY role""")
def disclosure_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "conversations").select("role", F.octet_length("text").cast("long").alias("b"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"), F.max("b").alias("most")).join(ag.medians(rows, ["role"], "b", "median_bytes"), "role")


BOOK.check("real_record_summary", """
SELECT stratum, count(*) AS n, count(CASE WHEN valid THEN 1 END) AS decided, count(CASE WHEN NOT valid THEN 1 END) AS unsure,
       count(CASE WHEN valid AND pred = truth THEN 1 END) AS agreed, round(CAST(count(CASE WHEN valid THEN 1 END) AS DOUBLE) / count(*), 6) AS coverage
FROM score_rows GROUP BY stratum""")  # fmt: skip
BOOK.check("margin_flags", """
SELECT executor, round(a - b, 6) AS delta, a - b > -0.02 AS retained, abs(a - b) < 0.02 AS equivalent FROM (
  SELECT executor, avg(CASE WHEN tier = '2-HIGH' THEN f1 END) AS a, avg(CASE WHEN tier = '3-MEDIUM' THEN f1 END) AS b FROM tiers GROUP BY executor) t""")  # fmt: skip


@BOOK.add("ledger_dedupe", """
WITH a AS (SELECT o_custkey % 3 AS provider, o_orderkey // 2 AS request, CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(38, 2) END AS cost, 100000.00::DECIMAL(38, 2) AS reserved FROM orders),
o AS (SELECT request, provider, max(cost) AS cost, max(reserved) AS reserved FROM a GROUP BY ALL)
SELECT provider, count(*) AS attempts, coalesce(sum(cost), 0)::DOUBLE AS cost, coalesce(sum(reserved) FILTER (cost IS NULL), 0)::DOUBLE AS reserved FROM o GROUP BY provider""")  # fmt: skip
def ledger_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money adds up as decimals and is shown as double at the end."""
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(38,2)"))
    attempts = view(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("provider"), F.expr("o_orderkey div 2").alias("request"), price.alias("cost"), F.lit("100000.00").cast("decimal(38,2)").alias("reserved")
    )
    return ag.ledger(attempts).select("provider", "attempts", F.col("cost").cast("double"), F.col("reserved").cast("double"))


BOOK.check("scope_usage", """
SELECT o_orderpriority AS scope, CAST(sum(last_n) AS BIGINT) AS used FROM (
  SELECT o_orderpriority, o_custkey, max(o_orderkey) AS last_n FROM orders GROUP BY o_orderpriority, o_custkey) s GROUP BY o_orderpriority""")
BOOK.check("resource_summary", """
SELECT o_custkey % 7 AS run, count(*) AS attempts, round(sum(o_totalprice), 2) AS seconds, count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END) AS missing_tokens,
       CASE WHEN count(CASE WHEN o_orderkey % 13 = 0 THEN 1 END) = 0 THEN CAST(sum(o_custkey) AS BIGINT) END AS tokens FROM orders GROUP BY o_custkey % 7""")  # fmt: skip
BOOK.check("measurements", """
SELECT o_orderpriority, count(*) AS calls, round(sum(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 60000) + 0.5), 2) AS seconds FROM orders GROUP BY o_orderpriority""")
BOOK.check("audit_totals", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(CASE WHEN value > 100 THEN 1 END) AS failures, max(event_id) - min(event_id) AS span FROM events GROUP BY event_type""")
BOOK.check("calibration_gate", """
SELECT source, f1, coverage, concat_ws(';', CASE WHEN f1 < 0.3 OR f1 > 0.9 THEN 'f1_out_of_range' END, CASE WHEN coverage < 0.4 THEN 'low_coverage' END) AS reasons,
       f1 BETWEEN 0.3 AND 0.9 AND coverage >= 0.4 AS eligible
FROM (SELECT section AS source, round(2.0 * sum(tp) / greatest(sum(2 * tp + fp + fn), 1), 4) AS f1, round(CAST(count(CASE WHEN valid THEN 1 END) AS DOUBLE) / count(*), 6) AS coverage FROM score_rows GROUP BY section) s""".replace("2.0 * sum(tp)", "CAST(2 * sum(tp) AS DOUBLE)"))  # fmt: skip
BOOK.check("panel_counts", """
SELECT section, count(*) AS n, count(DISTINCT stratum) AS strata, min(n_chars) AS smallest, max(n_chars) AS largest FROM score_rows GROUP BY section""")
BOOK.check("forecast", """
SELECT l.tier AS tier, d.depth, round(l.mean_seconds * d.depth * 24, 3) AS seconds, l.mean_seconds * d.depth * 24 <= 20000000 AS fits
FROM (SELECT o_orderpriority AS tier, avg(o_totalprice) AS mean_seconds FROM orders GROUP BY o_orderpriority) l
CROSS JOIN (SELECT DISTINCT l_linenumber AS depth FROM lineitem WHERE l_linenumber <= 7) d""")  # fmt: skip
BOOK.check("parse_coverage", """
SELECT profile % 4 AS panel, count(*) AS pairs, count(CASE WHEN version LIKE '%.0.%' THEN 1 END) AS version_unsupported, count(CASE WHEN version LIKE '1%' THEN 1 END) AS first_ones FROM components JOIN terms USING (vendor, product) GROUP BY profile % 4""")
BOOK.check("reconstruction_metrics", """
SELECT tier, repetition, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(CAST(2 * sum(tp) AS DOUBLE) / sum(2 * tp + fp + fn), 6) AS micro_f1 FROM cells GROUP BY tier, repetition""")
BOOK.check("schedule_grid", """
SELECT c.executor, t.tier, r.repetition FROM (SELECT DISTINCT executor FROM tiers) c CROSS JOIN (SELECT DISTINCT tier FROM tiers) t CROSS JOIN (SELECT DISTINCT repetition FROM tiers) r""")
BOOK.check("planned_vs_done", """
SELECT p.o_orderkey FROM orders p LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) d ON p.o_orderkey = d.l_orderkey WHERE d.l_orderkey IS NULL""")


@BOOK.add("journal_integrity", """
WITH s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 101 <> 0), r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 103 <> 0 GROUP BY 1)
SELECT count(*) AS works, count(*) FILTER (r.id IS NULL) AS without_result, count(*) FILTER (s.id IS NULL) AS without_spec, count(*) FILTER (n > 6) AS repeated FROM s FULL JOIN r ON s.id = r.id""")  # fmt: skip
def journal_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = view(spark, sf_dir, "orders").where("o_orderkey % 101 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("s"))
    done = view(spark, sf_dir, "lineitem").where("l_orderkey % 103 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return spec.join(done, "id", "full_outer").agg(
        F.count(F.lit(1)).alias("works"), F.count_if(F.col("n").isNull()).alias("without_result"), F.count_if(F.col("s").isNull()).alias("without_spec"), F.count_if(F.col("n") > 6).alias("repeated")
    )


@BOOK.add("fresh_vs_recorded", """
WITH a AS (SELECT o_orderkey, o_orderstatus AS s FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 = 0)
SELECT count(*) AS fresh, count(b.o_orderkey) AS compared, count(*) FILTER (b.o_orderkey IS NOT NULL AND a.s IS NOT DISTINCT FROM b.s) AS identical FROM a LEFT JOIN b USING (o_orderkey)""")  # fmt: skip
def fresh_vs_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = view(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    recorded = orders.where(k % 3 == 0).select("o_orderkey", F.when(k % 10 == 0, None).when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("r"), F.lit(1).alias("seen"))
    both = orders.select("o_orderkey", F.col("o_orderstatus").alias("s")).join(recorded, "o_orderkey", "left")
    return both.agg(F.count(F.lit(1)).alias("fresh"), F.count("seen").alias("compared"), F.count_if(F.col("seen").isNotNull() & F.col("s").eqNullSafe(F.col("r"))).alias("identical"))


BOOK.check("decision_cells", """
SELECT c.l_orderkey, c.l_linenumber, CASE WHEN g.l_orderkey IS NOT NULL AND s.l_orderkey IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN g.l_orderkey IS NULL AND s.l_orderkey IS NOT NULL THEN 1 ELSE 0 END AS fp,
       CASE WHEN g.l_orderkey IS NOT NULL AND s.l_orderkey IS NULL THEN 1 ELSE 0 END AS fn
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) c LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') g ON c.l_orderkey = g.l_orderkey AND c.l_linenumber = g.l_linenumber
LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') s ON c.l_orderkey = s.l_orderkey AND c.l_linenumber = s.l_linenumber""")  # fmt: skip
BOOK.check("trajectory_evaluations", """
SELECT t.executor, t.tier, t.repetition, count(*) AS rows, round(avg(e.latency), 4) AS latency FROM tiers t
JOIN (SELECT o_custkey % 2 AS executor, CAST(year(o_orderdate) AS BIGINT) AS repetition, o_totalprice AS latency FROM orders) e ON t.executor = e.executor AND t.repetition = e.repetition
GROUP BY t.executor, t.tier, t.repetition""")  # fmt: skip
BOOK.check("related_spelling", """
SELECT p.p_partkey, count(q.p_partkey) AS related FROM (SELECT p_partkey, lower(p_brand) AS b, lower(p_type) AS t FROM part) p
LEFT JOIN (SELECT p_partkey, lower(p_brand) AS b, lower(p_type) AS t FROM part) q ON p.b IS NOT DISTINCT FROM q.b AND p.t = q.t GROUP BY p.p_partkey""")  # fmt: skip
BOOK.check("sheet_join", "SELECT d.lang, l.quality, l.toxic, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang, l.quality, l.toxic")
BOOK.check("decision_audit", """
SELECT profile, count(*) AS candidates, count(DISTINCT cve) AS cves, count(CASE WHEN part <> 'a' THEN 1 END) AS wrong_part FROM components JOIN terms USING (vendor, product) GROUP BY profile""")
BOOK.check("size_filter", "SELECT doc_id FROM documents WHERE length(text) + length(source) <= 3000")
