"""Queries of producers' records: corroboration, identity, statuses, bounds in prose, lists of names. Spark builds nested records from
flat rows; the SQL says from the flat rows alone which rule decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import text as tx
from quillwork.operators import corroboration as co
from quillwork.operators.lineage import written
from quillwork.plans.base import Book, view

BOOK = Book()

#: Lines of orders as affected products; m chooses the fault of a line.
_CVE = "concat('CVE-2024-', o) AS cve"
_LINE = "l_orderkey AS o, l_linenumber AS q, l_partkey AS k, l_partkey % 40 AS m"
_VENDOR = "CASE WHEN l_partkey % 40 = 18 THEN 'apache' ELSE concat('brand_', substr(p_brand, 7)) END"
_PRODUCT = "CASE WHEN l_partkey % 40 = 18 THEN 'superset' ELSE concat(lower(p_type), '_kit') END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    joined = view(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    return joined.selectExpr("l_orderkey AS o", "l_linenumber AS q", "l_partkey AS k", "l_partkey % 40 AS m", f"{_VENDOR} AS vendor", f"{_PRODUCT} AS product")


def _records(lines: DataFrame) -> DataFrame:
    """One record per order: its lines (_lines) are affected products."""
    entry = "named_struct('version', {0}, 'lessThan', {1}, 'lessThanOrEqual', {2}, 'versionType', if(m = 6, 'git', 'semver'), 'status', if(m = 4, 'unaffected', 'affected'), 'changes', false)"
    at = lambda n: f"concat(q + {n}, '.0')"
    start = "if(m = 8, 'x', concat(q, '.0'))"
    whole = f"array({entry.format(start, f'CASE WHEN m = 7 THEN {at(0)} WHEN m = 17 THEN null WHEN m = 19 THEN {chr(39)}*{chr(39)} ELSE {at(5)} END', f'if(m = 5 or m = 17, {at(5)}, null)')})"
    two = lambda a, b: f"array({entry.format(start, at(a), 'null')}, {entry.format(at(b), at(5), 'null')})"
    none = f"cast(array() as array<{co.ENTRY}>)"
    entries = f"CASE m WHEN 3 THEN {none} WHEN 14 THEN {two(2, 2)} WHEN 15 THEN {two(3, 2)} WHEN 16 THEN {two(2, 3)} ELSE {whole} END"
    cpe = "concat('cpe:2.3:', if(m = 10, 'o', 'a'), ':', vendor, ':', if(m = 11, 'other', product), ':*:*:*:*:*:*:*:*')"
    affected = f"""cast(named_struct('vendor', CASE m WHEN 12 THEN null WHEN 18 THEN 'Apache Software Foundation' ELSE replace(vendor, '_', ' ') END,
        'product', CASE m WHEN 13 THEN 'other' WHEN 18 THEN 'Apache Superset' ELSE product END, 'cpes', if(m in (9, 10, 11), array({cpe}), null),
        'defaultStatus', if(m = 1, 'affected', 'unaffected'), 'constraints', m = 2, 'versions', {entries}) as {co.AFFECTED})"""
    # By the id that records are joined on, so that they stay where they are.
    placed = lines.select(F.expr(_CVE), "o", F.struct("q", "k", F.expr(affected).alias("a")).alias("x"))
    held = placed.groupBy("cve").agg(F.min("o").alias("o"), F.transform(F.sort_array(F.collect_list("x")), lambda x: x["a"]).alias("affected"))
    return held.selectExpr(
        "cve", "if(o % 31 = 0, 'OTHER', 'CVE_RECORD') AS kind", "if(o % 37 = 0, 'REJECTED', 'PUBLISHED') AS state", "if(o % 29 = 0, null, cve) AS told",
        f"if(o % 41 = 0, cast(array() as array<{co.AFFECTED}>), affected) AS affected",
    )


def _terms(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """The advisory of an order: a range for each line, and for some orders a product that no line names."""
    own = lines.select(F.expr(_CVE), "vendor", "product", F.expr("concat(q, '.0') AS lower"), F.expr("concat(q + 5, '.0') AS upper"))
    ghost = view(spark, sf_dir, "lineitem").where("l_orderkey % 43 = 0").selectExpr("concat('CVE-2024-', l_orderkey) AS cve", "'brand_0' AS vendor", "'ghost' AS product", "'1.0' AS lower", "'2.0' AS upper")
    return own.unionByName(ghost).withColumns({"exact": F.lit(None).cast("string"), "lower_inclusive": F.lit(True), "upper_inclusive": F.lit(False)})


@BOOK.add("corroboration_rules", f"""
WITH l AS (
  SELECT {_LINE}, {_VENDOR.replace("concat('brand_', substr(p_brand, 7))", "'brand_' || substr(p_brand, 7)")} AS vendor, {_PRODUCT.replace("concat(lower(p_type), '_kit')", "lower(p_type) || '_kit'")} AS product,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT *, CASE m WHEN 1 THEN 'cna_unknown_or_nonnegative_default' WHEN 2 THEN 'cna_additional_platform_or_component_constraints' WHEN 3 THEN 'cna_missing_or_excessive_versions'
    WHEN 4 THEN 'cna_explicit_status_override_or_unknown' WHEN 5 THEN 'cna_conflicting_upper_bounds' WHEN 6 THEN 'cna_unsupported_version_type' WHEN 7 THEN 'cna_empty_or_inverted_range'
    WHEN 8 THEN 'unsupported_numeric_version' WHEN 10 THEN 'cna_cpe_constraints' WHEN 11 THEN 'cna_cpe_product_mismatch' WHEN 12 THEN 'cna_missing_product_identity' WHEN 13 THEN 'cna_product_identity_not_confirmed' END AS fault FROM l),
d AS (SELECT *, CASE WHEN fault IS NULL AND count(*) FILTER (fault IS NULL) OVER (PARTITION BY o, vendor, product ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'cna_duplicate_product_scopes' ELSE fault END AS reason FROM f),
s AS (SELECT o, min_by(reason, r) FILTER (reason IS NOT NULL) AS first, bool_or(m IN (15, 16, 17, 19)) AS differs, sum(CASE WHEN m = 14 THEN 8 ELSE 6 END)::BIGINT AS n FROM d GROUP BY o),
t AS (SELECT o, n, CASE WHEN o % 31 = 0 OR o % 37 = 0 OR o % 29 = 0 THEN 'cna_identity_or_publication_state' WHEN o % 41 = 0 THEN 'cna_missing_affected' WHEN first IS NOT NULL THEN first
    WHEN o % 43 = 0 THEN 'cna_incomplete_product_coverage' WHEN differs THEN 'nvd_cna_numeric_predicate_disagreement' END AS reason FROM s)
SELECT 'CVE-2024-' || o AS cve, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS probes FROM t""")  # fmt: skip
def corroboration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = written(_lines(spark, sf_dir), "lines")  # of the records and of the advisories
    return co.corroborate(_records(lines), _terms(spark, sf_dir, lines))


@BOOK.add("product_identity", """
SELECT l_orderkey AS o, l_linenumber AS q, l_partkey AS k, count(*) AS n, CASE WHEN any_value(l_partkey % 40) IN (10, 11, 12, 13) THEN NULL WHEN any_value(l_partkey % 40) = 18 THEN 'apache/superset'
  ELSE any_value('brand_' || substr(p_brand, 7) || '/' || lower(p_type) || '_kit') END AS pair FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""")  # fmt: skip
def product_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' names against the products of their order: by CPE names, by folded names, by aliases."""
    lines = _lines(spark, sf_dir).groupBy("o", "q", "k", "m", "vendor", "product").agg(F.count(F.lit(1)).alias("n"))
    cpe = F.concat(F.when(F.col("m") == 10, "cpe:2.3:o:").otherwise("cpe:2.3:a:"), "vendor", F.lit(":"), F.when(F.col("m") == 11, "other").otherwise(F.col("product")), F.lit(":*:*:*:*:*:*:*:*"))
    named = lines.select(
        F.col("o").alias("cve"), F.struct("q", "k").alias("row"), "n",
        F.when(F.col("m") == 12, None).when(F.col("m") == 18, "Apache Software Foundation").otherwise(F.upper("vendor")).alias("vendor"),
        F.when(F.col("m") == 13, "other").when(F.col("m") == 18, "Apache Superset").otherwise(F.replace("product", F.lit("_"), F.lit("-"))).alias("product"),
        F.when(F.col("m").isin(9, 10, 11), F.array(cpe)).alias("cpes"),
    )
    found = co.resolved(named, lines.select(F.col("o").alias("cve"), "vendor", "product"))
    pair = F.when(F.col("identity_reason").isNull(), F.get("pairs", F.lit(0)))
    return found.select(F.col("cve").alias("o"), "row.q", "row.k", "n", F.concat_ws("/", pair["vendor"], pair["product"]).alias("pair")).withColumn("pair", F.nullif("pair", F.lit("")))


@BOOK.add("component_statuses", """
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS q, l_partkey AS k, 'brand_' || substr(p_brand, 7) AS vendor, lower(p_type) || '_kit' AS product, l_returnflag AS flag FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT o, vendor, product, min(q) AS low FROM l WHERE flag <> 'N' GROUP BY ALL),
x AS (SELECT l.o, l.q, l.vendor, l.product, l.q || '.' || (l.k % 10) AS v, CASE WHEN s.o IS NULL THEN 'unrelated_product' WHEN q >= low AND q < low + 3 THEN 'affected' ELSE 'unaffected' END AS status
      FROM l LEFT JOIN s ON s.o = l.o AND s.vendor = l.vendor AND s.product = l.product WHERE l.o IN (SELECT o FROM s))
SELECT o, string_agg(status, ',' ORDER BY q, vendor, product, v, status) AS statuses, bool_or(status = 'affected') AS applicable FROM x GROUP BY o""")  # fmt: skip
def component_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as components under the record of their order, which names the products of the lines that are not N."""
    flags = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    rows = flags.selectExpr("l_orderkey AS profile", "l_linenumber AS position", "l_returnflag AS flag", "concat('brand_', substr(p_brand, 7)) AS vendor", "concat(lower(p_type), '_kit') AS product", "concat(l_linenumber, '.', l_partkey % 10) AS version")
    first = rows.where("flag <> 'N'").groupBy("profile", "vendor", "product").agg(F.min("position").alias("low"))
    entry = f"cast(array(named_struct('version', concat(low, '.0'), 'lessThan', concat(low + 3, '.0'), 'lessThanOrEqual', null, 'versionType', 'semver', 'status', 'affected', 'changes', false)) as array<{co.ENTRY}>)"
    scopes = first.select(F.col("profile").alias("cve"), "vendor", "product", F.expr(entry).alias("entries"))
    candidates = scopes.select(F.col("cve").alias("profile"), "cve").distinct()
    found = co.statuses(rows.drop("flag"), scopes, candidates)
    return found.select(F.col("profile").alias("o"), F.array_join("statuses", ",").alias("statuses"), "applicable")


@BOOK.add("prose_bounds", """
WITH p AS (SELECT p_partkey AS k, p_size || '.' || (p_partkey % 10) AS v, p_partkey % 8 AS m FROM part)
SELECT 'CVE-2024-' || k AS cve, CASE m WHEN 0 THEN 'before version ' || v WHEN 3 THEN 'earlier than ' || v ELSE 'Below ' || v END AS phrase FROM p WHERE m IN (0, 3, 5)""")
def prose_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as advisories with an upper end, and with descriptions that say it plainly, deny it, or say something else."""
    parts = view(spark, sf_dir, "part").selectExpr("concat('CVE-2024-', p_partkey) AS cve", "concat(p_size, '.', p_partkey % 10) AS v", "p_partkey % 8 AS m")
    lower = F.when(F.col("m") == 7, "1.0").when(F.col("m") == 0, "0.0")
    terms = parts.select("cve", F.lit(None).cast("string").alias("exact"), lower.alias("lower"), F.col("v").alias("upper"), F.lit(True).alias("lower_inclusive"), (F.col("m") == 6).alias("upper_inclusive"))
    said = F.expr("""CASE m WHEN 0 THEN array(concat('All releases before version ', v, ' are hit.')) WHEN 1 THEN array(concat('Not before ', v, ', it is said')) WHEN 2 THEN array(concat('prior to v', v, '.1 it fails'))
        WHEN 3 THEN array(concat('is NOT before ', v, ' but some time later, and also in all those earlier than ', v)) WHEN 4 THEN array(concat('fixed in 9 and below  v', v))
        WHEN 5 THEN array('nothing is known', concat('Below ', v, ')')) ELSE array(concat('before ', v)) END""")
    return co.prose_bounds(terms, parts.select("cve", F.posexplode(said).alias("place", "text")))


@BOOK.add("unsplit_lists", """
WITH r AS (SELECT l_orderkey AS cve, l_partkey AS k, l_orderkey % 5 AS low FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) AND l_orderkey % 3 <> 0)
SELECT DISTINCT p_partkey // 50 AS profile, cve, p_partkey || ' ' || p_name || ' Firmware' AS product, (p_partkey % 9) || '.0' AS version
FROM r JOIN part ON p_partkey = k WHERE p_partkey % 9 >= low AND p_partkey % 9 < low + 3""")  # fmt: skip
def unsplit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records that name all parts of their lines in one field; a third is of another vendor."""
    named = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rows = named.groupBy(F.col("l_orderkey").alias("cve")).agg(F.array_join(F.collect_list(F.concat_ws(" ", "p_name", "l_partkey")), ", ").alias("product"))
    entry = "array(named_struct('version', concat(cve % 5, '.0'), 'lessThan', concat(cve % 5 + 3, '.0'), 'lessThanOrEqual', cast(null as string), 'status', 'affected'))"
    rows = rows.withColumn("entries", F.expr(entry)).withColumn("status", F.lit("unaffected")).withColumn("vendor", F.when(F.col("cve") % 3 == 0, "Other House").otherwise("Tools, Inc."))
    parts = view(spark, sf_dir, "part").selectExpr("p_partkey div 50 AS profile", "'Acme tools' AS vendor", "concat(p_partkey, ' ', p_name, ' Firmware') AS product", "concat(p_partkey % 9, '.0') AS version")
    return co.unsplit_lists(parts, rows)


@BOOK.add("entry_rendering", """
WITH e AS (
  SELECT l_orderkey AS o, l_linestatus = 'O' AS added, row_number() OVER (PARTITION BY l_orderkey, l_linestatus = 'O' ORDER BY l_linenumber, l_partkey, l_suppkey) AS r,
    CASE WHEN l_linestatus = 'O' THEN '(ADP enrichment) ' ELSE '' END || CASE WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE 'V' || l_suppkey END || ' / P' || l_partkey || ': ' AS head,
    concat_ws('; ', CASE WHEN l_partkey % 3 = 0 THEN 'default status: unaffected' END,
      CASE WHEN l_partkey % 5 <> 0 THEN 'affected: ' || l_linenumber || '.0' || CASE l_partkey % 4 WHEN 0 THEN ' up to, not including, 9.1 (semver)' WHEN 1 THEN ' up to and including 9.2; changes: unaffected at 9.0, None at 9.3' ELSE '' END END,
      CASE WHEN l_partkey % 6 = 1 THEN 'Zeta: 1' END, CASE WHEN l_partkey % 6 < 3 THEN 'modules: m' || l_linenumber || ', x "y"' END, CASE WHEN l_partkey % 6 = 2 THEN 'zed_' || (l_partkey % 10) || ': true' END) AS body FROM lineitem)
SELECT o, string_agg(head || CASE WHEN body = '' THEN 'no version data' ELSE body END, chr(10) ORDER BY added, r) AS text FROM e GROUP BY o""")  # fmt: skip
def entry_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries with fields of any name, told as JSON; those with status O were added by others."""
    field = lambda name, when, value: f"if({when}, concat(',\"', {name}, '\":', {value}), '')"
    versions = """concat('{"status":"affected","version":"', l_linenumber, '.0"', CASE l_partkey % 4 WHEN 0 THEN ',"lessThan":"9.1","versionType":"semver"'
        WHEN 1 THEN ',"lessThanOrEqual":"9.2","changes":[{"at":"9.0","status":"unaffected"},{"at":"9.3"}]' ELSE '' END, '}')"""
    extra = [
        field("'modules'", "l_partkey % 6 < 3", "concat('[\"m', l_linenumber, '\",\"x \\\\\"y\\\\\"\"]')"), field("concat('zed_', l_partkey % 10)", "l_partkey % 6 = 2", "'true'"), field("'Zeta'", "l_partkey % 6 = 1", "'1'"),
        field("'cpes'", "l_partkey % 6 = 3", "'[]'"), field("'packageName'", "l_partkey % 6 = 4", "'null'"), field("'repo'", "l_partkey % 6 = 5", "'\"\"'"),
    ]
    entry = f"""concat('{{"product":"P', l_partkey, '"', if(l_partkey % 7 = 0, '', concat(',"vendor":"V', l_suppkey, '"')), if(l_partkey % 3 = 0, ',"defaultStatus":"unaffected"', ''),
        if(l_partkey % 5 = 0, '', concat(',"versions":[', {versions}, ']')), {", ".join(extra)}, '}}')"""
    lines = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linestatus", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(entry).alias("e")).alias("x"))
    listed = lambda status: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("l_linestatus") == status, F.col("x")))), lambda x: x["e"]), ",")
    told = lines.groupBy("o").agg(F.concat(F.lit('{"containers":{"cna":{"affected":['), listed("F"), F.lit(']},"adp":[{"title":"t"},{"affected":['), listed("O"), F.lit("]}]}}")).alias("raw"))
    return told.select("o", tx.rendered_entries(F.col("raw")).alias("text"))
