"""Queries of scoring, metrics, agreement and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions import contracts, hashing
from quillwork.functions import score as sc
from quillwork.operators import aggregates as ag
from quillwork.operators import joins
from quillwork.operators import ordered as od
from quillwork.operators import resampling as rs
from quillwork.plans.base import Book, view

BOOK = Book()

_F1 = "CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END"
_METRICS = f"""count(*) AS scheduled, count(*) FILTER (valid) AS n_valid, round((count(*) FILTER (valid))::DOUBLE / count(*), 6) AS coverage,
       sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round({_F1}, 6)::DOUBLE AS micro_f1,
       round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp)) END, 6) AS micro_precision,
       round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn)) END, 6) AS micro_recall,
       round(CASE WHEN coalesce(sum(2 * tp + fp + fn) FILTER (valid), 0) = 0 THEN 0 ELSE 2 * (sum(tp) FILTER (valid))::DOUBLE / (sum(2 * tp + fp + fn) FILTER (valid)) END, 6) AS valid_f1"""


@BOOK.add("pooled_micro_f1", f"SELECT {_METRICS} FROM score_rows")
def pooled_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "score_rows").agg(*sc.metrics())


@BOOK.add("micro_f1_by_stratum", f"SELECT section, stratum, {_METRICS} FROM score_rows GROUP BY GROUPING SETS ((section), (section, stratum))")
def micro_f1_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.by_stratum(view(spark, sf_dir, "score_rows"), "section", "stratum")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: the line numbers as candidates, returned lines as truth, shipped lines as answer; every 9th order failed."""
    line = F.col("l_linenumber").cast("string")
    sets = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(line)).alias("candidates"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "A", line))).alias("truth"),
        F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", line))).alias("said"),
    )
    failed = F.col("l_orderkey") % 9 == 0
    return sets.withColumn("prediction", F.when(~failed, F.col("said"))).withColumn(
        "status", F.when(F.col("l_orderkey") % 18 == 0, "transport_failure").when(failed, "invalid").otherwise("ok")
    )


_SETS = """(SELECT l_orderkey, l_linenumber AS c, bool_or(l_returnflag = 'A') AS gold, bool_or(l_linestatus = 'F') AS said, l_orderkey % 9 = 0 AS failed
            FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@BOOK.add("answer_scores", f"""
SELECT l_orderkey, count(*) FILTER (gold AND said AND NOT failed) AS tp, count(*) FILTER (NOT gold AND (said OR failed)) AS fp, count(*) FILTER (gold AND (failed OR NOT said)) AS fn
FROM {_SETS} GROUP BY l_orderkey""")  # fmt: skip
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("s", sc.counts(F.col("candidates"), F.col("truth"), F.col("prediction")))
    return rows.select("l_orderkey", "s.tp", "s.fp", "s.fn")


@BOOK.add("error_categories_with_zeros", f"""
SELECT l_orderkey % 7 AS slot, count(*) FILTER (NOT failed AND gold = said) AS correct, count(*) FILTER (NOT failed AND said AND NOT gold) AS false_include,
       count(*) FILTER (NOT failed AND gold AND NOT said) AS miss, count(*) FILTER (failed AND l_orderkey % 18 = 0) AS transport_failure,
       count(*) FILTER (failed AND l_orderkey % 18 <> 0) AS invalid_answer FROM {_SETS} GROUP BY 1""")  # fmt: skip
def error_categories_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("categories", sc.categories(*[F.col(c) for c in ("candidates", "truth", "prediction", "status")]))
    return ag.category_counts(rows.withColumn("slot", F.col("l_orderkey") % 7), ["slot"])


@BOOK.add("batch_nonzero_fraction", """
WITH b AS (SELECT section, (row_number() OVER (PARTITION BY section ORDER BY profile) - 1) // 6 AS batch, fp + fn AS errors FROM score_rows),
s AS (SELECT section, batch, sum(errors) AS errors FROM b GROUP BY ALL)
SELECT section, count(*) AS batches, round((count(*) FILTER (errors > 0))::DOUBLE / count(*), 6) AS nonzero FROM s GROUP BY section""")  # fmt: skip
def batch_nonzero_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = od.placed_within(view(spark, sf_dir, "score_rows").select("section", "profile", "fp", "fn"), ["section"], [F.col("profile")])
    batches = rows.withColumn("batch", F.expr("turn div 6")).groupBy("section", "batch").agg(F.sum(F.col("fp") + F.col("fn")).alias("e"))
    return batches.groupBy("section").agg(F.count(F.lit(1)).alias("batches"), F.round(F.count_if(F.col("e") > 0) / F.count(F.lit(1)), 6).alias("nonzero"))


_PAIRS = "SELECT executor, repetition, a.f1 - b.f1 AS delta FROM (SELECT * FROM tiers) a JOIN (SELECT * FROM tiers) b USING (executor, repetition) WHERE a.tier = '2-HIGH' AND b.tier = '3-MEDIUM'"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.paired(view(spark, sf_dir, "tiers"), ["executor", "repetition"], "tier", "2-HIGH", "3-MEDIUM", "f1")


@BOOK.add("paired_contrast", f"SELECT executor, repetition, round(delta, 6) AS delta FROM ({_PAIRS})")
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select("executor", "repetition", F.round("delta", 6).alias("delta"))


_T = "[" + ", ".join(map(str, sc.T_975)) + "]::DOUBLE[]"
_TSQL = f"""
SELECT executor, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - h, 6) AS low, round(mean + h, 6) AS high
FROM (SELECT executor, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd, ({_T})[count(*) - 1] * stddev_samp(delta) / sqrt(count(*)) AS h
      FROM ({_PAIRS}) GROUP BY executor)"""


@BOOK.add("paired_t_interval", _TSQL)
def paired_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.t_interval(_deltas(spark, sf_dir), ["executor"], "delta")


_R = 400
_DRAW = "(('0x' || substr(sha256({parts}), 1, 8))::BIGINT % {n})"


@BOOK.add("bootstrap_mean_ci", f"""
WITH d AS (SELECT executor, delta, row_number() OVER (PARTITION BY executor ORDER BY repetition) - 1 AS i, count(*) OVER (PARTITION BY executor) AS n FROM ({_PAIRS})),
p AS (SELECT executor, r, {_DRAW.format(parts="'s1/' || r || '/' || i", n="n")} AS pick FROM d, range({_R}) t(r)),
m AS (SELECT p.executor, r, avg(delta) AS mean FROM p JOIN d ON d.executor = p.executor AND d.i = p.pick GROUP BY ALL),
l AS (SELECT executor, list_sort(list(mean)) AS v FROM m GROUP BY executor)
SELECT executor, round(v[{int(_R * 0.025) + 1}], 6) AS low, round(v[{int(_R * 0.975)}], 6) AS high FROM l""")  # fmt: skip
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.mean_interval(_deltas(spark, sf_dir), ["executor"], "repetition", "delta", _R, "s1")


def _weights(unit: str, seed: str, name: str, r: int) -> str:
    return f"""n_{name} AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} FROM cells)),
d_{name} AS (SELECT r, {_DRAW.format(parts=f"'{seed}/' || r || '/' || i", n="n")} AS i FROM n_{name}, range({r}) t(r)),
{name} AS (SELECT r, {unit}, count(*) AS {name} FROM d_{name} JOIN n_{name} USING (i) GROUP BY ALL)"""


_RP = 100


@BOOK.add("pigeonhole_ci", f"""
WITH {_weights("profile", "p1a", "wa", _RP)}, {_weights("cve", "p1b", "wb", _RP)},
c AS (SELECT profile, cve, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY ALL),
f AS (SELECT r, 2.0::DOUBLE * sum(wa * wb * tp) / sum(wa * wb * (2 * tp + fp + fn)) AS f1 FROM c JOIN wa USING (profile) JOIN wb USING (cve, r) GROUP BY r),
l AS (SELECT list_sort(list(f1)) AS v FROM f)
SELECT round(v[{int(_RP * 0.025) + 1}], 6) AS low, round(v[{int(_RP * 0.975)}], 6) AS high FROM l""")  # fmt: skip
def pigeonhole_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.pigeonhole(view(spark, sf_dir, "cells"), "profile", "cve", _RP, "p1")


@BOOK.add("joint_bootstrap_ci", f"""
WITH {_weights("profile", "j1", "w", _RP)},
c AS (SELECT profile, tier, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY ALL),
f AS (SELECT r, 2.0::DOUBLE * (sum(w * tp) FILTER (tier = 2)) / (sum(w * (2 * tp + fp + fn)) FILTER (tier = 2))
              - 2.0::DOUBLE * (sum(w * tp) FILTER (tier = 3)) / (sum(w * (2 * tp + fp + fn)) FILTER (tier = 3)) AS d FROM c JOIN w USING (profile) GROUP BY r),
l AS (SELECT list_sort(list(d)) AS v FROM f)
SELECT round(v[{int(_RP * 0.025) + 1}], 6) AS low, round(v[{int(_RP * 0.975)}], 6) AS high FROM l""")  # fmt: skip
def joint_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.joint(view(spark, sf_dir, "cells"), "profile", "tier", 2, 3, _RP, "j1")


@BOOK.add("two_stage_bootstrap_ci", f"""
WITH {_weights("profile", "t1", "w", _RP)},
c AS (SELECT profile, repetition, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY repetition) - 1 AS i, count(*) OVER (PARTITION BY profile) AS n FROM c),
d AS (SELECT r, profile, {_DRAW.format(parts="'t2/' || r || '/' || profile || '/' || i", n="n")} AS i FROM i, range({_RP}) t(r)),
f AS (SELECT r, 2.0::DOUBLE * sum(w * tp) / sum(w * (2 * tp + fp + fn)) AS f1 FROM d JOIN i USING (profile, i) JOIN w USING (r, profile) GROUP BY r),
l AS (SELECT list_sort(list(f1)) AS v FROM f)
SELECT round(v[{int(_RP * 0.025) + 1}], 6) AS low, round(v[{int(_RP * 0.975)}], 6) AS high FROM l""")  # fmt: skip
def two_stage_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles are drawn, and within each drawn profile its repetitions."""
    cells = view(spark, sf_dir, "cells").groupBy("profile", "repetition").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    own = Window.partitionBy("profile")
    inner = cells.withColumn("i", F.row_number().over(own.orderBy("repetition")) - 1).withColumn("of", F.count(F.lit(1)).over(own))
    pick = hashing.draw(F.col("of"), F.lit("t2"), F.col("replicate"), F.col("profile"), F.col("i"))
    drawn = rs.replicates(inner.select("profile", "i", "of"), _RP, "t2").select("replicate", "profile", pick.alias("i"))
    w = rs.weights(cells, "profile", _RP, "t1", "w")
    s = lambda c: F.sum(F.col("w") * F.col(c))
    each = drawn.join(inner.hint("merge"), ["profile", "i"]).join(w.hint("merge"), ["replicate", "profile"]).groupBy("replicate").agg(sc.f1(s("tp"), s("fp"), s("fn")).alias("f1"))
    return rs.ends(each, [], "f1")


_R3 = 60


@BOOK.add("three_stage_bootstrap_ci", f"""
WITH x AS (SELECT profile, repetition, tier, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY ALL),
g AS (SELECT profile, row_number() OVER (ORDER BY profile) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT profile FROM x)),
s AS (SELECT profile, repetition, row_number() OVER (PARTITION BY profile ORDER BY repetition) - 1 AS s, count(*) OVER (PARTITION BY profile) AS n FROM (SELECT DISTINCT profile, repetition FROM x)),
c AS (SELECT *, row_number() OVER (PARTITION BY profile, repetition ORDER BY tier) - 1 AS c, count(*) OVER (PARTITION BY profile, repetition) AS n FROM x),
d1 AS (SELECT r, g.g AS i, {_DRAW.format(parts="'n3/' || r || '/' || g", n="n")} AS pick FROM g, range({_R3}) t(r)),
d2 AS (SELECT r, i, g.profile, s.s AS j, {_DRAW.format(parts="'n3/' || r || '/' || i || '/' || s.s", n="s.n")} AS pick FROM d1 JOIN g ON g.g = d1.pick JOIN s ON s.profile = g.profile),
d3 AS (SELECT r, s.profile, s.repetition, {_DRAW.format(parts="'n3/' || r || '/' || i || '/' || j || '/' || c.c", n="c.n")} AS pick
       FROM d2 JOIN s ON s.profile = d2.profile AND s.s = d2.pick JOIN c ON c.profile = s.profile AND c.repetition = s.repetition),
f AS (SELECT r, 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS f1 FROM d3 JOIN c ON c.profile = d3.profile AND c.repetition = d3.repetition AND c.c = d3.pick GROUP BY r),
l AS (SELECT list_sort(list(f1)) AS v FROM f)
SELECT round(v[{int(_R3 * 0.025) + 1}], 6) AS low, round(v[{int(_R3 * 0.975)}], 6) AS high FROM l""")  # fmt: skip
def three_stage_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles are drawn, repetitions within each drawn profile, tiers within each drawn repetition."""
    return rs.three_stage(view(spark, sf_dir, "cells"), "profile", "repetition", "tier", _R3, "n3")


@BOOK.add("distribution_p90", """
SELECT o_orderpriority, count(x) AS known, count(*) FILTER (x IS NULL) AS missing, round(CASE WHEN count(*) FILTER (x IS NULL) = 0 THEN sum(x) END, 6) AS total,
       round(sum(x), 6) AS known_total, round(avg(x), 6) AS mean_known, quantile_disc(x, 0.9) AS p90
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 50 = 0 AND o_orderpriority < '3' THEN NULL ELSE round(o_totalprice) END AS x FROM orders) GROUP BY 1""")  # fmt: skip
def distribution_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(~((F.col("o_orderkey") % 50 == 0) & (F.col("o_orderpriority") < "3")), F.round("o_totalprice"))
    return ag.distribution(view(spark, sf_dir, "orders").withColumn("x", x), ["o_orderpriority"], "x")


@BOOK.add("rank_conventions", """
SELECT o_orderpriority, v[greatest(1, floor(0.9 * len(v))::INT)] AS floor_p90, v[least(floor(0.975 * len(v))::INT, len(v) - 1) + 1] AS clamped_975, round(p, 6) AS linear_975
FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, quantile_cont(o_totalprice, 0.975) AS p FROM orders GROUP BY 1)""")  # fmt: skip
def rank_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conventions of a rank: rows are placed within their group, whatever its size."""
    rows = view(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    low = F.floor((F.col("_n") - 1) * 0.975)
    ranks = od.at_ranks(rows, ["o_orderpriority"], "o_totalprice", {"floor_p90": ag.floor_rank(0.9), "clamped_975": ag.clamped_rank(0.975), "a": low, "b": F.least(low + 1, F.col("_n") - 1)})
    sizes = rows.groupBy("o_orderpriority").agg(((F.count(F.lit(1)) - 1) * 0.975).alias("at"))
    linear = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return ranks.join(sizes, "o_orderpriority").select("o_orderpriority", "floor_p90", "clamped_975", F.round(linear, 6).alias("linear_975"))


@BOOK.add("macro_f1", """
WITH c AS (SELECT tier, cve, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY ALL)
SELECT tier, round(avg(CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS macro_f1, count(*) FILTER (tp + fn > 0) AS units,
       round(5.0::DOUBLE * sum(tp) / (5 * sum(tp) + 4 * sum(fn) + sum(fp)), 6) AS f2, round(sum(tp)::DOUBLE / (sum(tp) + sum(fp)), 6) AS precision,
       round(sum(tp)::DOUBLE / (sum(tp) + sum(fn)), 6) AS recall FROM c GROUP BY tier""")  # fmt: skip
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.macro_f1(view(spark, sf_dir, "cells"), ["tier"], "cve")


@BOOK.add("cost_sensitivity", """
SELECT tier, k::INT AS k, round((k * sum(fn) + sum(fp))::DOUBLE / count(*), 6) AS cost FROM cells, (SELECT unnest([1, 2, 5, 10, 20]) AS k) GROUP BY tier, k""")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.costs(view(spark, sf_dir, "cells"), ["tier"])


@BOOK.add("error_profile", """
WITH g AS (SELECT tier, tp, fp, fn, unnest(['all', CASE WHEN cve % 2 = 0 THEN 'prose' ELSE 'structured' END, 'bound_' || (cve % 3)] || CASE WHEN profile % 4 = 0 THEN ['inclusive_equal'] ELSE [] END) AS grp FROM cells)
SELECT tier, grp, count(*) AS n, round(CASE WHEN sum(tp + fn) = 0 THEN 0 ELSE sum(fn)::DOUBLE / sum(tp + fn) END, 6) AS miss_share,
       round(sum(fp)::DOUBLE / count(*), 6) AS false_include_share FROM g GROUP BY ALL""")  # fmt: skip
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups overlap: a cell is counted in each of its groups."""
    groups = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("cve") % 2 == 0, "prose").otherwise("structured"), F.concat(F.lit("bound_"), (F.col("cve") % 3).cast("string")),
        F.when(F.col("profile") % 4 == 0, "inclusive_equal"),
    ))
    spread = view(spark, sf_dir, "cells").withColumn("grp", F.explode(groups))
    gold = F.sum(F.col("tp") + F.col("fn"))
    return spread.groupBy("tier", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.round(sc.ratio(F.sum("fn"), gold), 6).alias("miss_share"), F.round(F.sum("fp") / F.count(F.lit(1)), 6).alias("false_include_share")
    )


@BOOK.add("kappa", """
WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) AS same FROM labels),
p AS (SELECT n, same / n AS po, (SELECT sum(a.c * b.c) FROM (SELECT quality AS v, count(*) AS c FROM labels GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS c FROM labels GROUP BY 1) b USING (v)) / (n * n) AS pe FROM n)
SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM p""")  # fmt: skip
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.kappa(view(spark, sf_dir, "labels"), "quality", "toxic")


@BOOK.add("crosstab", "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = view(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).count()
    return wide.select("quality", *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"toxic_{v}") for v in (0, 1)])


#: Exact limits in DuckDB without beta functions: bisection on the sums of the binomial's terms.
def _limits(strata: str) -> str:
    term = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a + b) / 2) + (n - i) * ln(1 - (a + b) / 2))"
    upper = f"list_sum(list_transform(range({{0}}, n + 1), lambda i: {term}))"
    step = lambda at, target: f"CASE WHEN {upper.format(at)} < {target} THEN (a + b) / 2 ELSE a END, CASE WHEN {upper.format(at)} < {target} THEN b ELSE (a + b) / 2 END"
    solved = lambda name, at, target: f"""{name} AS (  -- the share at which {at} or more of n come out with the chance asked for
  SELECT *, 0::DOUBLE AS a, 1::DOUBLE AS b, 0 AS turn FROM strata UNION ALL SELECT * REPLACE ({step(at, target).replace(', CASE', ' AS a, CASE', 1)} AS b, turn + 1 AS turn) FROM {name} WHERE turn < 50)"""  # noqa: E731
    return f"""WITH RECURSIVE strata AS ({strata}), {solved("lower_end", "k", "alpha / 2")}, {solved("upper_end", "k + 1", "1 - alpha / 2")},
limits AS (SELECT l.* EXCLUDE (a, b, turn), CASE WHEN l.k = 0 THEN 0 ELSE (l.a + l.b) / 2 END AS low, CASE WHEN l.k = l.n THEN 1 ELSE (u.a + u.b) / 2 END AS high
  FROM lower_end l JOIN upper_end u ON u.id = l.id WHERE l.turn = 50 AND u.turn = 50)"""


@BOOK.add("clopper_pearson", _limits("SELECT section AS id, sum(truth)::BIGINT AS k, count(*) AS n, 0.05::DOUBLE AS alpha FROM score_rows WHERE valid GROUP BY 1")
          + " SELECT id AS section, k, n, round(low, 6) AS low, round(high, 6) AS high FROM limits")
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact limits of each source's share of good documents."""
    rows = view(spark, sf_dir, "score_rows").where("valid").groupBy("section").agg(F.sum("truth").alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("x", contracts.exact_limits(F.col("k"), F.col("n"), F.lit(0.05))).select("section", "k", "n", F.round("x.low", 6).alias("low"), F.round("x.high", 6).alias("high"))


@BOOK.add("weighted_share", _limits("""
SELECT *, 0.05::DOUBLE / count(*) OVER (PARTITION BY stratum) AS alpha, sum(weight) OVER (PARTITION BY stratum) AS total, count(*) OVER (PARTITION BY stratum) AS strata
FROM (SELECT stratum || '/' || section AS id, stratum, sum(truth) FILTER (valid)::BIGINT AS k, count(*) FILTER (valid) AS n, sum(n_chars) AS weight FROM score_rows GROUP BY 1, 2) WHERE n > 0""")
          + """ SELECT stratum, max(strata) AS strata, round(sum(weight / total * (k / n)), 6) AS estimate, round(sum(weight / total * low), 6) AS low, round(sum(weight / total * high), 6) AS high FROM limits GROUP BY stratum""")
def weighted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's share of good documents, from the labelled ones of its sources and the characters of all."""
    valid = F.col("valid")
    strata = view(spark, sf_dir, "score_rows").groupBy("stratum", "section").agg(F.sum(F.when(valid, F.col("truth"))).alias("k"), F.count_if(valid).alias("n"), F.sum("n_chars").alias("weight"))
    return ag.weighted_share(strata.where("n > 0"), ["stratum"])


@BOOK.add("strict_answer_contract", """
SELECT k % 6 AS spelling, count(*) AS n, CASE WHEN k % 6 = 0 THEN count(*) ELSE 0 END AS valid, CASE WHEN k % 6 = 0 THEN count(*) ELSE 0 END AS same FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) GROUP BY k % 6""")
def strict_answer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers in six spellings, of which only the plain one with known ids and a normal stop parses."""
    rows = _answers(spark, sf_dir)
    listed = F.concat(F.lit('{"applicable": ["'), F.array_join("said", '", "'), F.lit('"]}'))
    k = F.col("l_orderkey") % 6
    raw = F.when(k == 1, F.concat(F.lit("Answer: "), listed)).when(k == 2, F.lit('{"applicable": [], "applicable": []}')).when(k == 3, F.lit('{"applicable": ["nine"]}')).when(k == 4, F.lit('{"applicable": [NaN]}')).otherwise(F.when(F.size("said") == 0, '{"applicable": []}').otherwise(listed))
    finish = F.when(k == 5, "length").otherwise("stop")
    parsed = rows.select("l_orderkey", "said", contracts.parse_answer()(raw, finish, F.col("candidates")).alias("parsed"))
    return parsed.groupBy((F.col("l_orderkey") % 6).alias("spelling")).agg(
        F.count(F.lit(1)).alias("n"), F.count("parsed").alias("valid"), F.count_if(F.col("parsed") == F.col("said")).alias("same")
    )


@BOOK.add("scaffold_contract", """
SELECT k % 7 AS spelling, count(*) AS n, CASE WHEN k % 7 IN (0, 6) THEN count(*) ELSE 0 END AS valid FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) GROUP BY k % 7""")
def scaffold_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers with a decision for each candidate: all there and consistent, or one missing, twice, turned, of another shape, or beside a third key."""
    k = F.col("l_orderkey") % 7
    one = lambda x, yes: F.concat(F.lit('{"id": "'), x, F.lit('", "applicable": '), yes.cast("string"), F.lit("}"))
    told = F.transform("candidates", lambda x: one(x, F.array_contains("said", x)))
    first = F.get("candidates", F.lit(0))
    turned = F.transform("candidates", lambda x: one(x, F.array_contains("said", x) != (x == first)))
    shape = F.transform("candidates", lambda x: F.concat(F.lit('{"id": "'), x, F.lit('", "applicable": 1}')))
    listed = F.when(k == 1, F.slice(told, 2, 99)).when(k == 2, F.concat(told, F.slice(told, 1, 1))).when(k == 3, turned).when(k == 4, shape).otherwise(told)
    ids = F.array_join(F.transform("said", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    extra = F.when(k == 5, F.lit(', "why": ""')).otherwise("")
    raw = F.concat(F.lit('{"decisions": ['), F.array_join(listed, ", "), F.lit('], "applicable": ['), ids, F.lit("]"), extra, F.lit("}"))
    parsed = _answers(spark, sf_dir).select("l_orderkey", contracts.parse_answer("applicable", "decisions")(raw, F.lit("stop"), F.col("candidates")).alias("parsed"))
    return parsed.groupBy((F.col("l_orderkey") % 7).alias("spelling")).agg(F.count(F.lit(1)).alias("n"), F.count("parsed").alias("valid"))


@BOOK.add("canonical_digest")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").select("event_id", contracts.canonical_digest(F.col("props")).alias("digest"))


@BOOK.add("prompt_contract", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\S') AND length(text) <= 8000 THEN length(text) END AS prompt_chars FROM conversations")
def prompt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("text").alias("prompt")))
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(contracts.parse_prompt(raw)).alias("prompt_chars"))


@BOOK.add("hash_partition", """
WITH h AS (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 63, 2))::INT AS low, sha256(doc_id::VARCHAR) AS d FROM documents),
b AS (SELECT doc_id, list_reduce(list_transform(range(1, 65), lambda i: ('0x' || substr(d, i, 1))::INT), lambda a, x: (a * 16 + x) % 100) AS bucket FROM h)
SELECT doc_id, bucket::INT AS bucket, CASE WHEN bucket < 10 THEN 'pilot_development' WHEN bucket < 20 THEN 'pilot_validation' WHEN bucket < 60 THEN 'optimization' WHEN bucket < 75 THEN 'validation' ELSE 'test' END AS partition FROM b""")  # fmt: skip
def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "documents").select("doc_id", hashing.bucket(F.col("doc_id").cast("string"), 100).alias("bucket"))
    return b.withColumn("partition", hashing.partition_of(F.col("bucket")))
