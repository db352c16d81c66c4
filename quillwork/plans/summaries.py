"""Roll-ups, reports, gates and joins as DataFrame queries; their SQL stands beside the tables they report on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions import score as sc
from quillwork.operators import joins
from quillwork.plans.base import Book, view

BOOK = Book()

c = F.col


def size() -> Column:
    return F.count(F.lit(1))


def r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


def _year(name: str) -> Column:
    return F.year(name).cast("long")


def _sums() -> list[Column]:
    return [F.sum(x).cast("long").alias(x) for x in ("tp", "fp", "fn")]


@BOOK.add("partition_rollup")
def partition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, sizes = F.sum(c("tp") + c("fn")).cast("long"), F.count_distinct("n_chars")
    return view(spark, sf_dir, "score_rows").groupBy("section").agg(
        size().alias("profiles"), gold.alias("positives"), r(gold / F.greatest(size(), F.lit(1)), "prevalence"), sizes.alias("distinct_sizes"), r(size() / F.greatest(sizes, F.lit(1)), "mean_appearances")
    )


@BOOK.add("overlap_sets")
def overlap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that lie on more than one side."""
    return view(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("key")).agg(F.count_distinct("l_returnflag").alias("sides")).where("sides > 1")


@BOOK.add("exclusion_reasons")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(c("o_orderstatus") == "P", "pending").when(c("o_totalprice") < 20000, "too_small").otherwise("admitted")
    return view(spark, sf_dir, "orders").groupBy(_year("o_orderdate").alias("year"), reason.alias("reason")).agg(size().alias("n"))


@BOOK.add("cell_summary_population_sd")
def cell_summary_population_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tiers").groupBy("executor", "tier").agg(size().alias("n"), r(F.avg("f1"), "mean"), r(F.when(size() > 1, F.stddev_pop("f1")), "sd"))


@BOOK.add("tier_means_sample_sd")
def tier_means_sample_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by executor and tier, and reference rows over all executors."""
    tiers = view(spark, sf_dir, "tiers")
    own = tiers.groupBy(c("executor").cast("string").alias("executor"), "tier").agg(size().alias("n"), r(F.avg("f1"), "mean"), r(F.coalesce(F.when(size() > 1, F.stddev_samp("f1")), F.lit(0.0)), "sd"))
    return own.unionByName(tiers.groupBy("tier").agg(size().alias("n"), r(F.avg("f1"), "mean")).select(F.lit("pooled").alias("executor"), "*", F.lit(0.0).alias("sd")))


@BOOK.add("trajectory_listing")
def trajectory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tiers").where(c("tier") != "5-LOW").select("executor", "tier", "repetition", r(c("f1"), "f1"), "n")


@BOOK.add("budget_range")
def budget_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(size().alias("n"))
    return calls.groupBy("l_returnflag").agg(F.min("n").alias("least_calls"), F.max("n").alias("most_calls"), F.sum("n").alias("calls"))


@BOOK.add("cost_by_lineage")
def cost_by_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = view(spark, sf_dir, "lineitem").where(c("l_returnflag") == "R").select(c("l_orderkey").alias("o_orderkey"), F.lit(1).alias("child")).distinct()
    return view(spark, sf_dir, "orders").join(children, "o_orderkey", "left").groupBy(c("o_custkey").alias("section")).agg(r(F.sum("o_totalprice"), "seconds", 2), F.count("child").alias("children"))


@BOOK.add("real_record_summary")
def real_record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.count_if("valid")
    return view(spark, sf_dir, "score_rows").groupBy("stratum").agg(
        size().alias("n"), decided.alias("decided"), F.count_if(~c("valid")).alias("unsure"), F.count_if(c("valid") & (c("pred") == c("truth"))).alias("agreed"), r(decided / size(), "coverage")
    )


@BOOK.add("margin_flags")
def margin_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda tier: F.avg(F.when(c("tier") == tier, c("f1")))
    deltas = view(spark, sf_dir, "tiers").groupBy("executor").agg((mean("2-HIGH") - mean("3-MEDIUM")).alias("d"))
    return deltas.select("executor", r(c("d"), "delta"), (c("d") > -0.02).alias("retained"), (F.abs("d") < 0.02).alias("equivalent"))


@BOOK.add("scope_usage")
def scope_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last checkpoint of every session, summed by scope."""
    last = view(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("scope"), "o_custkey").agg(F.max("o_orderkey").alias("last"))
    return last.groupBy("scope").agg(F.sum("last").alias("used"))


@BOOK.add("resource_summary")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.count_if(c("o_orderkey") % 13 == 0)
    return view(spark, sf_dir, "orders").groupBy((c("o_custkey") % 7).alias("run")).agg(
        size().alias("attempts"), r(F.sum("o_totalprice"), "seconds", 2), missing.alias("missing_tokens"), F.when(missing == 0, F.sum("o_custkey")).alias("tokens")
    )


@BOOK.add("measurements")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call without a response is charged with its time limit."""
    seconds = F.coalesce(F.when(c("o_orderstatus") != "P", c("o_totalprice")), F.lit(60000)) + 0.5
    return view(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(size().alias("calls"), r(F.sum(seconds), "seconds", 2))


@BOOK.add("audit_totals")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").groupBy("event_type").agg(
        size().alias("n"), r(F.sum("value"), "total", 4), F.count_if(c("value") > 100).alias("failures"), (F.max("event_id") - F.min("event_id")).alias("span")
    )


@BOOK.add("calibration_gate")
def calibration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that fails is a reason; none is eligible."""
    s = lambda x: F.sum(x)
    rows = view(spark, sf_dir, "score_rows").groupBy(c("section").alias("source")).agg(
        r(2 * s("tp") / F.greatest(2 * s("tp") + s("fp") + s("fn"), F.lit(1)), "f1", 4), r(F.count_if("valid") / size(), "coverage")
    )
    reasons = F.array_compact(F.array(F.when(~c("f1").between(0.3, 0.9), "f1_out_of_range"), F.when(c("coverage") < 0.4, "low_coverage")))
    return rows.select("*", F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


@BOOK.add("panel_counts")
def panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "score_rows").groupBy("section").agg(size().alias("n"), F.count_distinct("stratum").alias("strata"), F.min("n_chars").alias("smallest"), F.max("n_chars").alias("largest"))


@BOOK.add("forecast")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of depth (a handful) for every tier, by its mean."""
    means = view(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("tier")).agg(F.avg("o_totalprice").alias("mean"))
    depths = view(spark, sf_dir, "lineitem").where("l_linenumber <= 7").agg(F.array_sort(F.collect_set("l_linenumber")).alias("depths"))
    # One row: the depths of the whole table as an array.
    spread = means.join(F.broadcast(depths)).select("tier", "mean", F.explode("depths").alias("depth"))
    seconds = c("mean") * c("depth") * 24
    return spread.select("tier", "depth", r(seconds, "seconds", 3), (seconds <= 20000000).alias("fits"))


@BOOK.add("parse_coverage")
def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "components").join(view(spark, sf_dir, "terms"), ["vendor", "product"])
    return pairs.groupBy((c("profile") % 4).alias("panel")).agg(size().alias("pairs"), F.count_if(c("version").contains(".0.")).alias("version_unsupported"), F.count_if(c("version").startswith("1")).alias("first_ones"))


@BOOK.add("reconstruction_metrics")
def reconstruction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = view(spark, sf_dir, "cells").groupBy("tier", "repetition").agg(*_sums())
    return sums.withColumn("micro_f1", F.round(sc.f1(c("tp"), c("fp"), c("fn")), 6))


@BOOK.add("schedule_grid")
def schedule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every executor, tier and repetition: sets of a few values each, exploded from one row."""
    sets = view(spark, sf_dir, "tiers").agg(*[F.collect_set(x).alias(x) for x in ("executor", "tier", "repetition")])
    for x in ("executor", "tier", "repetition"):
        sets = sets.withColumn(x, F.explode(x))
    return sets


@BOOK.add("planned_vs_done")
def planned_vs_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = view(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"))
    return view(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@BOOK.add("decision_cells")
def decision_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with truth and answer: one pass, as all three are lines of one table."""
    gold, said = F.bool_or(c("l_returnflag") == "A"), F.bool_or(c("l_linestatus") == "F")
    cells = view(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(gold.alias("g"), said.alias("s"))
    one = lambda x, name: F.when(x, 1).otherwise(0).alias(name)
    return cells.select("l_orderkey", "l_linenumber", one(c("g") & c("s"), "tp"), one(~c("g") & c("s"), "fp"), one(c("g") & ~c("s"), "fn"))


@BOOK.add("trajectory_evaluations")
def trajectory_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations are added up before they fan out to the trajectories that share them."""
    sums = view(spark, sf_dir, "orders").groupBy((c("o_custkey") % 2).alias("executor"), _year("o_orderdate").alias("repetition")).agg(size().alias("rows"), r(F.avg("o_totalprice"), "latency", 4))
    return view(spark, sf_dir, "tiers").join(sums, ["executor", "repetition"]).select("executor", "tier", "repetition", "rows", "latency")


@BOOK.add("related_spelling")
def related_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same folded spelling, null-safe: counted by spelling, not listed in pairs."""
    parts = view(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("b"), F.lower("p_type").alias("t"))
    sizes = parts.groupBy(c("b").alias("b2"), c("t").alias("t2")).agg(size().alias("related"))
    return parts.join(sizes, c("b").eqNullSafe(c("b2")) & (c("t") == c("t2")), "left").select("p_partkey", F.coalesce("related", F.lit(0)).alias("related"))


@BOOK.add("sheet_join")
def sheet_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "labels").join(view(spark, sf_dir, "documents"), "doc_id").groupBy("lang", "quality", "toxic").agg(size().alias("n"))


@BOOK.add("decision_audit")
def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "components").join(view(spark, sf_dir, "terms"), ["vendor", "product"])
    return pairs.groupBy("profile").agg(size().alias("candidates"), F.count_distinct("cve").alias("cves"), F.count_if(c("part") != "a").alias("wrong_part"))


@BOOK.add("size_filter")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").where(F.length("text") + F.length("source") <= 3000).select("doc_id")


@BOOK.add("quarantine_filter")
def quarantine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = view(spark, sf_dir, "lineitem").where("l_quantity > 49").select(c("l_orderkey").alias("o_orderkey"))
    free = view(spark, sf_dir, "orders").join(held, "o_orderkey", "left_anti")
    return free.groupBy(_year("o_orderdate").alias("year")).agg(size().alias("n"))


@BOOK.add("context_fit")
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition whose longest input and answer fit the window; a missing count is not shown to fit."""
    missing = F.count_if(c("tokens").isNull())
    return view(spark, sf_dir, "evaluations").groupBy(F.split("key", "/T")[0].alias("condition")).agg(
        size().alias("n"), F.max("tokens").cast("long").alias("most"), missing.alias("missing"), ((F.max("tokens") + 512 <= 1500) & (missing == 0)).alias("shown_to_fit")
    )


@BOOK.add("label_bound_lookup")
def label_bound_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = view(spark, sf_dir, "tiers")
    return tiers.join(tiers.groupBy("executor", "tier").agg(F.min("f1").alias("low")), ["executor", "tier"]).select("executor", "tier", "repetition", "low")


@BOOK.add("reconstruction_chain")
def reconstruction_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = view(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(size().alias("n"))
    both = view(spark, sf_dir, "orders").select("o_orderkey", (c("o_orderkey") % 7).alias("want")).join(answers, "o_orderkey", "left")
    return both.agg(size().alias("specs"), F.count("n").alias("answered"), F.count_if(c("n") == c("want")).alias("equal"))


@BOOK.add("label_sheet_assembly")
def label_sheet_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = view(spark, sf_dir, "components").join(view(spark, sf_dir, "terms"), ["vendor", "product"]).select(F.lit("decision").alias("sample"), c("profile").cast("long"))
    panel = view(spark, sf_dir, "cells").where("tier = 1").select(F.lit("panel").alias("sample"), c("profile").cast("long"))
    return decisions.unionByName(panel).groupBy("sample").agg(size().alias("n"), F.count_distinct("profile").alias("profiles"))


@BOOK.add("alias_styles")
def alias_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, kind, size = F.lower("p_brand"), F.lower("p_type"), c("p_size").cast("string")
    styles = [F.concat_ws(" ", kind, size), F.concat_ws(" ", F.concat_ws("-", brand, kind), size), F.concat_ws("@", F.concat_ws("/", brand, kind), size), F.concat_ws(" ", "p_brand", "p_type", size)]
    return view(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*styles), (c("p_partkey") % 4 + 1).cast("int")).alias("line"))


@BOOK.add("predicate_shape")
def predicate_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.when(size() > 5, "multi_term_or").when(F.max("lower") == F.max("upper"), "exact").otherwise("single_range")
    return view(spark, sf_dir, "terms").groupBy("vendor").agg(shape.alias("shape"))


@BOOK.add("publication_year")
def publication_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders").groupBy(_year("o_orderdate").alias("year")).agg(size().alias("n"))


@BOOK.add("section_union")
def section_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, table, key: view(spark, sf_dir, table).select(F.lit(name).alias("section"), c(key).alias("id"))
    return part("campaign", "orders", "o_orderkey").unionByName(part("extension", "lineitem", "l_orderkey")).groupBy("section").agg(size().alias("n"), F.count_distinct("id").alias("ids"))


@BOOK.add("component_sets_minus")
def component_sets_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, _ = joins.distractors(view(spark, sf_dir, "components"), view(spark, sf_dir, "terms").where("lower_inclusive"), ["vendor"])
    return none.groupBy("profile").agg(F.count_distinct("vendor").alias("vendors"))


def _first(rows: DataFrame, by: list[str], order: list[Column], keep: list[str], k: int = 1) -> DataFrame:
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(c("_k") <= k).select(*keep)


@BOOK.add("first_seen_dedupe")
def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate, so that a key without end is combined before the shuffle."""
    first = F.min(F.struct("ts", "event_id"))
    return view(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first.alias("x")).select("user_id", "event_type", "x.event_id")


@BOOK.add("latest_by_completion")
def latest_by_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "value"))
    return view(spark, sf_dir, "events").where(c("event_type") != "zz").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_id", "x.value")


@BOOK.add("latest_matching_record")
def latest_matching_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey")), "l_suppkey")
    return rows.where(c("l_returnflag") == "A").groupBy("l_suppkey").agg(F.max("l_orderkey").alias("l_orderkey"))


@BOOK.add("capped_relations")
def capped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 of each section: the limit is pushed below the shuffle."""
    rows = view(spark, sf_dir, "score_rows").where(c("fp") + c("fn") > 0).select("section", "profile")
    k = F.row_number().over(Window.partitionBy("section").orderBy("profile"))
    return rows.withColumn("k", k).where("k <= 12").withColumn("k", c("k").cast("long"))


@BOOK.add("text_window_prefix")
def text_window_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(view(spark, sf_dir, "score_rows").select("section", "profile"), ["section"], [c("profile")], ["section", "profile"], 5)


@BOOK.add("best_per_executor")
def best_per_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(view(spark, sf_dir, "tiers"), ["executor"], [F.desc("f1"), c("tier"), c("repetition")], ["executor", "tier", "repetition", "f1"])


@BOOK.add("round_series")
def round_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return view(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("round"), r(best, "incumbent"))


@BOOK.add("retry_ordinal")
def retry_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    return view(spark, sf_dir, "events").select("user_id", "event_type", "event_id", k.cast("long").alias("retry"))


@BOOK.add("ranked_order")
def ranked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.rank().over(Window.partitionBy("repetition").orderBy(F.round("f1", 2).desc(), F.desc("n"), "tier", "executor"))
    return view(spark, sf_dir, "tiers").select("repetition", "tier", place.cast("long").alias("place"), "executor")


@BOOK.add("family_promotion")
def family_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fastest of each family, and of those the two fastest."""
    best = F.min(F.struct(c("c_acctbal").alias("p90"), c("c_custkey").alias("id")))
    rows = view(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(c("c_mktsegment").alias("family")).agg(best.alias("x"))
    return rows.select("family", "x.id", "x.p90").orderBy("p90", "id").limit(2)
