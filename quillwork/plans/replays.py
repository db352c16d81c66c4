"""Queries of offline reconstruction: orders as requests, their lines as candidates and truth, with faults in what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators import reconstruction as rc
from quillwork.operators.lineage import written
from quillwork.plans.base import Book, view

BOOK = Book()


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders with lines as work of a run. By o: o % 9 = 0 answers no JSON, 1 is cut off, 2 is rejected, 3 never came (3 attempts), else plain."""
    line = F.col("l_linenumber").cast("string")
    # What all tables below are made of: written once, so that the lines are sent once.
    sets = written(view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(
        F.array_sort(F.collect_set(line)).alias("candidates"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "A", line))).alias("expected"),
        F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", line))).alias("said"),
    ), "sets")
    o = F.col("o")
    key = F.concat(F.when(o % 2 == 0, "main").otherwise("sealed"), F.lit("/p_"), o.cast("string"))
    none = F.array().cast("array<string>")
    specs = sets.select(
        o.alias("spec"), key.alias("key"), F.concat(F.lit("body "), o.cast("string")).alias("body"), F.when(o % 8 == 7, "optimizer").otherwise("executor").alias("role"), o.alias("profile"),
        F.concat(F.lit("c"), (o % 3).cast("string")).alias("condition"), F.when(o % 53 == 0, F.array_union("candidates", F.array(F.lit("99")))).otherwise(F.col("candidates")).alias("allowed"),
        F.array(F.lit("m1"), F.lit("m2")).alias("models"), F.lit("local").alias("provider"),
    )
    times = F.when(o % 9 == 3, F.when(o % 59 == 0, 2).otherwise(3)).otherwise(1)
    tries = sets.select(o, F.explode(F.sequence(F.lit(1), times)).alias("i"))
    attempt = F.concat_ws("/", o.cast("string"), "i")
    attempts = tries.select(attempt.alias("attempt"), o.alias("spec"), F.concat(F.lit("body "), F.when(o % 61 == 0, 0).otherwise(o).cast("string")).alias("body"), F.lit("local").alias("provider"))
    listed = F.concat(F.lit('{"applicable": ['), F.array_join(F.transform("said", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]}"))
    raw = F.when(o % 9 == 0, F.concat(F.lit("Sure: "), listed)).when(o % 9 == 2, "").otherwise(listed)
    responses = sets.where("o % 9 <> 3").select(
        F.concat_ws("/", o.cast("string"), F.lit("1")).alias("attempt"), raw.alias("raw"), F.when(o % 9 == 1, "length").otherwise("stop").alias("finish"),
        F.when(o % 9 == 2, F.when(o % 67 == 0, 500).otherwise(413)).otherwise(200).alias("http"), F.when(o % 71 == 0, "m9").otherwise("m2").alias("model"), F.lit("local").alias("returned"), F.sha2(raw, 256).alias("sha256"),
    )
    status = F.when(o % 9 == 2, "request_rejected").when(o % 9 == 3, "transport_failure").when((o % 9 < 2) & (o % 73 != 0), "invalid_output").otherwise("valid")
    value = F.when(status == "valid", F.when(o % 9 < 2, none).when(o % 79 == 0, none).otherwise(F.col("said")))
    results = sets.where("o % 83 <> 0").select(
        o.alias("spec"), F.when(o % 89 == 0, "other").otherwise(key).alias("key"), F.concat_ws("/", o.cast("string"), F.when(o % 9 == 3, "3").otherwise("1")).alias("attempt"),
        F.when(o % 9 != 3, F.sha2(F.when(o % 97 == 0, F.concat(raw, F.lit("?"))).otherwise(raw), 256)).alias("response_sha256"), status.alias("status"), value.alias("value"),
    )
    bad = o % 9 < 4
    evaluations = sets.where("o % 5 <> 0").select(
        key.alias("key"), F.when(bad, 0).otherwise(F.size(F.array_intersect("expected", "said"))).alias("tp"),
        (F.when(bad, F.size(F.array_except("candidates", "expected"))).otherwise(F.size(F.array_except("said", "expected"))) + F.when(o % 101 == 0, 1).otherwise(0)).alias("fp"),
        F.when(bad, F.size("expected")).otherwise(F.size(F.array_except("expected", "said"))).alias("fn"),
    )
    return {"specs": specs, "attempts": attempts, "responses": responses, "results": results, "evaluations": evaluations, "truth": sets.select(o.alias("profile"), "candidates", "expected")}


_SETS = """l AS (SELECT l_orderkey AS o, l_linenumber AS c, bool_or(l_returnflag = 'A') AS gold, bool_or(l_linestatus = 'F') AS said FROM lineitem GROUP BY ALL),
s AS (SELECT o, CASE WHEN o % 2 = 0 THEN 'main' ELSE 'sealed' END || '/p_' || o AS key, count(*) FILTER (gold AND said) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (gold AND NOT said) AS fn,
             count(*) FILTER (gold) AS n_gold, count(*) FILTER (NOT gold) AS n_rest, count(*) FILTER (said) AS n_said, o % 9 < 4 AS bad FROM l GROUP BY o)"""


@BOOK.add("reconstruction_violations", f"""
WITH {_SETS},
a AS (SELECT o, key, o || '/' || CASE WHEN o % 9 = 3 THEN 3 ELSE 1 END AS attempt FROM s WHERE o % 83 <> 0)
SELECT 'attempt_differs_from_request' AS rule, true AS raised, o || '/' || i AS subject, key AS item FROM s, range(1, 4) t(i) WHERE o % 61 = 0 AND o > 0 AND i <= CASE WHEN o % 9 = 3 THEN CASE WHEN o % 59 = 0 THEN 2 ELSE 3 END ELSE 1 END
UNION ALL SELECT 'result_of_another_key', true, key, attempt FROM a WHERE o % 89 = 0
UNION ALL SELECT 'response_differs_from_its_digest', true, key, attempt FROM a WHERE o % 97 = 0 AND o % 9 <> 3
UNION ALL SELECT 'rejection_without_client_error', true, key, attempt FROM a WHERE o % 9 = 2 AND o % 67 = 0
UNION ALL SELECT 'failure_before_attempts_ran_out', true, key, attempt FROM a WHERE o % 9 = 3 AND o % 59 = 0
UNION ALL SELECT 'identity_differs_from_condition', true, key, attempt FROM a WHERE o % 9 NOT IN (2, 3) AND o % 71 = 0
UNION ALL SELECT 'interpretation_differs', true, key, attempt FROM a JOIN s USING (o, key) WHERE (o % 9 < 2 AND o % 73 = 0) OR (o % 9 > 3 AND o % 79 = 0 AND n_said > 0)
UNION ALL SELECT 'allowed_ids_differ_from_profile', true, key, '' FROM a WHERE o % 8 <> 7 AND o % 53 = 0
UNION ALL SELECT 'score_differs', true, key, '' FROM a WHERE o % 8 <> 7 AND o % 5 <> 0 AND o % 101 = 0""")  # fmt: skip
def reconstruction_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    # Read by three branches.
    read = written(rc.reread(run["specs"], run["attempts"], run["responses"], run["results"]), "read")
    return rc.reconstruction_violations(run["specs"], run["attempts"], read, rc.scored(read, run["truth"]), run["evaluations"])


@BOOK.add("reconstructed_scores", f"""
WITH {_SETS}
SELECT key, CASE WHEN o % 9 = 2 THEN 'request_rejected' WHEN o % 9 = 3 THEN 'transport_failure' WHEN o % 9 < 2 THEN 'invalid_output' ELSE 'valid' END AS status,
       CASE WHEN bad THEN 0 ELSE tp END AS tp, CASE WHEN bad THEN n_rest ELSE fp END AS fp, CASE WHEN bad THEN n_gold ELSE fn END AS fn FROM s WHERE o % 83 <> 0 AND o % 8 <> 7""")  # fmt: skip
def reconstructed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    read = rc.reread(run["specs"], run["attempts"], run["responses"], run["results"])
    return rc.scored(read, run["truth"]).select("key", "status", "tp", "fp", "fn")


@BOOK.add("reconstruction_metrics_by_stage", f"""
WITH {_SETS},
r AS (SELECT split_part(key, '/', 1) AS stage, 'c' || (o % 3) AS condition, NOT bad AS valid, CASE WHEN bad THEN 0 ELSE tp END AS tp, CASE WHEN bad THEN n_rest ELSE fp END AS fp, CASE WHEN bad THEN n_gold ELSE fn END AS fn
      FROM s WHERE o % 83 <> 0 AND o % 8 <> 7)
SELECT stage, condition, count(*) AS scheduled, count(*) FILTER (valid) AS n_valid, round((count(*) FILTER (valid))::DOUBLE / count(*), 6) AS coverage, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
       round(2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1, round(sum(tp)::DOUBLE / sum(tp + fp), 6) AS micro_precision, round(sum(tp)::DOUBLE / sum(tp + fn), 6) AS micro_recall,
       round(2.0::DOUBLE * (sum(tp) FILTER (valid)) / (sum(2 * tp + fp + fn) FILTER (valid)), 6) AS valid_f1 FROM r GROUP BY stage, condition""")  # fmt: skip
def reconstruction_metrics_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    read = rc.reread(run["specs"], run["attempts"], run["responses"], run["results"])
    return rc.by_stage(rc.scored(read, run["truth"]))


@BOOK.add("reconstruction_totals", f"""
WITH {_SETS}
SELECT count(*) AS work, count(*) FILTER (o % 83 <> 0) AS completed_work, sum(CASE WHEN o % 9 <> 3 THEN 1 WHEN o % 59 = 0 THEN 2 ELSE 3 END)::BIGINT AS physical_attempts,
       sum(CASE WHEN o % 9 <> 3 THEN 0 WHEN o % 59 = 0 THEN 2 ELSE 3 END)::BIGINT AS unknown_attempts, count(*) FILTER (o % 83 <> 0 AND bad) AS invalid_or_failed FROM s""")  # fmt: skip
def reconstruction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    return rc.totals(run["specs"], run["attempts"], run["responses"], rc.reread(run["specs"], run["attempts"], run["responses"], run["results"]))
