"""Offline reconstruction: requests, attempts and raw replies are read again, parsed strictly and scored, and every stored
row that says something else is a violation. Stored verdicts are never an input of the reconstructed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import contracts
from quillwork.functions import score as sc
from quillwork.operators import audit

#: Replies of a server that end a request for good.
CLIENT_ERRORS = (400, 413, 422)
#: Attempts after which a transport failure may be committed.
MOST_ATTEMPTS = 3


def reread(specs: DataFrame, attempts: DataFrame, responses: DataFrame, results: DataFrame) -> DataFrame:
    """Every committed result beside its request and raw reply, with the reply parsed again: status, value.

    specs: spec, key, body, role, profile, condition, allowed (array), models (array), provider. attempts: attempt, spec, body, provider.
    responses: attempt, raw, finish, http, model, returned, sha256 (nothing for an attempt without a reply). results: spec, key, attempt,
    response_sha256, status, value (array)."""
    tried = attempts.groupBy("spec").agg(F.count(F.lit(1)).alias("tried"))
    told = results.select("spec", F.col("key").alias("told_key"), "attempt", "response_sha256", F.col("status").alias("told"), F.col("value").alias("told_value"))
    joined = specs.join(told, "spec").join(responses, "attempt", "left").join(tried, "spec", "left")
    parsed = joined.withColumn("parsed", contracts.parse_answer()(F.col("raw"), F.col("finish"), F.col("allowed")))
    failed = F.col("told").isin("request_rejected", "transport_failure")
    return parsed.withColumn("value", F.when(~failed, F.col("parsed"))).withColumn("status", F.when(failed, F.col("told")).when(F.col("parsed").isNull(), "invalid_output").otherwise("valid")).drop("parsed")


def scored(read: DataFrame, truth: DataFrame) -> DataFrame:
    """read with the counts of every executor's answer: truth has profile, candidates, expected (arrays)."""
    both = read.where("role = 'executor'").join(truth, "profile", "left")
    return both.withColumn("s", sc.counts(F.col("candidates"), F.col("expected"), F.col("value"))).select("*", "s.tp", "s.fp", "s.fn").drop("s")


def reconstruction_violations(specs: DataFrame, attempts: DataFrame, read: DataFrame, rescored: DataFrame, evaluations: DataFrame) -> DataFrame:
    """What the stored rows get wrong: read and rescored come from reread() and scored(); evaluations: key, tp, fp, fn, as stored."""
    asked = attempts.join(specs.select("spec", F.col("body").alias("wanted"), "key"), "spec", "left")
    missing = F.col("response_sha256").isNotNull() & ~F.col("response_sha256").eqNullSafe(F.col("sha256"))
    answered = ~F.col("told").isin("request_rejected", "transport_failure")
    identity = F.array_contains("models", F.col("model")) & (F.col("returned") == F.col("provider"))
    same_sets = F.array_sort(F.array_distinct("allowed")) == F.array_sort(F.array_distinct("candidates"))
    stored = rescored.join(evaluations.select("key", *[F.col(c).alias(f"told_{c}") for c in ("tp", "fp", "fn")], F.lit(True).alias("scored")), "key")
    return audit.union([
        audit.violations(asked, {"attempt_differs_from_request": ~F.col("body").eqNullSafe(F.col("wanted"))}, F.col("attempt"), F.col("key")),
        audit.violations(read, {
            "result_of_another_key": F.col("told_key") != F.col("key"),
            "response_differs_from_its_digest": missing,
            "rejection_without_client_error": (F.col("told") == "request_rejected") & ~F.coalesce(F.col("http").isin(*CLIENT_ERRORS), F.lit(False)),
            "failure_before_attempts_ran_out": (F.col("told") == "transport_failure") & (F.coalesce("tried", F.lit(0)) != MOST_ATTEMPTS),
            "identity_differs_from_condition": answered & ~F.coalesce(identity, F.lit(False)),
            "interpretation_differs": ~(F.col("told").eqNullSafe(F.col("status")) & F.col("told_value").eqNullSafe(F.col("value"))),
        }, F.col("key"), F.col("attempt")),
        audit.violations(rescored, {"allowed_ids_differ_from_profile": ~F.coalesce(same_sets, F.lit(False))}, F.col("key")),
        audit.violations(stored, {"score_differs": ~((F.col("tp") == F.col("told_tp")) & (F.col("fp") == F.col("told_fp")) & (F.col("fn") == F.col("told_fn")))}, F.col("key")),
    ])


def by_stage(rescored: DataFrame) -> DataFrame:
    """Pooled metrics of the reconstructed scores by stage (the first part of a key) and condition."""
    rows = rescored.select(F.split("key", "/")[0].alias("stage"), "condition", (F.col("status") == "valid").alias("valid"), "tp", "fp", "fn")
    return rows.groupBy("stage", "condition").agg(*sc.metrics())


def totals(specs: DataFrame, attempts: DataFrame, responses: DataFrame, read: DataFrame) -> DataFrame:
    """One row: work, completed_work, physical_attempts, unknown_attempts (without a reply), invalid_or_failed."""
    open_ = attempts.join(responses, "attempt", "left_anti")
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return specs.agg(
        F.count(F.lit(1)).alias("work"), n(read).alias("completed_work"), n(attempts).alias("physical_attempts"), n(open_).alias("unknown_attempts"), n(read.where("status <> 'valid'")).alias("invalid_or_failed")
    )
