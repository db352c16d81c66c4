"""Scoring of set-valued answers and the metrics over counts. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("correct", "false_include", "miss", "transport_failure", "invalid_answer")
#: Two-sided 97.5 % points of Student's t by degrees of freedom, 1 to 11 (fixed values).
T_975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201)


def ratio(a: Column, b: Column) -> Column:
    """a/b, and 0.0 over 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def f2(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(5.0 * tp, 5 * tp + 4 * fn + fp)


def counts(candidates: Column, truth: Column, prediction: Column) -> Column:
    """(tp, fp, fn) of an answer. A null prediction is the worst case: nothing found, everything else included."""
    size = lambda x: F.size(x).cast("long")
    absent = prediction.isNull()
    return F.struct(
        F.when(absent, 0).otherwise(size(F.array_intersect(truth, prediction))).cast("long").alias("tp"),
        F.when(absent, size(F.array_except(candidates, truth))).otherwise(size(F.array_except(prediction, truth))).alias("fp"),
        F.when(absent, size(truth)).otherwise(size(F.array_except(truth, prediction))).alias("fn"),
    )


def categories(candidates: Column, truth: Column, prediction: Column, status: Column) -> Column:
    """One category per candidate, in candidate order; a failed answer gives its failure for each."""

    def one(c: Column) -> Column:
        gold, said = F.array_contains(truth, c), F.array_contains(prediction, c)
        return (
            F.when(status == "transport_failure", "transport_failure")
            .when(prediction.isNull(), "invalid_answer")
            .when(said & ~gold, "false_include")
            .when(gold & ~said, "miss")
            .otherwise("correct")
        )

    return F.transform(candidates, one)


def metrics(tp: str = "tp", fp: str = "fp", fn: str = "fn", valid: str = "valid") -> list[Column]:
    """Aggregates: scheduled, answered, coverage, pooled metrics over all rows and over valid rows. Ratios come after the sums."""
    s = lambda c: F.sum(c).cast("long")
    v = lambda c: F.coalesce(F.sum(F.when(F.col(valid), F.col(c))), F.lit(0)).cast("long")
    n, ok = F.count(F.lit(1)), F.count_if(F.col(valid))
    r = lambda c, name: F.round(c, 6).alias(name)
    return [
        n.alias("scheduled"), ok.alias("n_valid"), r(ratio(ok, n), "coverage"), s(tp).alias("tp"), s(fp).alias("fp"), s(fn).alias("fn"),
        r(f1(s(tp), s(fp), s(fn)), "micro_f1"), r(ratio(s(tp), s(tp) + s(fp)), "micro_precision"), r(ratio(s(tp), s(tp) + s(fn)), "micro_recall"),
        r(f1(v(tp), v(fp), v(fn)), "valid_f1"),
    ]
