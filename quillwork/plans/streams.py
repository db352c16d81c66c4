"""Queries that run a stream over all available rows and return what it left in its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators.lineage import scratch
from quillwork.plans.base import Book, view
from quillwork.streaming import telemetry as tm

BOOK = Book()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The table may be one file or a folder of files: a file source takes either if a glob names it.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now into files of the shared folder and return them: of a complete stream the
    last batch, else all. A batch that is run again replaces its own files."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    # A stream without any row leaves this empty batch.
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(*stream.columns)


@BOOK.add("stream_progress", "SELECT event_type, count(*) AS committed FROM events GROUP BY event_type")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(tm.progress(_events(spark, sf_dir), "event_type"), "complete")


@BOOK.add("stream_journal_once", "SELECT user_id, event_type, min(1)::INT AS once FROM events GROUP BY user_id, event_type")
def stream_journal_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).withColumn("at", F.col("ts").cast("timestamp"))
    return drained(tm.once(events, "key", "at", "3650 days").select("user_id", "event_type", F.lit(1).alias("once")), "append")


@BOOK.add("stream_energy", """
WITH p AS (SELECT gpu, power, at_s - lag(at_s) OVER w AS gap, lag(power) OVER w AS before FROM frames WINDOW w AS (PARTITION BY gpu ORDER BY sequence))
SELECT gpu, round(coalesce(sum((power + before) / 2 * gap) FILTER (ok), 0), 2) AS joules, count(*) FILTER (ok) AS pairs, 0::BIGINT AS broken
FROM (SELECT *, coalesce(power IS NOT NULL AND before IS NOT NULL AND gap > 0 AND gap <= 86400, false) AS ok FROM p) GROUP BY gpu""")  # fmt: skip
def stream_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are numbered by a batch query, written out in the shared scratch folder, and streamed back."""
    folder = scratch(spark, "frames")
    view(spark, sf_dir, "frames").select("gpu", "sequence", "at_s", F.col("power")).write.parquet(folder)
    frames = spark.readStream.schema("gpu bigint, sequence bigint, at_s double, power double").parquet(folder)
    last = drained(tm.running_energy(frames, 86400.0), "update")
    return last.groupBy("gpu").agg(F.max_by(F.struct("joules", "pairs", "broken"), "pairs").alias("x")).select("gpu", F.round("x.joules", 2).alias("joules"), "x.pairs", "x.broken")


@BOOK.add("lost_attempts", """
SELECT o_orderkey % 10 AS slot, count(*) AS attempts, count(*) FILTER (l.k IS NULL) AS unknown FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o.o_orderkey GROUP BY 1""")
def lost_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("ok").alias("status")).distinct()
    settled = tm.outcomes(view(spark, sf_dir, "orders").select("o_orderkey"), responses, "o_orderkey")
    return settled.groupBy((F.col("o_orderkey") % 10).alias("slot")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "unknown").alias("unknown"))


@BOOK.add("budget_admission", """
SELECT o_custkey, count(*) AS admitted FROM (SELECT o_custkey, sum(round(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders)
WHERE spent <= 500000 GROUP BY o_custkey""")  # fmt: skip
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = view(spark, sf_dir, "orders").withColumn("cost", F.round("o_totalprice").cast("long"))
    return tm.admitted(requests, "o_custkey", "o_orderkey", "cost", 500000).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("admitted"))


@BOOK.add("stream_chain_strict", """
WITH p AS (SELECT gpu, power, at_s - lag(at_s) OVER w AS gap, lag(power) OVER w AS before FROM frames WINDOW w AS (PARTITION BY gpu ORDER BY sequence))
SELECT gpu, count(*) FILTER (power IS NOT NULL AND before IS NOT NULL AND gap > 0 AND gap <= 86400) AS pairs, round(coalesce(sum(gap) FILTER (power IS NOT NULL AND before IS NOT NULL AND gap > 0 AND gap <= 86400), 0), 2) AS covered_s
FROM p GROUP BY gpu""")  # fmt: skip
def stream_chain_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that name the digest of the frame before them, streamed strictly: a break would stop the query."""
    folder, digest = scratch(spark, "frames"), F.sha2(F.concat_ws("/", "gpu", "sequence"), 256)
    before = F.when(F.col("sequence") > 0, F.sha2(F.concat_ws("/", F.col("gpu"), F.col("sequence") - 1), 256))
    view(spark, sf_dir, "frames").select("gpu", "sequence", "at_s", "power", digest.alias("sha256"), before.alias("previous_sha256")).write.parquet(folder)
    last = drained(tm.running_energy(spark.readStream.schema(tm.FRAME).parquet(folder), 86400.0, strict=True), "update")
    return last.groupBy("gpu").agg(F.max_by(F.struct("pairs", "covered_s"), "pairs").alias("x")).select("gpu", "x.pairs", F.round("x.covered_s", 2).alias("covered_s"))


@BOOK.add("stream_soak", """
WITH r AS (SELECT user_id, event_id, sum(value) OVER w AS spent, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT user_id, min(n) FILTER (spent >= 900) AS n FROM r GROUP BY user_id)
SELECT d.user_id, 'completed' AS status, r.n AS rounds, round(r.spent, 6) AS seconds FROM d JOIN r ON r.user_id = d.user_id AND r.n = d.n WHERE d.n <= 40
UNION ALL SELECT d.user_id, 'ceiling', r.n, round(r.spent, 6) FROM d JOIN r ON r.user_id = d.user_id AND r.n = 40 WHERE d.n IS NULL OR d.n > 40""")  # fmt: skip
def stream_soak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rounds of work: a user's rounds go on until they took long enough, or are too many."""
    rounds = _events(spark, sf_dir).where("user_id IS NOT NULL").select("user_id", "event_id", F.col("ts").alias("at"), F.col("value").alias("seconds"))
    with tm.state_in_rocksdb(spark):
        return drained(tm.soak(rounds, "user_id", "at", "event_id", "seconds", 900.0, 40), "append").withColumn("seconds", F.round("seconds", 6))
