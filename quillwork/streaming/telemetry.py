"""Streams of sensor frames: torn tails, running energy with chain checks, progress, idempotent journals."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "gpu bigint, sequence bigint, at_s double, power double, sha256 string, previous_sha256 string"


def frame_lines(spark: SparkSession, path: str) -> DataFrame:
    """Frames of an append-only folder of JSON lines, with the file and line they come from. Only a last line without a line
    break may be torn and is left out; any other line that is no frame stops the query. A file is read as a whole."""
    whole = spark.readStream.option("maxFilesPerTrigger", 1).text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("l"))
    complete = lines.select("file_time", "file", F.posexplode(F.slice("l", 1, F.size("l") - 1)).alias("line", "value")).where(F.trim("value") != "")
    frames = complete.select("file_time", "file", "line", "value", F.from_json("value", FRAME).alias("f"))
    damaged = F.raise_error(F.concat(F.lit("a damaged line in "), F.col("file")))
    return frames.withColumn("sequence", F.when(F.col("f.sequence").isNotNull(), F.col("f.sequence")).otherwise(damaged.cast("bigint"))).select("file_time", "file", "line", "f.gpu", "sequence", "f.at_s", "f.power", "f.sha256", "f.previous_sha256")


ENERGY = "gpu bigint, joules double, covered_s double, pairs bigint, broken bigint"
_STATE = "sequence bigint, at_s double, power double, joules double, covered_s double, pairs bigint, broken bigint, sha256 string"
_WRITTEN = ["file_time", "file", "line"]


def running_energy(frames: DataFrame, most_gap: float, strict: bool = False) -> DataFrame:
    """Per sensor, after every batch: energy over adjacent frames, the time covered, and breaks of the chain.

    The state is one row a sensor. Frames are taken in the order they were written in (file and line), if they say
    where that was, else by sequence. A frame breaks the chain if its sequence does not follow, or if it names another digest than
    the frame before it has; one that steps back adds nothing. strict: a break stops the query."""
    written = all(x in frames.columns for x in _WRITTEN)
    chained = "previous_sha256" in frames.columns

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, at, power, joules, covered, pairs, broken, digest = state.get if state.exists else (-1, 0.0, float("nan"), 0.0, 0.0, 0, 0, None)
        rows = pd.concat(list(batches)).sort_values(_WRITTEN if written else "sequence", kind="stable")
        links = zip(rows["sha256"].tolist(), rows["previous_sha256"].tolist(), strict=True) if chained else [(None, None)] * len(rows)
        for s, t, p, (own, previous) in zip(*(rows[c].tolist() for c in ("sequence", "at_s", "power")), links, strict=True):
            torn = s <= seq or (seq >= 0 and s != seq + 1) or (previous is not None and seq >= 0 and previous != digest)
            if torn and strict:
                raise ValueError(f"sensor {key[0]}: frame {s} does not follow frame {seq}")
            broken += torn
            if s <= seq:
                continue
            if s == seq + 1 and power == power and p == p and 0 < t - at <= most_gap:
                joules, covered, pairs = joules + (p + power) / 2 * (t - at), covered + t - at, pairs + 1
            seq, at, power, digest = s, t, p, own
        state.update((seq, at, power, joules, covered, pairs, broken, digest))
        yield pd.DataFrame([(key[0], joules, covered, pairs, broken)], columns=["gpu", "joules", "covered_s", "pairs", "broken"])

    return frames.groupBy("gpu").applyInPandasWithState(update, ENERGY, _STATE, "update", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, task: str) -> DataFrame:
    """Committed records by task, complete after every batch."""
    return events.groupBy(task).agg(F.count(F.lit(1)).alias("committed"))


def once(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each logical key once, remembered for delay behind the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def journal(batch: DataFrame, committed: str, key: str) -> DataFrame:
    """For foreachBatch: the rows of a batch whose key is not committed yet, one a key."""
    return batch.dropDuplicates([key]).join(batch.sparkSession.read.parquet(committed).select(key), key, "left_anti")


def outcomes(intents: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Intents with their response status; one that was lost is unknown and keeps its reservation."""
    both = intents.join(responses.select(key, "status"), key, "left")
    return both.withColumn("status", F.coalesce("status", F.lit("unknown")))


def admitted(requests: DataFrame, scope: str, order: str, cost: str, cap: float) -> DataFrame:
    """Requests of each scope whose running cost stays within the cap."""
    from pyspark.sql import Window

    spent = F.sum(cost).over(Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("spent", spent).where(F.col("spent") <= cap)


class Soak(StatefulProcessor):
    """Adds up the rounds of a key, in their order, until they took long enough (completed) or are too many (ceiling); says so once.
    A round whose time is unknown counts and adds nothing; seconds are null if no round has a time."""

    def __init__(self, columns: list[str], target: float, most: int):
        self.columns, self.target, self.most = columns, target, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "rounds bigint, timed bigint, seconds double, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        rounds, timed, seconds, done = self.spent.get() if self.spent.exists() else (0, 0, 0.0, False)
        name, *order, took = self.columns
        said = []
        for more in [] if done else pd.concat(list(rows)).sort_values(order, kind="stable")[took].tolist():
            rounds = rounds + 1
            if more is not None and more == more:
                timed, seconds = timed + 1, seconds + more
            enough = timed > 0 and seconds >= self.target
            if enough or rounds >= self.most:
                said, done = [(key[0], "completed" if enough else "ceiling", rounds, seconds if timed else float("nan"))], True
                break
        self.spent.update((rounds, timed, seconds, done))
        yield pd.DataFrame(said, columns=[name, "status", "rounds", "seconds"])

    def close(self) -> None:
        pass


def soak(rounds: DataFrame, key: str, at: str, order: str, seconds: str, target: float, most: int) -> DataFrame:
    """key, status, rounds, seconds: one row a key as soon as its rounds took target seconds, or are most in number. The state is
    one row a key; the rounds of a batch are taken in order."""
    kind = dict(rounds.dtypes)[key]
    processor = Soak([key, at, order, seconds], target, most)
    return rounds.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, status string, rounds bigint, seconds double", "Append", "None")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with named state need, for the streams started within."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)
