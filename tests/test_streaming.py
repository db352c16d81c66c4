import os

import pytest
from pyspark.sql import functions as F

from quillwork.plans.streams import drained
from quillwork.streaming import telemetry as tm


def test_torn_tail_and_running_energy(spark, tmp_path):
    frames = [(0, 10.0), (1, 20.0), (2, None), (9, 30.0), (10, 50.0)]
    lines = [f'{{"gpu":1,"sequence":{i},"at_s":{t},"power":{"null" if p is None else p}}}' for i, (t, p) in enumerate(frames)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:3]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[3:]) + '\n{"gpu":1,"seq')  # torn: the last line has no line break
    os.utime(tmp_path / "a.jsonl", (1, 1))  # files are taken in the order of their times
    last = drained(tm.running_energy(tm.frame_lines(spark, str(tmp_path)), 2.5), "update").orderBy(F.desc("pairs")).first()
    assert (last.joules, last.covered_s, last.pairs, last.broken) == (55.0, 2.0, 2, 0)


def test_journal_takes_each_key_once(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(f"{tmp_path}/done")
    batch = spark.createDataFrame([(2, "a"), (3, "b"), (3, "c")], "k long, v string")
    assert [r.k for r in tm.journal(batch, f"{tmp_path}/done", "k").collect()] == [3]


def test_lost_attempts_are_unknown(spark):
    got = tm.outcomes(spark.range(2).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "ok")], "k long, status string"), "k")
    assert {r.k: r.status for r in got.collect()} == {0: "ok", 1: "unknown"}


def test_admission_stops_at_the_cap(spark):
    df = spark.createDataFrame([("s", i, 4.0) for i in range(5)], "scope string, i int, cost double")
    assert tm.admitted(df, "scope", "i", "cost", 10.0).count() == 2


def _written(folder, *files):
    for i, lines in enumerate(files):
        (folder / f"{i}.jsonl").write_text("".join(x + "\n" for x in lines))
        os.utime(folder / f"{i}.jsonl", (i + 1, i + 1))


def _frame(i, previous="null", **change):
    import json

    return json.dumps({"gpu": 1, "sequence": i, "at_s": float(i), "power": 10.0, "sha256": f"d{i}", "previous_sha256": None if previous == "null" else previous} | change)


def test_a_damaged_line_in_the_middle_stops_the_stream(spark, tmp_path):
    _written(tmp_path, [_frame(0), '{"gpu":1,"seq', _frame(1)])
    with pytest.raises(Exception, match="damaged line"):
        drained(tm.running_energy(tm.frame_lines(spark, str(tmp_path)), 2.5), "update")


@pytest.mark.parametrize("bad", [[_frame(0), _frame(2)], [_frame(1), _frame(0)], [_frame(0), _frame(0)], [_frame(0), _frame(1, "d7")]])
def test_disorder_and_broken_chains_are_seen(spark, tmp_path, bad):
    """In the order of writing: within a file and between files."""
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    _written(tmp_path / "one", bad)
    _written(tmp_path / "two", bad[:1], bad[1:])
    for folder in ("one", "two"):
        frames = lambda folder=folder: tm.frame_lines(spark, f"{tmp_path}/{folder}")
        assert drained(tm.running_energy(frames(), 2.5), "update").selectExpr("max(broken)").first()[0] == 1
        with pytest.raises(Exception, match="does not follow"):
            drained(tm.running_energy(frames(), 2.5, strict=True), "update")


def test_a_whole_chain_passes(spark, tmp_path):
    _written(tmp_path, [_frame(0), _frame(1, "d0")], [_frame(2, "d1")])
    last = drained(tm.running_energy(tm.frame_lines(spark, str(tmp_path)), 2.5, strict=True), "update").orderBy(F.desc("pairs")).first()
    assert (last.joules, last.pairs, last.broken) == (20.0, 2, 0)


def test_an_empty_stream_leaves_no_rows(spark, tmp_path):
    frames = spark.readStream.schema("gpu bigint, sequence bigint, at_s double, power double").parquet(str(tmp_path))
    assert drained(tm.running_energy(frames, 2.5), "update").count() == 0


def test_soak_goes_on_over_batches(spark, tmp_path):
    """State is kept between files; a key speaks once, and a rate source feeds the same processor."""
    rows = [(1, i, 1.0) for i in range(4)] + [(2, i, 5.0) for i in range(4)] + [(3, i, 0.1) for i in range(6)]
    for n, part in enumerate((rows[0::2], rows[1::2])):
        spark.createDataFrame(part, "k long, i long, s double").selectExpr("k", "timestamp_seconds(i) AS at", "i", "s").coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    stream = spark.readStream.schema("k long, at timestamp, i long, s double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    with tm.state_in_rocksdb(spark):
        got = {r.k: (r.status, r.rounds) for r in drained(tm.soak(stream, "k", "at", "i", "s", 4.0, 5), "append").collect()}
    assert got == {1: ("completed", 4), 2: ("completed", 1), 3: ("ceiling", 5)}
    rate = spark.readStream.format("rate").option("rowsPerSecond", 50).load().selectExpr("value % 2 AS k", "timestamp AS at", "value AS i", "1.0D AS s")
    with tm.state_in_rocksdb(spark):
        query = tm.soak(rate, "k", "at", "i", "s", 3.0, 100).writeStream.format("memory").queryName("soaked").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            for _ in range(60):
                query.processAllAvailable()
                if spark.table("soaked").count() == 2:
                    break
        finally:
            query.stop()
    assert {(r.status, r.rounds) for r in spark.table("soaked").collect()} == {("completed", 3)}
