import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillwork.llm import mixing as mx
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_shard"]


def words(text) -> list[str]:
    return [w for w in "".join("\n" if c in " \t\n\v\f\r" else c for c in text or "").split("\n") if w]


def poured(sizes: dict) -> dict:
    """Targets by pouring what is over again and again; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while rest > 1e-9 and open_:
        by, rest_now = sum(weight[s] for s in open_), rest
        rest = 0.0
        for s in list(open_):
            target[s] += rest_now * weight[s] / by
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def checked(got: pd.DataFrame, docs: list[tuple]) -> None:
    """got against (doc_id, text, source): sizes and targets by brute force, the mix by what it must hold."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    target = poured(sizes)
    key = lambda r: tuple("" if pd.isna(x) else str(int(x)) for x in r[:3]) + (round(r[3], 6),)
    expected = sorted(key((d, len(words(t)), sizes[s], target[s])) for d, t, s in docs)
    assert sorted(map(key, got[["doc_id", "size", "source_size", "target"]].itertuples(index=False))) == expected
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    by = got.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), n=("size", "sum")).reset_index()
    for size, goal, took, n in by.itertuples(index=False):
        assert abs(took - goal * n / max(size, 1)) <= 2 * mx.BLOCK * max(1, n // max(size, 1)), (size, goal, took)


def plain(got: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in got[COLUMNS].itertuples(index=False)), key=str)


def test_whole_table(spark, sf):
    docs = table(sf, "documents")
    checked(rows(mx.op12_mixing(spark, sf)), list(docs[["doc_id", "text", "source"]].itertuples(index=False, name=None)))


@pytest.mark.parametrize("level", ["0.001", "0.01"])
def test_sql_agrees(spark, level):
    sf = f"/root/testdata/sf{level}"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert plain(rows(mx.op12_mixing(spark, sf))) == plain(con.execute(mx.SQL).df())


def test_sql_agrees_with_several_shards(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 400 as int)) as text", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 11) end as source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = rows(mx.op12_mixing(spark, str(tmp_path)))
    assert got.first_shard.max() >= 1
    assert plain(got) == plain(con.execute(mx.SQL).df())


def test_partitions_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = plain(rows(mx.taken(mx.mix(docs))))
    monkeypatch.setattr(mx, "CELL_ROWS", 3)
    monkeypatch.setattr(mx, "CELLS", 7)
    assert plain(rows(mx.taken(mx.mix(docs.repartition(7, F.rand()))))) == first


@pytest.mark.parametrize("seed", range(8))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 7, r.randrange(100), r.randrange(100_000)]) for i in range(r.randrange(1, 30))}
    got = rows(mx.targets(spark.createDataFrame([("=" + s, n) for s, n in sizes.items()], "stratum string, source_size long")))
    expected = poured(sizes)
    for s, goal in zip(got.stratum, got.target, strict=True):
        assert goal == pytest.approx(expected[s[1:]], abs=1e-6)
    assert (got.quota <= mx.MOST_TIMES * got.blocks).all()


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 1000003])
def test_permutation(spark, n):
    rows_ = spark.range(n).withColumn("of", F.lit(n).cast("long")).withColumns(mx._keys(F.lit(3), F.lit(n).cast("long")))
    moved = rows_.select("id", mx._permuted(F.col("id"), F.col("of")).alias("q"))
    got = moved.agg(F.count_distinct("q"), F.min("q"), F.max("q"), F.count_if(F.col("q") == F.col("id")), F.corr("id", "q")).first()
    assert got[:3] == (n, 0, n - 1)
    if n >= 64:
        assert got[3] < max(8, n / 100) and abs(got[4]) < 4 / n**0.5


def test_slots_and_pieces(spark):
    """Quotas hold exactly, blocks are used equally often, shards have random counts, and pieces are whole blocks."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', 50 + cast(id % 100 as int)) as text", "case when id % 2 = 0 then 'hot' when id < 40 then 'small' else concat('s', id % 5) end as source")
    mixed = mx.mix(docs)
    slots, sources = rows(mixed.slots), rows(mixed.sources)
    assert slots.groupby("place").size().to_dict() == {p: q for p, q in zip(sources.place, sources.quota, strict=True) if q}
    for p, of in slots.groupby("place"):
        blocks = int(sources.blocks[sources.place == p].iloc[0])
        used = of.groupby("block").size().reindex(range(blocks), fill_value=0)
        assert used.max() - used.min() <= 1 and used.max() <= mx.MOST_TIMES
    counts = slots.groupby("shard").size()
    assert set(counts[:-1]) == {mx.SHARD_SLOTS} and len(counts) >= 2
    odds = (sources.set_index("place").quota / sources.quota.sum()).sort_index()
    share = (slots[slots.shard == 0].groupby("place").size() / mx.SHARD_SLOTS).reindex(odds.index, fill_value=0.0)
    assert ((share - odds).abs() < 5 * (odds * (1 - odds) / mx.SHARD_SLOTS) ** 0.5).all()
    found = rows(mx.pieces(mixed))
    for (p, block, shard), n in found.groupby(["place", "block", "shard"]).length.sum().items():
        times = len(slots[(slots.place == p) & (slots.block == block) & (slots.shard == shard)])
        last = int(sources.blocks[sources.place == p].iloc[0]) - 1
        assert n == times * mx.BLOCK or block == last


def test_equal_rows(spark):
    """A third of all rows are one row: laid out in runs, each a document of its own."""
    docs = [(7, "a b c d e", "x")] * 3500 + [(None, "n m", None)] * 1200 + [(i, "one two three " * (i % 40), f"s{i % 3}") for i in range(3000)]
    got = rows(mx.taken(mx.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))))
    checked(got, docs)


def test_awkward(spark):
    checked(rows(mx.taken(mx.mix(awkward(spark)))), [(r[0], r[1], r[3]) for r in awkward_rows()])
    assert rows(mx.taken(mx.mix(empty(spark)))).empty
    bare = [(1, None, "a"), (2, " \n", "b"), (2, " \n", "b")]
    got = rows(mx.taken(mx.mix(spark.createDataFrame(bare, "doc_id long, text string, source string"))))
    assert len(got) == 3 and got.taken.sum() == 0 and got.first_shard.isna().all() and (got.target == 0).all()
