import hashlib
import zlib

import duckdb
import pandas as pd
import pytest

from quillwork.llm import sharding as sh
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table


def brute(docs: list[tuple]) -> list[tuple]:
    """(doc_id, size, crc, shard, slot) by two plain sorts."""
    made = []
    for d, t, s in docs:
        raw = (t or "").encode()
        u = int(hashlib.md5((sh.SEED + ("" if d is None else f":{d}")).encode()).hexdigest()[:15], 16)
        made.append(("" if s is None else "=" + s, u, -(10**20) if d is None else d, zlib.crc32(raw), len(raw) + 8, d))
    frame = pd.DataFrame(made, columns=["s", "u", "k", "crc", "size", "d"]).sort_values(["s", "u", "k", "crc", "size"])
    frame["f"] = (frame.groupby("s").cumcount() + 0.5) / frame.groupby("s").s.transform("size")
    frame = frame.sort_values(["f", "s", "u", "k", "crc", "size"]).reset_index(drop=True)
    n = len(frame)
    return sorted(
        (-(10**20) if r.d is None or r.d != r.d else int(r.d), int(r.size_), int(r.crc), i * 24 // n, i - (i * 24 // n * n + 23) // 24)
        for i, r in enumerate(frame.rename(columns={"size": "size_"}).itertuples())
    )


def plain(got: pd.DataFrame) -> list[tuple]:
    return sorted(
        (-(10**20) if d is None or d != d else int(d), int(a), int(b), int(c), int(e)) for d, a, b, c, e in got[["doc_id", "size", "text_crc32", "shard", "slot"]].itertuples(index=False)
    )


def test_whole_table(spark, sf):
    docs = table(sf, "documents")
    got = rows(sh.op5_sharding(spark, sf))
    assert plain(got) == brute(list(zip(docs.doc_id.tolist(), docs.text, docs.source, strict=True)))
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 24


@pytest.mark.parametrize("level", ["0.001", "0.01"])
def test_sql_agrees(spark, level):
    sf = f"/root/testdata/sf{level}"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert plain(rows(sh.op5_sharding(spark, sf))) == plain(con.execute(sh.SQL).df())


def test_repeated_and_null_ids_are_spread(spark):
    """Rows of one id fill shards as any others do: every shard has its share of them."""
    docs = spark.range(2000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as doc_id", "'x' as text", "'one' as source")
    got = rows(sh.interleave(docs, bucket_rows=50))
    assert len(got) == 2000
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    per_shard = got.assign(null=got.doc_id.isna(), seven=got.doc_id == 7).groupby("shard")[["null", "seven"]].sum()
    assert per_shard.to_numpy().min() > 10


def test_small_buckets_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert plain(rows(sh.interleave(docs))) == plain(rows(sh.interleave(docs, bucket_rows=2)))


def test_every_shard_has_the_mixture(spark):
    docs = spark.range(4800).selectExpr("id as doc_id", "cast(id as string) as text", "case when id % 10 < 5 then 'hot' when id % 10 < 8 then 'b' else 'c' end as source")
    got = rows(sh.interleave(docs).join(docs.drop("text"), "doc_id"))
    share = got.groupby(["shard", "source"]).size().unstack()
    assert (share.max() - share.min()).max() <= 2


def test_awkward(spark):
    got = rows(sh.interleave(awkward(spark)))
    assert plain(got) == brute([(r[0], r[1], r[3]) for r in awkward_rows()])
    assert rows(sh.interleave(empty(spark))).empty
