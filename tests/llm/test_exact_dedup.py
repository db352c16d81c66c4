import hashlib
import random
import re

import pytest

from quillwork.llm import exact_dedup as ed
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table


def brute(docs: list[tuple]) -> list[tuple]:
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for n, own in groups.items():
        best = min(own, key=lambda i: (-len(docs[i][1] or ""), docs[i][0] is None, docs[i][0] or 0, i))
        for i in own:
            out.append((_id(docs[i][0]), _id(docs[best][0]), len(own), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def _id(x):
    return -(10**9) if x is None or x != x else int(x)


def plain(got):
    return sorted((_id(a), _id(b), int(c), d) for a, b, c, d in got[["doc_id", "keep_id", "group_size", "text_sha256"]].itertuples(index=False))


@pytest.mark.parametrize("bits", [64, 3])
def test_awkward(spark, bits):
    """With 3-bit hashes nearly every identifier is ambiguous, and the result is the same."""
    docs = [r[:2] for r in awkward_rows()]
    got = rows(ed.exact_duplicates(awkward(spark), hash_bits=bits))
    assert plain(got) == brute(docs)
    assert got.kept.sum() == len({x[3] for x in brute(docs)})
    assert rows(ed.exact_duplicates(empty(spark))).empty


@pytest.mark.parametrize("bits", [64, 6])
def test_whole_table(spark, sf, bits):
    docs = table(sf, "documents")
    got = rows(ed.exact_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), hash_bits=bits))
    assert plain(got) == brute(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))
    assert (got.kept == (got.doc_id == got.keep_id)).all()


def test_chunks_follow_content(spark):
    """An insertion at the front changes few chunks; chunks put together are the text."""
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz.,") for _ in range(60_000))
    df = spark.createDataFrame([(1, body), (2, "inserted" + body), (3, "x" * 20_000)], "i int, t string")
    from pyspark.sql import functions as F

    found = {r.i: r.c for r in df.select("i", ed.chunks(F.col("t")).alias("c")).collect()}
    assert "".join(found[1]) == body and "".join(found[3]) == "x" * 20_000
    assert len(set(found[1]) & set(found[2])) >= len(found[1]) - 2 and len(found[1]) > 10
