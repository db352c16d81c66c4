from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillwork.llm import filter_audit as fa
from tests.llm.helpers import EXTRA, awkward, awkward_rows, empty, rows, table

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SPACE = " \t\n\v\f\r"


def failed(docs: list[tuple]) -> list[set]:
    """Of (id, text) the filters that each fails, one document at a time."""
    least: dict = {}
    for i, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in docs:
        t = t or ""
        words = [w for w in "".join("\n" if c in SPACE else c for c in t).split("\n") if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if set("#$%&*|") & set(t) else set()
        out.append(fails | ({"E"} if i is not None and least[t] < i else set()))
    return out


def brute(docs: list[tuple], good: set, toxic: set) -> list[tuple]:
    """Every order applied step by step to every document of (id, text, part)."""
    fails, out, total = failed([d[:2] for d in docs]), [], Counter()
    parts = {p or "" for _, _, p in docs}
    for part in parts:
        own = [(f, i in good, i in toxic) for f, (i, _, p) in zip(fails, docs, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                total[part, x] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(x in d[0] for d in own) - len(gone), sum(d[0] == {x} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def plain(got: pd.DataFrame) -> list[tuple]:
    return sorted(got[COLUMNS].itertuples(index=False, name=None))


def labels_of(spark, found):
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")


def test_whole_table(spark, sf):
    docs, labels = table(sf, "documents"), table(sf, "labels")
    got = rows(fa.op11_filter_audit(spark, sf))
    assert plain(got) == brute(
        [(int(d), t, s) for d, t, s in docs[["doc_id", "text", "source"]].itertuples(index=False)], set(labels.doc_id[labels.quality == 1]), set(labels.doc_id[labels.toxic == 1])
    )
    assert len(got) == 600 * docs.source.nunique()


@pytest.mark.parametrize("level", ["0.001", "0.01"])
def test_sql_agrees(spark, level):
    sf = f"/root/testdata/sf{level}"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert plain(rows(fa.op11_filter_audit(spark, sf))) == plain(con.execute(fa.SQL).df())


def test_awkward(spark):
    good, toxic = [(1, 1, 0), (1, 0, 1), (9, 1, None), (None, 1, 1), (3, 0, 1), (77, 1, 1)], {1, 3}
    made = rows(fa.audit(awkward(spark), labels_of(spark, good).withColumns({c: F.lit("y") for c in EXTRA})))
    assert plain(made) == brute([(r[0], r[1], r[3]) for r in awkward_rows()], {1, 9}, toxic)
    assert rows(fa.audit(empty(spark), labels_of(spark, good))).empty


def test_copies_across_parts_and_no_labels(spark):
    docs = [(i, "Same text", p) for i, p in ((5, "a"), (3, "b"), (3, "b"), (9, None), (None, "a"), (4, ""))] + [(1, None, "a"), (2, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    made = rows(fa.audit(df, labels_of(spark, []).limit(0)))
    assert plain(made) == brute(docs, set(), set())
    assert set(made.part) == {"a", "b", ""}


@pytest.mark.parametrize("seed", range(5))
def test_polynomial(seed):
    """Corners count what a set of filters removes; the integral is the mean over all orders, which c / |mask| sums to."""
    counts = {m: (m * 7919 + seed * 104729) % 23 for m in range(32)}
    p = fa.polynomial(counts)
    assert fa.corners(p) == [sum(n for m, n in counts.items() if m & s) for s in range(32)]
    for f in range(5):
        assert fa.shapley(p, f) == sum(120 // m.bit_count() * n for m, n in counts.items() if m >> f & 1)
