from collections import Counter, defaultdict

import numpy as np
import pytest

from quillwork.llm import near_dedup as nd
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table


def brute_classes(docs: list[tuple]) -> dict[int, int]:
    """Row to class by all links of shingle sets at 0.8, from an inverted index."""
    sets = [set(nd.shingle_set(t or "").tolist()) for _, t in docs]
    root, holders = list(range(len(docs))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x]).items():
            if both >= nd.THRESHOLD * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    return {i: find(i) for i in range(len(docs))}


def assert_same(got, docs):
    truth = defaultdict(list)
    for i, c in brute_classes(docs).items():
        truth[c].append(docs[i][0])
    expected = Counter(tuple(sorted((-999 if x is None else x) for x in ids)) for ids in truth.values())
    assert sum(expected.values()) == got.kept.sum()
    sizes = Counter(len(ids) for ids in truth.values() for _ in ids)
    assert Counter(got.class_size.tolist()) == sizes
    for ids in truth.values():
        known = [x for x in ids if x is not None]
        if len(known) == len(ids) and all(sum(d == x for d, _ in docs) == 1 for x in known):
            assert set(got[got.doc_id.isin(known)].class_id) == {min(known)}


def test_sf(spark, sf):
    docs = table(sf, "documents")
    assert_same(rows(nd.op4_near_dedup(spark, sf)), list(zip(docs.doc_id.tolist(), docs.text, strict=True)))


def test_awkward(spark):
    got = rows(nd.near_duplicates(awkward(spark)))
    assert_same(got, [r[:2] for r in awkward_rows()])
    assert rows(nd.near_duplicates(empty(spark))).empty


def test_chain_of_links(spark):
    """Each text is like the next but not like the one after: one class all the same."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 25 : i * 25 + 250])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(nd.near_duplicates(df)).class_id) == {0}


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    elements = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 200).astype(float), rng.integers(1, 6, 200).astype(float)
    ea, eb = elements[:200], elements[60:260]
    x, y = dict(zip(ea.tolist(), a, strict=True)), dict(zip(eb.tolist(), b, strict=True))
    every = set(x) | set(y)
    truth = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x if i in y)
    m = 4096
    s = nd.sketches(np.concatenate([ea, eb]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, m)
    assert abs((s[0] == s[1]).mean() - truth) < 0.03
    # Scaling all weights of a text changes no register, nor does company in the batch.
    alone = nd.sketches(ea, a * 7.0, np.zeros(200, int), 1, m)
    assert (alone[0] == s[0]).all()


def test_repeated_lines_do_not_part_near_copies(spark):
    """A line repeated 10 to 100 times in one of two near copies: the shingle sets are alike all the same."""
    docs = []
    for i in range(24):
        own, line = " ".join(f"d{i}w{k}" for k in range(100 + 50 * (i % 5))), " ".join(f"d{i}l{k}" for k in range(24))
        docs += [(2 * i, f"{own}\n{line}"), (2 * i + 1, own + f"\n{line}" * (10, 30, 100)[i % 3])]
    sets = [nd.shingle_set(t) for _, t in docs]
    assert all(nd.jaccard(sets[i], sets[i + 1]) >= nd.THRESHOLD for i in range(0, len(docs), 2))
    got = rows(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert_same(got, docs)
    assert set(got.class_size) == {2}


def crowd(n: int, pairs: int) -> list[tuple]:
    """n texts that differ from one passage by little and are just too unlike to be links, and pairs of links among
    them that share two shingles more: nearly all buckets of a pair are those of the crowd."""
    passage = " ".join(f"p{k}" for k in range(160))
    own = [[f"d{i}w{k}" for k in range(20)] for i in range(n)]
    for i in range(pairs):
        own[n - 1 - i][:2] = own[n // 3 + i][:2]
    return [(i, f"{passage} {' '.join(w)}") for i, w in enumerate(own)]


def test_pairs_in_crowded_buckets(spark):
    """Similar texts meet in buckets of a thousand others, though neither is a bucket's first."""
    docs = crowd(1200, 60)
    got = rows(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert_same(got, docs)
    assert (got.class_size == 2).sum() == 120


def test_blocks_of_a_group_all_meet(spark):
    docs = crowd(90, 20)
    sets = spark.createDataFrame([(i, bytearray(nd.shingle_set(t).tobytes())) for i, t in docs], "node long, shingles binary")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 90)], "a long, b long")
    labels = spark.createDataFrame([(i, i // 2 * 2) for i in range(10)], "node long, label long")
    for block in (1500, 10**6):
        tasks = nd.crowded(pairs, sets.select("node"), labels, sets, block)
        assert (tasks.select("i", "j").distinct().count() > 20) == (block == 1500)
        links = rows(tasks.mapInPandas(lambda b: nd._across(b, 0.8), "a long, b long"))
        assert {(min(x), max(x)) for x in links.itertuples(index=False)} == {(30 + i, 89 - i) for i in range(20)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none", "two"])
def test_components_by_union_find(spark, shape):
    rng = np.random.default_rng(7)
    edges = {
        "chain": [(i, i + 1) for i in rng.permutation(60).tolist()],
        "star": [(30, i) for i in range(60) if i != 30] + [(5, 5)],
        "random": [tuple(x) for x in rng.integers(0, 120, (90, 2)).tolist()],
        "none": [],
        "two": [(9, 4), (4, 9)],
    }[shape]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = nd.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == root
