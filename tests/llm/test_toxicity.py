import zlib

import numpy as np
import pytest

from quillwork.llm import toxicity as tx
from tests.llm.helpers import awkward, awkward_rows, empty, prose, rows, table


@pytest.fixture(scope="module")
def labelled():
    bad = ["vile", "grubby", "lowefoo", "lowebar", "lowebaz"]
    texts = [prose(i, 60 + i % 50) for i in range(400)]
    truth = np.array([i % 4 == 0 for i in range(400)], dtype=np.int64)
    for i in range(0, 400, 4):
        words = texts[i].split()
        words[(i * 7) % len(words)] = bad[i // 4 % len(bad)] + ("," if i % 8 else "")
        texts[i] = " ".join(words)
    return texts, truth


def test_gradient():
    rng = np.random.default_rng(0)
    words = tx.Words([["idiot", "the", "of"]] * 9)
    net = tx.Network(len(words.word), len(words.keys) - 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    inputs, index = words.inputs(["idiot", "the", "of", "other"]), rng.integers(0, 4, (3, 5))
    mask, y = np.ones((3, 5), bool), np.array([1.0, 0, 1])
    mask[0, 3:] = False

    def loss():
        p = tx._sigmoid(net.forward(net.project(net.embed(*inputs)[0]), index, mask))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    numeric = {}
    for k in ("word", "in", "bias", "re", "att", "att_b", "att_v", "out", "out_b"):
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in net.p[k].shape)
            at = net.p[k][i]
            net.p[k][i] = at + 1e-3
            up = loss()
            net.p[k][i] = at - 1e-3
            numeric[k, i] = (up - loss()) / 2e-3
            net.p[k][i] = at
    net.train(inputs, index, mask, y, np.ones(3))
    for (k, i), value in numeric.items():
        assert abs(net.m[k][0][i] * 10 - value) < 1e-3


def test_learns_words_and_stems(labelled):
    texts, truth = labelled
    scorer = tx.fit(texts[:300], truth[:300])
    got = scorer.scores(texts[300:])
    assert ((got >= 0.5) == truth[300:]).mean() >= 0.97
    assert scorer.scores([prose(9, 3000) + " vile " + prose(8, 3000), prose(9, 3000)])[0] >= 0.5


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 47, 48, 49, 1000):
        starts = tx.windows(n)
        seen = np.zeros(n, bool)
        for s in starts:
            seen[s : s + tx.WINDOW] = True
        assert seen.all() and len(set(starts.tolist())) == len(starts) and (np.diff(starts) <= tx.STRIDE).all()


def test_batches_and_caches_change_nothing(labelled):
    texts, truth = labelled
    scorer = tx.fit(texts[:200], truth[:200], epochs=3)
    together = scorer.scores(texts[:40])
    scorer.prepare()
    assert np.allclose(together, np.concatenate([scorer.scores([t]) for t in texts[:40]]), atol=1e-5)


def test_held_out_accuracy(spark):
    got = rows(tx.op8_toxicity(spark, "/root/testdata/sf0.1"))
    labels = table("/root/testdata/sf0.1", "labels").merge(got, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = labels[labels.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.95


def test_awkward(spark, labelled):
    texts, truth = labelled
    learned = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1000 + i, int(y)) for i, y in enumerate(truth)] + [(None, 1)], "doc_id long, toxic int")
    docs = awkward(spark).select("doc_id", "text", "source").unionByName(learned)
    got = rows(tx.score(docs, labels))
    assert len(got) == len(awkward_rows()) + 400 and got.score.notna().all()
    assert (rows(tx.score(awkward(spark), labels.limit(0))).predicted == 0).all()
    assert rows(tx.score(empty(spark), labels)).empty


def test_the_training_sample_is_bounded_and_whole(spark, monkeypatch):
    """Long texts take part, repeated ids give one text, held-out rows give none."""
    monkeypatch.setattr(tx, "SAMPLE", 30)
    monkeypatch.setattr(tx, "SAMPLE_CHARS", 100_000)
    from pyspark.sql import functions as F

    docs = spark.range(400).selectExpr("id as doc_id", "case when id = 3 then repeat('long text ', 40000) else concat('text ', id) end as text")
    docs = docs.union(spark.range(500).selectExpr("cast(5 as bigint)", "concat('copy ', id)")).select("*", F.lit("x").alias("t"), F.lit("y").alias("pick"), F.lit("z").alias("truth"), F.lit(1).alias("turn"))
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").withColumn("size", F.lit("w"))
    got = tx.sample(docs, labels)
    assert got.doc_id.is_unique and got.groupby("truth").size().max() <= 30
    assert not {i for i in got.doc_id if zlib.crc32(str(int(i)).encode()) % 5 == 0}
    few = tx.sample(docs.where("doc_id in (3, 5, 7, 4, 6)"), labels.where("doc_id in (3, 5, 7, 4, 6)"))
    held_in = {i for i in (3, 5, 7, 4, 6) if zlib.crc32(str(i).encode()) % 5}
    assert {3, 4} <= set(few.doc_id) <= held_in and few.t.str.len().max() == 400_000
    assert tx.sample(docs.limit(0), labels).empty and tx.sample(docs, labels.limit(0)).empty
