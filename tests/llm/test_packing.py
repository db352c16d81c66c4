import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillwork.llm import packing
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(got, docs: list[tuple], library):
    """Every id in one piece, sequences gapless and full but for the last of each shard."""
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in docs]
    want = sorted((-1 if d is None or d != d else d, len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(docs, ids, strict=True))
    assert sum(len(i) for i in ids) == got.length.sum()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= packing.WINDOW
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    for shard, n in sizes.groupby(np.right_shift(sizes.index.to_numpy(), 32)):
        assert (n.sort_index().iloc[:-1] == packing.WINDOW).all(), shard
    by_id = {}
    for (d, _), i in zip(docs, ids, strict=True):
        by_id.setdefault(d, []).append(i)
    for d, own in by_id.items():
        pieces = got[got.doc_id.isna()] if d is None else got[got.doc_id == d]
        if len(own) == 1:
            at = 0
            for p in pieces.sort_values("start").itertuples():
                assert p.start == at and p.doc_tokens == len(own[0]) and p.ids_crc32 == zlib.crc32(own[0][at : at + p.length].tobytes())
                at += p.length
            assert at == len(own[0])
        else:
            assert pieces.length.sum() == sum(map(len, own))
    return want


def test_whole_table(spark, sf, library):
    docs = table(sf, "documents")
    got = rows(packing.op3_packing(spark, sf))
    check(got, list(zip(docs.doc_id.tolist(), docs.text, strict=True)), library)


def test_small_shards(spark, sf, library):
    docs = table(sf, "documents")
    got = rows(packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), shard_load=20_000))
    assert len(set((got.sequence_id.to_numpy() // 2**32).tolist())) > 5
    check(got, list(zip(docs.doc_id.tolist(), docs.text, strict=True)), library)


def test_awkward_tables(spark, library):
    got = rows(packing.pack(awkward(spark)))
    check(got, [r[:2] for r in awkward_rows()], library)
    assert rows(packing.pack(empty(spark))).empty


def test_added_tokens(library):
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    for text in ("end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", " <|endoftext|>\n\n x", ""):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids + [0], text


def brute_force(docs, corpus):
    """BM25 of every document for every other as the query, by its distinct tokens."""
    out = np.zeros((len(docs), len(docs)))
    for q, query in enumerate(docs):
        for d, doc in enumerate(docs):
            for t in set(query.tolist()) if q != d else ():
                tf = (doc == t).sum()
                if tf:
                    idf = np.log1p((corpus.docs - corpus.df[t] + 0.5) / (corpus.df[t] + 0.5))
                    out[q, d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / corpus.mean))
    return out


@pytest.mark.parametrize("n,most,words", [(50, 40, 60), (45, 30, 900), (1, 5, 9), (2, 9, 5)])
def test_scores_by_brute_force(n, most, words):
    rng = np.random.default_rng(n)
    docs = [np.minimum(rng.zipf(1.3, rng.integers(1, most)), words - 1) for _ in range(n)]
    corpus = packing.statistics(docs + docs[: n // 2] + [np.arange(words)], words)
    assert np.allclose(packing.scores(docs, corpus), brute_force(docs, corpus), rtol=1e-4, atol=1e-5)


def test_windows_are_filled_by_the_best_unused_neighbour():
    """A plain re-run of the rule over the brute-force scores."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, rng.integers(1, 700)) for _ in range(40)]
    corpus = packing.statistics(docs, 300)
    score, unused, place, order = brute_force(docs, corpus), list(range(len(docs))), 100, []
    while unused:
        seed = unused.pop(0)
        order.append(seed)
        place += len(docs[seed])
        while seed is not None and place % packing.WINDOW:
            window, following = place // packing.WINDOW, None
            while place // packing.WINDOW == window:
                best = max(unused, key=lambda d: score[seed, d], default=None)
                if best is None or score[seed, best] <= 0:
                    break
                unused.remove(best)
                order.append(best)
                place += len(docs[best])
                following = best
            seed = following
    got = list(packing.packed(docs, corpus, 100))
    assert list(dict.fromkeys(d for d, *_ in got)) == order
    assert [p for *_, p in got] == [100, *(100 + np.cumsum([n for _, _, n, _ in got])[:-1])]


def test_corpus_statistics(spark, sf, library):
    docs = table(sf, "documents")
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [0]) for t in docs.text]
    want = packing.statistics(ids, 50257)
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') as t")
    got = packing.tokenised(texts, public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)).where("token is not null").groupBy("token").sum("docs", "load").toPandas().set_index("token")
    assert got.loc[-2].tolist() == [want.docs, sum(map(len, ids))]
    held = got["sum(docs)"][got.index >= 0]
    assert (held == want.df[held.index]).all() and held.sum() == want.df.sum()
    assert got["sum(load)"][got.index != -2].sum() == sum(map(len, ids)) + packing.ROW_LOAD * want.docs


def test_a_hot_key_is_spread(spark):
    same = "silver lanterns drift above the quiet harbour " * 30
    df = spark.createDataFrame([(i, same) for i in range(400)], "doc_id long, text string")
    got = rows(packing.pack(df, shard_load=20_000))
    per_shard = got.groupby(got.sequence_id.to_numpy() // 2**32).length.sum()
    assert len(per_shard) > 4 and per_shard.max() < 2 * per_shard.median()


def test_related_documents_meet():
    rng = np.random.default_rng(4)
    topics = [rng.integers(100 * k, 100 * k + 40, 300) for k in range(8) for _ in range(6)]
    order = rng.permutation(len(topics))
    docs = [topics[i] for i in order]
    kin = total = 0
    by_window: dict[int, set] = {}
    for doc, _, _, place in packing.packed(docs, packing.statistics(docs, 1000)):
        by_window.setdefault(place // packing.WINDOW, set()).add(int(order[doc]) // 6)
    for group in by_window.values():
        total += 1
        kin += len(group) <= 2
    assert kin >= 0.8 * total


@pytest.mark.parametrize("space", [" ", "\n", "\t ", "　"])
def test_long_white_space(library, space):
    """A run of white space on which the fast library overflows its stack, with an added token behind it."""
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    text = "word" + space * (2_000_000 // len(space)) + "word <|endoftext|> é"
    got = own.ids(text)
    assert got[-1] == packing.END_ID and got[:-1].tolist() == library.encode(text, add_special_tokens=False).ids
    short = "word" + space * 40_000 + "word"
    assert own.ids(short)[:-1].tolist() == library.encode(short, add_special_tokens=False).ids
