import hashlib
import time
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillwork.llm import alignment as al
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
NONE = 0, 0, 0, 0, 0, 0, ""


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path(al.VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(al.MODEL))


def groups_of(text: str | None, models) -> list[tuple[list[int], list[int]]]:
    """Groups by intersection of the two sets of ends; whole texts, no cuts and no labels."""
    if not text:
        return []
    a, b = models
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_char = {c: i for i, c in enumerate([*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0xAD)), *map(chr, range(0xAE, 0x100))])}
    a_sizes = [len(a.id_to_token(i)) for i in a_ids]
    assert all(c in of_char or 0x100 <= ord(c) < 0x144 for i in set(a_ids) for c in a.id_to_token(i))
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(pieces) != (" " + text).encode():
        return []
    assert sum(a_sizes) == len((" " + text).encode())

    def ends(sizes):
        at, out = 0, []
        for n in sizes:
            at += n
            out.append(at)
        return out

    a_ends, b_ends = ends(a_sizes), ends(map(len, pieces))
    both, out, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
    for end in both:
        own_a, own_b = [], []
        while i < len(a_ends) and a_ends[i] <= end:
            own_a.append(a_ids[i])
            i += 1
        while j < len(b_ends) and b_ends[j] <= end:
            own_b.append(b_ids[j])
            j += 1
        out.append((own_a, own_b))
    return out


def brute(docs: list[tuple], models) -> list[tuple]:
    every = [groups_of(t, models) for _, t in docs]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in every]
    count = Counter(p for own in links for p in own)
    top: dict = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for (i, _), groups, own in zip(docs, every, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(n for p, n in own.items() if count[p] == top[p[0]])
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), best, sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def plain(got: pd.DataFrame) -> list[tuple]:
    return sorted(((None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:-1]), r[-1]) for r in got[COLUMNS].itertuples(index=False)), key=str)


def test_whole_table(spark, sf, models):
    docs = table(sf, "documents")
    assert plain(rows(al.op13_alignment(spark, sf))) == brute([(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)], models)


def test_small_slices_and_tasks_change_nothing(spark, sf, models):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert plain(rows(al.align(docs, slice_pairs=300, task_pairs=500))) == plain(rows(al.align(docs)))


ODD = ["a  b", " a", "a ", "\ta b", "a\nb \n c d", "x\x00y", "a ▁ b", "<s> <0x41> <|endoftext|> </s>", "ﬁ é é Ａ", " ", "\n", "naïve café 😀 日本語", "a b 　c", "x \u0085 y\x1c z", "don't  we'll", "١٢٣ 4 567", "﻿word ©", "aaa" * 50, "é ́x"]


def test_odd_spaces_and_characters(models):
    own = al.Aligner(public_tokenizers.path(al.VOCABULARY), public_tokenizers.path(al.MODEL))
    for text in [*ODD, " ".join(ODD), "\n".join(ODD), *[f"word {t} word" for t in ODD], "\tb", "x \tb"]:
        for _ in range(2):  # from what is kept, too
            n_a, n_b, n_groups, n_links, digest, keys, links = own.document(text)
            groups = groups_of(text, models)
            expected = Counter((x, y) for a, b in groups for x in a for y in b)
            assert (n_a, n_b, n_groups, n_links) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(expected.values())), repr(text)
            assert {(int(k) // own.b_size, int(k) % own.b_size): int(n) for k, n in zip(keys, links, strict=True)} == expected
            assert digest == (hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else "")


def test_chunks_and_full_caches_change_nothing(models, monkeypatch):
    paths = public_tokenizers.path(al.VOCABULARY), public_tokenizers.path(al.MODEL)
    text = " ".join(ODD).replace("▁", "_") * 3 + " end of it"
    whole = al.Aligner(*paths).document(text)
    monkeypatch.setattr(al, "CHUNK", 20)
    monkeypatch.setattr(al, "MOST_GROUPS", 2)
    own = al.Aligner(*paths)
    for _ in range(2):
        again = own.document(text)
        assert again[:5] == whole[:5] and again[5].tolist() == whole[5].tolist() and again[6].tolist() == whole[6].tolist()
    assert len(list(own.chunks(text))) > 5


def test_models_with_pieces_across_spaces_are_not_cut(models):
    own = al.Aligner(public_tokenizers.path(al.VOCABULARY), public_tokenizers.path(al.MODEL))
    expected = own.document("one two  three")[:5]
    own.cuts = False
    assert own.document("one two  three")[:5] == expected and list(own.chunks("one two")) == ["one two"]


def test_both_libraries_give_the_same_ids(models):
    own = al.aligner(public_tokenizers.path(al.VOCABULARY), public_tokenizers.path(al.MODEL))
    for text in [*ODD, *map(" ".join, (ODD, ODD[::-1])), "".join(map(chr, range(1, 0x3000)))]:
        assert own.fast(" " + text).tolist() == models[0].encode(" " + text, add_special_tokens=False).ids


def test_other_vocabularies_use_the_library_they_are_for():
    assert al._fast(public_tokenizers.path("word_bpe_49k.json")) is None


def test_long_runs_in_time():
    own = al.aligner(public_tokenizers.path(al.VOCABULARY), public_tokenizers.path(al.MODEL))
    began = time.time()
    assert own.document("word" + " " * 1_000_000 + "word")[0] == 1_000_001
    assert own.document("1 " * 600_000)[0] > 600_000
    assert own.document("x" * 300_000)[0] > 0
    assert time.time() - began < 60


def test_awkward(spark, models):
    docs = [(r[0], r[1]) for r in awkward_rows()]
    assert plain(rows(al.align(awkward(spark)))) == brute(docs, models)
    assert rows(al.align(empty(spark))).empty
    blank = rows(al.align(spark.createDataFrame([(1, None), (2, ""), (3, "▁"), (None, None)], "doc_id long, text string")))
    assert plain(blank) == sorted([(i, *NONE) for i in (1, 2, 3, None)], key=str)
