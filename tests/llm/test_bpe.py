import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from quillwork.llm import bpe
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table


@pytest.fixture(scope="module")
def both():
    own = bpe.ByteBpe(public_tokenizers.path(bpe.VOCABULARY))
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(both):
    own, library = both
    rng = random.Random(1)
    alphabet = [*" \n\t\x0b\x0c\r\x1c\x1f\x85\xa0　 aébcßЖ中文日😀stlldrev0123٣½_-.,!▁́‍﻿\x00İ", "  ", " ", "'s", "don't", "the", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        packed = own.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_whole_tables(spark, sf, both):
    _, library = both
    got = rows(bpe.op2_bpe(spark, sf)).set_index("doc_id")
    docs = table(sf, "documents")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode_ordinary(text)
        r = got.loc[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_tables(spark, both):
    got = rows(bpe.round_trips(awkward(spark)))
    expected = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in awkward_rows())
    assert sorted(got.decoded_sha256) == expected and got.doc_id.isna().sum() == 3
    assert rows(bpe.round_trips(empty(spark))).empty


def test_a_full_cache_changes_nothing(both):
    own, library = both
    small = bpe.SegmentCache(own.encode_whole, most=3)
    for text in ["a b c d e f", "g h i j a b", "x  y", " lead", "trail "]:
        packed = small.ids(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(text)
