"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

Every byte is mapped to a character of its own; every entry of the rank file becomes a piece of
the mapped characters, scored by its negative rank, under identity normalisation. Merging the
best-scored neighbours first is then the merge order of the ranks. A match of the split pattern
that is itself an entry is that entry. Decoding maps ids back to the bytes of their pieces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import table, text_of
from quillwork.llm.segments import SegmentCache

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: First of the 256 characters that stand for bytes (Latin Extended, no white space, no combining marks).
FIRST_CHAR = 0x100
#: Matches whose ids a worker keeps.
MOST_MATCHES = 400_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_CHARS)


_CHARS = {i: FIRST_CHAR + i for i in range(256)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised ModelProto: pieces in rank order, then the unknown piece it must have.

    Fields, fixed by the format: pieces 1 (piece 1, score 2, type 3), trainer_spec 2 (model_type 3,
    vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5)."""
    pieces = [(mapped(token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    if [-s for _, s, _ in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must count from 0 without gaps")
    pieces.append(("<unk>", 0.0, 2))
    body = b"".join(
        _message(1, _message(1, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, _varint(t))) for p, s, t in pieces
    )
    none = _varint((1 << 64) - 1)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces))) + _field(40, 0, _varint(len(ranks)))
    trainer += _field(41, 0, none) + _field(42, 0, none) + _field(43, 0, none)
    normal = _message(1, b"identity") + _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")
    return body + _message(2, trainer) + _message(3, normal)


class _Matches(dict):
    """Packed ids of matches of the split pattern; short ones are kept."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        packed = self.bpe.encode_match(match)
        if len(match) <= 64:
            self[match] = packed
        return packed


class ByteBpe:
    """encode(text) -> packed ids, decode(packed ids) -> bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern)
        self.bytes_of = [token for token, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.cache = SegmentCache(self.encode_whole)
        self.matches = _Matches(self)

    def encode_whole(self, text: str) -> bytes:
        if len(self.matches) > MOST_MATCHES:
            self.matches.clear()
        return b"".join(map(self.matches.__getitem__, self.split.findall(text)))

    def encode_match(self, match: str) -> bytes:
        raw = match.encode("utf-8")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.model.encode(mapped(raw))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return self.cache.ids(text)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def round_trips(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty and has no tokens; a null id stays null; repeated rows get a row each.
    Long texts are encoded whole. Other columns are never read."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch["t"]:
                packed = bpe.encode(text)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInPandas(encode, SCHEMA)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
