"""Packing by lexical retrieval: a sharded BM25 index fills each seed's window with its neighbours.

Documents are tokenised once, into a table that also holds, per task, how many documents have each
token: summed up, these are the document frequencies of the whole corpus, at most one row a token of
the vocabulary. A document's key is its most telling token (often in it, and of a high rank, as the
vocabulary gives frequent tokens low ranks). Keys are laid out on one line by the load of
their documents, and the line is cut into shards of equal load: related documents meet at every size
of corpus, and a key with a third of all rows is spread over a third of all shards by row number.

A shard is packed in blocks of its key order. Each block is an inverted index with the corpus's
statistics; every document's whole text is the query, and every document of the block is scored. A seed is
laid down, its unused neighbours by BM25 follow until the window is full, and the last of them, cut at the
window's end, is the seed of the next window. When no unused neighbour shares a term, the next
unused document in order goes on. A block goes on where the one before it ended, so only the last sequence of
a shard is not full.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import cut, table, text_of

WINDOW = 1024
#: The vocabulary, and the rank file of the same vocabulary: both libraries give the same ids.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 0
#: Load of a shard in tokens; a document counts as ROW_LOAD tokens more, so that short ones weigh something.
SHARD_LOAD, ROW_LOAD = 1_500_000, 100
#: A block ends with this many tokens or documents.
BLOCK_TOKENS, BLOCK_DOCS = 800_000, 1_600
#: Rows of the token table that a task hands over at once.
ROWS_AT_ONCE = 1_000
K1, B = 1.2, 0.75
#: White space of this length is split by the tokenizers library: the faster one backtracks over it until its stack is full.
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


class Tokenizer:
    """Ids as the tokenizers library gives them for the JSON file, added tokens included."""

    def __init__(self, vocabulary: str, ranks: str):
        with open(ranks, "rb") as f:
            pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        self.added = added
        # Two bytes an id where they suffice, for the table and the shuffle.
        self.stored = "<u2" if max([*pieces.values(), *added.values()]) < 1 << 16 else "<u4"
        self.vocabulary = vocabulary
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens=added)

    @cached_property
    def whole(self) -> tokenizers.Tokenizer:
        """The library that the ids are defined by."""
        return tokenizers.Tokenizer.from_file(self.vocabulary)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text and END_ID; a very long text never becomes a list of Python integers."""
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return np.array([*self.whole.encode(text, add_special_tokens=False).ids, END_ID], dtype="<u4")
        special = "all" if any(t in text for t in self.added) else set()
        if len(text) > 2_000_000:
            return np.append(self.encoding.encode_to_numpy(text, allowed_special=special, disallowed_special=()), np.uint32(END_ID)).astype("<u4")
        ids = self.encoding.encode(text, allowed_special="all") if special else self.encoding.encode_ordinary(text)
        ids.append(END_ID)
        return np.array(ids, dtype="<u4")


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str, ranks: str) -> Tokenizer:
    return Tokenizer(vocabulary, ranks)


class Statistics(NamedTuple):
    """Documents of the corpus, their mean length, and the documents that hold each token."""

    docs: int
    mean: float
    df: np.ndarray


def statistics(docs: list[np.ndarray], size: int) -> Statistics:
    df = np.zeros(size, np.int64)
    for ids in docs:
        df[np.unique(ids)] += 1
    return Statistics(len(docs), sum(map(len, docs)) / max(len(docs), 1), df)


def scores(docs: list[np.ndarray], corpus: Statistics) -> np.ndarray:
    """BM25 of every document (column) for every document as the query (row), by its distinct tokens; none for itself.

    Postings of tokens that few documents of the block hold are paired; those of the others, where
    pairs would be many, are multiplied as matrices. Both sum up the same terms."""
    n = len(docs)
    found = [np.unique(ids, return_counts=True) for ids in docs]
    term = np.concatenate([t for t, _ in found]).astype(np.int64)
    count = np.concatenate([c for _, c in found]).astype(np.float64)
    doc = np.repeat(np.arange(n), [len(t) for t, _ in found])
    held = corpus.df[term]
    norm = K1 * (1 - B + B * np.fromiter(map(len, docs), np.float64, n) / max(corpus.mean, 1.0))
    weight = (np.log1p((corpus.docs - held + 0.5) / (held + 0.5)) * count * (K1 + 1) / (count + norm[doc])).astype(np.float32)
    order = np.argsort(term, kind="stable")
    term, doc, weight = term[order], doc[order], weight[order]
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    size = np.diff(np.append(begin, len(term)))
    many = size > max(2, n // 14)
    out = np.zeros((n, n), np.float32)
    dense = np.flatnonzero(np.repeat(many, size))
    if len(dense):
        column = np.repeat(np.cumsum(many) - 1, size)[dense]
        matrix = np.zeros((n, many.sum()), np.float32)
        matrix[doc[dense], column] = weight[dense]
        out += (matrix > 0).astype(np.float32) @ matrix.T
    pairs, weights, waiting = [], [], 0

    def add() -> None:
        nonlocal out, waiting
        if pairs:
            out += np.bincount(np.concatenate(pairs), np.concatenate(weights), n * n).reshape(n, n).astype(np.float32)
            pairs.clear()
            weights.clear()
            waiting = 0

    for f in np.unique(size[~many & (size > 1)]).tolist():
        at = begin[~many & (size == f)]
        for part in np.array_split(at, -(-len(at) * f * f // 2_000_000)):
            these = part[:, None] + np.arange(f)
            d, w = doc[these], weight[these]
            pairs.append((d[:, :, None] * n + d[:, None, :]).ravel())
            weights.append(np.broadcast_to(w[:, None, :], (len(part), f, f)).ravel())
            waiting += len(pairs[-1])
            if waiting > 4_000_000:
                add()
    add()
    np.fill_diagonal(out, 0.0)
    return out


def packed(docs: list[np.ndarray], corpus: Statistics, place: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(document, start, length, place) of every piece of a block that begins at a place of its shard."""
    score = scores(docs, corpus)
    used = np.zeros(len(docs), dtype=bool)

    def lay(doc: int) -> Iterator[tuple[int, int, int, int]]:
        nonlocal place
        used[doc] = True
        score[:, doc] = 0.0
        start, total = 0, len(docs[doc])
        while start < total:
            length = min(total - start, WINDOW - place % WINDOW)
            yield doc, start, length, place
            start += length
            place += length

    for unused in range(len(docs)):
        if used[unused]:
            continue
        seed = unused
        yield from lay(seed)
        while seed >= 0 and place % WINDOW:
            window, following = place // WINDOW, -1
            while place // WINDOW == window:
                best = int(score[seed].argmax())
                if score[seed, best] <= 0:
                    break
                yield from lay(best)
                following = best
            seed = following


def keys(ids: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """The two most telling of the distinct tokens of a text; -1 for none."""
    weight = counts / (counts + K1) * np.log(ids + 2.0)
    top = np.argsort(-weight, kind="stable")[:2] if len(ids) < 3 else np.argpartition(-weight, 1)[:2]
    top = sorted(top.tolist(), key=lambda i: (-weight[i], ids[i]))
    found = [int(ids[i]) for i in top] + [-1, -1]
    return found[0], found[1]


#: A document, or (token not null) what a task found of a token: documents that hold it, load of those it is the key of.
#: Token -2 has all documents and all tokens.
TOKENS = "doc_id bigint, ids binary, key int, second int, token int, docs bigint, load bigint"


def tokenised(texts: DataFrame, vocabulary: str, ranks: str) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(vocabulary, ranks)
        docs, load = np.zeros(own.encoding.max_token_value + 3, np.int64), np.zeros(own.encoding.max_token_value + 3, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), batch["t"], strict=True):
                if len(rows) >= ROWS_AT_ONCE:
                    yield shaped(pd.DataFrame(rows, columns=["doc_id", "ids", "key", "second"]))
                    rows = []
                ids = own.ids(text)
                distinct, counts = np.unique(ids[:-1], return_counts=True)
                first, second = keys(distinct, counts)
                docs[distinct] += 1
                docs[END_ID] += END_ID not in distinct[:1]
                docs[-2] += 1
                load[first] += len(ids) + ROW_LOAD
                load[-2] += len(ids)
                rows.append((doc_id, ids.astype(own.stored).tobytes(), first, second))
            yield shaped(pd.DataFrame(rows, columns=["doc_id", "ids", "key", "second"]))
        some = np.flatnonzero((docs > 0) | (load > 0))
        names = np.where(some >= len(docs) - 2, some - len(docs), some)
        yield shaped(pd.DataFrame({"token": names, "docs": docs[some], "load": load[some]}))

    def shaped(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame.reindex(columns=["doc_id", "ids", "key", "second", "token", "docs", "load"])
        whole["ids"] = whole["ids"].astype(object).where(whole["ids"].notna(), None)
        return whole.astype({"doc_id": "Int64", "key": "Int32", "second": "Int32", "token": "Int32", "docs": "Int64", "load": "Int64"})

    return texts.mapInPandas(scan, TOKENS)


def pack(
    docs: DataFrame, path: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_load: int = SHARD_LOAD
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and then id 0, so a null or empty text is one id. Repeated rows are
    packed once each; a null id stays null. Texts of any length are packed whole. An empty table
    gives an empty result; other columns are never read. path and ranks: the vocabulary as the tokenizers library
    and as rank file."""
    vocabulary, ranks = path or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    rows = cut(tokenised(texts, vocabulary, ranks).withColumn("row_id", F.monotonically_increasing_id()), "tokens")
    # One row a token: bounded by the vocabulary, whatever the corpus.
    known = rows.where("token is not null").groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("load").alias("load")).toPandas().sort_values("token")
    total = known[known.token == -2]
    n, tokens = int(total.docs.sum()), int(total["load"].sum())
    line = known[(known.token != -2) & (known["load"] > 0)]
    frequency = known[known.token >= 0]
    df = np.zeros(int(known.token.max() if n else 0) + 1, np.int64)
    df[frequency.token.to_numpy(np.int64)] = frequency.docs.to_numpy(np.int64)
    corpus = docs.sparkSession.sparkContext.broadcast(Statistics(n, tokens / max(n, 1), df))
    ends = line["load"].cumsum().to_numpy(np.int64)
    shards = max(1, int(-(-ends[-1] // shard_load)) if len(ends) else 1)
    first, last = (ends - line["load"].to_numpy(np.int64)) // shard_load, (ends - 1) // shard_load
    laid = docs.sparkSession.createDataFrame(
        pd.DataFrame({"key": line.token.to_numpy(np.int32), "first": first.astype(np.int32), "span": (last - first + 1).astype(np.int32)}), "key int, first int, span int"
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored = tokenizer(vocabulary, ranks).stored
        held: list[tuple] = []
        size, place, shard = 0, 0, -1
        for batch in batches:
            ids = batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for shard, doc_id, packed_ids in zip(batch["shard"].tolist(), ids, batch["ids"], strict=True):
                held.append((doc_id, np.frombuffer(packed_ids, stored)))
                size += len(held[-1][1])
                if size >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                    yield pieces(shard, held, place)
                    held, size, place = [], 0, place + size
        if held:
            yield pieces(shard, held, place)

    def pieces(shard: int, held: list, begin: int) -> pd.DataFrame:
        out = [
            (held[d][0], start, length, zlib.crc32(held[d][1][start : start + length].astype("<u4").tobytes()), len(held[d][1]), (shard << 32) + place // WINDOW, place % WINDOW)
            for d, start, length, place in packed([t for _, t in held], corpus.value, begin)
        ]
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return frame.astype({"doc_id": "Int64"})

    dealt = rows.where("token is null").join(F.broadcast(laid), "key").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("span")).cast("int"))
    ordered = dealt.select("shard", "key", "second", "row_id", "doc_id", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "second", "row_id")
    return ordered.select("shard", "doc_id", "ids").mapInPandas(fill, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
