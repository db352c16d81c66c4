"""Alignment of two tokenizers on the same text, and how often the corpus links their ids.

A text is encoded by A (byte-level BPE, space + text) and by B (a sentencepiece model, which adds that
space itself). Each byte gets a label: no token ends with it, one of A does, one of B does, both do. A
regular expression scans the labels for spans up to each "both"; a span is a group, and the labels in it
count the group's tokens. A text whose bytes a tokenizer does not give back has no tokens.

Neither tokenizer has a token across a single space between two other characters that are not white
space, except one that starts with it. So a very long text is cut before some of these spaces, and its parts are
aligned alone, one after the other. A model with pieces across spaces is never cut.

The corpus-wide counts take two passes over one table of (id pairs, links) per document. First the tasks
add up their documents' pairs before the shuffle. Then the counts are cut into slices of bounded size by
the pair, the documents' pairs likewise, in batches, and batches meet their slice in tasks of bounded
size: a slice is sent to as many tasks as its batches need, so no id or pair is one task, and what is
sent grows with the corpus, not with its square.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwork.llm._shared import cut, table

VOCABULARY, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Labels of a byte: the bits of the tokenizers that end a token with it.
A_END, B_END, BOTH = 1, 2, 3
_SPAN = re.compile(rb"[^\x03]*\x03")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Groups whose text and pairs a worker keeps.
MOST_GROUPS = 200_000
#: White space of this length is left to the slower library.
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")
#: Characters after which a text is cut at the next place, so that no list of all its pieces is made.
CHUNK = 1_000_000
#: Pairs that a task adds up before it hands them over, pairs of a slice, and links of the batches of a task.
HELD_PAIRS, SLICE_PAIRS, TASK_PAIRS = 4_000_000, 2_000_000, 4_000_000

#: A document (doc_id to links), or a pair of ids and how many documents of a task hold it linked.
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys binary, links binary, pair bigint, docs bigint"
_ALIGNED = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("keys", pa.binary()), ("links", pa.binary()), ("pair", pa.int64()), ("docs", pa.int64())])
PACKED = "slice int, salt bigint, kind int, row_ids binary, sizes binary, keys binary, numbers binary"
_PACKED = pa.schema([("slice", pa.int32()), ("salt", pa.int64()), ("kind", pa.int32())] + [(n, pa.binary()) for n in ("row_ids", "sizes", "keys", "numbers")])
FOUND = "row_id bigint, n_best bigint, count_sum bigint"


def _byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _fast(vocabulary: str) -> Callable[[str], np.ndarray] | None:
    """The encoder of a vocabulary by the faster library, which merges by id; None if that is not the order of its merges."""
    with open(vocabulary, encoding="utf-8") as f:
        read = json.load(f)
    model, split, byte_of = read["model"], read.get("pre_tokenizer") or {}, _byte_characters()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
    plain = read.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    rest = [model["vocab"][m] for m in merged if m in model["vocab"]]
    if not plain or len(rest) != len(merged) or rest != sorted(set(rest)) or len(rest) + 256 != len(model["vocab"]) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: own.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class _Groups(dict):
    """Maps the number of a group to its text: the pair's key if it is one token each, or else a negative number."""

    def __init__(self, b_size: int):
        super().__init__()
        self.b_size, self.numbers, self.links, self.shapes = b_size, {}, [], {}

    def __missing__(self, pair: int) -> str:
        self[pair] = text = f"{pair // self.b_size}|{pair % self.b_size}"
        return text

    def number(self, a_ids: list[int], b_ids: list[int]) -> int:
        """The number of a group, with its text and each of its pairs with their links kept."""
        found = self.numbers.get(key := (tuple(a_ids), tuple(b_ids)))
        if found is None:
            self.numbers[key] = found = -1 - len(self.links)
            (some_a, of_a), (some_b, of_b) = np.unique(a_ids, return_counts=True), np.unique(b_ids, return_counts=True)
            self.links.append(((some_a[:, None] * self.b_size + some_b).ravel(), (of_a[:, None] * of_b).ravel()))
            self[found] = f"{','.join(map(str, a_ids))}|{','.join(map(str, b_ids))}"
        return found

    def of_shape(self, n: int, m: int, keys: list[int], bits: int) -> list[int]:
        """The numbers of groups of n and m tokens, each given as one number of all its ids."""
        known = self.shapes.setdefault((n, m), {})
        for key in set(keys) - known.keys():
            ids = [key >> bits * i & (1 << bits) - 1 for i in reversed(range(n + m))]
            known[key] = self.number(ids[:n], ids[n:])
        return [known[k] for k in keys]


class Aligner:
    """documents(texts) -> their rows. What is known of groups is kept, up to a bound: few make up nearly all texts."""

    def __init__(self, vocabulary: str, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(vocabulary)
        self.a.encode_special_tokens = True
        self.fast = _fast(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        byte_of, known = _byte_characters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_size = len(pieces)
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        # Four bytes a pair where they suffice, for the table and the shuffle.
        self.stored = "<u4" if len(self.a_bytes) * self.b_size <= 1 << 32 else "<u8"
        self.groups = _Groups(self.b_size)
        # Groups of up to 4 tokens are looked up by one number where their ids fit into it.
        self.bits = max(len(self.a_bytes), self.b_size).bit_length()

    def chunks(self, text: str) -> Iterator[str]:
        """The text in order, cut at spaces into parts of bounded length."""
        begin = 0
        while self.cuts and len(text) - begin > CHUNK and (place := _CUT.search(text, begin + CHUNK)):
            yield text[begin : place.start()]
            begin = place.end()
        yield text[begin:]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of A and B for a chunk; None where bytes differ."""
        b_ids = self.b.encode(text)
        raw = b" " + text.encode()
        if not b_ids or b"".join(itemgetter(*b_ids, 0)(self.b_bytes)[:-1]) != raw:
            return None
        # The fast library backtracks over white space until its stack is full. What it gives back are the bytes it was given.
        if self.fast and (len(text) < LONG_SPACE or not _LONG_SPACE.search(text)):
            return self.fast(" " + text), np.array(b_ids, np.int64)
        a_ids = self.a.encode(" " + text, add_special_tokens=False).ids
        return (np.array(a_ids, np.int64), np.array(b_ids, np.int64)) if b"".join(itemgetter(*a_ids, 0)(self.a_bytes)[:-1]) == raw else None

    def scanned(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels of the bytes, scanned: the tokens of A and of B in each group, and the group's number."""
        a_ends, b_ends = self.a_sizes[a_ids].cumsum(), self.b_sizes[b_ids].cumsum()
        labels = np.zeros(a_ends[-1], np.uint8)
        labels[a_ends - 1] = A_END
        labels[b_ends - 1] |= B_END
        spans = _SPAN.findall(labels.tobytes())
        ends = np.fromiter(map(len, spans), np.int64, len(spans)).cumsum() - 1
        # Labels of each kind up to the end of a span; the differences are the span's own.
        to_a, to_b = (np.cumsum(labels & kind != 0, dtype=np.int32)[ends].astype(np.int64) for kind in (A_END, B_END))
        of_a, of_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        at_a, at_b = to_a - of_a, to_b - of_b
        numbers = a_ids[at_a] * self.b_size + b_ids[at_b]
        rest = of_a + of_b > 2
        if 4 * self.bits <= 64:
            for n, m in ((1, 2), (2, 1), (1, 3), (3, 1), (2, 2)):
                at = np.flatnonzero((of_a == n) & (of_b == m))
                if len(at):
                    key = np.zeros(len(at), np.uint64)
                    for ids, begin, size in ((a_ids, at_a[at], n), (b_ids, at_b[at], m)):
                        for i in range(size):
                            key = key << np.uint64(self.bits) | ids[begin + i].astype(np.uint64)
                    numbers[at] = self.groups.of_shape(n, m, key.tolist(), self.bits)
                    rest[at] = False
        for i in np.flatnonzero(rest).tolist():
            numbers[i] = self.groups.number(a_ids[at_a[i] : to_a[i]].tolist(), b_ids[at_b[i] : to_b[i]].tolist())
        return of_a, of_b, numbers

    def documents(self, texts: list[str | None]) -> Iterator[Document]:
        """The rows of documents. The labels of many short ones are scanned at once: a text ends with "both", so no group crosses its end."""
        waiting: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
        done: list[Document | None] = [None] * len(texts)
        size = 0

        def settle() -> None:
            for (i, _), parts in zip(waiting, self.parts([ids for _, ids in waiting]), strict=True):
                done[i] = merged([parts])

        for i, text in enumerate(texts):
            chunks = self.chunks(text) if text else iter(())
            first = next(chunks, None)
            ids = None if first is None else self.ids(first)
            if ids is None:
                done[i] = NO_TOKENS
            elif len(text) <= CHUNK:
                waiting.append((i, ids))
                size += len(text)
                if size >= CHUNK:
                    settle()
                    waiting, size = [], 0
            else:
                done[i] = self.long(ids, chunks)
        settle()
        yield from done

    def document(self, text: str | None) -> Document:
        return next(self.documents([text]))

    def long(self, ids: tuple[np.ndarray, np.ndarray] | None, chunks: Iterator[str]) -> Document:
        """The row of a document of several chunks, the ids of the first of which are known."""
        parts = []
        while ids is not None:
            parts += self.parts([ids])
            following = next(chunks, None)
            if following is None:
                return merged(parts)
            ids = self.ids(following)
        return NO_TOKENS

    def parts(self, several: list[tuple[np.ndarray, np.ndarray]]) -> list[Part]:
        """What is found in each of several pairs of ids."""
        if not several:
            return []
        if len(self.groups) > MOST_GROUPS:
            self.groups = _Groups(self.b_size)
        n_a, n_b = (np.array([len(x[k]) for x in several]) for k in (0, 1))
        of_a, of_b, numbers = self.scanned(*(np.concatenate([x[k] for x in several]) for k in (0, 1)))
        # A part ends with the group in which its last token of A does.
        ends = np.searchsorted(of_a.cumsum(), n_a.cumsum()) + 1
        begins = np.append(0, ends[:-1])
        links = np.add.reduceat(of_a * of_b, begins)
        names = list(map(self.groups.__getitem__, numbers.tolist()))
        part = np.repeat(np.arange(len(several)), ends - begins)
        single = numbers >= 0
        # The links of each group of more than two tokens, gathered from those of the groups that occur here.
        some, which = np.unique(numbers[~single], return_inverse=True)
        known = [self.groups.links[-1 - i] for i in some.tolist()]
        sizes = np.array([len(k) for k, _ in known], np.int64)
        each = sizes[which]
        place = np.arange(each.sum()) + np.repeat((sizes.cumsum() - sizes)[which] - (each.cumsum() - each), each)
        flat = [np.concatenate([np.zeros(0, np.int64), *[x[k] for x in known]])[place] for k in (0, 1)]
        owner, key = np.append(part[single], np.repeat(part[~single], each)), np.append(numbers[single], flat[0])
        time = np.append(np.ones(int(single.sum()), np.int64), flat[1])
        order = np.lexsort((key, owner))
        owner, key, time = owner[order], key[order], time[order]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
        owner, key, time = owner[new], key[new], np.add.reduceat(time, new)
        at = np.searchsorted(owner, np.arange(len(several) + 1)).tolist()
        rows = zip(n_a.tolist(), n_b.tolist(), begins.tolist(), ends.tolist(), links.tolist(), at, at[1:], strict=False)
        return [((a, b, end - begin, n), ";".join(names[begin:end]), key[i:j], time[i:j]) for a, b, begin, end, n, i, j in rows]


#: n_a, n_b, n_groups, n_links, groups_sha256, the pairs and their links.
Document = tuple[int, int, int, int, str, np.ndarray, np.ndarray]
#: The four numbers, the groups as text, the pairs and their links.
Part = tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]
NO_TOKENS: Document = 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)


def merged(parts: list[Part]) -> Document:
    digest = hashlib.sha256()
    for i, (_, text, _, _) in enumerate(parts):
        digest.update((";" * (i > 0) + text).encode())
    totals = [sum(x) for x in zip(*[numbers for numbers, *_ in parts], strict=True)]
    if len(parts) == 1:
        return *totals, digest.hexdigest(), *parts[0][2:]
    return *totals, digest.hexdigest(), *summed(*(np.concatenate([x[k] for x in parts]) for k in (2, 3)))


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the numbers of each."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(numbers, begin) if len(begin) else numbers


@lru_cache(maxsize=2)
def aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def aligned(texts: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Rows of ALIGNED from doc_id and t."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(vocabulary, model)
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            return shaped({"pair": pa.array(pairs.astype(np.int64)), "docs": pa.array(docs.astype(np.int64))}, len(pairs))

        for batch in batches:
            for begin in range(0, len(batch), 500):
                part, rows = batch.slice(begin, 500), []
                for *numbers, digest, keys, links in own.documents(part.column("t").to_pylist()):
                    held.append(keys.astype(own.stored))
                    size += len(keys)
                    rows.append((*numbers, digest, held[-1].tobytes(), links.astype("<i8").tobytes()))
                    if size >= HELD_PAIRS:
                        yield counts()
                        held, size = [], 0
                names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "links")
                yield shaped({"doc_id": part.column("doc_id")} | {n: pa.array(v, _ALIGNED.field(n).type) for n, v in zip(names, zip(*rows, strict=True), strict=True)}, len(part))
        if size:
            yield counts()

    def shaped(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ALIGNED], schema=_ALIGNED)

    return texts.mapInArrow(scan, ALIGNED)


def _packed_pairs(pairs: DataFrame, slices: int, stored: str) -> DataFrame:
    """The counts (pair, docs, best) as rows of PACKED of kind 0: the count, doubled, plus 1 if it is its A id's highest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("pair").to_numpy().astype(stored)
            numbers = batch.column("docs").to_numpy() * 2 + batch.column("best").to_numpy(zero_copy_only=False)
            for i, at in _by_slice(keys, slices):
                yield _packed_row(i, 0, 0, np.zeros(0, "<i8"), np.zeros(0, "<i8"), keys[at], numbers[at])

    return pairs.mapInArrow(pack, PACKED)


def _packed_documents(docs: DataFrame, slices: int, salts: int, stored: str) -> DataFrame:
    """The documents' pairs as rows of PACKED of kind 1, many documents a row; sizes are their numbers of pairs in the row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, links = batch.column("row_id").to_numpy(), batch.column("keys"), batch.column("links")
            ends = np.cumsum([len(k) for k in keys.to_pylist()])
            for these in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ends // (4 * (TASK_PAIRS // 8)))) + 1):
                own = [np.frombuffer(keys[i].as_py(), stored) for i in these.tolist()]
                every = np.concatenate(own)
                number = np.concatenate([np.frombuffer(links[i].as_py(), "<i8") for i in these.tolist()])
                doc = np.repeat(np.arange(len(these)), [len(k) for k in own])
                for i, at in _by_slice(every, slices):
                    sizes = np.bincount(doc[at], minlength=len(these))
                    yield _packed_row(i, int(ids[these[0]]) * 2654435761 % (1 << 61) % salts, 1, ids[these][sizes > 0], sizes[sizes > 0], every[at], number[at])

    return docs.mapInArrow(pack, PACKED)


def _by_slice(keys: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    of = (keys % slices).astype(np.int64)
    for i in np.unique(of).tolist():
        yield i, np.flatnonzero(of == i)


def _packed_row(i: int, salt: int, kind: int, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    small = numbers.astype("<u4") if not len(numbers) or numbers.max() < 1 << 32 else numbers.astype("<u8")
    row = [i, salt, kind, ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), keys.tobytes(), small.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED, strict=True)], schema=_PACKED)


def _looked_up(dealt: DataFrame, stored: str) -> DataFrame:
    """Rows of FOUND; the tasks read the rows of a slice and salt together, those of kind 0 first."""

    def numbers(row: dict, name: str, n: int) -> np.ndarray:
        return np.frombuffer(row[name], "<u8" if len(row[name]) == 8 * n else "<u4").astype(np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, known, counts = None, [], None, None
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if (row["slice"], row["salt"]) != at:
                    at, parts, known = (row["slice"], row["salt"]), [], None
                keys = np.frombuffer(row["keys"], stored)
                values = numbers(row, "numbers", len(keys))
                if row["kind"] == 0:
                    parts.append((keys, values))
                    continue
                if known is None:
                    known, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(known)
                    known, counts, parts = known[order], counts[order], []
                own = counts[np.searchsorted(known, keys)]
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                begin = np.cumsum(sizes) - sizes
                best, total = np.add.reduceat(values * (own & 1), begin), np.add.reduceat(values * (own >> 1), begin)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["row_ids"], "<i8")), pa.array(best), pa.array(total)], names=["row_id", "n_best", "count_sum"])

    return dealt.mapInArrow(look, FOUND)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", slice_pairs: int = SLICE_PAIRS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose bytes a tokenizer does not give back (a U+2581 in it), has no tokens:
    zeros and ''. A null id stays null; repeated rows get a row each and count as documents each; an
    empty table gives an empty result. Texts of any length are aligned whole. Other columns are never read.
    vocabulary and model: the files of A (tokenizers) and B (sentencepiece)."""
    files = vocabulary or public_tokenizers.path(VOCABULARY), model or public_tokenizers.path(MODEL)
    own = aligner(*files)
    b_size, stored = own.b_size, own.stored
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    rows = cut(aligned(texts, *files).withColumn("row_id", F.monotonically_increasing_id()), "aligned")
    pairs = cut(rows.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {b_size}")), "pairs")
    n_pairs = pairs.count()
    documents = rows.where("pair is null")
    n_links = documents.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    slices = max(1, -(-n_pairs // slice_pairs))
    salts = max(1, -(-n_links // np.dtype(stored).itemsize // (slices * task_pairs)))
    tops = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    marked = pairs.join(tops, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))
    sent = _packed_pairs(marked, slices, stored).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    batches = _packed_documents(documents.where(F.octet_length("keys") > 0).select("row_id", "keys", "links"), slices, salts, stored)
    dealt = sent.unionByName(batches).repartition(slices * salts, "slice", "salt").sortWithinPartitions("slice", "salt", "kind")
    found = _looked_up(dealt, stored)
    own_columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    zero = F.lit(0).cast("long")
    whole = documents.select("row_id", *own_columns, "groups_sha256", zero.alias("n_best"), zero.alias("count_sum"))
    parts = found.select("row_id", *[F.lit(None).cast("long").alias(c) for c in own_columns], F.lit(None).cast("string").alias("groups_sha256"), "n_best", "count_sum")
    joined = whole.unionByName(parts).groupBy("row_id").agg(*[F.max(c).alias(c) for c in own_columns], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return joined.drop("row_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
