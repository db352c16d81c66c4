"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Elements are the distinct five-word shingles of a text, all of weight 1 however often they occur, so
that sketches and verification measure the same sets. Each element is a Poisson process of arrivals
with its weight as rate; every arrival goes to one of M registers, and a register keeps the element
that arrives first. Two texts agree in a register with the probability Jaccard similarity of their
weighted shingles, which at equal weights is the Jaccard similarity. Arrivals are made in rounds for
all elements at once, and an element stops as soon as its last arrival is later than every
register's first: later ones cannot matter.

Registers are banded. A pair is a link if the exact Jaccard similarity of the shingle sets reaches
the threshold. First each document is compared with the smallest of those that lead its buckets.
Classes that are still apart and share a bucket, directly or by way of others, then form groups, and
within a group all documents of different classes are compared by a prefix filter, which loses no
pair; large groups are split into blocks, and every block meets every other. So no two documents of
a bucket end in different classes untested. Classes are the connected components of the links.

Copies (equal word sequences) are one class from the start, and only their first document goes on:
a group of copies costs one row per document. Everything is keyed by row number, not by doc_id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import cut, discard, drop_scratch, scratch_mark, table, text_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: Shingles of a block of texts that are compared with another block in one task.
BLOCK = 4_000_000

_WORD = re.compile(r"\w+")
_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    MOST = 250_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text, in order."""
    if len(_hashes) > _hashes.MOST:
        _hashes.clear()
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; of a shorter text, the one of all its words."""
    with np.errstate(over="ignore"):
        n = len(words)
        if n == 0:
            return words
        width = min(WORDS, n)
        out = np.zeros(n - width + 1, dtype=np.uint64)
        for i in range(width):
            out = mix(out + words[i : n - width + 1 + i] + _GOLD)
        return out


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash registers, n by m: the element of the earliest arrival. n texts at once; owner is
    the text of each element. Texts without elements get zeros."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, dtype=np.uint64)
    # A text without elements has no arrivals to wait for.
    active = np.arange(len(elements))
    clock = np.zeros(len(elements))
    state = elements.copy()
    with np.errstate(over="ignore"):
        while len(active):
            state[active] = mix(state[active] + _GOLD)
            draw = state[active]
            wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            clock[active] += wait / weights[active]
            register = (mix(draw ^ _MIX1) % np.uint64(m)).astype(np.int64)
            key, at = owner[active] * m + register, clock[active]
            np.minimum.at(first, key, at)
            won = first[key] == at
            winner[key[won]] = elements[active[won]]
            last = first.reshape(n, m).max(axis=1)
            active = active[at < last[owner[active]]]
    return winner.reshape(n, m)


SKETCH = "doc_id bigint, text_key bigint, words_hash string, n_shingles bigint, bands array<bigint>"


def words_digest(words: np.ndarray) -> str | None:
    return hashlib.blake2b(words.tobytes(), digest_size=16).hexdigest() if len(words) else None


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("t"))


def sketch(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, words_hash (digest of the word sequence, null without words), n_shingles, bands."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = BANDS * ROWS
        for batch in batches:
            texts, at = batch["t"].tolist(), 0
            while at < len(texts):
                # As many texts at once as have about 200,000 characters.
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 200_000):
                    size += len(texts[to])
                    to += 1
                sets, digests = [], []
                for text in texts[at:to]:
                    words = word_hashes(text)
                    digests.append(words_digest(words))
                    sets.append(np.unique(shingle_hashes(words)))
                n, sizes = to - at, [len(e) for e in sets]
                registers = sketches(np.concatenate(sets), np.ones(sum(sizes)), np.repeat(np.arange(n), sizes), n, m)
                with np.errstate(over="ignore"):
                    band = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, BANDS)).copy()
                    for r in range(ROWS):
                        band = mix(band + registers.reshape(n, BANDS, ROWS)[:, :, r] + _GOLD)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at:to].astype("Int64").to_numpy(dtype=object, na_value=None),
                    "text_key": batch["text_key"].to_numpy()[at:to], "words_hash": digests, "n_shingles": sizes,
                    "bands": [b if k else b[:0] for b, k in zip(band.view(np.int64), sizes, strict=True)],
                })
                at = to

    return texts.mapInPandas(scan, SKETCH)


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes without repeats, as bytes) of the texts behind the wanted nodes.

    wanted has node, doc_id, text_key and words_hash; the digest settles which text is meant."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, text in zip(batch["node"], batch["words_hash"], batch["t"], strict=True):
                words = word_hashes(text)
                if words_digest(words) == digest:
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(words)).tobytes())
            yield pd.DataFrame({"node": nodes, "shingles": sets})

    w = wanted.select("node", "words_hash", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    found = texts.join(w, (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return found.select("node", "words_hash", "t").mapInPandas(scan, "node bigint, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold.

    The set of a goes to b's partition, so a document that many are paired with is read once there."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            like = [
                jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(batch["sa"], batch["sb"], strict=True)
            ]
            yield batch.loc[like, ["a", "b"]]

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(scan, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have links a-b: the smallest node of their component.

    In every round a node takes its smallest neighbour (or itself), then that node's own choice, and
    links are carried over to the nodes taken; those whose ends have met are done with, so that each round has few
    of the last one's links. Tables are written to the shared folder, so the plan stays short and a lost
    executor costs one round; superseded ones are deleted."""
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    rounds = []
    while not rounds or not links.isEmpty():
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("x")).select("x.*")
        least = cut(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("via")), "least")
        further = least.select(F.col("node").alias("via"), F.col("via").alias("label"))
        rounds.append(cut(least.join(further, "via").select("node", "label"), "labels"))
        for end in ("a", "b"):
            links = links.join(rounds[-1].withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", end)
        links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
        discard(least)
    labels = rounds.pop()
    while rounds:
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        earlier = rounds.pop()
        labels = cut(earlier.join(onward, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")
    return labels


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct pairs of labels whose members are paired in a bucket and not yet in one component."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    both = pairs.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    return both.where("a <> b").distinct()


def crowded(pairs: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """The texts of the buckets that hold several classes, dealt to tasks in which all of them meet; None if there are none.

    Classes that share a bucket, directly or by way of others, are a group. Two texts of different
    classes cannot both be of the group's largest class, so only the others are probes. Probes and
    members are split into blocks of about `block` shingles, and every block of probes goes with
    every block of members; a group that fits in one block is one task, each text in it once."""
    apart = cut(_apart(pairs, labels), "apart")
    if apart.isEmpty():
        return None
    groups = components(apart).select(F.col("node").alias("label"), F.col("label").alias("grp"))
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    held = cut(named.join(groups, "label").join(sets.select("node", (F.length("shingles") / 8).cast("long").alias("size")), "node"), "held")
    size = held.groupBy("grp", "label").agg(F.sum("size").alias("s"))
    sizes = size.groupBy("grp").agg(F.sum("s").alias("all"), F.max("s").alias("most"), F.max_by("label", F.struct("s", "label")).alias("major"))
    sizes = sizes.select("grp", "major", F.ceil(F.col("all") / block).alias("q"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / block)).alias("p"))
    probe, h = F.col("label") != F.col("major"), F.xxhash64("node")
    task = lambda i, j, probes, listed: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), probes.alias("probe"), listed.alias("listed"))
    no, yes = F.lit(False), F.lit(True)
    asking = F.when(probe, F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda j: task(F.pmod(h, F.col("p")), j, yes, no)))
    listed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda i: task(i, F.pmod(h, F.col("q")), no, yes))
    none = F.array().cast("array<struct<i:bigint,j:bigint,probe:boolean,listed:boolean>>")
    tasks = F.when(F.col("q") == 1, F.array(task(F.lit(0), F.lit(0), probe, yes))).otherwise(F.concat(F.coalesce(asking, none), listed))
    dealt = held.join(sizes, "grp").select("node", "label", "grp", F.explode(tasks).alias("x")).select("node", "label", "grp", "x.*")
    full = dealt.join(sets, "node").select("grp", "i", "j", "node", "label", "probe", "listed", "shingles")
    return full.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def _across(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links (a, b) between the classes of each task; the rows of a task stand together."""
    key, held = None, []
    found: list[tuple[int, int]] = []
    for batch in batches:
        for grp, i, j, *row in zip(*(batch[c].tolist() for c in ("grp", "i", "j", "node", "label", "probe", "listed", "shingles")), strict=True):
            if (grp, i, j) != key:
                if held:
                    found += cross_links(held, threshold)
                key, held = (grp, i, j), []
            held.append(row)
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        found = []
    if held:
        yield pd.DataFrame(cross_links(held, threshold), columns=["a", "b"], dtype="int64")


def cross_links(held: list, threshold: float) -> list[tuple[int, int]]:
    """Links between classes, found without loss: of every two classes of which a probe and a listed
    text reach the threshold, one such pair, unless links found before have joined them.

    held: node, label, probe, listed, shingles. Shingles are ranked by how many texts hold them. Two sets
    of n and m shingles that reach t share at least t max(n, m) of them, hence one of the first
    n - t n + 1 and m - t m + 1 of the rarest; texts are looked up by those alone, then compared in full."""
    sets = [np.frombuffer(r[4], np.uint64) for r in held]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ids = rank[ids]
    heads = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    rare = [np.sort(ids[b:e])[:h] for b, e, h in zip(begins, ends, heads, strict=True)]
    label = np.array([r[1] for r in held], np.int64)
    listed = [k for k, r in enumerate(held) if r[3]]
    owner = np.repeat(np.array(listed, np.int64), heads[listed])
    element = np.concatenate([rare[k] for k in listed]) if listed else owner
    order = np.argsort(element, kind="stable")
    owner = owner[order]
    at = np.concatenate(([0], np.cumsum(np.bincount(element, minlength=len(counts)))))
    mark = np.zeros(len(counts), bool)
    out = []
    for k in (k for k, r in enumerate(held) if r[2]):
        spans = [owner[at[x] : at[x + 1]] for x in rare[k].tolist() if at[x] < at[x + 1]]
        if not spans:
            continue
        near = np.unique(np.concatenate(spans))
        fits = np.minimum(sizes[near], sizes[k]) >= threshold * np.maximum(sizes[near], sizes[k]) - 1e-9
        near = near[fits & (label[near] != label[k])]
        mark[ids[begins[k] : ends[k]]] = True
        while len(near):
            part, near = near[:256], near[256:]
            both = np.add.reduceat(mark[np.concatenate([ids[begins[d] : ends[d]] for d in part.tolist()])].astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for d in part[both / (sizes[part] + sizes[k] - both) >= threshold].tolist():
                if label[d] != label[k]:
                    out.append((held[k][0], held[d][0]))
                    label[label == label[d]] = label[k]
            near = near[label[near] != label[k]]
        mark[ids[begins[k] : ends[k]]] = False
    return out


def classes(rows: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) of all nodes that have a link. rows: row_id, node and the sketch of each distinct text."""
    buckets = cut(rows.select("node", F.explode("bands").alias("band")), "buckets")
    heads = cut(buckets.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    members = cut(buckets.join(heads, "band").select("band", F.col("node").alias("a"), "b"), "members")
    nodes = members.select(F.col("a").alias("node")).distinct()
    sets = cut(shingle_sets(texts, rows.join(nodes, "node")), "sets")
    pairs = cut(members.where("a <> b").select("a", "b").distinct(), "pairs")

    # First the smallest partner of each text, then all that this leaves apart.
    links = cut(verified(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, threshold), "found")
    labels = components(links)
    tasks = crowded(pairs, members.select(F.col("a").alias("node")).distinct(), labels, sets)
    if tasks is None:
        return labels
    found = cut(tasks.mapInPandas(lambda batches: _across(batches, threshold), "a bigint, b bigint"), "found")
    return labels if found.isEmpty() else components(links.unionByName(found))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: row_id, doc_id, text_key, class_id, class_size, kept.

    class_id is the smallest doc_id of the class. The row kept has the smallest doc_id (null ids
    last) and is the first of repeated rows. Texts without words (null, empty, punctuation alone)
    have no shingles and are classes of their own; a text of fewer than five words is one shingle.
    Texts of any length are read whole.
    An empty table gives an empty result; other columns are never read."""
    mark = scratch_mark()
    texts = keyed(docs, id_col, text_col)
    rows = cut(sketch(texts).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    firsts = cut(rows.where("words_hash is not null").groupBy("words_hash").agg(F.min(least).alias("x")).select("words_hash", F.col("x.row_id").alias("node")), "firsts")
    distinct = cut(rows.join(firsts.select(F.col("node").alias("row_id"), "node"), "row_id").select("node", "doc_id", "text_key", "words_hash", "bands"), "distinct")
    labels = classes(distinct, texts, threshold)
    named = rows.select("row_id", "doc_id", "text_key", "words_hash").join(firsts, "words_hash", "left").join(labels, "node", "left")
    labelled = cut(named.select("row_id", "doc_id", "text_key", F.coalesce("label", "node", "row_id").alias("label")), "labelled")
    groups = cut(
        labelled.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"), F.min(least).alias("x"))
        .select("label", "class_size", F.col("x.doc_id").alias("class_id"), F.col("x.row_id").alias("keep_row")),
        "groups",
    )
    drop_scratch(mark, keep_last=2)  # the result reads these two alone
    return labelled.join(groups, "label").select("row_id", "doc_id", "text_key", "class_id", "class_size", (F.col("row_id") == F.col("keep_row")).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
