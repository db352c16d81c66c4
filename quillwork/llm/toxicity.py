"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as its own embedding (one shared embedding for words not in the training
sample) beside the mean embedding of its character 3- and 4-grams, borders included. Two gated
recurrent layers read a window of words in both directions, attention pools their states, and a
logistic unit scores the window. All overlapping windows of a text are scored; the text's score is
the highest. Training is by multiple instances: a text's label is put on its highest windows.

Training reads a bounded sample of labelled texts, whole, none of the held-out fold: in an order drawn by a hash
of the id, the first SAMPLE of each label, up to SAMPLE_CHARS characters in all; it happens on the driver. Scoring
reads every text whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import table, text_of

WINDOW, STRIDE = 32, 16
FOLDS = 5
#: Bounds of the training sample: texts of each label, and characters of all texts of a label but for its last one.
SAMPLE, SAMPLE_CHARS = 1600, 3_500_000
WIDTH, HIDDEN, ATTENTION = 10, 8, 8
#: Texts of the sample that must hold a word, or a gram, for an embedding of its own.
LEAST_WORD, LEAST_GRAM = 6, 4
#: Share of word ids that training hides, so that the characters must do.
HIDDEN_WORDS = 0.3
EPOCHS, BATCH, RATE, LEAST_STEPS = 8, 256, 0.01, 20
_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "…–—«»“”‘’¡¿"


def plain(token: str) -> str:
    """A token without case and without the punctuation around it."""
    return token.strip(_EDGE).lower() or token


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SLOT_BITS = 20


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character 3- and 4-grams of words with borders, and the word of each."""
    text = "".join([f"^{w}$" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    with np.errstate(over="ignore"):
        three = (((chars[:-2] + np.uint64(1)) * _A ^ chars[1:-1]) * _B ^ chars[2:]) * _A
        four = (three[:-1] ^ chars[3:]) * _B + np.uint64(4)
    inner3, inner4 = owner[:-2] == owner[2:], owner[:-3] == owner[3:]
    hashes = np.concatenate([three[inner3], four[inner4]])
    owners = np.concatenate([owner[:-2][inner3], owner[:-3][inner4]])
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


class Words:
    """Input ids of words: index of the word (0 if unknown) and of its known character grams (0 pads)."""

    def __init__(self, texts: list[list[str]]):
        words: Counter = Counter()
        for tokens in texts:
            words.update({plain(t) for t in tokens})
        self.word = {w: i for i, w in enumerate((w for w, n in words.items() if n >= LEAST_WORD), 1)}
        hashes, owners = grams(list(words))
        known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        held = np.bincount(inverse, np.fromiter(words.values(), np.int64, len(words))[owners])
        known = known[held >= LEAST_GRAM]
        # Grams live in a table of slots; of two in one slot, the later is not known.
        slot = (known >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        _, keep = np.unique(slot, return_index=True)
        self.keys = np.append(np.zeros(1, np.uint64), known[keep])
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        self.slots[slot[keep]] = np.arange(1, len(keep) + 1)

    def inputs(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, all gram ids one after another, and where each word's begin (with a pad)."""
        words = [plain(t) for t in tokens]
        ids = np.fromiter((self.word.get(w, 0) for w in words), np.int64, len(words))
        hashes, owners = grams(words)
        found = self.slots[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        known = (found > 0) & (self.keys[found] == hashes)
        count = np.bincount(owners[known], minlength=len(words))
        begin = np.cumsum(count + 1) - (count + 1)
        flat = np.zeros(len(words) + int(known.sum()), np.int64)
        rank = np.arange(int(known.sum())) - np.repeat(np.cumsum(count) - count, count)
        flat[np.repeat(begin, count) + 1 + rank] = found[known]
        return ids, flat, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the window score, and its gradient. Axis 0 of recurrent arrays is the direction."""

    def __init__(self, n_words: int, n_grams: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": draw(n_words + 1, WIDTH, by=0.1), "gram": draw(n_grams + 1, WIDTH, by=0.3), "in": draw(2 * WIDTH, 6 * h), "bias": np.zeros(6 * h, np.float32),
            "re": draw(2, h, 3 * h), "att": draw(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION, by=0.5),
            "out": draw(2 * h), "out_b": np.full(1, -1.0, np.float32),
        }
        self.p["gram"][0] = 0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def embed(self, ids: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.diff(np.append(begin, len(flat))) - 1
        total = np.add.reduceat(self.p["gram"][flat], begin, axis=0) if len(begin) else np.zeros((0, WIDTH), np.float32)
        scale = (1 / np.maximum(count, 1)).astype(np.float32)
        return np.concatenate([self.p["word"][ids], total * scale[:, None]], axis=1), scale

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input part of all gates of both directions."""
        return x @ self.p["in"] + self.p["bias"]

    def forward(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None):
        """Logits of windows; index gives each place's row of gates, mask its presence."""
        b, t = index.shape
        h = HIDDEN
        state = np.zeros((2, b, h), np.float32)
        states = np.empty((t, 2, b, h), np.float32)
        full = bool(mask.all())
        re = self.p["re"]
        # time, direction, window, gate; each direction in the order it reads
        laid = np.take(gates, index.T, axis=0)
        laid = np.stack([laid[..., : 3 * h], laid[::-1, :, 3 * h :]], axis=1)
        for s in range(t):
            g = laid[s]
            u = state @ re
            zr = 1 / (1 + np.exp(-(g[..., : 2 * h] + u[..., : 2 * h])))
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            new = n + z * (state - n)
            if not full:
                on = np.stack([mask[:, s], mask[:, t - 1 - s]])[..., None]
                new = np.where(on, new, state)
            if keep is not None:
                keep.append((state, z, r, n, u[..., 2 * h :]))
            state = states[s] = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # time, window, 2h
        a = np.tanh(both @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        e = np.where(mask.T, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[..., None] * both).sum(axis=0)
        logits = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logits, both, a, weight, pooled) if keep is not None else logits

    def train(self, inputs: tuple, index: np.ndarray, mask: np.ndarray, truth: np.ndarray, weight_of: np.ndarray) -> float:
        """One step of Adam on the logistic loss of a batch of windows; the loss."""
        p, h = self.p, HIDDEN
        x, scale = self.embed(*inputs)
        keep: list = []
        logits, both, a, weight, pooled = self.forward(self.project(x), index, mask, keep)
        prob = _sigmoid(logits)
        loss = float(-np.mean(weight_of * (truth * np.log(prob + 1e-7) + (1 - truth) * np.log(1 - prob + 1e-7))))
        b, t = index.shape
        d = ((prob - truth) * weight_of / b).astype(np.float32)
        grad = {"out": pooled.T @ d, "out_b": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        d_both = weight[..., None] * d_pooled
        d_weight = (both * d_pooled).sum(axis=2)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["att_v"] = np.tensordot(d_e, a, axes=([0, 1], [0, 1]))
        d_a = d_e[..., None] * p["att_v"] * (1 - a * a)
        grad["att"] = np.tensordot(both, d_a, axes=([0, 1], [0, 1]))
        grad["att_b"] = d_a.sum(axis=(0, 1))
        d_both += d_a @ p["att"].T
        d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]], axis=1)  # step, direction, window, h
        d_gates = np.zeros((len(x), 6 * h), np.float32)
        grad["re"] = np.zeros_like(p["re"])
        d_state = np.zeros((2, b, h), np.float32)
        re_t = p["re"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            old, z, r, n, un = keep[s]
            on = np.stack([mask[:, s], mask[:, t - 1 - s]])[..., None]
            d_new = (d_state + d_states[s]) * on
            through = (d_state + d_states[s]) * ~on
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (old - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=2)
            grad["re"] += old.transpose(0, 2, 1) @ d_u
            d_state = d_u @ re_t + d_new * z + through
            d_g = np.concatenate([d_z, d_r, d_n], axis=2)
            _add_rows(d_gates[:, : 3 * h], index[:, s], d_g[0])
            _add_rows(d_gates[:, 3 * h :], index[:, t - 1 - s], d_g[1])
        grad["in"], grad["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ p["in"].T
        ids, flat, begin = inputs
        grad["word"] = np.zeros_like(p["word"])
        _add_rows(grad["word"], ids, d_x[:, :WIDTH])
        grad["gram"] = np.zeros_like(p["gram"])
        _add_rows(grad["gram"], flat, np.repeat(d_x[:, WIDTH:] * scale[:, None], np.diff(np.append(begin, len(flat))), axis=0))
        grad["gram"][0] = 0
        self.t += 1
        for k, g in grad.items():
            m, v = self.m[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)
        return loss


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    if len(rows):
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        begin = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
        to[sorted_rows[begin]] += np.add.reduceat(values[order], begin, axis=0)


def windows(n: int) -> np.ndarray:
    """Starts of all overlapping windows of a text of n words; the last one ends with the text."""
    last = max(n - WINDOW, 0)
    return np.append(np.arange(0, last, STRIDE), last)


def laid_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of several texts: rows by place, presence, and each window's text. Texts without words have none."""
    index, mask, owner, place = [], [], [], np.arange(WINDOW)
    for i, r in enumerate(rows):
        if not len(r):
            continue
        starts = windows(len(r))
        at = starts[:, None] + place
        on = at < len(r)
        index.append(np.where(on, r[np.minimum(at, len(r) - 1)], 0))
        mask.append(on)
        owner.append(np.full(len(starts), i))
    if not index:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), bool), np.zeros(0, np.int64)
    return np.concatenate(index), np.concatenate(mask), np.concatenate(owner)


class Scorer:
    """A trained network with the gates of the words seen lately."""

    MOST = 250_000

    def __init__(self, words: Words, net: Network):
        self.words, self.net = words, net

    def prepare(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def rows_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > self.MOST:
            self.prepare()
        rows, start = self.rows, len(self.rows)
        out = [np.fromiter((rows.setdefault(t, len(rows)) for t in tokens), np.int64, len(tokens)) for tokens in texts]
        if len(rows) > start:
            if len(rows) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(len(rows), len(self.gates)), 6 * HIDDEN), np.float32)])
            fresh = list(rows)[start:] if start == 0 else _tail(rows, len(rows) - start)
            self.gates[start : len(rows)] = self.net.project(self.net.embed(*self.words.inputs(fresh))[0])
        return out

    def window_scores(self, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        parts = [self.net.forward(self.gates, index[i : i + 512], mask[i : i + 512]) for i in range(0, len(index), 512)]
        return _sigmoid(np.concatenate(parts)) if parts else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Highest window score of each text; 0 for a text without words."""
        out = np.zeros(len(texts))
        index, mask, owner = laid_out(self.rows_of([t.split() for t in texts]))
        np.maximum.at(out, owner, self.window_scores(index, mask))
        return out


def _tail(rows: dict[str, int], n: int) -> list[str]:
    last = []
    for key in reversed(rows):
        last.append(key)
        if len(last) == n:
            break
    return last[::-1]


def fit(texts: list[str], truth: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Scorer:
    """Train on whole texts with labels 0 and 1; without both labels, the scorer says the label there is."""
    tokens = [t.split() for t in texts]
    words = Words(tokens)
    net = Network(len(words.word), len(words.keys) - 1, seed)
    scorer = Scorer(words, net)
    scorer.prepare()
    if len(set(truth.tolist())) < 2:
        net.p["out"][:] = 0
        net.p["out_b"][:] = 5.0 if len(truth) and truth[0] == 1 else -5.0
        return scorer
    rng = np.random.default_rng(seed)
    distinct = {}
    rows = [np.fromiter((distinct.setdefault(t, len(distinct)) for t in x), np.int64, len(x)) for x in tokens]
    index, mask, owner = laid_out(rows)
    ids, flat, begin = words.inputs(list(distinct))
    size = np.diff(np.append(begin, len(flat)))
    label = truth[owner]
    for epoch in range(epochs):
        if epoch < 2:
            pick = np.concatenate([rng.permutation(np.flatnonzero(label == y))[:4000] for y in (0, 1)])
        else:
            scorer.gates = net.project(net.embed(ids, flat, begin)[0])
            score = scorer.window_scores(index, mask)
            order = np.lexsort((-score, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            pick = order[np.where(label[order] == 1, rank < 1, rank < 3)]
        share = label[pick].mean()
        # A small sample is gone over again until the epoch has LEAST_STEPS batches.
        pick = np.concatenate([rng.permutation(pick) for _ in range(max(1, -(-LEAST_STEPS * BATCH // len(pick))))])
        for i in range(0, len(pick), BATCH):
            w = pick[i : i + BATCH]
            used, local = np.unique(index[w], return_inverse=True)
            take = np.concatenate([np.arange(begin[u], begin[u] + size[u]) for u in used])
            shown = np.where(rng.random(len(used)) < HIDDEN_WORDS, 0, ids[used])
            inputs = (shown, flat[take], np.append(0, np.cumsum(size[used])[:-1]))
            y = label[w].astype(np.float32)
            balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            net.train(inputs, local.reshape(len(w), WINDOW), mask[w], y, balance)
    scorer.prepare()
    net.m = {}
    return scorer


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """At most SAMPLE texts of each label from outside the held-out fold, in the order of a hash of the id, the first
    whatever its length, and further ones while those before them have fewer than SAMPLE_CHARS characters. Of rows that repeat an
    id, one text is taken; it is chosen by hash before any text moves."""
    open_rows = labels.where(fold() != 0).where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").alias("truth"))
    drawn = [open_rows.where(F.col("truth") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])
    texts = docs.select("doc_id", text_of().alias("t")).select("doc_id", "t", F.xxhash64("t").alias("pick"), F.length("t").alias("size"))
    # One short row an id: at most 2 SAMPLE of them.
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "truth").agg(F.min(F.struct("pick", "size")).alias("x"))
    first = one.select("doc_id", "truth", "x.*", F.xxhash64("doc_id").alias("turn")).toPandas().sort_values(["truth", "turn", "doc_id"])
    first = first[first.groupby("truth")["size"].cumsum() - first["size"] < SAMPLE_CHARS]
    if first.empty:
        return pd.DataFrame({"doc_id": [], "t": [], "truth": []})
    wanted = docs.sparkSession.createDataFrame(first[["doc_id", "pick"]].drop_duplicates())
    found = texts.join(F.broadcast(wanted), ["doc_id", "pick"]).groupBy("doc_id", "pick").agg(F.first("t").alias("t")).toPandas()
    both = first.merge(found, on=["doc_id", "pick"])
    return both[["doc_id", "t", "truth"]].sort_values(["doc_id", "t", "truth"], kind="stable", ignore_index=True)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts, and texts of white space alone, score 0; a null id is in the fold of the
    empty string. Repeated rows get a row each. Without labels of both kinds every text scores
    under 0.5 (or over, if all are toxic). Columns beside doc_id, text and toxic are never read."""
    learned = sample(docs, labels)
    scorer = fit(learned["t"].tolist(), learned["truth"].to_numpy(dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts, scores, at = batch["t"].tolist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1_000_000):
                    size += len(texts[to])
                    to += 1
                scores.append(own.scores(texts[at:to]))
                at = to
            value = np.concatenate(scores) if scores else np.zeros(0)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "held_out": batch["held_out"],
                "score": value, "predicted": (value >= 0.5).astype(np.int32),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), text_of().alias("t"))
    return rows.mapInPandas(scan, "doc_id bigint, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
