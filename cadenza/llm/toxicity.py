"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a word embedding beside the mean of its character trigrams' embeddings, both hashed. A window of
WINDOW words runs through one gated recurrent layer in each direction; attention over the positions pools the
states, and a logistic unit scores the window. A document's score is its highest window's; windows overlap by
WINDOW - STRIDE words and cover the whole text.

The network is fitted on the driver, on a sample with stated bounds: at most FIT_POSITIVE and FIT_NEGATIVE labelled
documents (by a hash of the id), each id once, first those of at most FIT_BYTES bytes and, where these are too few,
others of at most MOST_BYTES; so the driver never gets more than (FIT_POSITIVE + FIT_NEGATIVE) * MOST_BYTES bytes. A
label belongs to a document, and the window that carries it is not known: at first it is the one with the highest
log-odds of its words, later the one that the network itself scores highest. Everything is seeded, so runs agree.

Defined cases: a null or empty text has one window without words; fewer words than a window are padded, and padding
changes no state; repeated rows are scored each; labels that repeat count as toxic if one of them is; of documents that repeat an id the shortest is learnt from; without both
labels in the sample all scores are 0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpoint
from .quality import fold

WINDOW, STRIDE = 64, 48
BUCKETS = 1 << 14
EMBED = 8
HIDDEN = 16
FIT_POSITIVE, FIT_NEGATIVE = 600, 900
FIT_BYTES, MOST_BYTES = 8_000, 64_000
#: At least so many epochs, and steps.
EPOCHS, LEAST_STEPS = 6, 150
BATCH, RATE = 64, 0.01
#: Words of fewer training documents are blanked in training: they tell documents apart, not labels.
LEAST_DOCUMENTS = 3
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SEED = 5
_CHUNK_WORDS = 100_000

_PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum())
#: Lower case, and ASCII punctuation as white space.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _PUNCTUATION, bytes(range(97, 123)) + b" " * len(_PUNCTUATION))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Lexicon:
    """Distinct words with their buckets: one for the word, one for each trigram of it."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, trigram buckets, and where each word's trigrams start."""
        joined = np.frombuffer(b"".join(b"<" + w + b">" for w in self.index), np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, self.index), np.int64, len(self.index))
        trigrams = joined[:-2] * np.uint64(0x1F123BB5) + joined[1:-1] * np.uint64(0x9E3779B1) + joined[2:] * np.uint64(0x85EBCA6B)
        trigrams ^= trigrams >> np.uint64(17)
        first = np.cumsum(lengths + 2) - lengths - 2
        starts = np.cumsum(lengths) - lengths
        inside = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        grams = trigrams[np.repeat(first, lengths) + inside]
        mixed = grams * (np.uint64(2) * inside.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
        whole ^= whole >> np.uint64(31)
        return (whole % np.uint64(BUCKETS)).astype(np.int64), (grams % np.uint64(BUCKETS)).astype(np.int64), starts


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: each window's document, first word and number of words."""
    doc, start, size, at = [], [], [], 0
    for i, n in enumerate(lengths):
        for s in range(0, max(n - WINDOW + STRIDE, 1), STRIDE):
            doc.append(i)
            start.append(at + s)
            size.append(min(WINDOW, n - s))
        at += n
    return np.array(doc, np.int64), np.array(start, np.int64), np.array(size, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, scoring and training; all arrays are float32."""

    def __init__(self, seed: int = SEED):
        rng, d, h = np.random.default_rng(seed), 2 * EMBED, HIDDEN

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"word": np.zeros((BUCKETS, EMBED), np.float32), "char": normal(BUCKETS, EMBED, scale=0.1)}
        for way in "fb":
            self.p |= {f"W{way}": normal(d, 3 * h, scale=d**-0.5), f"U{way}": normal(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": normal(2 * h, h, scale=(2 * h) ** -0.5), "a": np.zeros(h, np.float32), "v": normal(h, scale=h**-0.5), "w": normal(2 * h, scale=0.1), "o": np.zeros(1, np.float32)}

    def inputs(self, lexicon: Lexicon) -> np.ndarray:
        """A row for each word of the lexicon, and a last one of zeros for padding."""
        out = np.zeros((len(lexicon.index) + 1, 2 * EMBED), np.float32)
        if lexicon.index:
            word, grams, starts = lexicon.buckets()
            counts = np.diff(starts, append=len(grams))
            out[:-1, :EMBED] = self.p["word"][word]
            out[:-1, EMBED:] = np.add.reduceat(self.p["char"][grams], starts, axis=0) / counts[:, None]
        return out

    def _run(self, way: str, projected: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (windows, positions, HIDDEN) of one direction."""
        n, steps = at.shape
        h, state, u = HIDDEN, np.zeros((n, HIDDEN), np.float32), self.p[f"U{way}"]
        out = np.empty((n, steps, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, hu, m = projected[at[:, t]], state @ u, mask[:, t, None]
            gates = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
            after = state + m * (1 - z) * (new - state)
            if keep is not None:
                keep.append((t, state, z, r, new, hu[:, 2 * h :]))
            state = out[:, t] = after
        return out

    def forward(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; `at` are rows of `table`, the words' inputs."""
        p, states = self.p, []
        for way in "fb":
            steps: list | None = None if keep is None else keep.setdefault(way, [])
            states.append(self._run(way, table @ p[f"W{way}"] + p[f"c{way}"], at, mask, steps))
        hidden = np.concatenate(states, axis=2)
        squashed = np.tanh(hidden @ p["A"] + p["a"])
        energy = np.where(mask > 0, squashed @ p["v"], -1e9)
        weight = np.exp(energy - energy.max(axis=1, keepdims=True)) * (mask > 0)
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, hidden)
        if keep is not None:
            keep |= {"hidden": hidden, "squashed": squashed, "weight": weight, "pooled": pooled}
        return pooled @ p["w"] + p["o"]

    def gradients(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss: by parameter, and by row of `table`."""
        p, keep, h = self.p, {}, HIDDEN
        logit = self.forward(table, at, mask, keep)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        hidden, squashed, weight = keep["hidden"], keep["squashed"], keep["weight"]
        g = {"w": keep["pooled"].T @ d_logit, "o": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["w"]
        d_weight = np.einsum("nh,nth->nt", d_pooled, hidden)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_squashed = d_energy[:, :, None] * p["v"] * (1 - squashed**2)
        g |= {"v": np.einsum("nt,nth->h", d_energy, squashed), "A": np.einsum("nti,ntj->ij", hidden, d_squashed), "a": d_squashed.sum(axis=(0, 1))}
        d_hidden = weight[:, :, None] * d_pooled[:, None] + d_squashed @ p["A"].T
        d_table = np.zeros_like(table)
        for i, way in enumerate("fb"):
            u, d_state = p[f"U{way}"], np.zeros((len(at), h), np.float32)
            d_u, d_x = np.zeros_like(u), np.zeros((*at.shape, 3 * h), np.float32)
            for t, state, z, r, new, hu in reversed(keep[way]):
                d_after = d_state + d_hidden[:, t, i * h : (i + 1) * h]
                m = mask[:, t, None]
                d_new = d_after * m * (1 - z) * (1 - new**2)
                d_z = d_after * m * (state - new) * z * (1 - z)
                d_r = d_new * hu * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_x[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u += state.T @ d_hu
                d_state = d_after * (1 - m * (1 - z)) + d_hu @ u.T
            flat, rows = d_x.reshape(-1, 3 * h), at.ravel()
            g |= {f"U{way}": d_u, f"c{way}": flat.sum(axis=0), f"W{way}": table[rows].T @ flat}
            np.add.at(d_table, rows, flat @ p[f"W{way}"].T)
        return g, d_table

    def scores(self, documents: list[list[bytes]]) -> np.ndarray:
        """The highest window probability of each document."""
        out = np.zeros(len(documents))
        first = 0
        while first < len(documents):
            last, total = first, 0
            while last < len(documents) and (last == first or total + len(documents[last]) <= _CHUNK_WORDS):
                total += len(documents[last])
                last += 1
            out[first:last] = self._chunk(documents[first:last])
            first = last
        return out

    def _chunk(self, documents: list[list[bytes]]) -> np.ndarray:
        lexicon = Lexicon()
        at = lexicon.add([w for d in documents for w in d])
        doc, start, size = windows([len(d) for d in documents])
        table = self.inputs(lexicon)
        logit = np.concatenate([self.forward(table, *_laid_out(at, start[i : i + 2048], size[i : i + 2048], len(table) - 1)) for i in range(0, len(doc), 2048)])
        return _sigmoid(np.maximum.reduceat(logit, np.flatnonzero(np.diff(doc, prepend=-1))))


def _laid_out(at: np.ndarray, start: np.ndarray, size: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Word rows (windows, positions) and their mask, cut to the longest window."""
    steps = np.arange(max(1, int(size.max(initial=1))))
    mask = steps < size[:, None]
    rows = np.append(at, padding)[np.where(mask, start[:, None] + steps, -1)]
    return np.where(mask, rows, padding), mask.astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray) -> Network | None:
    """A network fitted to labelled texts; None without both labels."""
    if not 0 < labels.sum() < len(labels):
        return None
    rng, net, lexicon = np.random.default_rng(SEED), Network(), Lexicon()
    documents = [words_of(t) for t in texts]
    at = lexicon.add([w for d in documents for w in d])
    lengths = np.array([len(d) for d in documents])
    doc, start, size = windows(lengths.tolist())
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    owner, n = np.repeat(np.arange(len(documents)), lengths), len(lexicon.index)
    pairs = np.unique(np.stack([owner, at], axis=1), axis=0) if n else np.zeros((0, 2), int)
    seen = [np.bincount(pairs[labels[pairs[:, 0]] == y, 1], minlength=n) for y in (0, 1)]
    odds = np.log((seen[1] + 0.2) / (labels.sum() + 1)) - np.log((seen[0] + 0.2) / (len(labels) - labels.sum() + 1))
    rare = np.append(seen[0] + seen[1] < LEAST_DOCUMENTS, False)
    total = np.append(0, np.cumsum(np.maximum(odds, 0)[at] ** 2))
    signal = total[start + size] - total[start]
    word, grams, starts = lexicon.buckets()
    counts = np.diff(starts, append=len(grams))
    of_gram = np.repeat(np.arange(n), counts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (2 * len(documents))))
    for epoch in range(epochs):
        if epoch in (epochs // 2, epochs * 5 // 6):
            table = net.inputs(lexicon)
            signal = np.concatenate([net.forward(table, *_laid_out(at, start[i : i + 2048], size[i : i + 2048], n)) for i in range(0, len(doc), 2048)])
        best = np.array([f + int(signal[f:e].argmax()) for f, e in zip(first, [*first[1:], len(doc)], strict=True)])
        clean = np.flatnonzero(labels[doc] == 0)
        chosen = np.concatenate([best, rng.choice(clean, min(len(clean), len(documents)), replace=False)])
        chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), BATCH):
            some = chosen[i : i + BATCH]
            rows, mask = _laid_out(at, start[some], size[some], n)
            rows = np.where(rare[rows], n, rows)
            used, rows = np.unique(rows, return_inverse=True)
            g, d_rows = net.gradients(net.inputs(lexicon)[used] if n < 2000 else _inputs_of(net, word, grams, starts, counts, used, n), rows.reshape(mask.shape), mask, labels[doc[some]].astype(np.float32))
            real = used < n
            ids, d_rows = used[real], d_rows[real]
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], word[ids], d_rows[:, :EMBED])
            spread = _ranges(starts[ids], counts[ids])
            np.add.at(g["char"], grams[spread], np.repeat(d_rows[:, EMBED:] / counts[ids][:, None], counts[ids], axis=0))
            step += 1
            for k, v in net.p.items():
                one, two = moments[k]
                one += 0.1 * (g[k] - one)
                two += 0.001 * (g[k] ** 2 - two)
                v -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-6)
    return net


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(counts.sum())) + np.repeat(starts - ends + counts, counts)


def _inputs_of(net: Network, word: np.ndarray, grams: np.ndarray, starts: np.ndarray, counts: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """Inputs of some words only."""
    out = np.zeros((len(used), 2 * EMBED), np.float32)
    real = used < n
    ids = used[real]
    if len(ids):
        out[real, :EMBED] = net.p["word"][word[ids]]
        sums = np.add.reduceat(net.p["char"][grams[_ranges(starts[ids], counts[ids])]], np.cumsum(counts[ids]) - counts[ids], axis=0)
        out[real, EMBED:] = sums / counts[ids][:, None]
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the training sample: a row per id, of a bounded number and size."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).where("label is not null and _id is not null").groupBy("_id").agg(F.max("label").alias("label"))
    known = known.where(fold(F.col("_id"), FOLDS) != HELD_OUT)
    sized = docs.select("doc_id", "text").withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("_bytes") <= MOST_BYTES)
    usable = sized.select("doc_id", "_bytes").join(known, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("label").alias("label"), F.min("_bytes").alias("_least"))
    usable = checkpoint(usable)
    some = lambda label, most: usable.where(F.col("label") == label).orderBy(F.col("_least") > FIT_BYTES, F.xxhash64("_id"), "_id").limit(most)
    chosen = F.broadcast(some(1, FIT_POSITIVE).unionByName(some(0, FIT_NEGATIVE)))  # a bounded number of rows
    rows = sized.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("_bytes") == F.col("_least")))
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from the labelled documents outside the held-out fold, within the bounds of the sample."""
    rows = sample(docs, labels).orderBy("doc_id").collect()
    return train([r["text"].encode("utf-8", "surrogatepass") for r in rows], np.array([r["label"] for r in rows], np.int64))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = fit(docs, labels)

    def compute(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"score": pa.array(net.scores([words_of(t) for t in texts]) if net else np.full(len(texts), 0.5), pa.float64())}

    scored = append_columns(docs.select("doc_id", "text"), "text", [("score", T.DoubleType())], compute)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
