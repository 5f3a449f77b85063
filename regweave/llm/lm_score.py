"""Masked pseudo-likelihood: a window network that predicts every word from the words on both sides.

1. Word counts over all documents (summed per task, then in Spark) give the vocabulary: the most frequent words have a
   class of their own, every other word falls in one of a few classes by its hash. Inside its class a word has
   probability (n + 1) / (N + V + 1) by its own count n (N words, V distinct ones in the class); all unseen words
   share the remaining 1 / (N + V + 1).
2. A small network (embeddings of the LEFT words before and after, one hidden layer, softmax over classes) is trained
   in numpy. Each round every task takes gradient steps on a seeded share of the positions of its own documents (the
   shares of all rounds make up every position once), from the same starting weights; the weights are averaged in Spark, weighted by positions. What is gathered grows with
   the corpus, what reaches the driver is one set of weights.
3. A document's score is the sum of the log-probabilities of its words, each given both sides: log P(class) +
   log P(word | class). Counts of the HEAD most frequent words go to every task, all others are joined in Spark.

Texts are read twice: for the counts, and to store every word's class (a byte). Training and scoring read the classes.

Defined cases: null and empty texts have no words, log-probability 0 and a null mean; beyond a text's ends stands a
boundary class; an empty corpus leaves the initial weights; repeated rows are trained on and scored one by one; rows
with null ids are scored; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import text as T
from regweave.session import write_once

WORDS = 192
SHARED = 63
CLASSES = WORDS + SHARED + 1
BOUNDARY = CLASSES - 1
SIDE = 2
EMBED = 16
HIDDEN = 32
ROUNDS = 3
#: Words whose counts every task holds; the counts of all others stay a table.
HEAD = 65_536
RATE = 0.5
BATCH = 512
#: Positions whose class layer is computed at once: small enough for a core's cache. Results do not depend on it.
BLOCK = 256
#: Up to this bound exponents are taken as they are; beyond it each row's largest is subtracted first.
MAX_EXPONENT = 60.0
SEED = 29
#: Words, distinct in their slice, a task counts before it hands its counts on (they are summed again in Spark).
COUNT_BLOCK = 1_000_000


#: Leading bits of a hash that name its bucket in a lookup.
BUCKET_BITS = 20


class Lookup:
    """Places of hashes in a sorted array of distinct hashes, by a bucket of leading bits and a few steps inside it."""

    def __init__(self, keys: np.ndarray):
        bucket = np.searchsorted(keys, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
        self.first, self.steps = bucket.astype(np.int32), int(np.diff(bucket, append=len(keys)).max())
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where every hash is or would be inserted, and whether it is there."""
        at = self.first.take((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        end = len(self.keys) - 1
        for _ in range(self.steps):
            at += (self.keys.take(at) < hashes) & (at < end)
        return at, (self.keys.take(at) == hashes) & (at < end)


@dataclass(frozen=True)
class Vocabulary:
    """Sorted word hashes with their classes; any other word is classed by hash."""

    keys: np.ndarray
    classes: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shared = shared_class(hashes)
        if not len(self.keys):
            return shared
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.classes[at], shared)


def shared_class(hashes: np.ndarray) -> np.ndarray:
    return WORDS + (hashes >> np.uint64(32)).astype(np.int64) % SHARED


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: hash and count of every lower-case word of all documents, stored once."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for _, _, t in T.slices(b.column("text"), lower=True):
                parts.append(np.unique(t.word_hashes(), return_counts=True))
                held += len(parts[-1][0])
                if held > COUNT_BLOCK:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    counts = _texts(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return write_once(counts, "words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent lower-case words of all documents; ties by hash."""
    counts = word_counts(docs) if counts is None else counts
    rows = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    keys = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Vocabulary(keys[order], order)


def initial_weights() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(SEED))
    parts = [rng.normal(0, 0.1, (CLASSES, EMBED)), rng.normal(0, 0.15, (2 * SIDE * EMBED, HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, 0.1, (HIDDEN, CLASSES)), np.zeros(CLASSES)]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpacked(w: np.ndarray) -> list[np.ndarray]:
    shapes = [(CLASSES, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(w[at : at + n].reshape(s))
        at += n
    return out


def contexts(t: T.Texts, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Class of every word, and classes of the words around it (boundary beyond the text's ends)."""
    word = vocab.of(t.word_hashes())
    return word, _around(word, t.words()[3])


def _around(word: np.ndarray, n: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    """Classes of the SIDE words before and after every (picked) word, for texts of n words laid end to end."""
    padded = np.full(len(word) + 2 * SIDE * (len(n) + 1), BOUNDARY, word.dtype)
    place = np.arange(len(word)) + np.repeat(2 * SIDE * np.arange(1, len(n) + 1), n)
    padded[place] = word
    place = place if pick is None else place[pick]
    shifts = [k for k in range(-SIDE, SIDE + 1) if k]
    return np.stack([padded[place + k] for k in shifts]).T if len(place) else np.zeros((0, 2 * SIDE), word.dtype)


def _class_layer(w: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Weights and biases (last row) of the classes, and whether exponents can be taken as they are."""
    layer = np.vstack([w[3], w[4]])
    return layer, _bounded(layer)


def _bounded(layer: np.ndarray) -> bool:
    # hidden units are within [-1, 1], so small weights bound the exponents
    return bool((np.ones(len(layer), layer.dtype) @ np.abs(layer)).max() < MAX_EXPONENT)


def _exponents(h: np.ndarray, layer: np.ndarray, bounded: bool, out: np.ndarray) -> np.ndarray:
    """Exponents of the classes, in ``out``; ``h`` are hidden units and a one, for the bias."""
    z = np.matmul(h, layer, out=out[: len(h)])
    if not bounded:
        z -= z.max(1, keepdims=True)
    return z


def log_probabilities(w: list[np.ndarray], word: np.ndarray, around: np.ndarray) -> np.ndarray:
    out, ones, (layer, bounded) = np.empty(len(word)), np.ones(CLASSES, w[3].dtype), _class_layer(w)
    # the first layer of every class at every place, summed by place instead of multiplied word by word
    tables = [w[0] @ w[1][k * EMBED : (k + 1) * EMBED] for k in range(2 * SIDE)]
    tables[0] += w[2]
    h, rows, scores = np.ones((BLOCK, HIDDEN + 1), w[3].dtype), np.arange(BLOCK), np.empty((BLOCK, CLASSES), w[3].dtype)
    for lo in range(0, len(word), BLOCK):
        y, a = word[lo : lo + BLOCK], around[lo : lo + BLOCK].astype(np.int64)
        m = len(y)
        x = tables[0].take(a[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            x += tables[k].take(a[:, k], axis=0)
        np.tanh(x, out=h[:m, :-1])
        z = _exponents(h[:m], layer, bounded, scores)
        own = z[rows[:m], y]
        out[lo : lo + m] = own - np.log(np.exp(z, out=z) @ ones)
    return out


def train(w: list[np.ndarray], word: np.ndarray, around: np.ndarray, rate: float) -> None:
    """Plain gradient steps, in place.

    The class layer of a step runs in blocks. Rows are scaled where they are narrow: the exponentials stay as they are,
    and 1 / (their sum) goes to the hidden units and their gradients.
    """
    pairs = np.result_type(w[0], np.complex64)  # two components of an embedding are added at a time
    embeddings = w[0].reshape(-1).view(pairs)
    places = np.arange(embeddings.size).reshape(len(w[0]), -1)
    ones, first, layer = np.ones(max(BATCH, CLASSES), w[3].dtype), np.arange(BLOCK) * CLASSES, _class_layer(w)[0]
    h, dh, scores = np.ones((BATCH, HIDDEN + 1), w[3].dtype), np.empty((BATCH, HIDDEN), w[3].dtype), np.empty((BLOCK, CLASSES), w[3].dtype)
    for lo in range(0, len(word), BATCH):
        y, a = word[lo : lo + BATCH], around[lo : lo + BATCH].astype(np.int64).reshape(-1)
        m, bounded, change = len(y), _bounded(layer), 0.0
        x, back = w[0].take(a, axis=0).reshape(m, -1), dh[:m]
        units = x @ w[1]
        units += w[2]
        h[:m, :-1] = np.tanh(units, out=units)
        for b in range(0, m, BLOCK):
            at = slice(b, min(b + BLOCK, m))
            p = _exponents(h[at], layer, bounded, scores)
            total = np.exp(p, out=p) @ ones[:CLASSES]
            p.reshape(-1)[first[: len(total)] + y[at]] -= total
            step = (rate / m / total)[:, None]
            np.multiply(p @ layer[:-1].T, step, out=back[at])
            change = p.T @ (h[at] * step) + change
        units *= units
        back *= np.subtract(1, units, out=units)
        layer -= change.T
        dx = back @ w[1].T
        w[1] -= x.T @ back
        w[2] -= ones[:m] @ back
        np.subtract.at(embeddings, places.take(a, axis=0).reshape(-1), dx.reshape(-1).view(pairs))
    w[3][:], w[4][:] = layer[:-1], layer[-1]


def in_round(row: np.ndarray, place: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """The positions (row and place in its text) trained on in round r; every position has one round."""
    return T.mix(T.mix(row.astype(np.uint64)) + place.astype(np.uint64)) % np.uint64(rounds) == r


def encode(docs: DataFrame, vocab: Vocabulary, counts: DataFrame) -> DataFrame:
    """``doc_id, row, n_words, classes, head, words`` of every row, stored once: training and scoring read no text.

    ``classes`` holds a byte a word; ``head`` sums log P(word | class) as far as tasks hold the counts, ``words`` are
    the hashes of the words whose counts they do not hold.
    """
    own = docs.sparkSession.createDataFrame([(int(k),) for k in vocab.keys.view(np.int64)], "word long")
    rare = counts.join(F.broadcast(own), "word", "left_anti")
    shared = F.lit(WORDS) + F.shiftrightunsigned("word", 32) % SHARED
    base = np.zeros(CLASSES)
    for r in rare.groupBy(shared.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        base[r["k"]] = np.log(r["n"] + r["v"] + 1.0)
    top = rare.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    # a word with a class of its own is the whole of it
    known = np.concatenate([vocab.keys, top.column("word").to_numpy().view(np.uint64)])
    known_log = np.concatenate([np.zeros(len(vocab.keys)), np.log(top.column("n").to_numpy() + 1.0)])
    order = np.argsort(known)
    known, known_log = known[order], np.append(known_log[order], 0.0)
    # classes of words that tasks know; the others are shared
    known_class, find = np.append(vocab.of(known), 0).astype(np.uint8), Lookup(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), lower=True):
                n, hashes = t.words()[3], t.word_hashes()
                owner = np.repeat(np.arange(t.n), n)
                at, there = find.places(hashes)
                word, rest = known_class.take(at), ~there
                word[rest] = shared_class(hashes[rest])
                each = np.where(there, known_log.take(at), 0.0) - base.take(word)
                total = np.bincount(owner, each, minlength=t.n).astype(np.float64)
                classes = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), t.n, [None, pa.py_buffer(_offsets(n)), pa.py_buffer(word)]
                )
                words = pa.LargeListArray.from_arrays(
                    pa.array(_offsets(np.bincount(owner[rest], minlength=t.n))), pa.array(hashes[rest].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(row + np.arange(t.n)), pa.array(n), classes.cast(pa.binary()), pa.array(total), words.cast(pa.list_(pa.int64()))],
                    ["doc_id", "row", "n_words", "classes", "head", "words"],
                )
                row += t.n

    schema = "doc_id long, row long, n_words long, classes binary, head double, words array<long>"
    return write_once(_texts(docs).mapInArrow(run, schema), "encoded")


def _offsets(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _encoded_parts(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, classes, words per row) of about SLICE_BYTES words each (or of one longer text)."""
    column = b.column("classes").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + T.SLICE_BYTES, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], np.diff(off[lo : hi + 1])
        lo = hi


def fit_network(encoded: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights averaged over tasks after every round; ``encoded`` as of :func:`encode`."""
    weights = initial_weights()
    for r in range(rounds):
        start, rate = weights, RATE / (1 + r)

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate, r=r) -> Iterator[pa.RecordBatch]:
            w = start.copy()
            parts, seen = unpacked(w), 0
            for b in batches:
                rows = b.column("row").to_numpy()
                for lo, hi, word, n in _encoded_parts(b):
                    place = T.ranges(np.zeros(hi - lo, np.int64), n)
                    pick = in_round(np.repeat(rows[lo:hi], n), place, r, rounds)
                    train(parts, word[pick], _around(word, n, pick), rate)
                    seen += int(pick.sum())
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(w))), pa.array(w.astype(np.float64) * seen), pa.array(np.full(len(w), float(seen)))],
                    ["i", "wn", "n"],
                )

        mean = (
            encoded.select("row", "classes").mapInArrow(run, "i long, wn double, n double").groupBy("i")
            .agg((F.sum("wn") / F.sum("n")).alias("w")).orderBy("i").toArrow()
        )
        if mean.num_rows:
            weights = mean.column("w").to_numpy().astype(np.float32)
    return weights


def score_documents(encoded: DataFrame, weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every encoded row; ``counts`` as of :func:`word_counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unpacked(weights)
        for b in batches:
            for lo, hi, word, n in _encoded_parts(b):
                each = log_probabilities(w, word, _around(word, n))
                total = np.bincount(np.repeat(np.arange(hi - lo), n), each, minlength=hi - lo).astype(np.float64)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), part.column("n_words"), pc.add(part.column("head"), pa.array(total))],
                    ["doc_id", "row", "n_words", "known"],
                )

    known = encoded.select("doc_id", "row", "n_words", "classes", "head").mapInArrow(run, "doc_id long, row long, n_words long, known double")
    rest = encoded.select("row", F.explode("words").alias("word")).join(counts, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    out = known.join(rest, "row", "left").withColumn("log_prob", total)
    return out.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Counts, vocabulary, training and scoring over the same documents."""
    counts = word_counts(docs)
    encoded = encode(docs, vocabulary(docs, counts), counts)
    return score_documents(encoded, fit_network(encoded), counts)
