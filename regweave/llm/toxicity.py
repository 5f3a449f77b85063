"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings (4 to 7 bytes) that occur in labelled toxic documents far more
often than in the others, counted per document in Spark. Features are densities of lexicon hits, their closeness to
second-person words, capitals, punctuation and obfuscation (letters around a digit or mark, and hits that appear
only after such characters are read as letters). Features of a training document use counts without that
document, so the trees see them as they will look on new texts. Two-fold margins calibrate the final score.

Defined cases: null and empty texts have no words and get the score of an all-zero feature row; without labels of
both kinds the score is the share of toxic labels (0 if there are none); a document labelled twice counts as toxic
if one label says so; null ids take no part in learning and are scored; repeated rows are scored one by one; an
empty table gives an empty result; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.llm import text as T
from regweave.llm.labelled import MAX_LABELLED, label_sample
from regweave.llm.trees import Forest, fit, isotonic

MAX_TERMS = 8192
MIN_TOXIC = 3
MIN_WEIGHT = 1.5
BEGINNINGS = (4, 5, 6, 7)
NEAR = 4
# fixed values: second-person words of the languages at hand
SECOND_PERSON = (
    "you your yours yourself u ur tu toi ton ta tes te vous votre vos du dich dir dein deine deinen deiner ihr euch "
    "euer eure tú ti usted ustedes vosotros vuestro os"
).split()
# fixed values: characters read as letters
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_READ = T.LOWER_MAP.copy()
for _a, _b in LOOKALIKES.items():
    _READ[ord(_a)] = ord(_b)
_MARKS = T.table(".,;:!?*#@$%&^~_-+=/|<>()[]{}\"'")
_INNER = T.table("0123456789.*@$!_#^~+|")


def _hash_words(words: list[str]) -> np.ndarray:
    column = pa.array(words)
    return np.sort(np.concatenate([t.word_hashes() for _, _, t in T.slices(column, lower=True)]))


_PERSON = _hash_words(SECOND_PERSON)


@dataclass(frozen=True)
class Lexicon:
    """Sorted term hashes with the labelled documents (toxic, other) that have them."""

    terms: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    n_toxic: int
    n_other: int

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(keys.shape, -1, np.int64)
        if len(self.terms):
            gate = np.zeros(1 << 16, bool)
            gate[(self.terms >> np.uint64(48)).astype(np.int64)] = True
            hit = np.flatnonzero(gate[(keys >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, keys[hit]), len(self.terms) - 1)
            real = self.terms[at] == keys[hit]
            out[hit[real]] = at[real]
        return out

    def weights(self, at: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Log odds of the terms ``at`` (0 for -1 and for weak ones); ``own``: the label to leave out per entry, or -1."""
        toxic, other = self.toxic[at].astype(float), self.other[at].astype(float)
        if own is not None:
            toxic, other = toxic - (own == 1), other - (own == 0)
        w = np.log((toxic + 0.5) / (self.n_toxic + 1)) - np.log((np.maximum(other, 0) + 0.5) / (self.n_other + 1))
        return np.where((at >= 0) & (toxic >= MIN_TOXIC - 1) & (w >= MIN_WEIGHT), w, 0.0)


def _cores(t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks around them (at most a few on each side)."""
    s, e, _, _ = t.words()
    s, e = s.copy(), e.copy()
    plain = T.LETTER | T.CONTINUATION | T.DIGIT
    for _ in range(4):
        s += (s < e) & ~plain[t.data[np.minimum(s, len(t.data) - 1)]]
        e -= (s < e) & ~plain[t.data[np.maximum(e - 1, 0)]]
    return s, e


def _terms(t: T.Texts, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Keys of every word: the word, and its beginnings (0 where the word is not longer than that)."""
    keys = [np.where(e > s, t.hash_spans(s, e), np.uint64(0))]
    for k in BEGINNINGS:
        h = t.hash_spans(s, np.minimum(s + k, e)) ^ T._WINDOW[20 + k]
        keys.append(np.where(e - s > k, h, np.uint64(0)))
    return keys


def features(t: T.Texts, lexicon: Lexicon, own: np.ndarray | None = None) -> np.ndarray:
    """One dense row per text; ``t`` must be lower-cased, ``own`` gives labels of training texts."""
    _, _, first, n = t.words()
    owner = np.repeat(np.arange(t.n), n)
    mine = None if own is None else own[owner]
    s, e = _cores(t)
    keys = _terms(t, s, e)
    words = np.maximum(n, 1)
    per = lambda w: np.bincount(owner, w, minlength=t.n)
    whole = lexicon.weights(lexicon.find(keys[0]), mine)
    begin = np.zeros(len(owner))
    for k in keys[1:]:
        begin = np.maximum(begin, lexicon.weights(lexicon.find(k), mine))
    read = T.Texts(_READ[t.raw], t.start, t.end)
    inner = _INNER[t.data]
    inner[1:] &= (T.LETTER | T.CONTINUATION)[t.data[:-1]]
    inner[:-1] &= T.LETTER[t.data[1:]]
    odd = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(inner, out=odd[1:])
    odd = odd[e] > odd[s]
    hidden = np.zeros(len(owner))
    if odd.any():
        at = np.flatnonzero(odd)
        hidden[at] = lexicon.weights(lexicon.find(read.hash_spans(s[at], e[at])), None if mine is None else mine[at])
    hit = np.maximum(np.maximum(whole, begin), hidden)
    person = np.zeros(len(owner) + 1, np.int64)
    at = np.minimum(np.searchsorted(_PERSON, keys[0]), len(_PERSON) - 1)
    np.cumsum(_PERSON[at] == keys[0], out=person[1:])
    place = np.arange(len(owner))
    lo, hi = np.maximum(place - NEAR, first[owner]), np.minimum(place + NEAR + 1, (first + n)[owner])
    near = (person[hi] > person[lo]) & (hit > 0)
    top = np.zeros(t.n)
    np.maximum.at(top, owner, hit)
    chars = np.maximum(t.count(~T.SPACE[t.data]), 1)
    upper = T.UPPER[t.raw]
    return np.stack(
        [
            per(whole > 0) / words, np.log1p(per(whole > 0)), per(begin > 0) / words, np.log1p(per(begin > 0)),
            per(hidden > 0) / words, per(hit) / words, top, per(near) / words, t.count(upper) / chars,
            t.count(t.raw == 33) / chars, t.count(_MARKS[t.raw]) / chars, per(odd) / words, np.log1p(n),
        ],
        axis=1,
    )


def _texts(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def learn_lexicon(sampled: DataFrame, limit: int = MAX_TERMS) -> Lexicon:
    """Terms of ``sampled`` (text, y) by document counts; ties by hash; at most ``limit`` strongest terms are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), lower=True):
                y = b.column("y").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(t.n), t.words()[3])
                keys = np.concatenate(_terms(t, *_cores(t)))
                doc = np.tile(owner, 1 + len(BEGINNINGS))
                real = keys != 0
                keys, doc = keys[real], doc[real]
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                keys, toxic = keys[new], y[doc[new]]
                term, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, minlength=len(term))
                bad = np.bincount(at, toxic, minlength=len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(bad), pa.array(n - bad)], ["term", "toxic", "other"]
                )

    size = sampled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n_toxic, n_other = int(size["t"]), int(size["n"] - size["t"])
    weight = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(n_other + 1.0))
    rows = (
        sampled.select("text", "y").mapInArrow(run, "term long, toxic long, other long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter((F.col("toxic") >= MIN_TOXIC) & (weight >= MIN_WEIGHT))
        .orderBy(F.desc(F.col("toxic") * weight), "term").limit(limit).collect()
    )
    terms = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(terms)
    toxic, other = (np.array([r[c] for r in rows], np.int64)[order] for c in ("toxic", "other"))
    if not len(rows):
        toxic = other = np.zeros(1, np.int64)
    return Lexicon(terms[order], toxic, other, n_toxic, n_other)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    forest: Forest
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of the raw probability keeps the order inside flat parts."""
        margin = self.forest.margin(x)
        flat = np.interp(margin, self.knots, self.levels)
        return np.clip(0.99 * flat + 0.01 / (1 + np.exp(-np.clip(margin, -40, 40))), 0, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, where=None, limit: int = MAX_LABELLED) -> Model:
    """Lexicon, trees and calibration from at most ``limit`` labelled documents (those that pass ``where``)."""
    sample = label_sample(labels, "toxic", "max", limit, where)
    sampled = _texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    lexicon = learn_lexicon(sampled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), lower=True):
                part = b.slice(lo, hi - lo)
                x = features(t, lexicon, part.column("y").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"]
                )

    rows = (
        sampled.mapInArrow(run, "doc_id long, y int, x array<double>")
        .groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).orderBy("doc_id").collect()
    )
    y = np.array([r["r"]["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        level = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, fit(np.zeros((0, 1)), np.zeros(0)), np.array([0.0]), np.array([level]))
    x = np.array([r["r"]["x"] for r in rows])
    half = np.arange(len(y)) % 2 == 0
    margin = np.zeros(len(y))
    for part in (half, ~half):
        margin[part] = fit(x[~part], y[~part]).margin(x[part])
    knots, levels = isotonic(margin, y)
    return Model(lexicon, fit(x, y), knots, levels)


def toxicity(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``held_out`` is a boolean column expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), lower=True):
                score = model.score(features(t, model.lexicon))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return _texts(docs, held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
