"""Quality rules: boosted trees over document statistics, behind a plain base rule.

The statistics come from one pass over whole texts. The trees are fitted on at most ``MAX_LABELLED`` labelled
documents and travel to the tasks as flat numpy arrays. The score can only fall when symbols, repeated words or
repeated lines take a larger share.

Defined cases: a null text has no words, so every count is 0 and the base rule rejects it; an empty table gives an
empty result; without labels (or with labels of one class) the trees are constant and only the base rule
decides; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.llm import text as T
from regweave.llm.labelled import MAX_LABELLED, label_sample
from regweave.llm.trees import Forest, fit

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = T.table("#*$%&|<>")
MARKS = T.table(".,;:!?")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
         "mark_share", "exclaim_share", "line_words", "distinct_share"]
#: Direction of the quality score in a statistic.
MONOTONE = {STATS.index("symbol_share"): -1, STATS.index("dup_line_share"): -1, STATS.index("repeat_share"): -1}


def statistics(t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (one column per name in BASE) and model features (STATS) of each text."""
    _, _, first, n = t.words()
    hashes = t.word_hashes()
    owner = np.repeat(np.arange(t.n), n)
    word_chars = t.count(~(T.SPACE | T.CONTINUATION)[t.data])
    symbols = t.count(SYMBOLS[t.data])
    windows, at, per = t.windows(WINDOW, hashes)
    many, _ = T.repeated(T.within(windows, np.repeat(np.arange(t.n), per)))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[many], 1)
    np.add.at(cover, at[many] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    repeat = inside[first + n] - inside[first]
    ls, le, line_doc = t.lines()
    _, later = T.repeated(T.within(t.hash_spans(ls, le), line_doc))
    dup_lines = np.bincount(line_doc[later], minlength=t.n)
    lines = np.maximum(np.bincount(line_doc, minlength=t.n), 1)
    _, seen = T.repeated(T.within(hashes, owner))
    again = np.bincount(owner[seen], minlength=t.n)
    words, chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    share = lambda mask: t.count(mask[t.data]) / chars
    x = np.stack([np.log1p(n), word_chars / words, symbols / chars, dup_lines / lines, repeat / words, share(T.UPPER),
                  share(T.DIGIT), share(MARKS), share(T.table("!")), np.log1p(n / lines), 1 - again / words], axis=1)
    return np.stack([n, word_chars, symbols, dup_lines, repeat], axis=1), x


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Forest:
    """Trees from at most ``limit`` labelled documents; only their statistics reach the driver."""
    sample = label_sample(labels, "quality", "min", limit)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text")):
                x = statistics(t)[1]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"]
                )

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(features, "doc_id long, y int, x array<double>")
        .groupBy("doc_id")
        .agg(F.min(F.struct("y", "x")).alias("r"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["r"]["x"] for r in rows]).reshape(len(rows), len(STATS))
    y = np.array([r["r"]["y"] for r in rows], dtype=float)
    return fit(x, y, MONOTONE)


def quality_rules(docs: DataFrame, forest: Forest, keep: list[str] | None = None, min_score: float = 0.5) -> DataFrame:
    """Counts, base rule, score and verdict of every row of ``docs``; columns named in ``keep`` are carried along."""
    keep = ["doc_id"] if keep is None else keep
    kinds = dict(docs.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in keep] + [f"{c} long" for c in BASE]
    fields += ["base_failed boolean", "kept boolean", "quality double"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("_text")):
                counts, x = statistics(t)
                failed, score = base_failed(counts), forest.probability(x)
                part = b.slice(lo, hi - lo)
                arrays = [part.column(c) for c in keep] + [pa.array(counts[:, k]) for k in range(len(BASE))]
                arrays += [pa.array(failed), pa.array(~failed & (score >= min_score)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *BASE, "base_failed", "kept", "quality"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(judge, ", ".join(fields))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; same columns."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    inner = {c: f"_in{i}" for i, c in enumerate(docs.columns)}  # own names cannot clash with the operator's
    plain = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in docs.columns], "text")
    verdicts = quality_rules(plain, fit_quality(docs, labels), list(inner.values()))
    return verdicts.filter("kept").select(*[F.col(inner[c]).alias(c) for c in docs.columns])
