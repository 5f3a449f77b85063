"""Mixing sources to target weights by iterative proportional fitting over source, language and topic.

1. Every document gets a topic (nearest of a few centroids of hashed word counts, fitted by k-means over all
   documents) and its number of words as token weight. The counts are stored once, in 256 bytes a document.
2. Tokens are summed to cells (source, language, topic), and cells to one row per source.
3. Raking: factors for languages and topics are adjusted in turn until all three margins fit; the factor of a
   source follows from those two, so a step only sums a languages x topics table. The number of sources, and of
   documents, does not matter to the driver.
4. A document's ratio is the target share of its cell over the observed one. It is sampled with probability
   ratio / ``ceiling``, at most 1; the draw is a seeded hash of its id and text. With the default ceiling of 1 cells
   below their target are kept whole and the others thinned; a larger ceiling comes closer to the targets and
   keeps less. ``design_weight`` is the ratio over the probability: tokens of sampled rows times it meet the targets
   in expectation at any ceiling. Rows without it, as the stage hands them on, fall short where a ratio exceeds it.

Target margins are the observed shares raised to a power below one (a temperature), which lifts small sources,
languages and topics; explicit shares can be given instead.

Defined cases: a null source or language is a category of its own; documents without words have no tokens to
weigh, take part in no margin and get the probability of their cell (1 if the cell has no tokens at all); a margin
whose target is 0 gets probability 0; repeated rows draw alike; an empty table gives an empty result; other
columns are not read by the operator and are carried along by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.llm import text as T
from regweave.session import write_once

TOPICS = 8
DIMS = 256
ROUNDS = 15
#: Length of a centroid; its components are whole numbers.
UNIT = 4096
TEMPERATURE = 0.8
CEILING = 1.0
STEPS = 50
TOLERANCE = 1e-6
SEED = 77


def profiles(t: T.Texts) -> np.ndarray:
    """Unit vectors of hashed lower-case word counts, damped by a square root, in steps of 1 / 255."""
    _, _, _, n = t.words()
    owner = np.repeat(np.arange(t.n), n)
    slot = (t.word_hashes() >> np.uint64(56)).astype(np.int64) % DIMS
    counts = np.bincount(owner * DIMS + slot, minlength=t.n * DIMS).reshape(t.n, DIMS)
    return np.rint(255 * np.sqrt(counts / np.maximum(n, 1)[:, None])).astype(np.uint8)


def topic_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid by cosine, ties to the first; both sides are whole numbers, so sums are exact in any order."""
    return (x.astype(float) @ centroids.T).argmax(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), DIMS)


def store_profiles(docs: DataFrame) -> DataFrame:
    """``_source, _lang, _tokens, x`` of every row, stored once: topics are fitted and cells summed without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("_text"), lower=True):
                part = b.slice(lo, hi - lo)
                x = pa.array([r.tobytes() for r in profiles(t)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_source"), part.column("_lang"), pa.array(t.words()[3]), x], ["_source", "_lang", "_tokens", "x"]
                )

    return write_once(_plain(docs).mapInArrow(run, "_source string, _lang string, _tokens long, x binary"), "profiles")


def fit_topics(stored: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (whole numbers, length about ``UNIT``) by spherical k-means over all profiles with words.

    A round is one scan of the stored profiles: tasks add up the profiles of every topic, Spark adds up the tasks, and
    topics x DIMS sums reach the driver. The first centroids are the profiles with the smallest hash of every hash class.
    """
    own = F.xxhash64("x", F.lit(SEED))
    rows = stored.filter("_tokens > 0").select("x", own.alias("h"))
    heads = [r["h"] for r in rows.groupBy(F.pmod("h", F.lit(topics)).alias("k")).agg(F.min("h").alias("h")).orderBy("k").collect()]
    if not heads:
        return np.eye(1, DIMS)
    first = {r["h"]: bytes(r["x"]) for r in rows.filter(F.col("h").isin(heads)).groupBy("h").agg(F.min("x").alias("x")).collect()}
    c = _scaled(np.stack([np.frombuffer(first[h], np.uint8) for h in heads]).astype(float))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(c), DIMS), np.int64)
            for b in batches:
                x = _matrix(b.column("x"))
                at = topic_of(x, c)
                for k in range(len(c)):
                    sums[k] += x[at == k].sum(0, dtype=np.int64)
            k, i = sums.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(sums[k, i])], ["k", "i", "s"])

        total = c.copy()
        found = rows.select("x").mapInArrow(run, "k long, i long, s long").groupBy("k", "i").agg(F.sum("s").alias("s")).collect()
        total[sorted({r["k"] for r in found})] = 0.0  # a topic without documents stays where it is
        for r in found:
            total[r["k"], r["i"]] = r["s"]
        new = _scaled(total)
        if np.array_equal(new, c):
            break
        c = new
    return c


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.rint(UNIT * x / np.sqrt((x * x).sum(1, keepdims=True)))


def _plain(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        *more,
        F.col("text").cast("string").alias("_text"),
        F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"),
    )


def cell_tokens(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``_source, _lang, _topic, tokens`` of all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = pa.array(topic_of(_matrix(b.column("x")), centroids))
            yield pa.RecordBatch.from_arrays([b.column("_source"), b.column("_lang"), topic, b.column("_tokens")], ["_source", "_lang", "_topic", "_tokens"])

    rows = stored.mapInArrow(run, "_source string, _lang string, _topic long, _tokens long")
    return rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))


def describe(docs: DataFrame, centroids: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with ``_source, _lang, _topic, _tokens``."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["_source string", "_lang string", "_topic long", "_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("_text"), lower=True):
                topic = topic_of(profiles(t), centroids)
                part = b.slice(lo, hi - lo)
                arrays = [part.column(c) for c in [*keep, "_source", "_lang"]] + [pa.array(topic), pa.array(t.words()[3])]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "_source", "_lang", "_topic", "_tokens"])

    return _plain(docs, *keep).mapInArrow(run, schema)


def tempered(shares: dict, temperature: float) -> dict:
    raised = {k: v**temperature if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def calibrate(
    cells: DataFrame,
    temperature: float = TEMPERATURE,
    languages: dict | None = None,
    topics: dict | None = None,
    sources: DataFrame | None = None,
    steps: int = STEPS,
) -> tuple[DataFrame, dict, dict]:
    """Raking factors: a table ``_source, a`` and factors by language and by topic.

    ``cells``: _source, _lang, _topic, tokens. ``languages`` and ``topics`` are target shares (languages are a code
    list, so languages x topics fits the driver); ``sources`` is a table ``_source, share``. Left out, a target
    is the tempered observed share.
    """
    spark = cells.sparkSession
    cells = cells.filter("tokens > 0")
    seen = cells.groupBy("_lang", "_topic").agg(F.sum("tokens").alias("n")).collect()
    by_lang: dict = {}
    by_topic: dict = {}
    for r in seen:
        by_lang[r["_lang"]] = by_lang.get(r["_lang"], 0) + r["n"]
        by_topic[r["_topic"]] = by_topic.get(r["_topic"], 0) + r["n"]
    if not seen:
        return spark.createDataFrame([], "_source string, a double"), {}, {}
    total = sum(by_lang.values())
    langs = sorted(by_lang, key=lambda v: (v is None, v or ""))
    tops = sorted(by_topic)
    goal_l = languages or tempered({k: v / total for k, v in by_lang.items()}, temperature)
    goal_t = topics or tempered({k: v / total for k, v in by_topic.items()}, temperature)
    u = np.array([goal_l.get(k, 0.0) for k in langs])
    v = np.array([goal_t.get(k, 0.0) for k in tops])
    place = spark.createDataFrame([(k, i) for i, k in enumerate(langs)], "_l string, li int")
    spot = spark.createDataFrame([(k, i) for i, k in enumerate(tops)], "_t long, ti int")
    rows = (
        cells.join(F.broadcast(place), F.col("_lang").eqNullSafe(F.col("_l")))
        .join(F.broadcast(spot), F.col("_topic") == F.col("_t"))
        .groupBy("_source")
        .agg(
            F.sum("tokens").alias("n"),
            F.collect_list(F.struct("li", "ti", F.col("tokens").cast("double").alias("x"))).alias("cells"),
        )
    )
    if sources is None:
        weight = rows.agg(F.sum(F.pow("n", F.lit(temperature)))).first()[0]
        rows = rows.withColumn("goal", F.pow("n", F.lit(temperature)) / F.lit(weight))
    else:
        share = sources.select(F.col("_source").alias("_given"), "share")
        rows = rows.join(share, F.col("_source").eqNullSafe(F.col("_given")), "left")
        rows = rows.withColumn("goal", F.coalesce("share", F.lit(0.0)))
    rows = write_once(rows.select("_source", "goal", "cells"), "margins")

    def by_source(b: np.ndarray, c: np.ndarray) -> DataFrame:
        fb, fc = F.array(*map(F.lit, b.tolist())), F.array(*map(F.lit, c.tolist()))
        mass = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["x"] * F.get(fb, x["li"]) * F.get(fc, x["ti"]))
        return rows.select("_source", "cells", F.when(mass > 0, F.col("goal") / mass).otherwise(F.lit(0.0)).alias("a"))

    b, c = np.ones(len(langs)), np.ones(len(tops))
    for _ in range(steps):
        m = np.zeros((len(langs), len(tops)))
        part = by_source(b, c).select("a", F.explode("cells").alias("x"))
        for r in part.groupBy("x.li", "x.ti").agg(F.sum(F.col("a") * F.col("x.x")).alias("m")).collect():
            m[r["li"], r["ti"]] = r["m"]
        off = np.abs(b * (m @ c) - u).max() + np.abs(c * (b @ m) - v).max()
        if off < TOLERANCE:
            break
        b = np.divide(u, m @ c, out=np.zeros_like(u), where=m @ c > 0)
        c = np.divide(v, b @ m, out=np.zeros_like(v), where=b @ m > 0)
    factors = by_source(b, c).select("_source", "a")
    return factors, dict(zip(langs, b.tolist())), dict(zip(tops, c.tolist()))


def mix_sources(
    docs: DataFrame, keep: list[str] | None = None, temperature: float = TEMPERATURE, ceiling: float = CEILING, **targets
) -> DataFrame:
    """Columns ``keep`` (doc_id) of every row with topic, n_tokens, weight, probability, design_weight, and sampled (boolean)."""
    keep = ["doc_id"] if keep is None else keep
    spark, stored = docs.sparkSession, store_profiles(docs)
    centroids = fit_topics(stored)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    rows = describe(docs.withColumn("_draw", draw), centroids, [*keep, "_draw"])
    cells = write_once(cell_tokens(stored, centroids), "cells")
    sources, by_lang, by_topic = calibrate(cells, temperature, **targets)
    b = spark.createDataFrame(list(by_lang.items()), "_l string, b double")
    c = spark.createDataFrame(list(by_topic.items()), "_t long, c double")
    sources = sources.select(F.col("_source").alias("_s"), "a")

    def weighed(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(b), F.col("_lang").eqNullSafe(F.col("_l")), "left")
        df = df.join(F.broadcast(c), F.col("_topic") == F.col("_t"), "left")
        df = df.join(sources, F.col("_source").eqNullSafe(F.col("_s")), "left")
        return df.withColumn("weight", F.col("a") * F.col("b") * F.col("c"))

    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    ratio = F.col("weight") * F.lit(total / ceiling)
    out = weighed(rows).withColumn("probability", F.coalesce(F.least(ratio, F.lit(1.0)), F.lit(1.0)))
    full = F.when(F.col("probability") > 0, F.col("weight") * F.lit(total) / F.col("probability")).otherwise(F.lit(0.0))
    out = out.withColumn("design_weight", F.coalesce(full, F.lit(1.0)))
    return out.select(
        *keep,
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        "weight",
        "probability",
        "design_weight",
        (F.col("_draw") < F.col("probability")).alias("sampled"),
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled documents; same columns."""
    inner = {c: f"_in{i}" for i, c in enumerate(docs.columns)}  # own names cannot clash with the operator's
    plain = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in docs.columns], "doc_id", "text", "source", "lang")
    mixed = mix_sources(plain, list(inner.values()))
    return mixed.filter("sampled").select(*[F.col(inner[c]).alias(c) for c in docs.columns])
