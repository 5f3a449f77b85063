"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Signature: a text's distinct word shingles are hashed (the first permutation) onto positions of a table that holds
the second permutation; coordinate k of the signature is the minimum over the table shifted circularly by k. All
coordinates of a shingle are therefore one contiguous window of the table.

Every link that counts is confirmed on full shingle sets. Candidates share one of BANDS bands of ROWS coordinates:
a pair at similarity 0.85 shares none with probability about (1 - 0.85**8)**48 = 2e-7. The pipeline's stage goes down
to STAGE_PERCENT and cuts the same coordinates into bands of STAGE_ROWS: (1 - 0.8**6)**64 = 3e-9. Groups are never
expanded into all pairs:

1. Texts with the same shingle set form one class; only its smallest doc_id goes on.
2. In each bucket every member is compared with two pivots, its smallest and its largest id; first only with the
   pivot that shares most bands, then with the others, unless both already hang on the same text.
3. Buckets that still hold several components are searched in blocks: members outside the bucket's main component
   against all members, by signature agreement; only pairs whose estimate is within about five standard
   deviations of the threshold are emitted, and verified as above.

Defined cases: null and empty texts have an empty set, are linked with nothing and keep their own id; a text of fewer
words than a shingle is one shingle; rows with a null doc_id are linked with nothing, have a null component
and are kept; texts that share a doc_id are linked with each other and each row keeps its own set size; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regweave.llm import text as T
from regweave.llm.components import components
from regweave.session import materialize, write_once

WIDTH = 5
PERCENT = 85
ROWS, BANDS = 8, 48
COORDS = ROWS * BANDS
BITS = 22
SLACK = 0.09
#: The pipeline's stage: lower threshold, shorter bands, five standard deviations of the estimate at that threshold.
STAGE_PERCENT = 80
STAGE_ROWS = 6
STAGE_SLACK = 0.105
BLOCK = 2048
_CHUNK = 4096
_table: np.ndarray | None = None


def _windows() -> np.ndarray:
    """Row p holds the second permutation at p, p+1, ..., p+COORDS-1, circularly."""
    global _table
    if _table is None:
        pi = np.random.Generator(np.random.PCG64(11)).permutation(1 << BITS).astype(np.uint32)
        _table = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDS - 1]]), COORDS)
    return _table


def signatures(position: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Minimum of the table windows at the positions of each set; ``count`` gives the (positive) set sizes."""
    view, out = _windows(), np.empty((len(count), COORDS), np.uint32)
    end = np.cumsum(count)
    row = 0
    while row < len(count):
        lo = end[row] - count[row]
        stop = max(row + 1, int(np.searchsorted(end, lo + _CHUNK, side="right")))
        if stop == row + 1:
            best = view[position[lo : min(lo + _CHUNK, end[row])]].min(0)
            for k in range(lo + _CHUNK, end[row], _CHUNK):
                best = np.minimum(best, view[position[k : min(k + _CHUNK, end[row])]].min(0))
            out[row] = best
        else:
            starts = end[row:stop] - count[row:stop] - lo
            out[row:stop] = np.minimum.reduceat(view[position[lo : end[stop - 1]]], starts, axis=0)
        row = stop
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates of each signature; the band's number is part of the key."""
    bands = COORDS // rows
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = (parts * T._WINDOW[:rows]).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * T._WINDOW[41]
    return T.mix(h).view(np.int64)


def _list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.ravel(), kind))


def sketch(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, bands, low`` per row; (h1, h2, n_shingles) identifies the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), lower=True):
                doc, g = T.shingles(t, WIDTH)
                n = np.bincount(doc, minlength=t.n)
                full = np.flatnonzero(n)
                h = np.zeros((2, t.n), np.uint64)
                sig = np.zeros((t.n, COORDS), np.uint32)
                if len(full):
                    starts = (np.cumsum(n) - n)[full]
                    for k in (0, 1):
                        h[k, full] = np.add.reduceat(T.mix(g ^ T._WINDOW[50 + k]), starts)
                    sig[full] = signatures((g >> np.uint64(64 - BITS)).astype(np.int64), n[full])
                low = pa.array([r.tobytes() for r in (sig & 0xFF).astype(np.uint8)], pa.binary())
                arrays = [b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64))]
                arrays += [_list_column(band_keys(sig, rows), pa.int64()), low]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "h1", "h2", "bands", "low"])

    schema = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, low binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node, words``: sorted distinct shingle hashes of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in T.slices(b.column("text"), lower=True):
                doc, g = T.shingles(t, WIDTH)
                off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.n))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(off), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), sets], ["node", "words"])

    return docs.mapInArrow(run, "node long, words array<long>").filter(F.size("words") > 0)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those with 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    na, nb = F.size("wa"), F.size("wb")
    fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * both >= percent * (na + nb - both))
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(fits).select("a", "b").distinct()


def _with_component(df: DataFrame, comp: DataFrame, node: str, out: str) -> DataFrame:
    label = comp.select(F.col("node").alias(node), F.col("component").alias(out))
    return df.join(label, node, "left").withColumn(out, F.coalesce(out, node))


def _blocked_candidates(rows: DataFrame, percent: int, slack: float = SLACK) -> DataFrame:
    """Pairs of one bucket in different components that a signature estimate cannot rule out, block by block.

    ``rows``: key, band, node, component, main, n_shingles, low, bands. Each block pair is one group of at most about
    2 * BLOCK rows, so a hot bucket is spread over many tasks. A pair is emitted once, by the first band it shares;
    that is read from the whole band keys, as low bytes may agree in a band whose bucket does not hold the pair.
    """
    outside = F.col("component") != F.col("main")
    size = rows.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cy"),
        F.ceil(F.sum(outside.cast("int")) / BLOCK).cast("int").alias("cx"),
    )
    rows = rows.join(size, "key")
    spot = F.xxhash64("node")
    x = rows.filter(outside).withColumn("bx", F.pmod(spot, F.col("cx"))).withColumn("by", F.explode(F.sequence(F.lit(0), F.col("cy") - 1)))
    y = rows.withColumn("by", F.pmod(spot, F.col("cy"))).withColumn("bx", F.explode(F.sequence(F.lit(0), F.col("cx") - 1)))
    cols = ["key", F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), "band", "node", "component", "main", "n_shingles", "low", "bands"]
    both = x.select(*cols, F.lit(True).alias("outer")).union(y.select(*cols, F.lit(False).alias("outer")))
    least = percent / 100 - slack

    def compare(table: pa.Table) -> pa.Table:
        outer = np.asarray(table.column("outer").to_numpy(zero_copy_only=False), bool)
        node, comp, main, n = (table.column(c).to_numpy() for c in ("node", "component", "main", "n_shingles"))
        band = table.column("band")[0].as_py()
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(node), COORDS)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        xs, ys = np.flatnonzero(outer), np.flatnonzero(~outer)
        a, b = [], []
        for i in xs:
            small, large = np.minimum(n[i], n[ys]), np.maximum(n[i], n[ys])
            once = (comp[ys] == main[ys]) | (node[ys] > node[i])  # of two outer members the smaller one asks
            ok = ys[(comp[ys] != comp[i]) & once & (100 * small >= percent * large)]
            ok = ok[(low[ok] == low[i]).mean(1) >= least]
            ok = ok[(keys[ok] == keys[i]).argmax(1) == band]
            a.append(np.minimum(node[ok], node[i]))
            b.append(np.maximum(node[ok], node[i]))
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("key", "bx", "by").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, slack: float = SLACK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; ``rows`` (of a band) and ``slack`` go with ``percent``."""
    sketches = write_once(sketch(docs, rows), "sketches")
    classes = (
        sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    )
    classes = write_once(classes, "classes")
    copies = classes.filter("copies > 1").select("h1", "h2", "n_shingles", "node")
    named = sketches.select("doc_id", "n_shingles", "h1", "h2").join(copies, ["h1", "h2", "n_shingles"], "left")
    named = named.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("node")), "doc_id").alias("node"))
    named = write_once(named, "named")
    one_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z")
    same_id = named.join(one_id, "doc_id").select("a", F.col("node").alias("b"))
    entries = classes.select("node", F.posexplode("bands").alias("band", "key"))
    pivots = (
        entries.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("p"), F.max("node").alias("q"))
        .filter(F.col("p") != F.col("q"))
    )
    buckets = write_once(entries.join(pivots, "key"), "buckets")
    near = buckets.select("node", F.explode(F.array("p", "q")).alias("pivot")).filter(F.col("node") != F.col("pivot"))
    shared = near.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    best = Window.partitionBy("node").orderBy(F.desc("bands"), "pivot")
    pairs = write_once(
        shared.withColumn("turn", F.row_number().over(best)).select(
            "node", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "turn"
        ),
        "pairs",
    )
    involved = buckets.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = write_once(shingle_sets(texts.join(involved, "node").select("node", "text")), "sets")

    first = write_once(confirmed(pairs.filter("turn = 1"), sets, percent), "links")
    # what hangs on the same node after the first step needs no second comparison
    hung = pairs.filter("turn = 1").select("a", "b", "node").join(first, ["a", "b"]).select("node", (F.col("a") + F.col("b") - F.col("node")).alias("to"))
    more = pairs.filter("turn > 1")
    for end in ("a", "b"):
        to = hung.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        more = more.join(to, end, "left").withColumn(f"to_{end}", F.coalesce(f"to_{end}", end))
    more = more.filter("to_a != to_b").select("a", "b").distinct()
    comp = materialize(components(first.union(same_id).union(confirmed(more, sets, percent))))

    labelled = _with_component(buckets.select("key", "band", "node"), comp, "node", "component")
    tally = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        tally.groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("key", F.col("top.component").alias("main"))
    )
    open_rows = labelled.join(mixed, "key").join(classes.select("node", "n_shingles", "low", "bands"), "node")
    rest = write_once(_blocked_candidates(open_rows, percent, slack), "rest")
    late = _with_component(_with_component(confirmed(rest, sets, percent), comp, "a", "ca"), comp, "b", "cb")
    moved = components(late.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = moved.select(F.col("node").alias("component_id"), F.col("component").alias("to"))

    out = named.join(comp, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    out = out.join(moved, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("to", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; same columns."""
    gone = near_duplicates(docs, STAGE_PERCENT, STAGE_ROWS, STAGE_SLACK).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
