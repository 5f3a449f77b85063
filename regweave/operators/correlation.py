"""Ranks and correlations on sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave.constants import DEFAULT_RANK_SEED
from regweave.operators import draws
from regweave.operators.matrix import densify
from regweave.operators.skew import salted_join, spread
from regweave.session import write_once

TIE_SALTS = 64
HELD_ENTRIES = 8_000_000  # regulator entries that a task holds
HELD_CELLS = 1 << 20  # cells of a gene that come as one row
CHUNK = 1 << 16
PAIRS = 1 << 20


def _bucket(value: Column) -> Column:
    """A coarse bucket that respects the order of values: 32 per power of two, mirrored for negatives."""
    size = F.floor(F.log2(F.abs(value)) * 32) + 40_000
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("int")


def _count_below(levels: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_below``: entries of the gene before each level ``(gene, *order, _n)``; ``order[0]`` is the value.

    Two steps: offsets of the buckets of a gene (a bounded number), then positions inside a bucket. A
    gene with any number of distinct values is therefore accumulated by many tasks.
    """
    marked = levels.withColumn("_vb", _bucket(F.col("value")))
    earlier = Window.partitionBy("gene").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("gene", "_vb")
        .agg(F.sum("_n").alias("_bn"))
        .select("gene", "_vb", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy("gene", "_vb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(offsets, ["gene", "_vb"])
        .withColumn("_below", F.col("_off") + F.col("_in"))
        .drop("_vb", "_off", "_in")
    )


def to_rankings(
    values: DataFrame, nr_cells: int, base: int = 1, ties: str = "shuffle", seed: int = DEFAULT_RANK_SEED
) -> DataFrame:
    """Dense ranks ``gene, cell, rank`` of all cells, zeros included (cells numbered from 0).

    ``shuffle`` gives distinct ranks with tied cells in a seeded random order of the gene (the same in SQL), ``average`` the mean rank
    of the tie. Rows are first counted per (gene, value, hash bucket), so neither a gene with very many
    cells nor one huge tie is sorted by a single task.
    """
    if ties not in ("shuffle", "average"):
        raise ValueError("ties must be shuffle or average")
    dense = densify(values, nr_cells).withColumn(
        "_h", draws.draw_key(F.col("cell"), seed, draws.TIES, draws.name_number(F.col("gene")))
    )
    dense = dense.withColumn("_b", F.pmod(F.col("_h"), F.lit(TIE_SALTS)).cast("int"))
    tie = Window.partitionBy("gene", "value")
    counts = (
        _count_below(dense.groupBy("gene", "value", "_b").agg(F.count(F.lit(1)).alias("_n")), ["value", "_b"])
        .withColumn("_mean", F.min("_below").over(tie) + (F.sum("_n").over(tie) - 1) / 2.0)
    )
    out = dense.join(counts, ["gene", "value", "_b"])
    if ties == "average":
        return out.select("gene", "cell", (F.col("_mean") + base).cast("double").alias("rank"))
    local = F.row_number().over(Window.partitionBy("gene", "value", "_b").orderBy("_h", "cell")) - 1
    return out.select("gene", "cell", (F.col("_below") + local + base).cast("double").alias("rank"))


def shifted_ranks(values: DataFrame, nr_cells: int) -> DataFrame:
    """Average ranks minus the rank of the zeros, for stored entries only.

    Correlation does not change under a shift, and after it the zeros are zero again: rank correlation
    on sparse data never needs the dense matrix.
    """
    per_gene = values.groupBy("gene").agg(
        (F.lit(nr_cells) - F.count(F.lit(1))).alias("_zeros"), F.count_if(F.col("value") < 0).alias("_neg")
    )
    levels = (
        _count_below(values.groupBy("gene", "value").agg(F.count(F.lit(1)).alias("_n")), ["value"])
        .join(per_gene, "gene")
        .select(
            "gene",
            "value",
            (
                (F.col("_below") + F.when(F.col("value") > 0, F.col("_zeros")).otherwise(0) + (F.col("_n") + 1) / 2.0)
                - (F.col("_neg") + (F.col("_zeros") + 1) / 2.0)
            ).alias("_r"),
        )
    )
    return values.join(levels, ["gene", "value"]).select("gene", "cell", F.col("_r").alias("value"))


def pair_products(values: DataFrame, regulators: DataFrame, bound: int | None = None) -> DataFrame:
    """``ridx, gene, xy``: dot products over shared cells, summed map-side inside the join."""
    x = values.join(regulators.withColumnRenamed("regulator", "gene"), "gene").select(
        "cell", "ridx", F.col("value").alias("_x")
    )
    return (
        salted_join(spread(values, "gene", "cell"), x, "cell", "gene", bound)
        .groupBy("ridx", "gene")
        .agg(F.sum(F.col("_x") * F.col("value")).alias("xy"))
    )


def _held_regulators(x: DataFrame, regulators: DataFrame, nr_entries: int) -> DataFrame:
    """The regulators' entries in rows of some ten thousand, and their names and sums, for a task that holds them."""
    none = lambda *kinds: [F.lit(None).cast(kind) for kind in kinds]
    chunk = F.pmod(F.xxhash64("ridx", "cell"), F.lit(-(-nr_entries // CHUNK) or 1))
    entries = x.filter("cell IS NOT NULL").groupBy(chunk.alias("_c")).agg(F.collect_list(F.struct("ridx", "cell", "value")).alias("e"))
    entries = entries.select(F.col("e.ridx").alias("ridx"), F.col("e.cell").alias("cell"), F.col("e.value").alias("value"), *none("array<double>", "array<string>"))
    sums = x.groupBy("ridx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(regulators, "ridx")
    sums = sums.groupBy(F.floor(F.col("ridx") / CHUNK).alias("_c")).agg(F.collect_list(F.struct("ridx", "s", "ss", "regulator")).alias("e"))
    sums = sums.select(F.col("e.ridx").alias("ridx"), *none("array<bigint>"), F.col("e.s").alias("value"), F.col("e.ss").alias("squares"), F.col("e.regulator").alias("names"))
    return entries.union(sums).toDF("ridx", "cell", "value", "squares", "names")


class _Held:
    """Regulators by cell, and their sums, in a task."""

    def __init__(self, rows: list[dict[str, pa.Scalar]]):
        array = lambda x, kind: np.zeros(0, kind) if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(kind)
        entries, sums = ([r for r in rows if (r["names"].values is None) == plain] for plain in (True, False))
        ridx, cell, value = (np.concatenate([array(r[c], kind) for r in entries] + [np.zeros(0, kind)]) for c, kind in (("ridx", np.int64), ("cell", np.int64), ("value", float)))
        place, self.s, self.ss = (np.concatenate([array(r[c], kind) for r in sums] + [np.zeros(0, kind)]) for c, kind in (("ridx", np.int64), ("value", float), ("squares", float)))
        names = [n for r in sums for n in r["names"].as_py()]
        order = np.argsort(place)  # regulators in order; one without entries has no sums and no row
        self.names, self.s, self.ss = [names[i] for i in order], self.s[order], self.ss[order]
        self.at = {n: i for i, n in enumerate(self.names)}
        self.tf = pa.array(self.names, pa.string())
        order = np.argsort(cell, kind="stable")
        self.row, self.value = np.searchsorted(np.sort(place), ridx[order]), value[order]
        self.cell, starts = np.unique(cell[order], return_index=True)
        self.ptr = np.append(starts, len(cell))

    def products(self, cell: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scalar products of all regulators with a vector."""
        at = np.searchsorted(self.cell, cell)
        hit = at < len(self.cell)
        hit[hit] = self.cell[at[hit]] == cell[hit]
        at, value = at[hit], value[hit]
        out = np.zeros(len(self.names))
        sizes = self.ptr[at + 1] - self.ptr[at]
        upto, done = np.cumsum(sizes), 0
        while done < len(at):  # so many pairs at once
            stop = max(done + 1, int(np.searchsorted(upto, upto[done] - sizes[done] + PAIRS, side="right")))
            n = sizes[done:stop]
            i = np.arange(n.sum()) + np.repeat(self.ptr[at[done:stop]] - (np.cumsum(n) - n), n)
            out += np.bincount(self.row[i], self.value[i] * np.repeat(value[done:stop], n), len(out))
            done = stop
        return out


def _pearson_in_tasks(values: DataFrame, regulators: DataFrame, x: DataFrame, nr_entries: int, nr_cells: int) -> DataFrame:
    """Tasks hold the regulators and go through the genes: entries are shuffled, never pairs."""
    parts = 2 * values.sparkSession.sparkContext.defaultParallelism
    held = _held_regulators(x, regulators, nr_entries).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    entry = F.when(F.col("cell").isNotNull(), F.struct(F.col("cell").cast("bigint").alias("cell"), F.col("value").cast("double").alias("value")))
    genes = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.collect_list(entry).alias("e"))
    genes = genes.select(
        F.lit(1).alias("side"), F.pmod(F.xxhash64("gene"), F.lit(parts)).cast("int").alias("g"), "gene", "s", "ss", F.col("e.cell").alias("cell"), F.col("e.value").alias("value")
    )
    both = held.withColumn("side", F.lit(0)).unionByName(genes, allowMissingColumns=True)
    both = both.repartitionById(parts, F.col("g")).sortWithinPartitions("side")
    n = float(nr_cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, regs, out, size = [], None, [], 0
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in columns.items()}
                if row["side"].as_py() == 0:
                    rows.append(row)
                    continue
                if regs is None:
                    regs, rows = _Held(rows), []
                gene, s, ss = (row[c].as_py() for c in ("gene", "s", "ss"))
                s, ss = (np.nan if v is None else v for v in (s, ss))
                xy = np.zeros(len(regs.s))
                if gene is not None:
                    xy = regs.products(row["cell"].values.to_numpy(zero_copy_only=False), row["value"].values.to_numpy(zero_copy_only=False))
                cov = xy - s * regs.s / n
                spread = np.sqrt(np.maximum(ss - s * s / n, 0.0)) * np.sqrt(np.maximum(regs.ss - regs.s * regs.s / n, 0.0))
                known = (spread != 0) & ~np.isnan(s)
                corr = np.divide(cov, spread, out=np.zeros(len(cov)), where=known)
                own = regs.at.get(gene, -1)
                if own >= 0:
                    corr[own], known[own] = 1.0, True
                sign = np.sign(np.nan_to_num(cov)).astype(np.int32)
                out.append([regs.tf, pa.repeat(pa.scalar(gene, pa.string()), len(cov)), pa.array(corr, mask=~known), pa.array(sign)])
                size += len(cov)
                if size >= CHUNK:
                    yield _stacked(out)
                    out, size = [], 0
        if out:
            yield _stacked(out)

    return both.mapInArrow(work, "tf string, gene string, corr double, sign int")


def _stacked(parts: list[list[pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], ["tf", "gene", "corr", "sign"])


def pearson(values: DataFrame, regulators: DataFrame, nr_cells: int) -> DataFrame:
    """``tf, gene, corr, sign`` for every regulator and gene, from sums over stored entries.

    ``regulators`` is ``(regulator, ridx)``. Constant genes have no correlation (null). A regulator with
    itself is 1. Regulators of few entries are held by tasks that go through the genes; otherwise products are joined.
    """
    x = values.join(regulators.withColumnRenamed("regulator", "gene"), "gene").select("ridx", F.col("cell").cast("bigint").alias("cell"), F.col("value").cast("double").alias("value"))
    nr_entries = x.count() if nr_cells <= HELD_CELLS else HELD_ENTRIES + 1
    if nr_entries <= HELD_ENTRIES:
        return _pearson_in_tasks(values, regulators, x, nr_entries, nr_cells)
    sums = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    sums = write_once(sums, "gene-sums")
    reg = sums.join(regulators.withColumnRenamed("regulator", "gene"), "gene").select(
        "ridx", F.col("gene").alias("tf"), F.col("s").alias("ts"), F.col("ss").alias("tss")
    )
    last = regulators.count() - 1
    nr_genes = sums.count()
    n = F.lit(float(nr_cells))
    grid = sums.select("gene", "s", "ss", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("ridx"))
    cov = F.coalesce("xy", F.lit(0.0)) - F.col("s") * F.col("ts") / n
    spread = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / n, F.lit(0.0))) * F.sqrt(
        F.greatest(F.col("tss") - F.col("ts") * F.col("ts") / n, F.lit(0.0))
    )
    return (
        grid.join(pair_products(values, regulators, nr_genes * (last + 1)), ["gene", "ridx"], "left")
        .join(reg, "ridx")
        .select(
            "tf",
            "gene",
            F.when(F.col("tf") == F.col("gene"), F.lit(1.0)).otherwise(F.try_divide(cov, spread)).alias("corr"),
            F.signum(cov).cast("int").alias("sign"),
        )
    )


def rows_by_regulator(corr: DataFrame, value: str = "corr", delimiter: str = "\t") -> DataFrame:
    """``tf, line``: the values of every regulator in gene name order; a line is one row of the matrix."""
    pairs = F.array_sort(F.collect_list(F.struct("gene", F.col(value).cast("string").alias("v"))))
    return corr.groupBy("tf").agg(F.array_join(F.transform(pairs, lambda e: e["v"]), delimiter).alias("line"))


def spearman(values: DataFrame, regulators: DataFrame, nr_cells: int) -> DataFrame:
    """Rank correlation ``tf, gene, corr`` with average ranks for ties."""
    ranks = write_once(shifted_ranks(values, nr_cells), "ranks")  # read three times below
    return pearson(ranks, regulators, nr_cells).select("tf", "gene", "corr")


def spearman_shuffled(
    values: DataFrame, regulators: DataFrame, nr_cells: int, seed: int = DEFAULT_RANK_SEED
) -> DataFrame:
    """Rank correlation on distinct ranks (ties in random order); dense, so costly on sparse data."""
    ranks = to_rankings(values, nr_cells, 1, "shuffle", seed).withColumnRenamed("rank", "value")
    ranks = write_once(ranks, "ranks")
    return pearson(ranks, regulators, nr_cells).select("tf", "gene", "corr")
