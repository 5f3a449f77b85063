"""Compressed sparse column arrays, stored as tables, and Parquet expression tables.

``indptr (pos, start)`` has one row per cell plus the end; ``indices (pos, gene_idx)`` and
``data (pos, value)`` one row per stored entry; ``gene_names (gene_idx, gene)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regweave.operators.matrix import unpack

BLOCK_BITS = 16


def cell_ranges(indptr: DataFrame) -> DataFrame:
    """``cell, start, stop``: each cell's half-open range of entry positions.

    The start of the next cell comes from an equi-join on ``pos + 1``, not from a global window.
    """
    nxt = indptr.select((F.col("pos") - 1).alias("pos"), F.col("start").alias("stop"))
    return indptr.join(nxt, "pos").select(F.col("pos").alias("cell"), "start", "stop")


def csc_entries(
    indptr: DataFrame,
    indices: DataFrame,
    data: DataFrame,
    cell_top: int | None = None,
    gene_index: DataFrame | None = None,
) -> DataFrame:
    """Entries ``cell, gene_idx, value``.

    The range join position -> cell is an equi-join on blocks of positions plus a range test. A cell
    with very many entries spans many blocks and is therefore spread over tasks. ``cell_top`` keeps the
    first cells and is pushed into the ranges; ``gene_index`` is ``(gene_idx, new_idx)`` and re-indexes
    to that selection.
    """
    ranges = cell_ranges(indptr).filter(F.col("stop") > F.col("start"))
    if cell_top is not None:
        ranges = ranges.filter(F.col("cell") < cell_top)
    blocks = ranges.withColumn(
        "block",
        F.explode(F.sequence(F.shiftright("start", BLOCK_BITS), F.shiftright(F.col("stop") - 1, BLOCK_BITS))),
    )
    entries = indices
    if gene_index is not None:
        entries = entries.join(gene_index, "gene_idx").select("pos", F.col("new_idx").alias("gene_idx"))
    entries = entries.join(data, "pos").withColumn("block", F.shiftright("pos", BLOCK_BITS))
    return (
        entries.join(blocks, "block")
        .filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")))
        .select("cell", "gene_idx", "value")
    )


def name_genes(entries: DataFrame, gene_names: DataFrame) -> DataFrame:
    """Columns to genes: long expression table ``gene, cell, value``."""
    return entries.join(gene_names, "gene_idx").select("gene", "cell", F.col("value").cast("double").alias("value"))


def to_csc(values: DataFrame, gene_names: DataFrame, indexed_cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indptr, indices, data) of a long table; positions follow (cell, gene_idx).

    Offsets are accumulated over per-block counts of cells, never over entries.
    """
    located = (
        values.join(gene_names, "gene")
        .join(indexed_cells, "cell")
        .select(F.col("new_cell").alias("c"), "gene_idx", "value")
    )
    counts = indexed_cells.select(F.col("new_cell").alias("c")).join(
        located.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c", "left"
    ).select("c", F.coalesce("n", F.lit(0)).alias("n"), F.shiftright("c", BLOCK_BITS).alias("b"))
    over_blocks = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("b").agg(F.sum("n").alias("bn")).select(
        "b", F.coalesce(F.sum("bn").over(over_blocks), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(base, "b")
        .select("c", (F.col("base") + F.col("before")).alias("start"), "n")
    )
    end = starts.agg((F.max("c") + 1).alias("pos"), F.sum("n").alias("start"))
    indptr = starts.select(F.col("c").alias("pos"), "start").unionByName(end)
    order = Window.partitionBy("c").orderBy("gene_idx")
    placed = located.join(starts, "c").select(
        (F.col("start") + F.row_number().over(order) - 1).alias("pos"), "gene_idx", "value"
    )
    return indptr, placed.select("pos", "gene_idx"), placed.select("pos", "value")


def csc_dimensions(indptr: DataFrame, gene_names: DataFrame) -> tuple[int, int]:
    """(cells, genes)."""
    return indptr.count() - 1, gene_names.count()


def read_expression_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Long entries from a Parquet table in long or packed form, by its schema."""
    df = spark.read.parquet(path)
    return unpack(df) if {"indices", "values"} <= set(df.columns) else df.select("gene", "cell", "value")
