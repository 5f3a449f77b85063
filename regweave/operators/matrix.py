"""The expression table: long form, packed form, dense form.

Long form: ``gene STRING, cell INT/BIGINT, value DOUBLE``, one row per stored (non-zero) entry. Zeros
are implicit, so the set of all cells travels next to it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave.session import write_once

PACK_CELLS = 1 << 20
DENSE_CHUNK = 1 << 16


@dataclass(frozen=True)
class Expression:
    """Stored entries plus the dimension of all cells (cells without entries count too).

    ``names`` lists the genes, those without entries among them; without it the genes with entries count.
    """

    values: DataFrame
    cells: DataFrame
    stored: bool = False  # values is a plain scan of a columnar table, cheap to read again
    names: DataFrame | None = None

    def genes(self) -> DataFrame:
        """Distinct gene names, kept as a table."""
        return (self.values if self.names is None else self.names).select("gene").distinct()

    def store(self) -> Expression:
        """The same matrix as a scan of scratch tables; use it before reading values several times."""
        if self.stored:
            return self
        return Expression(
            write_once(self.values.select("gene", "cell", "value"), "expression"),
            write_once(self.cells.select("cell"), "cells"),
            stored=True,
            names=None if self.names is None else write_once(self.names.select("gene").distinct(), "gene-names"),
        )

    def summed(self) -> Expression:
        """The same matrix with repeated (gene, cell) entries added up."""
        return dataclasses.replace(self, values=sum_duplicates(self.values), stored=False)

    def nr_cells(self) -> int:
        return self.cells.count()


def is_missing(value: Column, missing: Iterable[float] = (float("nan"), 0.0)) -> Column:
    """True for null and for the listed placeholders (NaN needs its own test)."""
    cond = value.isNull()
    for m in missing:
        cond = cond | (F.isnan(value) if m != m else (value == F.lit(float(m))))
    return cond


def drop_missing(df: DataFrame, missing: Iterable[float] = (float("nan"), 0.0)) -> DataFrame:
    return df.filter(~is_missing(F.col("value"), missing))


def sum_duplicates(df: DataFrame) -> DataFrame:
    """One entry per (gene, cell): repeated gene names add up, entries that cancel vanish."""
    return drop_missing(df.groupBy("gene", "cell").agg(F.sum("value").alias("value")))


def pack(df: DataFrame, nr_cells: int, cells_per_row: int = PACK_CELLS) -> DataFrame:
    """Sparse vector rows ``gene, chunk, size, indices, values`` (cells numbered from 0).

    A vector is split into chunks of at most ``cells_per_row`` cells, so a row never outgrows a task
    however many cells there are; matrices up to that width give exactly one row per gene.
    """
    chunk = F.floor(F.col("cell") / cells_per_row).cast("int")
    return (
        df.withColumn("chunk", chunk)
        .groupBy("gene", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("cell").cast("int").alias("i"), F.col("value").alias("v")))).alias("e"))
        .select(
            "gene",
            "chunk",
            F.lit(nr_cells).alias("size"),
            F.col("e.i").alias("indices"),
            F.col("e.v").alias("values"),
        )
    )


def unpack(packed: DataFrame) -> DataFrame:
    """Packed rows back to long form; purely map-side."""
    return packed.select("gene", F.explode(F.arrays_zip("indices", "values")).alias("e")).select(
        "gene", F.col("e.indices").alias("cell"), F.col("e.values").alias("value")
    )


def densify(
    df: DataFrame,
    nr_cells: int,
    row: str = "gene",
    col: str = "cell",
    value: str = "value",
    rows: DataFrame | None = None,
    chunk: int = DENSE_CHUNK,
) -> DataFrame:
    """Fill the implicit zeros: one output row per (row, col) for ``col`` in ``0..nr_cells-1``.

    Only the sparse entries are shuffled and sorted. Every entry then emits itself and the run of
    zeros up to the next entry, map-side. One zero marker per (row, chunk of columns) starts each run,
    so an unbounded row is cut into chunks that are filled in parallel.
    """
    names = (df if rows is None else rows).select(row).distinct()
    nr_chunks = max(1, -(-nr_cells // chunk))
    starts = names.select(
        row,
        F.explode(F.sequence(F.lit(0), F.lit(nr_chunks - 1))).alias("_chunk"),
    ).select(row, "_chunk", (F.col("_chunk") * chunk).cast("long").alias("_i"), F.lit(0.0).alias("_v"), F.lit(0).alias("_real"))
    entries = df.select(
        row,
        F.floor(F.col(col) / chunk).cast("int").alias("_chunk"),
        F.col(col).cast("long").alias("_i"),
        F.col(value).cast("double").alias("_v"),
        F.lit(1).alias("_real"),
    )
    w = Window.partitionBy(row, "_chunk").orderBy("_i", "_real")
    end = F.least((F.col("_chunk").cast("long") + 1) * chunk, F.lit(nr_cells).cast("long"))
    runs = (
        entries.unionByName(starts)
        .withColumn("_next", F.coalesce(F.lead("_i").over(w), end))
        .filter(F.col("_next") > F.col("_i"))
    )
    return runs.select(
        row, "_i", "_v", F.explode(F.sequence(F.col("_i"), F.col("_next") - 1)).alias(col)
    ).select(row, col, F.when(F.col(col) == F.col("_i"), F.col("_v")).otherwise(F.lit(0.0)).alias(value))


def cell_major(df: DataFrame, gene_index: DataFrame, value_type: str = "double") -> DataFrame:
    """Rows of the matrix by cell: ``cell, entries ARRAY<STRUCT<idx, value>>`` sorted by index.

    ``gene_index`` is ``(gene, idx)``; passing only some genes re-indexes to that selection. A group
    holds at most one entry per listed gene.
    """
    return (
        df.join(gene_index, "gene")
        .groupBy("cell")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("value").cast(value_type).alias("value")))
            ).alias("entries")
        )
    )


def labelled_rows(rows: DataFrame, response: DataFrame) -> DataFrame:
    """Attach the dense response ``(cell, label)``; cells without entries keep an empty row."""
    return response.join(rows, "cell", "left").select(
        "cell",
        "label",
        F.coalesce("entries", F.array().cast(rows.schema["entries"].dataType)).alias("entries"),
    )


def drop_column(df: DataFrame, gene: str) -> DataFrame:
    """Matrix without one gene."""
    return df.filter(F.col("gene") != F.lit(gene))


def dimensions(expr: Expression) -> DataFrame:
    """One row: number of genes and number of cells, those without entries included."""
    g = expr.genes().agg(F.count(F.lit(1)).alias("genes"))
    c = expr.cells.agg(F.count(F.lit(1)).alias("cells"))
    return g.withColumn("_k", F.lit(0)).join(c.withColumn("_k", F.lit(0)), "_k").drop("_k")
