"""Selection of targets, regulators and cells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.constants import DEFAULT_SEED
from regweave.operators import draws
from regweave.operators.matrix import Expression
from regweave.operators.ordering import id_position, position_by_range


def as_gene_table(df: DataFrame, genes: DataFrame | Iterable[str]) -> DataFrame:
    """A one-column table of distinct names from a table or a Python collection."""
    if isinstance(genes, DataFrame):
        return genes.select(F.col(genes.columns[0]).cast("string").alias("gene")).distinct()
    return df.sparkSession.createDataFrame([(g,) for g in sorted(set(genes))], "gene string")


def keep_genes(df: DataFrame, genes: DataFrame | Iterable[str] | None, column: str = "gene") -> DataFrame:
    """Semi-join on the gene list; no list (or an empty collection) keeps everything."""
    if genes is None or (not isinstance(genes, DataFrame) and not list(genes)):
        return df
    wanted = as_gene_table(df, genes).withColumnRenamed("gene", column)
    return df.join(wanted, column, "left_semi")


def regulator_index(values: DataFrame, candidates: DataFrame | Iterable[str]) -> DataFrame:
    """Candidates present in the data, numbered by name: ``regulator, ridx``."""
    present = as_gene_table(values, candidates).join(values.select("gene").distinct(), "gene", "left_semi")
    return position_by_range(present, "gene", "ridx").select(F.col("gene").alias("regulator"), F.col("ridx").cast("int").alias("ridx"))


def require_regulators(regulators: DataFrame) -> DataFrame:
    """Raise when no candidate regulator occurs in the data."""
    if regulators.isEmpty():
        raise ValueError("none of the candidate regulators occurs in the expression data")
    return regulators


def without_self(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("regulator") != F.col("target"))


def fold_case(genes: DataFrame) -> DataFrame:
    """Upper-cased names (data sets that spell genes in capitals)."""
    return genes.select(F.upper("gene").alias("gene")).distinct()


def first_genes(values: DataFrame, n: int | None) -> DataFrame:
    """The first n gene names in name order; ``None`` means all."""
    genes = values.select("gene").distinct()
    return genes if n is None else genes.orderBy("gene").limit(n)


def index_cells(cells: DataFrame) -> DataFrame:
    """``cell, new_cell``: cells numbered densely from 0 in the order of their id."""
    return id_position(cells.select("cell").distinct(), "cell", "new_cell")


def slice_cells(values: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the selected cells and re-index them; ``selection`` is ``(cell, new_cell)``."""
    return values.join(selection.select("cell", "new_cell"), "cell").select(
        "gene", F.col("new_cell").alias("cell"), "value"
    )


def slice_expression(expr: Expression, selection: DataFrame) -> Expression:
    return Expression(slice_cells(expr.values, selection), selection.select(F.col("new_cell").alias("cell")), names=expr.names)


def random_cells(cells: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """A seeded random subset of n cells (all when there are fewer)."""
    return draws.shuffled(cells.select("cell"), "cell", seed, draws.SAMPLES).filter(F.col("position") < n).select("cell")


def cell_difference(cells: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct cells that are not among the others."""
    return cells.select("cell").join(other.select("cell"), "cell", "left_anti").distinct()


def sub_sample(expr: Expression, n: int, seed: int = DEFAULT_SEED) -> Expression:
    """Matrix restricted to n random cells, re-indexed from 0; unchanged when n covers all."""
    if n >= expr.nr_cells():
        return expr
    return slice_expression(expr, index_cells(random_cells(expr.cells, n, seed)))


def disjoint_subsets(cells: DataFrame, excluded: DataFrame | None, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Random disjoint chunks of n cells among those not excluded: ``cell, subset``."""
    rest = cells.select("cell").distinct() if excluded is None else cell_difference(cells, excluded)
    return draws.shuffled(rest, "cell", seed, draws.SAMPLES).select("cell", F.floor(F.col("position") / n).cast("int").alias("subset"))


def nr_phases(nr_cells: int, cells_per_phase: int) -> int:
    windows = -(-nr_cells // cells_per_phase)
    if windows < 2:
        raise ValueError("phase-wise runs need at least two windows of cells")
    return windows - 1


def assign_phases(indexed: DataFrame, nr_cells: int, cells_per_phase: int, skip: int = 0) -> DataFrame:
    """Add ``phase`` to densely indexed cells (``new_cell``).

    Consecutive windows of ``cells_per_phase`` cells; the last two form one phase; phases count from
    the end of the cell range; the first ``skip`` phases are left out.
    """
    last = nr_phases(nr_cells, cells_per_phase) - 1
    window = F.floor(F.col("new_cell") / cells_per_phase)
    return (
        indexed.withColumn("phase", (F.lit(last) - F.least(window, F.lit(last))).cast("int"))
        .filter(F.col("phase") >= skip)
    )


def assign_folds(cells: DataFrame, nr_cells: int, nr_folds: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Random balanced folds: ``cell, fold``."""
    if nr_folds <= 1:
        raise ValueError("cross-validation needs more than one fold")
    if nr_cells <= 0:
        raise ValueError("cross-validation needs at least one cell")
    k = min(nr_folds, nr_cells)
    return draws.shuffled(cells.select("cell"), "cell", seed, draws.FOLDS).select("cell", (F.col("position") % k).cast("int").alias("fold"))


def split_folds(folds: DataFrame, test_fold: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) cells of one cross-validation set."""
    return folds.filter(F.col("fold") != test_fold), folds.filter(F.col("fold") == test_fold)


def random_genes(genes: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """A seeded random subset of n genes."""
    return draws.shuffled(genes.select("gene"), "gene", seed, draws.GENES).filter(F.col("position") < n).select("gene")
