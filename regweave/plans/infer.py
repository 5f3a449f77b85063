"""Inference: from an expression matrix and candidate regulators to a weighted edge list."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.edges import postprocess
from regweave.operators.features import Binned, bin_regulators
from regweave.operators.importance import importance
from regweave.operators.matrix import Expression
from regweave.operators.select import as_gene_table, assign_phases, index_cells, nr_phases, regulator_index, require_regulators
from regweave.params import BoostParams, RegressionParams
from regweave.plans import first_round, stumps
from regweave.plans.histogram import HistogramBooster
from regweave.session import write_once


def one_phase(cells: DataFrame) -> DataFrame:
    """``cell, phase, fit``: all cells fitted together."""
    return cells.select("cell", F.lit(0).alias("phase"), F.lit(True).alias("fit"))


@dataclass(frozen=True)
class Problem:
    """Inputs of a fit, with regulators numbered and binned."""

    expr: Expression
    binned: Binned
    targets: DataFrame | None


def prepare(
    expr: Expression,
    candidates: DataFrame | Iterable[str],
    targets: DataFrame | Iterable[str] | None = None,
    max_bin: int | None = None,
) -> Problem:
    expr = expr.summed().store()
    regulators = write_once(regulator_index(expr.values, candidates), "regulators")
    require_regulators(regulators)
    wanted = None
    if targets is not None and (isinstance(targets, DataFrame) or list(targets)):
        wanted = as_gene_table(expr.values, targets)
    return Problem(expr, bin_regulators(expr.values, regulators, max_bin), wanted)


def booster(
    problem: Problem,
    params: BoostParams,
    cells: DataFrame | None = None,
    nr_partitions: int | None = None,
    cells_per_block: int | None = None,
) -> HistogramBooster:
    """The engine on a problem; ``cells`` (cell, phase, fit) says which cells are fitted together or held out."""
    chosen = one_phase(problem.expr.cells) if cells is None else cells
    engine = stumps.StumpBooster if stumps.fits(problem.expr.values, problem.expr.cells, problem.binned, params) else HistogramBooster
    return engine(problem.expr.values, chosen, problem.binned, params, problem.targets, nr_partitions, cells_per_block)


def infer_splits(
    problem: Problem, params: BoostParams, rounds: int, nr_partitions: int | None = None, cells_per_block: int | None = None
) -> DataFrame:
    """The split log of all targets: ``target, round, node, regulator, threshold, missing_left, gain, cover``."""
    fit = booster(problem, params, None, nr_partitions, cells_per_block)
    log, _ = fit.boost(rounds)
    return fit.split_log(log).drop("phase")


def edges_after(log: DataFrame, rounds: int | None = None) -> DataFrame:
    """Raw edges from the first ``rounds`` rounds of a split log: a sweep over rounds is a filter."""
    part = log if rounds is None else log.filter(F.col("round") < rounds)
    return importance(part).select("regulator", "target", "gain")


def first_round_gains(problem: Problem, params: BoostParams | None = None) -> DataFrame:
    """``regulator, target, gain``: every regulator's best first-round gain for every target."""
    return first_round.first_round_gains(problem.expr.values, problem.expr.cells, problem.binned, params or BoostParams(), problem.targets)


def infer_regulations(
    expr: Expression,
    candidates: DataFrame | Iterable[str],
    params: RegressionParams,
    targets: DataFrame | Iterable[str] | None = None,
    regularized: bool = False,
    normalized: bool = False,
    truncated: int | None = None,
    nr_partitions: int | None = None,
    max_bin: int | None = None,
) -> DataFrame:
    """Target filter, boosting, labels, inclusion filter, normalization, truncation, sort."""
    if params.nr_rounds is None:
        raise ValueError("the number of boosting rounds is not set; estimate it first")
    problem = prepare(expr, candidates, targets, max_bin)
    log = infer_splits(problem, params.boost, params.nr_rounds, nr_partitions)
    return postprocess(edges_after(log), params.regularize, regularized, normalized, truncated)


def infer_phases(
    expr: Expression,
    candidates: DataFrame | Iterable[str],
    params: RegressionParams,
    cells_per_phase: int,
    skip: int = 0,
    max_bin: int | None = None,
    nr_partitions: int | None = None,
    cells_per_block: int | None = None,
) -> DataFrame:
    """Phase-wise inference as one job: ``phase, regulator, target, gain, include``.

    The phase of a cell block is part of every key, so trees of any depth and any sampling are fitted for all phases
    side by side; a phase draws its rows from its own cells.
    """
    total = expr.nr_cells()
    nr_phases(total, cells_per_phase)  # raises where there are too few windows
    phases = assign_phases(index_cells(expr.cells), total, cells_per_phase, skip)
    cells = write_once(phases.select("cell", "phase", F.lit(True).alias("fit")), "phase-cells")
    fit = booster(prepare(expr, candidates, None, max_bin), params.boost, cells, nr_partitions, cells_per_block)
    log, _ = fit.boost(params.nr_rounds)
    edges = fit.split_log(log).groupBy("phase", "regulator", "target").agg(F.sum("gain").alias("gain"))
    return postprocess(edges, params.regularize, group=("phase", "target"), sort=False)
