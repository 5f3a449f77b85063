"""Estimate the number of boosting rounds by cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave import constants as C
from regweave.operators.edges import elbow_points
from regweave.operators.matrix import Expression
from regweave.operators.select import assign_folds, random_genes
from regweave.params import BoostParams
from regweave.plans.infer import Problem, booster, prepare
from regweave.session import materialize, write_once


def held_out(folds: DataFrame, test_fold: int = 0) -> DataFrame:
    """``cell, phase, fit`` of one cross-validation set: the cells of ``test_fold`` only get their loss tracked."""
    return folds.select("cell", F.lit(0).alias("phase"), (F.col("fold") != test_fold).alias("fit"))


def rounds_from_losses(losses: DataFrame) -> DataFrame:
    """``target, loss, rounds``: the elbow of every test-loss curve that has one."""
    points = elbow_points(losses, ["target"], [F.col("round")], "test_loss", x_scale=C.ELBOW_X_SCALE)
    return points.select("target", F.col("test_loss").alias("loss"), F.col("elbow").cast("int").alias("rounds"))


def loss_curves(
    problem: Problem, folds: DataFrame, params: BoostParams, rounds: int, nr_partitions: int | None = None, cells_per_block: int | None = None
) -> DataFrame:
    """``target, round, train_loss, test_loss`` for a fixed number of rounds."""
    fit = booster(problem, params, held_out(folds), nr_partitions, cells_per_block)
    _, losses = fit.boost(rounds, track_loss=True)
    return fit.losses(losses)


def estimate_rounds(
    problem: Problem,
    params: BoostParams,
    nr_folds: int = C.DEFAULT_NR_FOLDS,
    max_rounds: int = C.MAX_ROUNDS,
    batch: int = C.ROUNDS_PER_BATCH,
    nr_partitions: int | None = None,
    cells_per_block: int | None = None,
) -> DataFrame:
    """``target, loss, rounds`` for the targets whose test loss flattens within ``max_rounds``.

    Rounds go on from the stored residuals in steps of ``batch``; no round is fitted twice. After every step the whole
    test-loss history is searched for its elbow, and the first one found counts. Target blocks that are done leave.
    """
    cells = problem.expr.cells
    folds = write_once(assign_folds(cells, cells.count(), nr_folds, params.seed), "folds")
    fit = booster(problem, params, held_out(folds), nr_partitions, cells_per_block)
    history, done, fitted = [], [], 0
    left = None
    while fitted < max_rounds:
        step = min(batch, max_rounds - fitted)
        _, losses = fit.boost(step, track_loss=True)
        history.append(fit.losses(losses))
        fitted += step
        curves = _union(history)
        if left is not None:
            curves = curves.join(left, "target", "left_semi")
        found = materialize(rounds_from_losses(curves))
        done.append(found)
        left = write_once(curves.select("target").distinct().join(found.select("target"), "target", "left_anti"), "targets-left")
        if left.isEmpty():
            break
        fit.keep_targets(left)
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aggregate_rounds(estimates: DataFrame, agg: Callable[[Column], Column] = F.max) -> int | None:
    """One number of rounds for the run; ``None`` without any estimate."""
    value = estimates.agg(agg(F.col("rounds")).alias("rounds")).first()["rounds"]
    return None if value is None else int(value)


def estimate_run(
    expr: Expression,
    candidates: DataFrame | Iterable[str],
    params: BoostParams,
    nr_folds: int = C.DEFAULT_NR_FOLDS,
    nr_genes: int = C.DEFAULT_ESTIMATION_SET,
    genes: Iterable[str] = (),
    agg: Callable[[Column], Column] = F.max,
    max_rounds: int = C.MAX_ROUNDS,
    max_bin: int | None = None,
    nr_partitions: int | None = None,
) -> tuple[int | None, DataFrame]:
    """(rounds or None, estimates) on a random or a given set of genes."""
    genes = list(genes)
    chosen = genes if genes else write_once(random_genes(expr.genes(), nr_genes, params.seed), "estimation-genes")
    problem = prepare(expr, candidates, chosen, max_bin)
    estimates = materialize(
        estimate_rounds(problem, params, nr_folds, max_rounds, nr_partitions=nr_partitions)
    )
    return aggregate_rounds(estimates, agg), estimates
