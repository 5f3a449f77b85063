"""The engine for sparse targets against brute force and against the engine of whole residual arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import as_expression, boost, fixture
from regweave.operators import draws
from regweave.operators.matrix import Expression
from regweave.operators.select import assign_folds
from regweave.params import BoostParams, RegressionParams
from regweave.plans import infer as INF
from regweave.plans import stumps
from regweave.plans.estimate import loss_curves
from regweave.plans.histogram import HistogramBooster
from regweave.session import scratch_path, write_once
from test_boosting import assert_same, drawn, splits


@pytest.fixture(autouse=True)
def any_density(monkeypatch):
    monkeypatch.setattr(stumps, "DENSITY", 2.0)
    monkeypatch.setattr(stumps, "PAIRS", 100)
    monkeypatch.setattr(stumps, "CHUNK", 16)


def sparse(seed=2, cells=90, regulators=12, targets=70):
    """Mostly zeros: regulators without a shared cell, regulators that tie, values seen once."""
    rng = np.random.default_rng(seed)
    X = rng.integers(1, 5, (regulators, cells)) * (rng.random((regulators, cells)) < 0.12)
    X[3] = X[1]
    Y = rng.integers(1, 4, (targets, cells)) * (rng.random((targets, cells)) < 0.08)
    Y[0] = 0
    Y[:9] += 2 * (X[0] > 1) * (rng.random((9, cells)) < 0.8)
    names = [f"r{i:02d}" for i in range(regulators)]
    return np.vstack([X, Y]).astype(float), X.astype(float), names, names + [f"t{i:02d}" for i in range(targets)]


@pytest.fixture(scope="module", params=["dense", "sparse"])
def data(request):
    return fixture() if request.param == "dense" else sparse()


@pytest.fixture(scope="module")
def problem(spark, data):
    Y, _, regs, names = data
    return INF.prepare(as_expression(spark, Y, names), regs)


def present(Y, names):
    return [i for i in range(len(names)) if Y[i].any()]


@pytest.mark.parametrize("block, fit, brute", [(None, {}, {}), (16, {}, {}), (None, {"gamma": 1.5, "min_child_weight": 4}, {"gamma": 1.5, "mcw": 4}), (7, {"min_child_weight": 0}, {"mcw": 0.0})])
def test_sparse_fit_matches_brute_force(problem, data, block, fit, brute):
    Y, X, regs, names = data
    keep = present(Y, names)
    want, _ = boost(Y[keep], X, regs, [names[i] for i in keep], 0.3, 4, **brute)
    booster = INF.booster(problem, BoostParams(eta=0.3, **fit), cells_per_block=block)
    assert isinstance(booster, stumps.StumpBooster)
    assert_same(splits(booster.split_log(booster.boost(4)[0]).drop("phase")), want, node=True)


def test_sparse_row_sampling_and_held_out_cells(spark, problem, data):
    Y, X, regs, names = data
    keep, n = present(Y, names), Y.shape[1]
    mask = drawn(n, 0.6, 666, draws.ROWS, 0)
    want, _ = boost(Y[keep], X, regs, [names[i] for i in keep], 0.3, 1, fit=mask)
    assert_same(splits(INF.infer_splits(problem, BoostParams(eta=0.3, subsample=0.6), 1)), want, node=True)
    folds = write_once(assign_folds(problem.expr.cells, n, 5), "folds")
    test = np.zeros(n, bool)
    test[[r.cell for r in folds.filter("fold = 0").collect()]] = True
    _, residuals = boost(Y[keep], X, regs, [names[i] for i in keep], 0.3, 3, fit=~test)
    want = sorted((t, r, np.sqrt((e[~test] ** 2).mean()), np.sqrt((e[test] ** 2).mean())) for t, r, e in residuals)
    got = sorted(map(tuple, loss_curves(problem, folds, BoostParams(eta=0.3), 3).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-9)


def test_both_engines_agree_on_sampled_rounds_phases_and_resumption(spark, problem, data, monkeypatch):
    p = BoostParams(eta=0.2, subsample=0.7, colsample_bytree=0.6, gamma=0.5, seed=7)
    whole = INF.booster(problem, p)
    want = splits(whole.split_log(whole.boost(6)[0]))
    first, path = INF.booster(problem, p), scratch_path(spark, "state")
    first.boost(2)
    first.save(path)
    again = HistogramBooster.load(spark, path)
    again.boost(4)
    resumed = splits(again.split_log(again.log()))
    assert again.done == 6 and [g[:-2] for g in resumed] == [w[:-2] for w in want]
    np.testing.assert_allclose([g[-2:] for g in resumed], [w[-2:] for w in want], rtol=1e-9)
    phases = RegressionParams(BoostParams(eta=0.3, subsample=0.8), nr_rounds=3)
    Y, _, regs, names = data
    networks = [{}, {}]
    expr = as_expression(spark, Y, names)
    for k in (0, 1):
        for r in INF.infer_phases(expr, regs, phases, 20).collect():
            networks[k][r.phase, r.regulator, r.target] = r.gain
        monkeypatch.setattr(stumps, "DENSITY", 0.0)
    other = INF.booster(problem, p)
    assert isinstance(other, HistogramBooster) and not isinstance(other, stumps.StumpBooster)
    got = splits(other.split_log(other.boost(6)[0]))
    assert [g[:-2] for g in got] == [w[:-2] for w in want]
    np.testing.assert_allclose([g[-2:] for g in got], [w[-2:] for w in want], rtol=1e-9)
    assert networks[0].keys() == networks[1].keys() and networks[0]
    np.testing.assert_allclose([networks[0][k] for k in networks[1]], list(networks[1].values()), rtol=1e-9)


def test_state_follows_the_entries(spark):
    """20 targets with 3 entries among 30,000 cells: a whole residual array of a target takes 240 kB."""
    rows = [(f"g{g:02d}", g % 2 * 1009 + k * 7001, 5.0 + k) for g in range(20) for k in range(3)]
    values = spark.createDataFrame(rows, "gene string, cell int, value double")
    cells = spark.range(30_000).select(F.col("id").cast("int").alias("cell"))
    fit = INF.booster(INF.prepare(Expression(values, cells), ["g00", "g01"]), BoostParams(eta=0.3))
    log, _ = fit.boost(2)
    assert log.count() >= 18
    size = spark.read.parquet(fit.state).selectExpr("sum(size(base) + size(idx) + size(val)) as n").first().n
    assert size < 1000


@pytest.mark.parametrize("mcw", [0.0, 1.0, 4.0])
def test_sparse_first_gains_match_brute_force(problem, data, mcw, monkeypatch):
    from test_boosting import brute_first_gains

    Y, X, regs, names = data
    keep = present(Y, names)
    monkeypatch.setattr("regweave.plans.first_round.target_moments", None)  # the windows over pairs are not used
    got = {(r.regulator, r.target): r.gain for r in INF.first_round_gains(problem, BoostParams(min_child_weight=mcw)).collect()}
    want = brute_first_gains(Y[keep], X, regs, [names[i] for i in keep], max(mcw, 1e-12))
    assert got.keys() == want.keys() and got
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_first_gains_count_cells_outside_the_list(spark, monkeypatch):
    """Entries of cells that are null or not listed count in sums and bins, repeated cells repeat products, as in the windows."""
    Y, _, regs, names = sparse()
    rows = [(g, c if c < 70 else None if c % 2 else c, float(v)) for g, row in zip(names, Y) for c, v in enumerate(row) if v]
    rows += [(None, 5, 2.0), (None, None, 1.0)]
    values = spark.createDataFrame(rows, "gene string, cell int, value double")
    cells = spark.createDataFrame([(c,) for c in [*range(80), 3, 4]], "cell int")
    found = []
    for density in (2.0, 0.0):
        monkeypatch.setattr(stumps, "DENSITY", density)
        problem = INF.prepare(Expression(values, cells), regs)
        found.append({(r.regulator, r.target): r.gain for r in INF.first_round_gains(problem).collect()})
    assert found[0].keys() == found[1].keys() and found[0]
    np.testing.assert_allclose([found[0][k] for k in found[1]], list(found[1].values()), rtol=1e-9)
