import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import as_expression, boost, fixture
from regweave.operators import draws
from regweave.operators.features import bin_regulators, running_counts
from regweave.operators.select import assign_folds, regulator_index
from regweave.params import BoostParams, RegressionParams
from regweave.plans import estimate as EST
from regweave.plans import infer as INF
from regweave.plans.estimate import aggregate_rounds, estimate_rounds, estimate_run, loss_curves, rounds_from_losses
from regweave.plans.histogram import HistogramBooster
from regweave.session import scratch_path, write_once

BLOCKS = [None, 16]  # one block of cells (all rounds in a task), or several whose histograms are added in Spark


@pytest.fixture(scope="module")
def data():
    return fixture()


@pytest.fixture(scope="module")
def problem(spark, data):
    Y, _, regs, names = data
    return INF.prepare(as_expression(spark, Y, names), regs, max_bin=None)


def splits(log):
    cols = ["target", "round"] + (["node"] if "node" in log.columns else []) + ["regulator", "threshold", "missing_left", "gain", "cover"]
    return sorted(tuple(r) for r in log.select(*cols).collect())


def assert_same(got, want, node=False):
    want = sorted(w if node else w[:2] + w[3:] for w in want)
    assert [g[:-2] for g in got] == [w[:-2] for w in want]
    np.testing.assert_allclose([g[-2:] for g in got], [w[-2:] for w in want], rtol=1e-8)


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize(
    "fit, brute",
    [
        ({}, {}),
        ({"gamma": 12.0, "min_child_weight": 6}, {"gamma": 12.0, "mcw": 6}),
        ({"max_depth": 3}, {"depth": 3}),
        ({"max_depth": 3, "gamma": 15.0}, {"depth": 3, "gamma": 15.0}),
    ],
)
def test_fit_matches_brute_force(problem, data, block, fit, brute):
    Y, X, regs, names = data
    want, _ = boost(Y, X, regs, names, 0.3, 2, **brute)
    got = INF.infer_splits(problem, BoostParams(eta=0.3, **fit), 2, cells_per_block=block)
    assert want
    assert_same(splits(got), want, node=True)


def drawn(n, fraction, seed, stream, round_nr):
    keys = draws.draw_keys(np.arange(n), seed, stream, round_nr)
    mask = np.zeros(n, bool)
    mask[np.argsort(keys)[: draws.sample_size(fraction, n)]] = True
    return mask


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("fraction", [1 / 3, 0.123456])
def test_row_sampling_of_any_fraction(problem, data, block, fraction):
    Y, X, regs, names = data
    mask = drawn(60, fraction, 666, draws.ROWS, 0)
    assert mask.sum() == int(fraction * 60 + 1e-9)
    want, _ = boost(Y, X, regs, names, 0.3, 1, fit=mask)
    assert_same(splits(INF.infer_splits(problem, BoostParams(eta=0.3, subsample=fraction), 1, cells_per_block=block)), want, node=True)


@pytest.mark.parametrize("depth", [1, 2])
def test_blocks_do_not_change_the_answer(problem, depth):
    p = BoostParams(eta=0.3, subsample=0.8, colsample_bytree=0.6, max_depth=depth, seed=3)
    one, many, few = (splits(INF.infer_splits(problem, p, 3, cells_per_block=b)) for b in (None, 16, 40))
    assert [s[:-2] for s in one] == [s[:-2] for s in many] == [s[:-2] for s in few]
    np.testing.assert_allclose([s[-2] for s in one], [s[-2] for s in many], rtol=1e-9)


def test_column_sampling_offers_the_drawn_regulators(problem, data):
    _, _, regs, _ = data
    log = splits(INF.infer_splits(problem, BoostParams(eta=0.3, colsample_bytree=0.5, seed=777), 4))
    for t in range(4):
        offered = {r for r, m in zip(regs, drawn(len(regs), 0.5, 777, draws.COLUMNS, t)) if m}
        assert {s[3] for s in log if s[1] == t} <= offered and len(offered) == 4


def test_values_seen_in_no_fitted_cell_are_no_thresholds(spark, data):
    """Values that occur in held-out or not drawn cells only."""
    Y, X, regs, names = data
    Y, X = Y.copy(), X.copy()
    mask = drawn(60, 0.8, 666, draws.ROWS, 0)
    for c in np.flatnonzero(~mask):
        X[:, c] = np.where(X[:, c] > 0, X[:, c] - 0.5, 0)
    Y[: len(regs)] = X
    problem = INF.prepare(as_expression(spark, Y, names), regs)
    want, _ = boost(Y, X, regs, names, 0.3, 1, fit=mask)
    for block in BLOCKS:
        assert_same(splits(INF.infer_splits(problem, BoostParams(eta=0.3, subsample=0.8), 1, cells_per_block=block)), want, node=True)
    folds = spark.createDataFrame([(c, int(m)) for c, m in enumerate(mask)], "cell int, fold int")
    _, residuals = boost(Y, X, regs, names, 0.3, 1, fit=mask)
    want = sorted((t, np.sqrt((e[mask] ** 2).mean()), np.sqrt((e[~mask] ** 2).mean())) for t, _, e in residuals)
    for block in BLOCKS:
        got = sorted((r.target, r.train_loss, r.test_loss) for r in loss_curves(problem, folds, BoostParams(eta=0.3), 1, cells_per_block=block).collect())
        np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-9)


def test_draws_are_the_same_everywhere(spark):
    import duckdb

    x = np.arange(1000)
    for stream, t in ((draws.ROWS, 0), (draws.COLUMNS, 17)):
        want = draws.draw_keys(x, 666, stream, t).tolist()
        df = spark.range(1000).coalesce(1)
        assert [r.k for r in df.select(draws.draw_key(F.col("id"), 666, stream, t).alias("k")).collect()] == want
        assert [r.k for r in df.select(draws.draw_key(F.col("id"), 666, stream, F.lit(t)).alias("k")).collect()] == want
        sql = f"SELECT {draws.draw_sql('i', 666, stream, t)} FROM (SELECT unnest(range(1000)) AS i) ORDER BY i"
        assert [r[0] for r in duckdb.sql(sql).fetchall()] == want
        assert len(set(want)) == 1000


def test_draw_limits_are_ranks(spark):
    pos = spark.range(500).selectExpr("cast(id % 2 as int) as `group`", "id div 2 as pos")
    got = draws.draw_limits(pos, {0: 10, 1: 250}, 5, draws.ROWS, [0, 3])
    for g, k in ((0, 10), (1, 250)):
        for t in (0, 3):
            assert got[g, t] == sorted(draws.draw_keys(np.arange(250), 5, draws.ROWS, t))[k - 1]


def test_duplicate_entries_add_up(spark, data):
    Y, _, regs, names = data
    expr = as_expression(spark, Y, names)
    halves = expr.values.withColumn("value", F.col("value") / 2)
    twice = INF.prepare(dataclasses.replace(expr, values=halves.unionByName(halves)), regs)
    once = INF.prepare(expr, regs)
    a, b = (splits(INF.infer_splits(x, BoostParams(eta=0.3), 2)) for x in (once, twice))
    assert [s[:4] for s in a] == [s[:4] for s in b]
    np.testing.assert_allclose([s[5] for s in a], [s[5] for s in b], rtol=1e-9)


@pytest.mark.parametrize("block", BLOCKS)
def test_estimation_never_passes_its_limit(problem, block):
    found = EST.estimate_rounds(problem, BoostParams(eta=0.3), 5, max_rounds=6, batch=60, cells_per_block=block)
    assert all(r.rounds < 6 for r in found.collect())


def test_growing_steps_find_the_first_elbow(spark, data):
    Y, _, regs, names = data
    problem = INF.prepare(as_expression(spark, Y, names), regs)
    p = BoostParams(eta=0.3)
    folds = write_once(assign_folds(problem.expr.cells, 60, 5, p.seed), "folds")
    losses = write_once(EST.loss_curves(problem, folds, p, 40), "losses")
    want = {}
    for upto in range(5, 41, 5):
        for r in EST.rounds_from_losses(losses.filter(F.col("round") < upto)).collect():
            want.setdefault(r.target, r.rounds)
    got = {r.target: r.rounds for r in EST.estimate_rounds(problem, p, 5, max_rounds=40, batch=5).collect()}
    assert got == want


@pytest.mark.parametrize("block, params", [(None, {"max_depth": 2, "subsample": 0.7}), (16, {"colsample_bytree": 0.6})])
def test_resume_equals_one_run(spark, problem, block, params):
    """2 rounds, stored, loaded, 3 more: the same as 5."""
    p = BoostParams(eta=0.3, **params)
    whole = INF.booster(problem, p, cells_per_block=block)
    want = splits(whole.split_log(whole.boost(5)[0]))
    first, path = INF.booster(problem, p, cells_per_block=block), scratch_path(spark, "state")
    first.boost(2)
    first.save(path)
    again = HistogramBooster.load(spark, path)
    assert again.done == 2
    again.boost(3)
    got = splits(again.split_log(again.log()))
    assert [s[:-2] for s in got] == [s[:-2] for s in want]
    np.testing.assert_allclose([s[-2] for s in got], [s[-2] for s in want], rtol=1e-12)
    again.save(path)  # a later version; the earlier one goes when the state is loaded
    later = HistogramBooster.load(spark, path)
    assert later.done == 5
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(f"{path}/round-2/state").count()


def test_state_without_rounds_cannot_be_stored(problem):
    with pytest.raises(ValueError):
        INF.booster(problem, BoostParams()).save("nowhere")


@pytest.mark.parametrize("block", BLOCKS)
def test_losses_match_brute_force(problem, data, block):
    Y, X, regs, names = data
    folds = write_once(assign_folds(problem.expr.cells, 60, 5), "folds")
    test = np.zeros(60, bool)
    test[[r.cell for r in folds.filter("fold = 0").collect()]] = True
    assert test.sum() == 12
    log, residuals = boost(Y, X, regs, names, 0.3, 2, fit=~test)
    want = sorted((t, r, np.sqrt((e[~test] ** 2).mean()), np.sqrt((e[test] ** 2).mean())) for t, r, e in residuals)
    got = sorted(map(tuple, loss_curves(problem, folds, BoostParams(eta=0.3), 2, cells_per_block=block).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-9)


def test_batched_estimation_finds_the_first_batch_with_an_elbow(spark, problem):
    p = BoostParams(eta=0.3)
    got = {r.target: r.rounds for r in estimate_rounds(problem, p, max_rounds=60, batch=20).collect()}
    folds = write_once(assign_folds(problem.expr.cells, 60, 5, p.seed), "folds")
    curves = write_once(loss_curves(problem, folds, p, 60), "curves")
    want = {}
    for upto in (20, 40, 60):
        for r in rounds_from_losses(curves.filter(F.col("round") < upto)).collect():
            want.setdefault(r.target, r.rounds)
    assert got == want and got


def test_estimation_does_not_depend_on_blocks(spark, problem):
    p = BoostParams(eta=0.5)
    small = INF.Problem(problem.expr, problem.binned, spark.createDataFrame([("t00",), ("t07",)], "gene string"))
    a, b = ({r.target: r.rounds for r in estimate_rounds(small, p, max_rounds=8, batch=4, cells_per_block=x).collect()} for x in BLOCKS)
    assert a == b


def test_estimate_run_uses_random_or_given_genes(spark, data):
    Y, _, regs, names = data
    expr = as_expression(spark, Y, names)
    rounds, est = estimate_run(expr, regs, BoostParams(eta=0.3), nr_genes=4, max_rounds=100)
    assert est.count() <= 4
    assert rounds is None or rounds == max(r.rounds for r in est.collect())
    _, est = estimate_run(expr, regs, BoostParams(eta=0.3), genes=["t01"], max_rounds=50)
    assert {r.target for r in est.collect()} <= {"t01"}


def test_aggregate_rounds(spark):
    est = spark.createDataFrame([(r,) for r in (25, 55, 34, 666, 320)], "rounds int")
    assert aggregate_rounds(est) == 666
    assert aggregate_rounds(est, F.min) == 25
    assert aggregate_rounds(est.filter("rounds < 0")) is None


def test_metamorphic_cell_permutation_and_rescaling(spark, data, problem):
    Y, X, regs, names = data
    base = splits(INF.infer_splits(problem, BoostParams(eta=0.3), 3))
    perm = np.random.default_rng(0).permutation(Y.shape[1])
    moved = INF.prepare(as_expression(spark, Y[:, perm], names), regs, max_bin=None)
    got = splits(INF.infer_splits(moved, BoostParams(eta=0.3), 3))
    assert [g[:5] for g in got] == [b[:5] for b in base]
    targets = [n for n in names if n.startswith("t")]
    scaled = Y.copy()
    scaled[0] *= 10.0
    other = INF.prepare(as_expression(spark, scaled, names), regs, targets, max_bin=None)
    got = splits(INF.infer_splits(other, BoostParams(eta=0.3), 3))
    np.testing.assert_allclose([g[5] for g in got], [b[5] for b in base if b[0] in targets], rtol=1e-9)


def test_quantile_bins_are_capped_and_cover_all_values(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(1, 500))
    expr = as_expression(spark, values, ["r"])
    binned = bin_regulators(expr.values, regulator_index(expr.values, ["r"]), 16)
    bins = [r.bin for r in binned.cells.collect()]
    assert len(bins) == 500 and max(bins) <= 17 and min(bins) == 1
    top = binned.features.agg(F.max("threshold")).first()[0]
    assert top == values.max()


def test_infer_regulations_end_to_end(spark, data):
    Y, _, regs, names = data
    expr = as_expression(spark, Y, names)
    params = RegressionParams(BoostParams(eta=0.3), nr_rounds=10)
    edges = INF.infer_regulations(expr, regs, params, normalized=True).collect()
    sums = {}
    for e in edges:
        assert e.regulator != e.target and e.regulator in regs and e.include in (0, 1)
        sums[e.target] = sums.get(e.target, 0) + e.gain
    assert set(sums) == set(names)
    np.testing.assert_allclose(list(sums.values()), 1.0)
    assert [e.gain for e in edges] == sorted((e.gain for e in edges), reverse=True)
    assert {e.regulator for e in edges if e.target == "t00" and e.gain > 0.5} == {"r00"}
    only = INF.infer_regulations(expr, regs, params, targets=["t03"], regularized=True, truncated=2)
    assert only.count() <= 2 and {r.target for r in only.collect()} == {"t03"}
    with pytest.raises(ValueError):
        INF.infer_regulations(expr, ["nope"], params)
    with pytest.raises(ValueError):
        INF.infer_regulations(expr, regs, RegressionParams())


def test_phases_equal_separate_runs(spark, data):
    Y, X, regs, names = data
    expr = as_expression(spark, Y, names)
    params = RegressionParams(BoostParams(eta=0.3), nr_rounds=3)
    got = {(r.phase, r.regulator, r.target): r.gain for r in INF.infer_phases(expr, regs, params, 20, max_bin=None).collect()}
    assert {k[0] for k in got} == {0, 1}
    for phase, cells in ((0, slice(20, 60)), (1, slice(0, 20))):
        want = {}
        for row in boost(Y[:, cells], X[:, cells], regs, names, 0.3, 3)[0]:
            want[(phase, row[3], row[0])] = want.get((phase, row[3], row[0]), 0) + row[6]
        have = {k: v for k, v in got.items() if k[0] == phase}
        assert have.keys() == want.keys()
        np.testing.assert_allclose([have[k] for k in want], list(want.values()), rtol=1e-8)


def test_rounds_sweep_is_a_prefix(problem):
    log = INF.infer_splits(problem, BoostParams(eta=0.3), 4)
    two = {(r.regulator, r.target): r.gain for r in INF.edges_after(log, 2).collect()}
    again = INF.edges_after(INF.infer_splits(problem, BoostParams(eta=0.3), 2))
    np.testing.assert_allclose(sorted(two.values()), sorted(r.gain for r in again.collect()))


@pytest.mark.parametrize("params", [{"subsample": 0.8}, {"max_depth": 2}])
def test_phases_do_not_depend_on_blocks(spark, data, params):
    Y, _, regs, names = data
    expr = as_expression(spark, Y, names)
    fit = RegressionParams(BoostParams(eta=0.3, **params), nr_rounds=2)
    runs = []
    for block in (None, 8):
        rows = INF.infer_phases(expr, regs, fit, 20, cells_per_block=block).collect()
        runs.append({(r.phase, r.regulator, r.target): r.gain for r in rows})
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) > 10
    np.testing.assert_allclose([runs[0][k] for k in runs[0]], [runs[1][k] for k in runs[0]], rtol=1e-8)


def brute_first_gains(Y, X, regs, names, mcw=1.0):
    out = {}
    for t, y in zip(names, Y):
        res = y - 0.5
        tot, n = res.sum(), len(res)
        for r, x in zip(regs, X):
            best = 0.0
            for thr in np.unique(x[x != 0]) if r != t else []:
                for d in (0, 1):
                    left = np.where(x != 0, x <= thr, d == 1)
                    nl, s = left.sum(), res[left].sum()
                    if min(nl, n - nl) >= mcw:
                        best = max(best, s * s / (nl + 1) + (tot - s) ** 2 / (n - nl + 1) - tot * tot / (n + 1))
            if best > 1e-6:
                out[r, t] = best
    return out


@pytest.mark.parametrize("mcw", [1.0, 4.0, 25.0])
def test_first_round_gains_match_brute_force(problem, data, mcw):
    Y, X, regs, names = data
    got = {(r.regulator, r.target): r.gain for r in INF.first_round_gains(problem, BoostParams(min_child_weight=mcw)).collect()}
    want = brute_first_gains(Y, X, regs, names, mcw)
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_first_round_gains_of_continuous_and_dense_regulators(spark):
    """Very many distinct values, negative values, and a regulator without missing cells."""
    rng = np.random.default_rng(4)
    X = np.stack([rng.normal(size=200), np.where(rng.random(200) < 0.3, rng.normal(size=200), 0)])
    Y = np.vstack([X, np.where(rng.random((3, 200)) < 0.1, rng.poisson(3, (3, 200)) + X[0], 0)])
    names = ["r0", "r1", "t0", "t1", "t2"]
    problem = INF.prepare(as_expression(spark, Y, names), names[:2])
    got = {(r.regulator, r.target): r.gain for r in INF.first_round_gains(problem).collect()}
    want = brute_first_gains(Y, X, names[:2], names)
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_exact_bins_of_very_many_values(spark, monkeypatch):
    """One regulator of 120,000 distinct values: numbers, thresholds and running counts, without a list per regulator."""
    n = 120_000
    values = spark.range(n).selectExpr("'r' as gene", "id as cell", "cast((id * 7919) % 120011 + 1 as double) as value")
    monkeypatch.setattr("regweave.operators.features.BINS_PER_RANGE", 1000)
    binned = bin_regulators(values, regulator_index(values, ["r"]), None)
    assert binned.features.count() == n
    bad = binned.cells.join(values, "cell").join(binned.features.select("f", "threshold"), "f").filter("threshold <> value").count()
    order = binned.features.selectExpr("bin", "threshold", "lag(threshold) over (partition by ridx order by bin) as p").filter("p >= threshold").count()
    counts = running_counts(binned).filter("upto <> bin or n <> 1").count()
    assert (bad, order, counts) == (0, 0, 0)
