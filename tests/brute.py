"""Plain numpy boosting over cells, written independently of the engines, for small fixtures."""

import numpy as np


def boost(Y, X, names, targets, eta, rounds, depth=1, gamma=0.0, mcw=1.0, lam=1.0, fit=None, base=0.5):
    """Y: (targets, cells); X: (regulators, cells), zeros missing. Returns split rows and residuals.

    Rows: (target, round, node, regulator, threshold, default_left, gain, cover); the threshold is the
    largest present value that goes left.
    """
    fit = np.ones(Y.shape[1], bool) if fit is None else fit
    log, residuals = [], []
    for t, y in zip(targets, Y):
        res = y - base
        scale = float((y * y).sum()) + 1.0
        for rnd in range(rounds):
            node = np.zeros(len(res), int)
            splits = {}
            for level in range(depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    inside = (node == k) & fit
                    if not inside.any():
                        continue
                    best = best_split(res, X, inside, names, t, scale, mcw, lam)
                    if best is None:
                        continue
                    r, thr, d, gain = best
                    splits[k] = (names[r], thr, d, gain, float(inside.sum()))
                    present = X[r] != 0
                    left = np.where(present, X[r] <= thr, d == 1)
                    node = np.where(node == k, np.where(left, 2 * k + 1, 2 * k + 2), node)
            for k in sorted(splits, reverse=True):
                if splits[k][3] < gamma and 2 * k + 1 not in splits and 2 * k + 2 not in splits:
                    del splits[k]
                    node[(node == 2 * k + 1) | (node == 2 * k + 2)] = k
            log += [(t, rnd, k, *s) for k, s in sorted(splits.items())]
            for k in np.unique(node):
                here = node == k
                s, n = res[here & fit].sum(), (here & fit).sum()
                res = np.where(here, res - eta * s / (n + lam), res)
            residuals.append((t, rnd, res.copy()))
    return log, residuals


def best_split(res, X, inside, names, target, scale, mcw, lam):
    total, n = res[inside].sum(), inside.sum()
    best = None
    for r, name in enumerate(names):
        if name == target:
            continue
        values = np.unique(X[r][inside & (X[r] != 0)])
        for b, thr in enumerate(values):
            for d in (0, 1):
                left = inside & np.where(X[r] != 0, X[r] <= thr, d == 1)
                nl = left.sum()
                nr = n - nl
                if nl < max(mcw, 1e-12) or nr < max(mcw, 1e-12):
                    continue
                sl = res[left].sum()
                sr = total - sl
                gain = sl * sl / (nl + lam) + sr * sr / (nr + lam) - total * total / (n + lam)
                if gain <= 1e-6:
                    continue
                key = (round(gain / scale, 9), -r, -b, -d)
                if best is None or key > best[0]:
                    best = (key, (r, thr, d, gain))
    return None if best is None else best[1]


def fixture(seed=1, cells=60, regulators=8, targets=10):
    rng = np.random.default_rng(seed)
    X = rng.integers(1, 6, (regulators, cells)) * (rng.random((regulators, cells)) < 0.4)
    Y = rng.poisson(2, (targets, cells)).astype(float)
    Y[: targets // 2] += 3 * X[0]
    rnames = [f"r{i:02d}" for i in range(regulators)]
    tnames = [f"t{i:02d}" for i in range(targets)]
    everything = np.vstack([X.astype(float), Y])
    return everything, X.astype(float), rnames, rnames + tnames


def as_expression(spark, matrix, names):
    from pyspark.sql import functions as F

    from regweave.operators.matrix import Expression

    rows = [(g, c, float(v)) for g, row in zip(names, matrix) for c, v in enumerate(row) if v != 0]
    values = spark.createDataFrame(rows, "gene string, cell int, value double")
    return Expression(values, spark.range(matrix.shape[1]).select(F.col("id").cast("int").alias("cell")))
