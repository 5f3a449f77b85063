"""Boosting, estimation and whole runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from regweave import constants as C
from regweave.catalog.registry import query
from regweave.catalog.tables import SQL_PARTS, embedding_expression, part_regulators, parts_expression, sql_streaks, table
from regweave.operators import draws
from regweave.operators.edges import included, normalize, with_labels
from regweave.operators.matrix import Expression, pack
from regweave.operators.select import index_cells, slice_cells
from regweave.params import BoostParams, RegressionParams, RunConfig
from regweave.plans import estimate as EST
from regweave.plans import infer as INF
from regweave.plans.histogram import HistogramBooster
from regweave.plans.run import run
from regweave.plans.tasks import flat_map_targets, flat_map_targets_with_regulators
from regweave.session import scratch_path, write_once
from regweave.sinks.writers import save_edges_parquet, save_matrix_slice
from regweave.sources.text import read_edges

ETA = 0.3
OFF_HALVES = 0.000217  # gains of small integer data often end in an exact half, where the order of summation would show

SQL_GAINS = (
    SQL_PARTS
    + """,
nn AS (SELECT CAST(count(*) AS DOUBLE) AS nc FROM cells),
bins AS (SELECT regulator, ridx, value AS v, CAST(count(*) AS DOUBLE) AS n FROM expr JOIN regs ON gene = regulator GROUP BY 1, 2, 3),
tot AS (SELECT gene AS target, sum(value) - 0.5 * nc AS tot, nc FROM expr CROSS JOIN nn GROUP BY gene, nc),
ysum AS (
  SELECT y.gene AS target, x.gene AS regulator, x.value AS v, sum(y.value) AS y
  FROM expr x JOIN regs ON x.gene = regulator JOIN expr y USING (cell) GROUP BY 1, 2, 3),
grid AS (
  SELECT t.*, b.regulator, b.v, b.n, coalesce(y, 0) - 0.5 * b.n AS s FROM tot t CROSS JOIN bins b
  LEFT JOIN ysum y ON y.target = t.target AND y.regulator = b.regulator AND y.v = b.v WHERE b.regulator <> t.target),
acc AS (
  SELECT *, sum(s) OVER w AS ls, sum(n) OVER w AS ln, tot - sum(s) OVER p AS ms, nc - sum(n) OVER p AS mn
  FROM grid WINDOW w AS (PARTITION BY target, regulator ORDER BY v), p AS (PARTITION BY target, regulator)),
sides AS (SELECT target, regulator, tot, nc, ls + d * ms AS l, ln + d * mn AS nl FROM acc CROSS JOIN (VALUES (0), (1)) t(d)),
gains AS (
  SELECT regulator, target, max(l * l / (nl + 1) + (tot - l) * (tot - l) / (nc - nl + 1) - tot * tot / (nc + 1)) AS gain
  FROM sides WHERE nl >= 1 AND nc - nl >= 1 GROUP BY 1, 2),
edges AS (SELECT regulator, target, gain FROM gains WHERE gain > 1e-6)
"""
)


def parts_problem(spark, sf, targets=None):
    return INF.prepare(parts_expression(spark, sf), part_regulators(spark, sf), targets, max_bin=None)


@query("first_round_gains", f"WITH {SQL_GAINS} SELECT regulator, target, round(gain, 4) AS gain FROM edges")
def first_round_gains(spark, sf):
    return INF.first_round_gains(parts_problem(spark, sf)).withColumn("gain", F.round("gain", 4))


@query(
    "flagship_network",
    f"""WITH {SQL_GAINS}, {sql_streaks("edges", "target", "gain DESC, regulator", "gain", 3)},
    kept AS (SELECT regulator, target, gain FROM marked WHERE elbow IS NULL OR idx < elbow - 2),
    norm AS (SELECT regulator, target, gain / sum(gain) OVER (PARTITION BY target) AS gain FROM kept)
    SELECT regulator, target, round(gain, 6) AS gain FROM norm""",
)
def flagship_network(spark, sf):
    """Gains, elbow labels, inclusion filter, normalization."""
    edges = INF.first_round_gains(parts_problem(spark, sf))
    return normalize(included(with_labels(edges))).select("regulator", "target", F.round("gain", 6).alias("gain"))


SQL_PHASES = """
placed AS (SELECT cell, i, greatest(1, n // 4) AS per, n FROM (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS i, count(*) OVER () AS n FROM cells)),
split AS (SELECT cell, CAST((ceil(n / per) - 2) - least(i // per, ceil(n / per) - 2) AS INTEGER) AS phase, true AS fit FROM placed)"""
SQL_FOLDS = "split AS (SELECT cell, 0 AS phase, cell % 5 <> 0 AS fit FROM cells)"
SQL_ALL = "split AS (SELECT cell, 0 AS phase, true AS fit FROM cells)"
SQL_LOSSES = " UNION ALL ".join(f"SELECT target, {k} AS round, fit, res FROM res{k + 1}" for k in range(5))


def _sql_rounds(
    rounds: int, eta: float, split: str = SQL_ALL, depth: int = 1, subsample: float = 1.0, colsample: float = 1.0, seed: int = 666, gamma: float = 0.0, mcw: float = 1.0
) -> str:
    """Boosting unrolled over cells: rows and regulators of the round, best split per node and level, leaf weights.

    ``split`` gives the phase of every cell (each is fitted by itself) and whether the cell is fitted on. ``gamma``
    prunes stumps only.
    """
    key = "phase, target, node"
    ctes = [
        SQL_PARTS,
        split,
        "posn AS MATERIALIZED (SELECT cell, phase, fit, row_number() OVER (PARTITION BY phase ORDER BY NOT fit, cell) - 1 AS pos, sum(CAST(fit AS INTEGER)) OVER (PARTITION BY phase) AS nfit FROM split)",
        "genes AS (SELECT DISTINCT gene AS target FROM expr)",
        """scale AS MATERIALIZED (SELECT phase, target, coalesce(sq, 0) + 1 AS scale FROM genes CROSS JOIN (SELECT DISTINCT phase FROM split)
        LEFT JOIN (SELECT phase, gene AS target, sum(value * value) AS sq FROM expr JOIN split USING (cell) GROUP BY ALL) USING (phase, target))""",
        "x AS MATERIALIZED (SELECT cell, ridx, regulator, dense_rank() OVER (PARTITION BY ridx ORDER BY value) AS bin FROM expr JOIN regs ON gene = regulator)",
        """res0 AS MATERIALIZED (SELECT g.target, c.cell, c.phase, c.fit, coalesce(value, 0.0) - 0.5 AS res FROM genes g
        CROSS JOIN split c LEFT JOIN expr e ON e.gene = g.target AND e.cell = c.cell)""",
    ]
    logs = []
    for t in range(rounds):
        rank = f"row_number() OVER (PARTITION BY phase ORDER BY {draws.draw_sql('pos', seed, draws.ROWS, t)}) <= greatest(1, floor({subsample} * nfit + 1e-9))"
        drawn = f"SELECT cell FROM posn WHERE fit QUALIFY {rank}" if subsample < 1 else "SELECT cell FROM posn WHERE fit"
        column = f"row_number() OVER (ORDER BY {draws.draw_sql('ridx', seed, draws.COLUMNS, t)}) <= (SELECT greatest(1, floor({colsample} * count(*) + 1e-9)) FROM regs)"
        ctes += [
            f"used{t} AS MATERIALIZED ({drawn})",
            f"offer{t} AS MATERIALIZED (SELECT ridx FROM regs {'QUALIFY ' + column if colsample < 1 else ''})",
            f"nd{t}_0 AS (SELECT target, cell, phase, fit, res, 0 AS node FROM res{t})",
        ]
        for v in range(depth):
            n = f"{t}_{v}"
            ctes += [
                f"in{n} AS MATERIALIZED (SELECT * FROM nd{n} JOIN used{t} USING (cell) WHERE node >= {(1 << v) - 1})",
                f"tot{n} AS MATERIALIZED (SELECT {key}, sum(res) AS tot, CAST(count(*) AS DOUBLE) AS nc, scale FROM in{n} JOIN scale USING (phase, target) GROUP BY ALL)",
                f"hist{n} AS (SELECT {key}, ridx, regulator, bin, sum(res) AS s, CAST(count(*) AS DOUBLE) AS n FROM in{n} JOIN x USING (cell) SEMI JOIN offer{t} USING (ridx) GROUP BY ALL)",
                f"""acc{n} AS (SELECT {key}, ridx, bin, tot, scale, nc, sum(s) OVER w AS ls, sum(n) OVER w AS ln, tot - sum(s) OVER p AS ms, nc - sum(n) OVER p AS mn
                FROM hist{n} JOIN tot{n} USING ({key}) WHERE regulator <> target
                WINDOW w AS (PARTITION BY {key}, ridx ORDER BY bin), p AS (PARTITION BY {key}, ridx))""",
                f"""cnd{n} AS (SELECT *, l * l / (nl + 1) + (tot - l) * (tot - l) / (nc - nl + 1) - tot * tot / (nc + 1) AS gain FROM (
                SELECT {key}, ridx, bin, d, tot, scale, nc, ls + d * ms AS l, ln + d * mn AS nl FROM acc{n} CROSS JOIN (VALUES (0), (1)) t(d)) WHERE nl >= {mcw} AND nc - nl >= {mcw})""",
                f"""top{n} AS (SELECT {key}, ridx, bin AS cut, d, gain FROM cnd{n} WHERE gain > 1e-6
                QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(gain / scale, 9) DESC, ridx, bin, d) = 1)""",
                f"best{n} AS MATERIALIZED (SELECT * FROM top{n} WHERE gain >= {gamma if depth == 1 else 0})",
                f"""nd{t}_{v + 1} AS MATERIALIZED (SELECT r.target, r.cell, r.phase, r.fit, r.res, CASE WHEN b.target IS NULL THEN r.node
                WHEN coalesce(x.bin <= b.cut, b.d = 1) THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node
                FROM nd{n} r LEFT JOIN best{n} b ON b.target = r.target AND b.phase = r.phase AND b.node = r.node LEFT JOIN x ON x.cell = r.cell AND x.ridx = b.ridx)""",
            ]
            logs.append(f"SELECT phase, target, {t} AS round, node, ridx, gain FROM best{n}")
        ctes += [
            f"leaf{t} AS MATERIALIZED (SELECT {key}, {eta} * sum(res) / (count(*) + 1) AS w FROM nd{t}_{depth} JOIN used{t} USING (cell) GROUP BY ALL)",
            f"res{t + 1} AS MATERIALIZED (SELECT target, cell, phase, fit, res - coalesce(w, 0) AS res FROM nd{t}_{depth} LEFT JOIN leaf{t} USING ({key}))",
        ]
    return ", ".join(ctes) + f", log AS (SELECT regulator, l.* FROM ({' UNION ALL '.join(logs)}) l JOIN regs USING (ridx))"


@query(
    "boosted_network",
    f"WITH {_sql_rounds(3, ETA)} SELECT regulator, target, CAST(count(*) AS BIGINT) AS splits, round(sum(gain), 3) AS gain FROM log GROUP BY 1, 2",
)
def boosted_network(spark, sf):
    log = INF.infer_splits(parts_problem(spark, sf), BoostParams(eta=ETA), 3)
    return log.groupBy("regulator", "target").agg(F.count(F.lit(1)).alias("splits"), F.round(F.sum("gain"), 3).alias("gain"))


@query(
    "rounds_sweep",
    f"""WITH {_sql_rounds(3, ETA)} SELECT CAST(n AS INTEGER) AS rounds, regulator, target, round(sum(gain), 3) AS gain
    FROM log JOIN (SELECT unnest([1, 2, 3]) AS n) ON round < n GROUP BY 1, 2, 3""",
)
def rounds_sweep(spark, sf):
    """Networks for several numbers of rounds out of one fit."""
    log = write_once(INF.infer_splits(parts_problem(spark, sf), BoostParams(eta=ETA), 3), "split-log")
    parts = [INF.edges_after(log, n).withColumn("rounds", F.lit(n)) for n in (1, 2, 3)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("rounds", "regulator", "target", F.round("gain", 3).alias("gain"))


@query(
    "resumed_boosting",
    f"WITH {_sql_rounds(3, ETA)} SELECT target, CAST(round AS INTEGER) AS round, regulator, round(gain, 3) AS gain FROM log",
)
def resumed_boosting(spark, sf):
    """One round, stored, then two more from the stored state."""
    problem, path = parts_problem(spark, sf), scratch_path(spark, "boosting-state")
    fit = INF.booster(problem, BoostParams(eta=ETA))
    fit.boost(1)
    fit.save(path)
    again = HistogramBooster.load(spark, path)
    again.boost(2)
    return again.split_log(again.log()).select("target", "round", "regulator", F.round("gain", 3).alias("gain"))


@query(
    "boosted_network_on_cells",
    f"WITH {_sql_rounds(2, ETA)} SELECT regulator, target, CAST(round AS INTEGER) AS round, round(gain, 3) AS gain FROM log",
)
def boosted_network_on_cells(spark, sf):
    """Histograms of several blocks of cells added up; the second round sees the first one's residuals."""
    log = INF.infer_splits(parts_problem(spark, sf), BoostParams(eta=ETA), 2, cells_per_block=256)
    return log.select("regulator", "target", "round", F.round("gain", 3).alias("gain"))


@query(
    "boosted_network_by_joins",
    f"WITH {_sql_rounds(2, ETA)} SELECT regulator, target, CAST(round AS INTEGER) AS round, round(gain, 3) AS gain FROM log",
)
def boosted_network_by_joins(spark, sf):
    """The same with small blocks of cells: many partial histograms."""
    log = INF.infer_splits(parts_problem(spark, sf), BoostParams(eta=ETA), 2, cells_per_block=64)
    return log.select("regulator", "target", "round", F.round("gain", 3).alias("gain"))


@query(
    "inferred_regulations",
    f"""WITH {_sql_rounds(25, 0.2, subsample=0.8, colsample=0.7, seed=777, gamma=2)}, edges AS (SELECT regulator, target, sum(gain) AS gain FROM log GROUP BY 1, 2),
    {sql_streaks("edges", "target", "gain DESC, regulator", "gain", 3)},
    kept AS (SELECT regulator, target, gain FROM marked WHERE elbow IS NULL OR idx < elbow - 2)
    SELECT regulator, target, round(gain / sum(gain) OVER (PARTITION BY target), 4) AS gain, CAST(1 AS INTEGER) AS include FROM kept""",
)
def inferred_regulations(spark, sf):
    """The whole inference with row and column sampling, labels and normalization."""
    params = RegressionParams(BoostParams(eta=0.2, subsample=0.8, colsample_bytree=0.7, gamma=2, seed=777), nr_rounds=25)
    edges = INF.infer_regulations(
        parts_expression(spark, sf), part_regulators(spark, sf), params, regularized=True, normalized=True
    )
    return edges.withColumn("gain", F.round("gain", 4))


@query("deep_tree_network")
def deep_tree_network(spark, sf):
    """Depth-3 trees with exact row sampling on the dense embedding matrix, quantile bins."""
    expr = embedding_expression(spark, sf)
    problem = INF.prepare(expr, expr.genes(), max_bin=16)
    log = INF.infer_splits(problem, BoostParams(eta=0.15, max_depth=3, subsample=0.8, min_child_weight=6), 2)
    return INF.edges_after(log)


@query(
    "sampled_network",
    f"WITH {_sql_rounds(4, 0.2, subsample=0.8, colsample=0.7, seed=777, gamma=2, mcw=3)} SELECT regulator, target, CAST(round AS INTEGER) AS round, round(gain, 3) AS gain FROM log",
)
def sampled_network(spark, sf):
    """Stumps with sampled rows and regulators, a least gain and a least number of cells per side."""
    params = BoostParams(eta=0.2, subsample=0.8, colsample_bytree=0.7, seed=777, gamma=2, min_child_weight=3)
    log = INF.infer_splits(parts_problem(spark, sf), params, 4)
    return log.select("regulator", "target", "round", F.round("gain", 3).alias("gain"))


@query(
    "sampled_tree_network",
    f"""WITH {_sql_rounds(2, 0.15, depth=3, subsample=0.8, colsample=0.7, seed=777, mcw=6)}
    SELECT regulator, target, CAST(round AS INTEGER) AS round, CAST(node AS INTEGER) AS node, round(gain, 3) AS gain FROM log""",
)
def sampled_tree_network(spark, sf):
    """Depth-3 trees with sampled rows and regulators."""
    params = BoostParams(eta=0.15, max_depth=3, subsample=0.8, colsample_bytree=0.7, seed=777, min_child_weight=6)
    log = INF.infer_splits(parts_problem(spark, sf), params, 2)
    return log.select("regulator", "target", "round", "node", F.round("gain", 3).alias("gain"))


@query(
    "sampled_phase_networks",
    f"""WITH {_sql_rounds(2, ETA, SQL_PHASES, depth=2, subsample=0.75, seed=5, mcw=2)}
    SELECT phase, regulator, target, round(sum(gain) + {OFF_HALVES}, 3) AS gain FROM log GROUP BY 1, 2, 3""",
)
def sampled_phase_networks(spark, sf):
    """Trees with sampled rows for every phase of cells, all phases in one job."""
    expr = parts_expression(spark, sf)
    params = RegressionParams(BoostParams(eta=ETA, max_depth=2, subsample=0.75, seed=5, min_child_weight=2), nr_rounds=2, regularize=None)
    edges = INF.infer_phases(expr, part_regulators(spark, sf), params, cells_per_phase=max(1, expr.nr_cells() // 4))
    return edges.select("phase", "regulator", "target", F.round(F.col("gain") + OFF_HALVES, 3).alias("gain"))


@query(
    "phase_networks",
    f"""WITH {_sql_rounds(3, ETA, SQL_PHASES)}, edges AS (
      SELECT phase, regulator, target, sum(gain) AS gain FROM log GROUP BY ALL),
    {sql_streaks("edges", "phase, target", "gain DESC, regulator", "gain", 3)}
    SELECT phase, regulator, target, round(gain, 3) AS gain, CAST(CASE WHEN elbow IS NULL OR idx < elbow - 2 THEN 1 ELSE 0 END AS INTEGER) AS include FROM marked""",
)
def phase_networks(spark, sf):
    """One network per phase of cells, all phases in one job."""
    expr = parts_expression(spark, sf)
    params = RegressionParams(BoostParams(eta=ETA), nr_rounds=3)
    edges = INF.infer_phases(expr, part_regulators(spark, sf), params, cells_per_phase=max(1, expr.nr_cells() // 4))
    return edges.select("phase", "regulator", "target", F.round("gain", 3).alias("gain"), "include")


@query(
    "phase_directories",
    f"""WITH {_sql_rounds(2, ETA, SQL_PHASES)} SELECT phase, regulator, target, round(sum(gain), 3) AS gain FROM log GROUP BY 1, 2, 3""",
)
def phase_directories(spark, sf):
    """Networks of several phases, one Parquet directory per phase."""
    expr = parts_expression(spark, sf)
    params = RegressionParams(BoostParams(eta=ETA), nr_rounds=2)
    path = scratch_path(spark, "phases")
    edges = INF.infer_phases(expr, part_regulators(spark, sf), params, cells_per_phase=max(1, expr.nr_cells() // 4))
    save_edges_parquet(edges, path, by_phase=True)
    return spark.read.parquet(path).select("phase", "regulator", "target", F.round("gain", 3).alias("gain"))


@query(
    "loss_curves",
    f"""WITH {_sql_rounds(5, ETA, SQL_FOLDS)}, seen AS ({SQL_LOSSES})
    SELECT target, CAST(round AS INTEGER) AS round, round(sqrt(avg(CASE WHEN fit THEN res * res END)), 6) AS train_loss,
    round(sqrt(avg(CASE WHEN NOT fit THEN res * res END)), 6) AS test_loss FROM seen GROUP BY target, round""",
)
def loss_curves(spark, sf):
    """Train and test loss per round of every gene; every fifth cell is held out."""
    problem = parts_problem(spark, sf)
    folds = problem.expr.cells.select("cell", (F.col("cell") % 5).cast("int").alias("fold"))
    losses = EST.loss_curves(problem, folds, BoostParams(eta=ETA), 5)
    return losses.select("target", "round", F.round("train_loss", 6).alias("train_loss"), F.round("test_loss", 6).alias("test_loss"))


@query(
    "duplicate_genes",
    f"WITH {SQL_GAINS} SELECT regulator, target, round(gain, 4) AS gain FROM edges",
)
def duplicate_genes(spark, sf):
    """Entries of a gene and cell that are listed several times add up before the fit."""
    lines = table(spark, sf, "lineitem")
    values = lines.select(F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("value"))
    expr = Expression(values, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell")))
    return INF.first_round_gains(INF.prepare(expr, part_regulators(spark, sf))).withColumn("gain", F.round("gain", 4))


def _sql_estimates(eta: float, last: int) -> str:
    """Stumps in a recursive query over residuals, with the first fold held out; then the first prefix of whole steps with an elbow.

    ``last`` ends the recursion: an elbow beyond that round would be missing.
    """
    genes = draws.shuffled_sql("(SELECT DISTINCT gene FROM expr)", "gene", 666, draws.GENES)
    folds = draws.shuffled_sql("(SELECT cell FROM cells)", "cell", 666, draws.FOLDS)
    return f"""WITH RECURSIVE {SQL_PARTS},
    genes AS MATERIALIZED (SELECT gene AS target FROM {genes} WHERE position < 20),
    split AS MATERIALIZED (SELECT cell, position % 5 <> 0 AS fit FROM {folds}),
    scale AS MATERIALIZED (SELECT gene AS target, sum(value * value) + 1 AS scale FROM expr SEMI JOIN genes ON gene = target GROUP BY 1),
    x AS MATERIALIZED (SELECT cell, ridx, regulator, dense_rank() OVER (PARTITION BY ridx ORDER BY value) AS bin FROM expr JOIN regs ON gene = regulator),
    state AS (
      SELECT 0 AS round, target, c.cell, c.fit, coalesce(value, 0.0) - 0.5 AS res
      FROM genes CROSS JOIN split c LEFT JOIN expr e ON e.gene = target AND e.cell = c.cell
      UNION ALL (
      WITH tot AS (SELECT target, sum(res) AS tot, CAST(count(*) AS DOUBLE) AS nc FROM state WHERE fit GROUP BY target),
      hist AS (SELECT target, ridx, regulator, bin, sum(res) AS s, CAST(count(*) AS DOUBLE) AS n FROM state JOIN x USING (cell) WHERE fit AND regulator <> target GROUP BY ALL),
      acc AS (SELECT target, ridx, bin, tot, nc, sum(s) OVER w AS ls, sum(n) OVER w AS ln, tot - sum(s) OVER p AS ms, nc - sum(n) OVER p AS mn
        FROM hist JOIN tot USING (target) WINDOW w AS (PARTITION BY target, ridx ORDER BY bin), p AS (PARTITION BY target, ridx)),
      cnd AS (SELECT *, l * l / (nl + 1) + (tot - l) * (tot - l) / (nc - nl + 1) - tot * tot / (nc + 1) AS gain FROM (
        SELECT target, ridx, bin, d, tot, nc, ls + d * ms AS l, ln + d * mn AS nl FROM acc CROSS JOIN (VALUES (0), (1)) t(d)) WHERE nl >= 1 AND nc - nl >= 1),
      best AS (SELECT target, ridx, bin AS cut, d FROM cnd JOIN scale USING (target) WHERE gain > 1e-6
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(gain / scale, 9) DESC, ridx, bin, d) = 1),
      sided AS (SELECT s.*, CASE WHEN b.target IS NULL THEN 0 WHEN coalesce(x.bin <= b.cut, b.d = 1) THEN 1 ELSE 2 END AS node
        FROM state s LEFT JOIN best b ON b.target = s.target LEFT JOIN x ON x.cell = s.cell AND x.ridx = b.ridx),
      leaf AS (SELECT target, node, {eta} * sum(res) / (count(*) + 1) AS w FROM sided WHERE fit GROUP BY ALL)
      SELECT round + 1, target, cell, fit, res - coalesce(w, 0) FROM sided LEFT JOIN leaf USING (target, node) WHERE round < {last})),
    losses AS (SELECT target, round - 1 AS round, sqrt(avg(res * res)) AS test_loss FROM state WHERE NOT fit AND round > 0 GROUP BY ALL),
    curves AS (SELECT l.*, upto FROM losses l JOIN (SELECT unnest(range({C.ROUNDS_PER_BATCH}, {last} + 1, {C.ROUNDS_PER_BATCH})) AS upto) ON round < upto),
    {sql_streaks("curves", "target, upto", "round", "test_loss", C.ELBOW_X_SCALE)}
    SELECT target, round(test_loss, 4) AS loss, CAST(elbow AS INTEGER) AS rounds FROM marked
    WHERE idx = elbow QUALIFY upto = min(upto) OVER (PARTITION BY target)"""


@query("estimated_rounds", _sql_estimates(ETA, 500))
def estimated_rounds(spark, sf):
    """Boosting rounds estimated on the default random set of genes."""
    _, estimates = EST.estimate_run(parts_expression(spark, sf), part_regulators(spark, sf), BoostParams(eta=ETA))
    return estimates.select("target", F.round("loss", 4).alias("loss"), "rounds")


@query(
    "aggregated_rounds",
    "SELECT CAST(max(o_custkey) AS INTEGER) AS max_rounds, CAST(min(o_custkey) AS INTEGER) AS min_rounds FROM orders",
)
def aggregated_rounds(spark, sf):
    """Aggregation of per-target estimates with a pluggable aggregate."""
    est = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("target"), F.col("o_custkey").alias("rounds"))
    return spark.createDataFrame([(EST.aggregate_rounds(est), EST.aggregate_rounds(est, F.min))], "max_rounds int, min_rounds int")


@query(
    "target_tasks",
    f"""WITH {SQL_PARTS} SELECT gene, CAST(count(*) AS BIGINT) AS stored, sum(value) AS total, max(value) AS top FROM expr GROUP BY gene""",
)
def target_tasks(spark, sf):
    """A user task mapped over all target vectors."""
    expr = parts_expression(spark, sf)
    indexed = index_cells(expr.cells)
    packed = pack(slice_cells(expr.values, indexed), indexed.count())
    return flat_map_targets(
        packed,
        lambda row: [(row.gene, len(row.values), float(sum(row.values)), float(max(row.values)))],
        "gene string, stored long, total double, top double",
    )


@query(
    "target_regulator_tasks",
    f"""WITH {SQL_PARTS}, own AS (SELECT e.*, gene IN (SELECT regulator FROM regs) AS regulating FROM expr e),
    nn AS (SELECT count(*) AS n FROM cells),
    m AS (SELECT gene, regulating, sum(value) AS s, sum(value * value) AS q FROM own GROUP BY 1, 2),
    dots AS (SELECT r.gene AS regulator, t.gene AS target, sum(r.value * t.value) AS d
      FROM own r JOIN own t ON r.cell = t.cell WHERE r.regulating AND r.gene <> t.gene GROUP BY 1, 2)
    SELECT r.gene AS regulator, t.gene AS target,
      round((n * coalesce(d, 0) - r.s * t.s) / nullif(sqrt(n * r.q - r.s * r.s) * sqrt(n * t.q - t.s * t.s), 0), 6) AS correlation
    FROM m r CROSS JOIN m t CROSS JOIN nn LEFT JOIN dots ON regulator = r.gene AND target = t.gene
    WHERE r.regulating AND r.gene <> t.gene""",
)
def target_regulator_tasks(spark, sf):
    """A user task that correlates its target with every regulator of a block."""
    expr = parts_expression(spark, sf)
    indexed = index_cells(expr.cells)
    packed = write_once(pack(slice_cells(expr.values, indexed), indexed.count()), "packed")

    def correlate(row, block):
        n, s, q = block.size, float(sum(row.values)), float(sum(v * v for v in row.values))
        sums, squares = block.sums(block.values), block.sums(block.values**2)
        spread = np.sqrt(np.maximum(n * squares - sums**2, 0)) * np.sqrt(max(n * q - s * s, 0))
        cov = n * block.products(row) - sums * s
        for name, c, w in zip(block.genes, cov, spread):
            if name != row.gene:
                yield name, row.gene, float(c / w) if w else None

    out = flat_map_targets_with_regulators(packed, part_regulators(spark, sf), correlate, "regulator string, target string, correlation double")
    return out.select("regulator", "target", F.round("correlation", 6).alias("correlation"))


@query(
    "run_report_items",
    f"""WITH {SQL_PARTS}, r AS (SELECT count(*) AS n FROM expr WHERE gene IN (SELECT regulator FROM regs)),
    items AS (SELECT 'matrix.entries' AS key, CAST(count(*) AS VARCHAR) AS value FROM expr
      UNION ALL SELECT 'matrix.cells', CAST(count(*) AS VARCHAR) FROM cells
      UNION ALL SELECT 'matrix.regulator_entries', CAST(n AS VARCHAR) FROM r
      UNION ALL SELECT 'matrix.regulator_bytes', CAST(12 * n AS VARCHAR) FROM r)
    SELECT * FROM items UNION ALL SELECT * FROM (VALUES ('rounds', '7'), ('params.nr_folds', '5'), ('params.nr_rounds', '7'),
      ('boost.eta', '0.01'), ('boost.max_depth', '1'), ('boost.subsample', '1.0'), ('config.run_mode', '"cfg"'))""",
)
def run_report_items(spark, sf):
    """The report of a run from files: sizes counted while the matrix is stored, and parameters as resolved."""
    matrix, names, out = (scratch_path(spark, n) for n in ("report-matrix", "report-regulators", "report-output"))
    save_matrix_slice(parts_expression(spark, sf), matrix, compression="lz4")
    part_regulators(spark, sf).select(F.col("gene").alias("value")).write.text(names)
    run(spark, RunConfig(input_path=matrix, regulators_path=names, output_path=out, nr_boosting_rounds=7, run_mode="cfg"))
    kept = ["rounds", "params.nr_folds", "params.nr_rounds", "boost.eta", "boost.max_depth", "boost.subsample", "config.run_mode"]
    report = spark.read.json(f"{out}.report").select("key", "value")
    return report.filter(F.col("key").isin(kept) | F.col("key").startswith("matrix."))


@query(
    "configured_run",
    f"""WITH {_sql_rounds(3, ETA)}, edges AS (SELECT regulator, target, sum(gain) AS gain FROM log GROUP BY 1, 2),
    {sql_streaks("edges", "target", "gain DESC, regulator", "gain", 3)}
    SELECT regulator, target, round(CAST(CAST(gain / sum(gain) OVER (PARTITION BY target) AS FLOAT) AS DOUBLE), 3) AS gain,
    CAST(CASE WHEN elbow IS NULL OR idx < elbow - 2 THEN 1 ELSE 0 END AS INTEGER) AS include FROM marked""",
)
def configured_run(spark, sf):
    """Files in, inference by configuration, edges and report out; the edges as written."""
    expr = parts_expression(spark, sf)
    matrix, names, out = (scratch_path(spark, n) for n in ("run-matrix", "run-regulators", "run-output"))
    save_matrix_slice(expr, matrix, compression="lz4")
    part_regulators(spark, sf).select(F.col("gene").alias("value")).write.text(names)
    run(
        spark,
        RunConfig(
            input_path=matrix,
            regulators_path=names,
            output_path=out,
            nr_boosting_rounds=3,
            booster_params={"eta": ETA},
            normalized=True,
            include_flags=True,
        ),
    )
    edges = read_edges(spark, f"{out}.result", include_flags=True)
    return edges.withColumn("gain", F.round(F.col("gain").cast("float").cast("double"), 3))
