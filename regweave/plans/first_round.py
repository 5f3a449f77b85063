"""First-round gains of every regulator for every target, as joins and window sums; nothing is collected.

Between two bins in which a target has values, its running sum stands still while the count grows, and the gain is then
a convex function of the count (squares over positive linear terms). So the best split of such a run is at its first or
last bin, and only runs are looked at: one row per (target, regulator, bin with values) and one leading row per (target,
regulator), which is the size of the answer. No table of targets x bins is made.

On a sparse matrix the same is done by the tasks of :mod:`regweave.plans.stumps`, which hold the regulators and go through
the targets, so pairs are neither shuffled nor sorted.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave.operators.features import Binned, running_counts, target_moments
from regweave.operators.ordering import hash_position
from regweave.params import BoostParams
from regweave.session import write_once


def first_round_gains(values: DataFrame, cells: DataFrame, binned: Binned, params: BoostParams, targets: DataFrame | None = None) -> DataFrame:
    """``regulator, target, gain`` of all pairs whose best gain is above the least one."""
    from regweave.plans import stumps

    if stumps.fits(values, cells, binned, dataclasses.replace(params, max_depth=1)):
        all_cells = cells.select("cell", F.lit(0).alias("phase"), F.lit(True).alias("fit"))
        whole = dataclasses.replace(params, max_depth=1, subsample=1.0, colsample_bytree=1.0)
        return stumps.StumpBooster(values, all_cells, binned, whole, targets, totals=True).first_gains()
    if targets is not None:
        values = values.join(targets, "gene", "left_semi")
    p0, lam, floor = params.base_score, params.reg_lambda, max(params.min_child_weight, 1e-12)
    nr_cells, nr_regulators = cells.count(), binned.regulators.count()
    names = write_once(hash_position(values.select("gene").distinct(), "gene", 0, "tid"), "targets")
    counts = write_once(running_counts(binned), "running-counts")
    total = F.lit(float(nr_cells))
    missing = total - F.max("upto").over(Window.partitionBy("ridx"))
    # counts at which both sides keep ``min_child_weight`` cells, for missing cells right (0) and left (1)
    sides = counts.withColumn("miss", missing).withColumn("all", total - F.col("miss"))
    lower = [F.min(F.when(F.col("upto") + (F.col("miss") if d else F.lit(0)) >= floor, F.col("upto"))) for d in (0, 1)]
    upper = [F.max(F.when((F.col("all") if d else total) - F.col("upto") >= floor, F.col("upto"))) for d in (0, 1)]
    regs = sides.groupBy("ridx").agg(
        F.first("all").alias("all"), F.min("upto").alias("start"), lower[0].alias("lo0"), upper[0].alias("hi0"), lower[1].alias("lo1"), upper[1].alias("hi1")
    )
    regs = write_once(regs.join(binned.regulators, "ridx"), "regulator-limits")
    numbered = values.join(names, "gene").select("tid", "cell", "value")
    width = binned.features.count()
    single = cells.select("cell", F.lit(0).alias("grp"))
    sums = target_moments(numbered, single, binned, width, 1, names.count()).select("tid", "f", "y")
    seen = sums.join(counts, "f").select("tid", "ridx", "bin", "y", F.col("upto").alias("at"), (F.col("upto") - F.col("n")).alias("before"))
    lead = names.select("tid", F.explode(F.sequence(F.lit(0), F.lit(nr_regulators - 1))).alias("ridx")).select(
        "tid", "ridx", F.lit(0).alias("bin"), F.lit(0.0).alias("y"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("before")
    )
    pair = Window.partitionBy("tid", "ridx")
    order = pair.orderBy("bin")
    runs = (
        seen.unionByName(lead)
        .withColumn("ys", F.sum("y").over(order))
        .withColumn("yall", F.sum("y").over(pair))
        .withColumn("next", F.lead("before").over(order))
    )
    totals = numbered.groupBy("tid").agg((F.sum("value") - p0 * nr_cells).alias("tot"))
    wide = runs.join(regs, "ridx").join(totals, "tid")
    first, last = F.coalesce("at", "start"), F.coalesce("next", "all")
    tot = F.col("tot")

    def gain(d: int, n: Column) -> Column:
        left = F.col("ys") - p0 * n
        many = n
        if d:
            left = left + tot - (F.col("yall") - p0 * F.col("all"))
            many = n + (total - F.col("all"))
        score = lambda s, c: F.try_divide(s * s, c + F.lit(lam))
        return score(left, many) + score(tot - left, total - many) - score(tot, total)

    options = []
    for d in (0, 1):
        lo, hi = F.col(f"lo{d}"), F.col(f"hi{d}")
        a, b = F.greatest(first, lo).cast("double"), F.least(last, hi).cast("double")
        allowed = lo.isNotNull() & hi.isNotNull() & (a <= b)
        options += [F.when(allowed, gain(d, a)), F.when(allowed, gain(d, b))]
    best = wide.withColumn("gain", F.greatest(*options)).groupBy("tid", "ridx").agg(F.max("gain").alias("gain"), F.first("regulator").alias("regulator"))
    named = names.select("tid", F.col("gene").alias("target"))
    return (
        best.filter(F.col("gain") > params.min_gain)
        .join(named, "tid")
        .filter(F.col("regulator") != F.col("target"))
        .select("regulator", "target", "gain")
    )
