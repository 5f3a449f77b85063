"""Binned regulator features and the moments that stump boosting needs.

A *feature* is one (regulator, bin) pair, numbered ``f`` over all regulators in name order. A missing
(zero) regulator value belongs to no feature. With squared loss a stump fit depends on the data only
through

* ``y(target, f)``  - sum of the target over the cells of a feature,
* ``n(f)``          - number of its cells,

so the first round's gains need no residuals (:mod:`regweave.plans.first_round`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regweave.operators.ordering import position_by_range
from regweave.operators.skew import salted_join, spread
from regweave.session import write_once

BINS_PER_RANGE = 65_536


@dataclass(frozen=True)
class Binned:
    """``cells``: (cell, f, ridx, bin); ``features``: (f, ridx, bin, threshold, regulator)."""

    cells: DataFrame
    features: DataFrame
    regulators: DataFrame


def quantile_bounds(reg: DataFrame, max_bin: int) -> DataFrame:
    """``ridx, uppers``: at most ``max_bin + 1`` ascending upper bounds for regulators of more distinct values.

    The bounds come from a mergeable sketch, so no list of distinct values is ever gathered.
    """
    distinct = reg.groupBy("ridx", "value").agg(F.count(F.lit(1)).alias("_c"))
    wide = distinct.groupBy("ridx").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > max_bin).select("ridx")
    levels = [(i + 1) / max_bin for i in range(max_bin)]
    return (
        reg.join(wide, "ridx", "left_semi")
        .groupBy("ridx")
        .agg(F.percentile_approx("value", levels, 20 * max_bin).alias("q"), F.max("value").alias("top"))
        .select("ridx", F.array_sort(F.array_distinct(F.array_append("q", F.col("top")))).alias("uppers"))
    )


def bin_regulators(values: DataFrame, regulators: DataFrame, max_bin: int | None) -> Binned:
    """Assign a bin to every stored regulator value. ``regulators`` is ``(regulator, ridx)``.

    Without ``max_bin`` every distinct value is a bin. The distinct (regulator, value) pairs are numbered by a range
    partition and partition counts, and a value finds its number by an equi-join, so neither one regulator's values nor
    their number meet in one row or task. With ``max_bin`` regulators of more values use quantile bounds: a value is
    first replaced by the upper bound of its bin.
    """
    reg = values.join(regulators.withColumnRenamed("regulator", "gene"), "gene").select("ridx", "cell", "value")
    reg = reg.withColumn("upper", F.col("value"))
    if max_bin is not None:
        reg = write_once(reg, "regulator-values")
        bounds = write_once(quantile_bounds(reg, max_bin), "bin-bounds")
        found = F.element_at(F.filter("uppers", lambda u: u >= F.col("value")), 1)
        reg = reg.join(bounds, "ridx", "left").select("ridx", "cell", F.coalesce(found, "value").alias("upper"))
    reg = write_once(reg.select("ridx", "cell", "upper"), "regulator-bounds")
    distinct = reg.select("ridx", "upper").distinct().withColumn("_key", F.struct("ridx", "upper"))
    numbered = write_once(position_by_range(distinct, "_key", "f").select("ridx", "upper", "f"), "bin-numbers")
    first = numbered.groupBy("ridx").agg(F.min("f").alias("_first"))
    placed = numbered.join(first, "ridx").select(
        F.col("f").cast("int").alias("f"), "ridx", (F.col("f") - F.col("_first") + 1).cast("int").alias("bin"), F.col("upper").alias("threshold")
    )
    features = write_once(placed.join(regulators, "ridx"), "features")
    own = features.select("f", "ridx", "bin", F.col("threshold").alias("upper"))
    cells = reg.join(own, ["ridx", "upper"]).select("cell", "f", "ridx", "bin")
    return Binned(write_once(cells, "binned-cells"), features, regulators)


def running_counts(binned: Binned) -> DataFrame:
    """``f, ridx, bin, n, upto``: cells per feature, and cells of the regulator up to its bin.

    Running sums go over ranges of bins first and then inside a range, so a regulator of very many bins is not summed
    in one task.
    """
    n = binned.cells.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    counted = binned.features.select("f", "ridx", "bin").join(n, "f").withColumn("_range", F.floor(F.col("bin") / BINS_PER_RANGE))
    counted = write_once(counted, "feature-counts")
    earlier = Window.partitionBy("ridx").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("ridx", "_range").agg(F.sum("n").alias("_n"))
    offsets = sums.select("ridx", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("ridx", "_range").orderBy("bin"))
    return counted.withColumn("_in", inside).join(offsets, ["ridx", "_range"]).select("f", "ridx", "bin", "n", (F.col("_in") + F.col("_before")).alias("upto"))


def target_moments(
    values: DataFrame, groups: DataFrame, binned: Binned, nr_features: int, nr_groups: int, nr_targets: int
) -> DataFrame:
    """``tid, grp, f, y``: sums of each target over the cells of each feature, by cell group.

    ``values`` is ``(tid, cell, value)``. Pairs are summed map-side inside the join stage under one packed
    long key, so the shuffle carries at most one row per (target, group, feature) and task, never the
    pairs themselves. The cell group travels with the smaller regulator side.
    """
    x = binned.cells.join(groups, "cell").select("cell", (F.col("grp").cast("long") * nr_features + F.col("f")).alias("gf"))
    width = nr_features * nr_groups
    return (
        salted_join(spread(values, "tid", "cell"), x, "cell", "tid", nr_targets * binned.regulators.count())
        .groupBy((F.col("tid") * width + F.col("gf")).alias("k"))
        .agg(F.sum("value").alias("y"))
        .select(
            F.expr(f"k div {width}").alias("tid"),
            F.expr(f"cast((k % {width}) div {nr_features} as int)").alias("grp"),
            F.expr(f"cast(k % {nr_features} as int)").alias("f"),
            "y",
        )
    )
