"""Operators on edge tables ``regulator, target, gain [, include]``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave import constants as C
from regweave.functions.scalar import turn_angle


def min_max_scaled(edges: DataFrame, group: str = "target", value: str = "gain", out: str = "scaled") -> DataFrame:
    """Add ``(value - min) / (max - min)`` of the group; null for a constant group."""
    span = edges.groupBy(group).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    scaled = F.try_divide(F.col(value) - F.col("_mn"), F.col("_mx") - F.col("_mn"))
    return edges.join(span, group).withColumn(out, scaled).drop("_mn", "_mx")


def with_turns(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: str,
    x_scale: float = C.ELBOW_X_SCALE,
) -> DataFrame:
    """Add ``idx`` (0-based), ``n`` and the turn angle ``theta`` at the successor of every point.

    All windows share one partitioning, so this costs one exchange and one sort. A group is one
    target's edge list (at most one row per regulator) or one loss curve (one row per round).
    """
    ordered = Window.partitionBy(*group).orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    span = F.col("_max") - F.col("_min")

    def scaled(c: Column) -> Column:
        return F.try_divide(c - F.col("_min"), span)

    staged = (
        df.withColumn("idx", (F.row_number().over(ordered) - 1).cast("int"))
        .withColumn("n", F.count(F.lit(1)).over(whole).cast("int"))
        .withColumn("_next", F.lead(value).over(ordered))
        .withColumn("_last", F.last(value).over(whole))
        .withColumn("_min", F.min(value).over(whole))
        .withColumn("_max", F.max(value).over(whole))
    )
    theta = turn_angle(
        (F.col("idx").cast("double"), scaled(F.col(value))),
        (F.col("idx").cast("double") + 1, scaled(F.col("_next"))),
        (F.col("n").cast("double") * x_scale, scaled(F.col("_last"))),
    )
    return staged.withColumn("theta", theta).drop("_next", "_last", "_min", "_max")


def with_streaks(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: str,
    precision: float = C.ELBOW_PRECISION,
    x_scale: float = C.ELBOW_X_SCALE,
    streak: int = C.ELBOW_STREAK,
) -> DataFrame:
    """Add ``straight`` and ``elbow``: the first index that ends ``streak`` straight turns, or null."""
    recent = Window.partitionBy(*group).orderBy("idx").rowsBetween(-(streak - 1), 0)
    whole = Window.partitionBy(*group)
    straight = F.coalesce(F.abs(F.col("theta") - F.lit(3.141592653589793)) < precision, F.lit(False))
    ends = (F.col("_run") == streak) & (F.col("n") >= C.ELBOW_MIN_POINTS)
    return (
        with_turns(df, group, order, value, x_scale)
        .withColumn("straight", straight)
        .withColumn("_run", F.sum(F.col("straight").cast("int")).over(recent))
        .withColumn("elbow", F.min(F.when(ends, F.col("idx"))).over(whole))
        .drop("_run")
    )


def elbow_points(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: str,
    precision: float = C.ELBOW_PRECISION,
    x_scale: float = C.ELBOW_X_SCALE,
    streak: int = C.ELBOW_STREAK,
) -> DataFrame:
    """The row at the elbow of every group that has one."""
    marked = with_streaks(df, group, order, value, precision, x_scale, streak)
    return marked.filter(F.col("idx") == F.col("elbow")).drop("theta", "straight", "n", "idx")


def gain_order() -> list[Column]:
    """Gain descending with a deterministic tie-break."""
    return [F.desc("gain"), F.asc("regulator"), F.asc("target")]


def with_labels(
    edges: DataFrame,
    precision: float | None = C.ELBOW_PRECISION,
    streak: int = C.ELBOW_STREAK,
    x_scale: float = C.ELBOW_LABEL_X_SCALE,
    group: Sequence[str] = ("target",),
) -> DataFrame:
    """Set ``include``: 1 before the elbow of the target's sorted gains, 0 from there, all 1 without
    an elbow. ``precision=None`` leaves everything included."""
    if precision is None:
        return edges.withColumn("include", F.lit(1))
    marked = with_streaks(edges, group, gain_order(), "gain", precision, x_scale, streak)
    cut = F.col("elbow") - (streak - 1)
    include = F.when(F.col("elbow").isNull() | (F.col("idx") < cut), 1).otherwise(0)
    return marked.withColumn("include", include).drop("idx", "n", "theta", "straight", "elbow")


def included(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("include") == 1)


def normalize(
    edges: DataFrame,
    agg: Callable[[Column], Column] = F.sum,
    group: Sequence[str] = ("target",),
    skew_safe: bool = False,
) -> DataFrame:
    """Divide each gain by an aggregate of its target's gains.

    The default is a window, which is free after :func:`with_labels` (same partitioning).
    ``skew_safe`` aggregates map-side first and joins the per-target totals back, which never gathers
    a target's edges in one task; use it on stored edge lists where one target may dominate.
    """
    if skew_safe:
        totals = edges.groupBy(*group).agg(agg(F.col("gain")).alias("_total"))
        out = edges.join(totals, list(group))
    else:
        out = edges.withColumn("_total", agg(F.col("gain")).over(Window.partitionBy(*group)))
    gain = F.try_divide(F.col("gain"), F.col("_total").cast("double"))
    return out.withColumn("gain", gain).drop("_total").select(*edges.columns)


def truncate(edges: DataFrame, n: int | None) -> DataFrame:
    """The n strongest edges overall (plans as TakeOrderedAndProject)."""
    return edges if n is None else edges.orderBy(*gain_order()).limit(n)


def sort_by_gain(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*gain_order())


def sort_by_names(edges: DataFrame) -> DataFrame:
    return edges.orderBy("regulator", "target", F.desc("gain"))


def gain_rollup(edges: DataFrame) -> DataFrame:
    """Spread, total and maximum of gains per target and overall (target null)."""
    return edges.rollup("target").agg(
        F.stddev("gain").alias("stddev_gain"), F.sum("gain").alias("sum_gain"), F.max("gain").alias("max_gain")
    )


def postprocess(
    edges: DataFrame,
    precision: float | None = C.ELBOW_PRECISION,
    regularized: bool = False,
    normalized: bool = False,
    truncated: int | None = None,
    sort: bool = True,
    group: Sequence[str] = ("target",),
) -> DataFrame:
    """Label, optionally filter, normalize, truncate and sort, in that order.

    Normalization comes after the inclusion filter, so totals cover included edges only. A truncated
    result is already ordered and is not sorted a second time.
    """
    out = with_labels(edges, precision, group=group)
    if regularized:
        out = included(out)
    if normalized:
        out = normalize(out, group=group)
    if truncated is not None:
        return truncate(out, truncated)
    return sort_by_gain(out) if sort else out
