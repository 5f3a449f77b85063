"""Equi-joins that stay balanced when single keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEY_PAIRS = 20_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for work that grows per row: re-partition inputs of fewer partitions than cores.

    Large inputs already have more partitions than that and pass through without a shuffle. The hash
    covers all given keys, so one hot key does not end up in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)


def salted_join(
    big: DataFrame,
    other: DataFrame,
    key: str,
    spread_by: str,
    bound: int | None = None,
    pairs_per_salt: int = HOT_KEY_PAIRS,
) -> DataFrame:
    """Inner join on ``key`` where keys that make more than ``pairs_per_salt`` pairs are split.

    What makes a key hot is the product of its rows on both sides. The table of hot keys has at most
    ``pairs / pairs_per_salt`` entries. Rows of ``big`` with a hot key are spread by a hash of
    ``spread_by``; the matching rows of ``other`` are repeated once per salt. No row is dropped.
    ``bound`` is a proven limit on the pairs of a key (a cell holds at most one entry per gene and side);
    where it rules out hot keys the plain join is planned and the counting pass saved.
    """
    if bound is not None and bound <= pairs_per_salt:
        return big.join(other, key)
    left_rows = big.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    right_rows = other.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    pairs = F.col("_a").cast("double") * F.col("_b")
    hot = (
        left_rows.join(right_rows, key)
        .filter(pairs > pairs_per_salt)
        .select(key, F.least(F.ceil(pairs / pairs_per_salt), F.col("_a")).cast("int").alias("_salts"))
    )
    left = (
        big.join(hot, key, "left")
        .withColumn(
            "_salt",
            F.when(
                F.col("_salts").isNotNull(),
                F.pmod(F.xxhash64(F.col(spread_by)), F.col("_salts").cast("long")),
            )
            .otherwise(F.lit(0))
            .cast("int"),
        )
        .drop("_salts")
    )
    right = (
        other.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.join(right, [key, "_salt"]).drop("_salt")
