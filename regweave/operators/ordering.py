"""Exact global positions without a single-partition window over the data.

A plain ``row_number() over (order by x)`` moves every row into one task. Here rows are first put in
coarse buckets that respect the order; only the bucket counts (at most ``2**16`` for hashes) are
accumulated globally, and rows are numbered inside their bucket in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave.session import write_once


def position_in_order(df: DataFrame, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add the 0-based position of each row in the order (bucket, *order)."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        rows.withColumn("_local", local)
        .join(offsets, "_bucket")
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def hash_position(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Position in a seeded pseudo-random order: the distributed form of a shuffle."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return position_in_order(df, F.shiftright(h, 48), [h, F.col(key)], out)


def position_by_range(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """Position in the order of any sortable key, however its values are spread.

    Rows are range-partitioned by sampled bounds and stored, so that the partition is fixed; only the
    partition counts are accumulated globally.
    """
    kept = write_once(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranged")
    return position_in_order(kept, F.col("_part"), [F.col(key)], out).drop("_part")


def id_position(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """Position in the order of an integer id (dense re-indexing); sparse ids cost nothing extra."""
    return position_by_range(df, key, out)
