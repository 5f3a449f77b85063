"""Seeded draws of rows by a portable permutation of integers, the same in Spark, numpy and SQL.

A position ``x`` gets the key ``a * (x + b)**5 mod PRIME`` with ``a`` and ``b`` from seed, stream and round. 5 does not
divide PRIME - 1, so this is a permutation of 0 .. PRIME - 1 and no two positions share a key; all products stay below
2**62. A draw of k out of n rows takes the k smallest keys (rank selection), so any fraction is met exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regweave.operators.ordering import position_by_range, position_in_order

PRIME = 2_147_483_647
ROWS, COLUMNS, FOLDS, SAMPLES, GENES, TIES = range(6)  # streams: one per purpose
_BUCKET = 1 << 15


def constants(seed: int, stream: int, round_nr: int = 0) -> tuple[int, int]:
    a = 1 + (seed * 7919 + stream * 104_729 + round_nr * 1_299_709 + 12_345) % (PRIME - 1)
    b = (seed * 15_485_863 + stream * 32_452_843 + round_nr * 49_979_687 + 67_890) % PRIME
    return a, b


def draw_key(x: Column, seed: int, stream: int, round_nr: int | Column = 0) -> Column:
    """The key of a position (0-based, below PRIME)."""
    if isinstance(round_nr, Column):
        r = round_nr.cast("long")
        a = F.lit(1) + F.pmod(F.lit(seed * 7919 + stream * 104_729 + 12_345) + r * 1_299_709, F.lit(PRIME - 1))
        b = F.pmod(F.lit(seed * 15_485_863 + stream * 32_452_843 + 67_890) + r * 49_979_687, F.lit(PRIME))
    else:
        a, b = map(F.lit, constants(seed, stream, round_nr))
    u = (x.cast("long") + b) % PRIME
    square = (u * u) % PRIME
    return ((((square * square) % PRIME) * u) % PRIME * a) % PRIME


def draw_keys(x: np.ndarray, seed: int, stream: int, round_nr: int = 0) -> np.ndarray:
    a, b = constants(seed, stream, round_nr)
    u = (x.astype(np.int64) + b) % PRIME
    square = u * u % PRIME
    return square * square % PRIME * u % PRIME * a % PRIME


def draw_sql(x: str, seed: int, stream: int, round_nr: int | str = 0) -> str:
    """The key as an SQL expression; ``round_nr`` may be one too."""
    if isinstance(round_nr, str):
        a = f"(1 + ({seed * 7919 + stream * 104_729 + 12_345} + {round_nr} * 1299709) % {PRIME - 1})"
        b = f"(({seed * 15_485_863 + stream * 32_452_843 + 67_890} + {round_nr} * 49979687) % {PRIME})"
    else:
        a, b = constants(seed, stream, round_nr)
    u = f"((CAST({x} AS BIGINT) + {b}) % {PRIME})"
    square = f"({u} * {u} % {PRIME})"
    return f"(({square} * {square} % {PRIME}) * {u} % {PRIME} * {a} % {PRIME})"


def name_number(name: Column) -> Column:
    """A number below 2**28 from a name: a round of its own for every gene."""
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long")


def name_number_sql(name: str) -> str:
    return f"CAST('0x' || substr(md5({name}), 1, 7) AS BIGINT)"


def shuffled(df: DataFrame, key: str, seed: int, stream: int, out: str = "position") -> DataFrame:
    """The rank of every row's key: a seeded shuffle. ``key`` (distinct) gives the positions the keys are made of."""
    placed = position_by_range(df, key, "_pos").withColumn("_draw", draw_key(F.col("_pos"), seed, stream))
    return position_in_order(placed, F.shiftright("_draw", 15), [F.col("_draw")], out).drop("_pos", "_draw")


def shuffled_sql(source: str, key: str, seed: int, stream: int) -> str:
    """``source`` with a column ``position``: the same shuffle."""
    return f"""(SELECT * EXCLUDE (_pos), row_number() OVER (ORDER BY {draw_sql("_pos", seed, stream)}) - 1 AS position
    FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS _pos FROM {source}))"""


def sample_size(fraction: float, n: int) -> int:
    """Rows drawn out of n: the whole part, at least one."""
    return max(1, int(fraction * n + 1e-9))


def draw_limits(positions: DataFrame, sizes: dict[int, int], seed: int, stream: int, rounds: Sequence[int]) -> dict[tuple[int, int], int]:
    """(group, round) -> the largest key drawn, where ``sizes[group]`` rows are drawn from each group.

    ``positions``: group, pos. The key of that rank is found in Spark: counts per key range first, then the keys of
    the one range that holds the rank. One number per group and round reaches the driver.
    """
    if not rounds or not sizes:
        return {}
    spark = positions.sparkSession
    wanted = spark.createDataFrame([(int(g), int(k)) for g, k in sizes.items()], "group int, k long")
    turns = F.explode(F.array(*[F.lit(int(r)) for r in rounds])) if len(rounds) < 64 else F.explode(F.sequence(F.lit(int(min(rounds))), F.lit(int(max(rounds)))))
    keyed = positions.select(F.col("group").cast("int").alias("group"), "pos").withColumn("round", turns)
    keyed = keyed.withColumn("key", draw_key(F.col("pos"), seed, stream, F.col("round"))).withColumn("bucket", F.floor(F.col("key") / _BUCKET))
    order = Window.partitionBy("group", "round").orderBy("bucket")
    counts = keyed.groupBy("group", "round", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(wanted), "group")
    hit = running.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    hit = hit.select("group", "round", "bucket", (F.col("k") - F.col("upto") + F.col("n")).cast("int").alias("rank"))
    found = (
        keyed.join(hit, ["group", "round", "bucket"])
        .groupBy("group", "round", "rank")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
        .select("group", "round", F.element_at("keys", F.col("rank")).alias("limit"))
    )
    return {(r["group"], r["round"]): r["limit"] for r in found.collect()}
