"""Target-count sweep: wall time of inference for growing numbers of targets, one JSON line.

A synthetic matrix, as dense and as wide as ``SWEEP_CELLS`` and ``SWEEP_GENES`` say, 25 rounds, eta 0.2, subsample 0.8,
colsample 0.7, gamma 2. ``SWEEP_TARGETS`` lists the counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from regweave.operators.matrix import Expression
from regweave.params import BoostParams
from regweave.plans import infer as INF

CELLS = int(os.environ.get("SWEEP_CELLS", "3005"))
GENES = int(os.environ.get("SWEEP_GENES", "19972"))
REGULATORS = int(os.environ.get("SWEEP_REGULATORS", "1000"))
DENSITY = float(os.environ.get("SWEEP_DENSITY", "0.2"))
COUNTS = [int(n) for n in os.environ.get("SWEEP_TARGETS", "1,5,10,25,100,250,1000,2500,10000,19972").split(",")]


def matrix(spark: SparkSession) -> Expression:
    """Counts with few distinct values, as in single-cell data; the same on every run."""
    grid = spark.range(GENES).select(F.format_string("g%05d", "id").alias("gene"), F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    draw = F.pmod(F.xxhash64("gene", "cell"), F.lit(1_000_000)) / 1_000_000
    value = F.ceil(-F.log(draw / DENSITY + 1e-9) * 2)
    entries = grid.filter(draw < DENSITY).select("gene", "cell", F.greatest(value, F.lit(1)).cast("double").alias("value"))
    return Expression(entries, spark.range(CELLS).select(F.col("id").cast("int").alias("cell")))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="regweave-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    expr = matrix(spark).store()
    names = expr.genes().filter(F.col("gene") < f"g{REGULATORS:05d}")
    params = BoostParams(eta=0.2, subsample=0.8, colsample_bytree=0.7, gamma=2, seed=777)
    seconds = {}
    for count in COUNTS:
        start = time.perf_counter()
        targets = [f"g{i:05d}" for i in range(min(count, GENES))]
        log = INF.infer_splits(INF.prepare(expr, names, targets), params, 25)
        INF.edges_after(log).write.format("noop").mode("overwrite").save()
        seconds[count] = round(time.perf_counter() - start, 1)
        print(json.dumps({"metric": "wall time by target count", "unit": "sec", "targets": seconds, "cells": CELLS, "genes": GENES}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
