"""A bounded, seeded sample of labelled documents: what classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bound: at most this many labelled documents are used to fit a classifier.
MAX_LABELLED = 20_000


def label_sample(labels: DataFrame, column: str, worst: str, limit: int = MAX_LABELLED, where=None) -> DataFrame:
    """``doc_id, y``: one 0/1 label per document, at most ``limit`` documents in a seeded hash order.

    Null ids and null labels are left out. A document labelled more than once takes its ``worst`` label
    ("min" or "max").
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna()
    if where is not None:
        rows = rows.filter(where)
    pick = F.min if worst == "min" else F.max
    return rows.groupBy("doc_id").agg(pick("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(limit)
