"""Vector columns: assembling scalars and interaction products."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(*columns: str) -> Column:
    """Numeric columns as one array of doubles."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def interact(*vectors: Column) -> Column:
    """All products of one element from each vector, the last vector varying fastest."""

    def times(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: x * y)))

    return reduce(times, vectors)


def assemble_ml(df: DataFrame, columns: Sequence[str], out: str = "expression") -> DataFrame:
    """The same as :func:`assemble`, as a Spark ML vector column."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)
