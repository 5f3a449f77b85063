"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def turn_angle(a: Point, b: Point, c: Point) -> Column:
    """Angle at ``b`` between the directions to ``a`` and to ``c``, in radians.

    The cosine is clamped to [-1, 1], so rounding never turns a straight line into NaN; degenerate
    points give null.
    """
    ux, uy = a[0] - b[0], a[1] - b[1]
    vx, vy = c[0] - b[0], c[1] - b[1]
    norms = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.try_divide(ux * vx + uy * vy, norms)
    return F.when(cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def challenge_score(df: DataFrame, p_roc: str = "p_roc", p_pr: str = "p_pr") -> DataFrame:
    """Overall network score: mean of -log10 over both p-value columns."""
    return df.agg(
        (-(F.sum(F.log10(p_roc)) + F.sum(F.log10(p_pr))) / (2 * F.count(F.lit(1)))).alias("score")
    )


def quote_delimiter(delimiter: str) -> str:
    """Regular expression that matches the delimiter literally."""
    return "\\Q" + delimiter + "\\E"


def split_line(line: Column, delimiter: str, regex: bool = False) -> Column:
    """Trimmed fields of a delimited line."""
    parts = F.split(line, delimiter if regex else quote_delimiter(delimiter))
    return F.transform(parts, lambda x: F.trim(x))


def parse_eval_line(line: Column, metric: str = "rmse") -> tuple[Column, Column]:
    """(train, test) loss out of a booster evaluation line ``[i]<TAB>train-rmse:x<TAB>test-rmse:y``."""

    def get(part: str) -> Column:
        return F.regexp_extract(line, rf"(?:^|\t){part}-{metric}:([^\t]+)", 1).try_cast("double")

    return get("train"), get("test")


def parse_split_line(line: Column) -> Column:
    """Struct ``feature, threshold, gain, cover`` of a tree-dump split line; null for leaves."""
    feature = F.regexp_extract(line, r"\[f(\d+)<", 1).try_cast("int")
    threshold = F.regexp_extract(line, r"<([^\]]+)\]", 1).try_cast("double")
    gain = F.regexp_extract(line, r",gain=([^,]+)", 1).try_cast("double")
    cover = F.regexp_extract(line, r",cover=([^,]+)", 1).try_cast("double")
    return F.when(
        feature.isNotNull(),
        F.struct(
            feature.alias("feature"), threshold.alias("threshold"), gain.alias("gain"), cover.alias("cover")
        ),
    )
