"""Post-processing of edge lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog.registry import query
from regweave.catalog.tables import SQL_EDGES, SQL_LABELLED, nation_edges, sql_streaks, table
from regweave.functions.scalar import challenge_score
from regweave.operators import edges as E


@query(
    "edge_labels",
    f"WITH {SQL_LABELLED} SELECT regulator, target, round(gain, 2) AS gain, include FROM labelled",
)
def edge_labels(spark, sf):
    return E.with_labels(nation_edges(spark, sf)).select("regulator", "target", F.round("gain", 2).alias("gain"), "include")


@query(
    "turn_angles",
    f"""WITH {SQL_EDGES}, {sql_streaks("edges", "target", "gain DESC, regulator", "gain", 10)}
    SELECT regulator, target, CAST(idx AS INTEGER) AS idx, round(theta, 5) AS theta FROM marked""",
)
def turn_angles(spark, sf):
    out = E.with_turns(nation_edges(spark, sf), ["target"], E.gain_order(), "gain")
    return out.select("regulator", "target", "idx", F.round("theta", 5).alias("theta"))


@query(
    "elbow_points",
    f"""WITH {SQL_EDGES}, {sql_streaks("edges", "target", "gain DESC, regulator", "gain", 10)}
    SELECT target, CAST(min(elbow) AS INTEGER) AS elbow FROM marked GROUP BY target HAVING min(elbow) IS NOT NULL""",
)
def elbow_points(spark, sf):
    return E.elbow_points(nation_edges(spark, sf), ["target"], E.gain_order(), "gain").select("target", "elbow")


@query(
    "included_edges",
    f"WITH {SQL_LABELLED} SELECT regulator, target, round(gain, 2) AS gain FROM labelled WHERE include = 1",
)
def included_edges(spark, sf):
    out = E.included(E.with_labels(nation_edges(spark, sf)))
    return out.select("regulator", "target", F.round("gain", 2).alias("gain"))


@query(
    "normalized_by_sum",
    f"""WITH {SQL_EDGES} SELECT regulator, target, round(gain / sum(gain) OVER (PARTITION BY target), 6) AS gain FROM edges""",
)
def normalized_by_sum(spark, sf):
    return E.normalize(nation_edges(spark, sf), skew_safe=True).withColumn("gain", F.round("gain", 6))


@query(
    "normalized_by_max",
    f"""WITH {SQL_EDGES} SELECT regulator, target, round(gain / max(gain) OVER (PARTITION BY target), 6) AS gain FROM edges""",
)
def normalized_by_max(spark, sf):
    return E.normalize(nation_edges(spark, sf), F.max).withColumn("gain", F.round("gain", 6))


@query(
    "min_max_scaled",
    f"""WITH {SQL_EDGES}, s AS (SELECT *, min(gain) OVER (PARTITION BY target) AS mn, max(gain) OVER (PARTITION BY target) AS mx FROM edges)
    SELECT regulator, target, round((gain - mn) / nullif(mx - mn, 0), 6) AS scaled FROM s""",
)
def min_max_scaled(spark, sf):
    return E.min_max_scaled(nation_edges(spark, sf)).select("regulator", "target", F.round("scaled", 6).alias("scaled"))


@query(
    "top_edges",
    f"WITH {SQL_EDGES} SELECT regulator, target, round(gain, 2) AS gain FROM edges ORDER BY gain DESC, regulator, target LIMIT 1000",
)
def top_edges(spark, sf):
    return E.truncate(nation_edges(spark, sf), 1000).withColumn("gain", F.round("gain", 2))


@query("edges_by_gain", f"WITH {SQL_EDGES} SELECT regulator, target, round(gain, 2) AS gain FROM edges ORDER BY gain DESC")
def edges_by_gain(spark, sf):
    return E.sort_by_gain(nation_edges(spark, sf)).withColumn("gain", F.round("gain", 2))


@query(
    "edges_by_names",
    f"WITH {SQL_EDGES} SELECT regulator, target, round(gain, 2) AS gain FROM edges ORDER BY regulator, target, gain DESC",
)
def edges_by_names(spark, sf):
    return E.sort_by_names(nation_edges(spark, sf)).withColumn("gain", F.round("gain", 2))


@query(
    "gain_rollup",
    f"""WITH {SQL_EDGES} SELECT target, round(stddev(gain), 3) AS stddev_gain, round(sum(gain), 2) AS sum_gain,
    round(max(gain), 2) AS max_gain FROM edges GROUP BY ROLLUP (target)""",
)
def gain_rollup(spark, sf):
    return E.gain_rollup(nation_edges(spark, sf)).select(
        "target",
        F.round("stddev_gain", 3).alias("stddev_gain"),
        F.round("sum_gain", 2).alias("sum_gain"),
        F.round("max_gain", 2).alias("max_gain"),
    )


@query(
    "postprocessed_edges",
    f"""WITH {SQL_LABELLED}, norm AS (
      SELECT regulator, target, gain / sum(gain) OVER (PARTITION BY target) AS gain, include FROM labelled WHERE include = 1)
    SELECT regulator, target, round(gain, 6) AS gain, include FROM norm""",
)
def postprocessed_edges(spark, sf):
    out = E.postprocess(nation_edges(spark, sf), regularized=True, normalized=True)
    return out.withColumn("gain", F.round("gain", 6)).select("regulator", "target", "gain", "include")


@query(
    "challenge_score",
    """SELECT round(-(sum(log10(p_roc)) + sum(log10(p_pr))) / (2 * count(*)), 6) AS score FROM (
      SELECT 1 / (1 + o_totalprice) AS p_roc, 1 / (2 + o_custkey) AS p_pr FROM orders)""",
)
def score_over_orders(spark, sf):
    p = table(spark, sf, "orders").select(
        (1 / (1 + F.col("o_totalprice"))).alias("p_roc"), (1 / (2 + F.col("o_custkey"))).alias("p_pr")
    )
    return challenge_score(p).select(F.round("score", 6).alias("score"))
