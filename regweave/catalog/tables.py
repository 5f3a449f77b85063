"""Expression tables and edge lists derived from the driver tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.operators.matrix import Expression

REGULATOR_MAX_SIZE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts_expression(spark: SparkSession, sf_dir: str) -> Expression:
    """Parts as genes, suppliers as cells, ordered quantity as expression."""
    values = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").alias("cell"))
        .agg(F.sum("l_quantity").alias("value"))
        .filter(F.col("value") != 0)
    )
    return Expression(values, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")))


def part_regulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regulators: parts of the smallest sizes."""
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_size") <= REGULATOR_MAX_SIZE)
        .select(F.col("p_partkey").cast("string").alias("gene"))
    )


def events_expression(spark: SparkSession, sf_dir: str) -> Expression:
    """Event types as genes, users as cells, event counts as expression."""
    events = table(spark, sf_dir, "events")
    values = events.groupBy(F.col("event_type").alias("gene"), F.col("user_id").alias("cell")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return Expression(values, events.select(F.col("user_id").alias("cell")).distinct())


def embedding_expression(spark: SparkSession, sf_dir: str) -> Expression:
    """Embedding positions as genes, vectors as cells: a dense matrix with negative values."""
    emb = table(spark, sf_dir, "embeddings")
    values = (
        emb.select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("p", "v"))
        .select(F.format_string("g%03d", "p").alias("gene"), "cell", F.col("v").cast("double").alias("value"))
        .filter(F.col("value") != 0)
    )
    return Expression(values, emb.select(F.col("vec_id").alias("cell")))


def token_expression(spark: SparkSession, sf_dir: str) -> Expression:
    """Tokens as genes, documents as cells, term counts as expression; whole texts."""
    docs = table(spark, sf_dir, "documents")
    values = (
        docs.select(F.col("doc_id").alias("cell"), F.explode(F.split(F.lower("text"), "[ \\n\\t.,]+")).alias("gene"))
        .filter(F.col("gene") != "")
        .groupBy("gene", "cell")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    return Expression(values, docs.select(F.col("doc_id").alias("cell")))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain edge list: supplier nation -> part, weighted by revenue."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", "l_extendedprice")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("regulator"), F.col("l_partkey").cast("string").alias("target"))
        .agg(F.sum("l_extendedprice").alias("gain"))
    )


SQL_PARTS = """
expr AS (
  SELECT CAST(l_partkey AS VARCHAR) AS gene, l_suppkey AS cell, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
cells AS (SELECT s_suppkey AS cell FROM supplier),
cand AS (SELECT CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_size <= 2),
regs AS (
  SELECT gene AS regulator, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS ridx
  FROM (SELECT DISTINCT gene FROM cand WHERE gene IN (SELECT gene FROM expr)))
"""

SQL_EVENTS = """
expr AS (SELECT event_type AS gene, user_id AS cell, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
cells AS (SELECT DISTINCT user_id AS cell FROM events)
"""

SQL_EMBED = """
expr AS (
  SELECT format('g{:03d}', p - 1) AS gene, cell, value FROM (
    SELECT vec_id AS cell, unnest(range(1, len(embedding) + 1)) AS p, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
  WHERE value <> 0),
cells AS (SELECT vec_id AS cell FROM embeddings)
"""

SQL_EDGES = """
edges AS (
  SELECT n_name AS regulator, CAST(l_partkey AS VARCHAR) AS target, sum(l_extendedprice) AS gain
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)
"""


def sql_streaks(source: str, grp: str, order: str, value: str, x_scale: int) -> str:
    """CTEs ``marked``: rows of ``source`` with idx, n, theta and the group's elbow index."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER g AS n, lead({value}) OVER w AS nxt,
         last_value({value}) OVER (PARTITION BY {grp} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lst,
         min({value}) OVER g AS mn, max({value}) OVER g AS mx
  FROM {source} WINDOW w AS (PARTITION BY {grp} ORDER BY {order}), g AS (PARTITION BY {grp})),
legs AS (
  SELECT *, -1.0 AS ux, ({value} - nxt) / nullif(mx - mn, 0) AS uy,
         n * {x_scale} - (idx + 1) AS vx, (lst - nxt) / nullif(mx - mn, 0) AS vy FROM ranked),
turned AS (
  SELECT *, CASE WHEN uy IS NOT NULL THEN
    acos(greatest(-1.0, least(1.0, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))))) END AS theta FROM legs),
flagged AS (SELECT *, coalesce(abs(theta - pi()) < 0.001, false) AS straight FROM turned),
runs AS (
  SELECT *, sum(CASE WHEN straight THEN 1 ELSE 0 END) OVER (PARTITION BY {grp} ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM flagged),
marked AS (
  SELECT *, min(CASE WHEN run = 3 AND n >= 4 THEN idx END) OVER (PARTITION BY {grp}) AS elbow FROM runs)
"""


SQL_LABELLED = (
    SQL_EDGES
    + ","
    + sql_streaks("edges", "target", "gain DESC, regulator", "gain", 3)
    + """,
labelled AS (
  SELECT regulator, target, gain, CAST(CASE WHEN elbow IS NULL OR idx < elbow - 2 THEN 1 ELSE 0 END AS INTEGER) AS include FROM marked)
"""
)
