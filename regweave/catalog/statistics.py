"""Ranks, correlations, vectors and parsed learner output."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog.registry import query
from regweave.catalog.tables import (
    SQL_EMBED,
    SQL_EVENTS,
    SQL_PARTS,
    embedding_expression,
    events_expression,
    part_regulators,
    parts_expression,
    table,
    token_expression,
)
from regweave.functions.vectors import assemble, interact
from regweave.constants import DEFAULT_RANK_SEED
from regweave.operators import correlation as R
from regweave.operators import draws
from regweave.operators import select as S
from regweave.operators.importance import dump_importance, importance, parse_dump, parse_losses
from regweave.operators.matrix import cell_major, pack, unpack

SQL_PEARSON = """
st AS (SELECT gene, sum(value) AS s, sum(value * value) AS ss FROM vals GROUP BY gene),
xy AS (SELECT x.gene AS tf, y.gene AS gene, sum(x.value * y.value) AS xy FROM vals x JOIN regs ON x.gene = regulator JOIN vals y USING (cell) GROUP BY 1, 2),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
corr AS (
  SELECT t.gene AS tf, g.gene, coalesce(xy, 0) - t.s * g.s / n AS cov,
         sqrt(greatest(t.ss - t.s * t.s / n, 0)) * sqrt(greatest(g.ss - g.s * g.s / n, 0)) AS spread
  FROM st t JOIN regs ON t.gene = regulator CROSS JOIN st g CROSS JOIN n LEFT JOIN xy ON xy.tf = t.gene AND xy.gene = g.gene)
"""

SQL_AVG_RANKS = """
dense AS (
  SELECT g.gene, c.cell, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN cells c
  LEFT JOIN expr e ON e.gene = g.gene AND e.cell = c.cell),
vals AS (
  SELECT gene, cell, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS value FROM dense)
"""


@query(
    "average_ranks",
    f"""WITH {SQL_EMBED}, {SQL_AVG_RANKS}, i AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic FROM cells)
    SELECT gene, CAST(ic AS BIGINT) AS cell, CAST(value AS DOUBLE) AS rank FROM vals JOIN i USING (cell)""",
)
def average_ranks(spark, sf):
    expr = embedding_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    return R.to_rankings(S.slice_cells(expr.values, indexed), indexed.count(), ties="average")


@query(
    "shuffled_ranks",
    f"""WITH {SQL_EVENTS}, {SQL_AVG_RANKS.split("vals AS")[0].rstrip().rstrip(",")}
    SELECT gene, value, CAST(min(r) AS DOUBLE) AS first_rank, CAST(max(r) AS DOUBLE) AS last_rank, CAST(count(*) AS BIGINT) AS ranks
    FROM (SELECT gene, value, row_number() OVER (PARTITION BY gene ORDER BY value) AS r FROM dense) GROUP BY 1, 2""",
)
def shuffled_ranks(spark, sf):
    """Random tie order: what is fixed is the block of ranks each tie occupies."""
    from regweave.operators.matrix import densify

    expr = events_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    n = indexed.count()
    values = S.slice_cells(expr.values, indexed)
    ranks = R.to_rankings(values, n).join(densify(values, n), ["gene", "cell"])
    return ranks.groupBy("gene", "value").agg(
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.countDistinct("rank").alias("ranks")
    )


@query(
    "pearson_matrix",
    f"WITH {SQL_PARTS}, vals AS (SELECT * FROM expr), {SQL_PEARSON} SELECT tf, gene, CASE WHEN tf = gene THEN 1.0 ELSE round(cov / nullif(spread, 0), 6) END AS corr FROM corr",
)
def pearson_matrix(spark, sf):
    expr = parts_expression(spark, sf).store()
    regs = S.regulator_index(expr.values, part_regulators(spark, sf))
    return R.pearson(expr.values, regs, expr.nr_cells()).select("tf", "gene", F.round("corr", 6).alias("corr"))


@query(
    "covariance_sign",
    f"WITH {SQL_PARTS}, vals AS (SELECT * FROM expr), {SQL_PEARSON} SELECT tf, gene, CAST(sign(round(cov, 9)) AS INTEGER) AS sign FROM corr",
)
def covariance_sign(spark, sf):
    expr = parts_expression(spark, sf).store()
    regs = S.regulator_index(expr.values, part_regulators(spark, sf))
    return R.pearson(expr.values, regs, expr.nr_cells()).select("tf", "gene", "sign")


@query(
    "spearman_matrix",
    f"WITH {SQL_PARTS}, {SQL_AVG_RANKS}, {SQL_PEARSON} SELECT tf, gene, CASE WHEN tf = gene THEN 1.0 ELSE round(cov / nullif(spread, 0), 6) END AS corr FROM corr",
)
def spearman_matrix(spark, sf):
    expr = parts_expression(spark, sf).store()
    regs = S.regulator_index(expr.values, part_regulators(spark, sf))
    return R.spearman(expr.values, regs, expr.nr_cells()).select("tf", "gene", F.round("corr", 6).alias("corr"))


@query(
    "spearman_dense_matrix",
    f"""WITH {SQL_EMBED}, regs AS (SELECT gene AS regulator FROM expr GROUP BY gene), {SQL_AVG_RANKS}, {SQL_PEARSON}
    SELECT tf, gene, CASE WHEN tf = gene THEN 1.0 ELSE round(cov / nullif(spread, 0), 6) END AS corr FROM corr""",
)
def spearman_dense_matrix(spark, sf):
    """All embedding positions against each other, without ties, on dense values of both signs."""
    expr = embedding_expression(spark, sf).store()
    regs = S.regulator_index(expr.values, expr.genes())
    return R.spearman(expr.values, regs, expr.nr_cells()).select("tf", "gene", F.round("corr", 6).alias("corr"))


SQL_TIE_KEY = draws.draw_sql("cell", DEFAULT_RANK_SEED, draws.TIES, draws.name_number_sql("gene"))
SQL_SHUFFLED_RANKS = SQL_AVG_RANKS.split("vals AS")[0] + f"""vals AS (
  SELECT gene, cell, CAST(row_number() OVER (PARTITION BY gene ORDER BY value, k % 64, k, cell) AS DOUBLE) AS value FROM (SELECT *, {SQL_TIE_KEY} AS k FROM dense))"""


@query(
    "spearman_shuffled_matrix",
    f"""WITH {SQL_EMBED}, regs AS (SELECT gene AS regulator FROM expr GROUP BY gene), {SQL_SHUFFLED_RANKS}, {SQL_PEARSON}
    SELECT tf, gene, CASE WHEN tf = gene THEN 1.0 ELSE round(cov / nullif(spread, 0), 6) END AS corr FROM corr""",
)
def spearman_shuffled_matrix(spark, sf):
    """Distinct ranks; tied cells stand in a seeded order of their gene, which SQL repeats."""
    expr = embedding_expression(spark, sf).store()
    regs = S.regulator_index(expr.values, expr.genes())
    return R.spearman_shuffled(expr.values, regs, expr.nr_cells()).select("tf", "gene", F.round("corr", 6).alias("corr"))


@query(
    "spearman_shuffled_counts",
    f"""WITH ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS cell FROM (SELECT DISTINCT user_id FROM events)),
    expr AS (SELECT event_type AS gene, cell, CAST(count(*) AS DOUBLE) AS value FROM events JOIN ids USING (user_id) GROUP BY 1, 2),
    cells AS (SELECT cell FROM ids),
    regs AS (SELECT gene AS regulator FROM expr GROUP BY gene), {SQL_SHUFFLED_RANKS}, {SQL_PEARSON}
    SELECT tf, gene, CASE WHEN tf = gene THEN 1.0 ELSE round(cov / nullif(spread, 0), 6) END AS corr FROM corr""",
)
def spearman_shuffled_counts(spark, sf):
    """The same on counts, where nearly every value is tied."""
    expr = events_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    values = S.slice_cells(expr.values, indexed)
    regs = S.regulator_index(values, values.select("gene").distinct())
    return R.spearman_shuffled(values, regs, indexed.count()).select("tf", "gene", F.round("corr", 6).alias("corr"))


@query(
    "correlation_rows",
    f"""WITH {SQL_EMBED}, regs AS (SELECT gene AS regulator FROM expr GROUP BY gene), vals AS (SELECT * FROM expr), {SQL_PEARSON},
    r AS (SELECT tf, gene, CASE WHEN tf = gene THEN 1 ELSE CAST(sign(cov) AS INTEGER) END AS v FROM corr)
    SELECT tf, string_agg(CAST(v AS VARCHAR), '\t' ORDER BY gene) AS line FROM r GROUP BY tf""",
)
def correlation_rows(spark, sf):
    """One text line of signs per regulator, genes in name order."""
    expr = embedding_expression(spark, sf).store()
    regs = S.regulator_index(expr.values, expr.genes())
    corr = R.pearson(expr.values, regs, expr.nr_cells())
    sign = F.when(F.col("tf") == F.col("gene"), F.lit(1)).otherwise(F.col("sign"))
    return R.rows_by_regulator(corr.select("tf", "gene", sign.cast("string").alias("sign")), "sign")


@query(
    "packed_vectors",
    f"""WITH {SQL_PARTS}, i AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic, count(*) OVER () AS n FROM cells)
    SELECT gene, CAST(n AS INTEGER) AS size, CAST(count(*) AS INTEGER) AS stored, string_agg(CAST(ic AS VARCHAR), ',' ORDER BY ic) AS indices,
    string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY ic) AS vals FROM expr JOIN i USING (cell) GROUP BY gene, n""",
)
def packed_vectors(spark, sf):
    expr = parts_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    packed = pack(S.slice_cells(expr.values, indexed), indexed.count())
    return packed.select(
        "gene",
        "size",
        F.size("indices").alias("stored"),
        F.array_join("indices", ",").alias("indices"),
        F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("vals"),
    )


@query("unpacked_vectors", f"WITH {SQL_PARTS}, i AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic FROM cells) SELECT gene, CAST(ic AS INTEGER) AS cell, value FROM expr JOIN i USING (cell)")
def unpacked_vectors(spark, sf):
    expr = parts_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    return unpack(pack(S.slice_cells(expr.values, indexed), indexed.count(), cells_per_row=64))


@query(
    "typed_row_projection",
    f"""WITH {SQL_PARTS} SELECT cell, string_agg(CAST(ridx AS VARCHAR) || ':' || CAST(CAST(value AS INTEGER) AS VARCHAR), ' ' ORDER BY ridx) AS int_row,
    CAST(count(*) AS INTEGER) AS stored FROM expr JOIN regs ON gene = regulator GROUP BY cell""",
)
def typed_row_projection(spark, sf):
    expr = parts_expression(spark, sf)
    regs = S.regulator_index(expr.values, part_regulators(spark, sf))
    rows = cell_major(expr.values, regs.select(F.col("regulator").alias("gene"), F.col("ridx").alias("idx")), "int")
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["value"].cast("string"))), " ")
    return rows.select("cell", text.alias("int_row"), F.size("entries").alias("stored"))


@query(
    "assembled_vectors",
    "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem",
)
def assembled_vectors(spark, sf):
    vec = assemble("l_quantity", "l_discount", "l_tax")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "lineitem").withColumn("v", vec).select("l_orderkey", "l_linenumber", F.round(total, 6).alias("total"))


@query(
    "interaction_products",
    """SELECT CAST(p AS INTEGER) AS position, round(sum(v), 3) AS total FROM (
      SELECT unnest([0, 1, 2, 3]) AS p, unnest([l_quantity * l_discount, l_quantity * l_tax, l_linenumber * l_discount, l_linenumber * l_tax]) AS v FROM lineitem) GROUP BY 1""",
)
def interaction_products(spark, sf):
    prod = interact(assemble("l_quantity", "l_linenumber"), assemble("l_discount", "l_tax"))
    return (
        table(spark, sf, "lineitem")
        .select(F.posexplode(prod).alias("position", "v"))
        .groupBy("position")
        .agg(F.round(F.sum("v"), 3).alias("total"))
    )


def _dump_lines(spark, sf):
    """Line items written as lines of a tree dump; one order is one tree."""
    split = F.format_string(
        "\t%d:[f%d<%s] yes=1,no=2,missing=1,gain=%s,cover=%d",
        F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_partkey"),
    )
    leaf = F.format_string("\t\t%d:leaf=%s,cover=%d", F.col("l_linenumber"), F.col("l_discount").cast("string"), F.col("l_partkey"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tree_id"), F.when(F.col("l_returnflag") == "N", leaf).otherwise(split).alias("line")
    )


@query(
    "tree_dump_splits",
    """SELECT l_orderkey AS tree_id, CAST(l_suppkey AS INTEGER) AS feature, l_quantity AS threshold,
    CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS gain, CAST(l_partkey AS DOUBLE) AS cover FROM lineitem WHERE l_returnflag <> 'N'""",
)
def tree_dump_splits(spark, sf):
    return parse_dump(_dump_lines(spark, sf))


@query(
    "tree_dump_importance",
    """SELECT CAST(l_suppkey AS INTEGER) AS feature, CAST(count(*) AS BIGINT) AS frequency,
    round(sum(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE)), 2) AS gain, CAST(sum(l_partkey) AS DOUBLE) AS cover FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""",
)
def tree_dump_importance(spark, sf):
    return dump_importance(_dump_lines(spark, sf)).withColumn("gain", F.round("gain", 2))


@query(
    "evaluation_losses",
    """SELECT o_orderkey AS round, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS train_loss, CAST(o_custkey AS DOUBLE) AS test_loss FROM orders""",
)
def evaluation_losses(spark, sf):
    line = F.format_string(
        "[%d]\ttrain-rmse:%s\ttest-rmse:%d", F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_custkey")
    )
    return parse_losses(table(spark, sf, "orders").select(F.col("o_orderkey").alias("round"), line.alias("line")))


@query(
    "score_sums",
    """SELECT CAST(l_partkey AS VARCHAR) AS target, CAST(l_suppkey AS VARCHAR) AS regulator, CAST(count(*) AS BIGINT) AS frequency,
    round(sum(l_extendedprice), 2) AS gain, sum(l_quantity) AS cover FROM lineitem GROUP BY 1, 2""",
)
def score_sums(spark, sf):
    log = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("target"),
        F.col("l_suppkey").cast("string").alias("regulator"),
        F.col("l_extendedprice").alias("gain"),
        F.col("l_quantity").alias("cover"),
    )
    return importance(log).withColumn("gain", F.round("gain", 2))


@query(
    "token_statistics",
    """WITH t AS (SELECT doc_id AS cell, unnest(regexp_split_to_array(lower(text), '[ \\n\\t.,]+')) AS gene FROM documents)
    SELECT gene, CAST(count(DISTINCT cell) AS BIGINT) AS cells, CAST(count(*) AS DOUBLE) AS total FROM t WHERE gene <> '' GROUP BY gene""",
)
def token_statistics(spark, sf):
    """Gene-wise counts of the token matrix over whole texts."""
    values = token_expression(spark, sf).values
    return values.groupBy("gene").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
