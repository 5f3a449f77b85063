"""Selection of genes, regulators and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog.registry import query
from regweave.catalog.tables import SQL_EVENTS, SQL_PARTS, events_expression, part_regulators, parts_expression, table
from regweave.operators import draws
from regweave.operators import matrix as M
from regweave.operators import select as S
from regweave.operators.ordering import hash_position


@query(
    "target_filter",
    f"WITH {SQL_PARTS} SELECT gene, cell, value FROM expr WHERE gene IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'PROMO')",
)
def target_filter(spark, sf):
    wanted = table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").cast("string").alias("gene"))
    return S.keep_genes(parts_expression(spark, sf).values, wanted)


@query("regulator_index", f"WITH {SQL_PARTS} SELECT regulator, ridx FROM regs")
def regulator_index(spark, sf):
    expr = parts_expression(spark, sf)
    return S.require_regulators(S.regulator_index(expr.values, part_regulators(spark, sf)))


@query(
    "regulator_matrix",
    f"""WITH {SQL_PARTS} SELECT r.ridx, cell, value FROM expr JOIN regs r ON gene = r.regulator""",
)
def regulator_matrix(spark, sf):
    expr = parts_expression(spark, sf)
    regs = S.regulator_index(expr.values, part_regulators(spark, sf)).withColumnRenamed("regulator", "gene")
    return M.sum_duplicates(expr.values).join(regs, "gene").select("ridx", "cell", "value")


@query(
    "self_regulation_excluded",
    f"""WITH {SQL_PARTS} SELECT x.gene AS regulator, y.gene AS target, CAST(count(*) AS BIGINT) AS shared_cells
    FROM expr x JOIN regs ON x.gene = regulator JOIN expr y USING (cell) WHERE x.gene <> y.gene GROUP BY 1, 2""",
)
def self_regulation_excluded(spark, sf):
    from regweave.operators.skew import salted_join

    expr = parts_expression(spark, sf)
    x = S.keep_genes(expr.values, part_regulators(spark, sf)).select(F.col("gene").alias("regulator"), "cell")
    pairs = salted_join(expr.values.select(F.col("gene").alias("target"), "cell"), x, "cell", "target")
    return S.without_self(pairs.groupBy("regulator", "target").agg(F.count(F.lit(1)).alias("shared_cells")))


@query(
    "cell_slice",
    f"""WITH {SQL_PARTS}, sel AS (
      SELECT s_suppkey AS cell, row_number() OVER (ORDER BY s_suppkey) - 1 AS new_cell FROM supplier WHERE s_acctbal > 0)
    SELECT gene, CAST(new_cell AS BIGINT) AS cell, value FROM expr JOIN sel USING (cell)""",
)
def cell_slice(spark, sf):
    expr = parts_expression(spark, sf)
    chosen = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("cell"))
    return S.slice_expression(expr, S.index_cells(chosen)).values


@query("upper_case_regulators", "SELECT DISTINCT upper(p_name) AS gene FROM part")
def upper_case_regulators(spark, sf):
    return S.fold_case(table(spark, sf, "part").select(F.col("p_name").alias("gene")))


@query(
    "missing_filter",
    """SELECT o_orderkey AS cell, value FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST('NaN' AS DOUBLE) WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS value FROM orders)
    WHERE value IS NOT NULL AND NOT isnan(value) AND value <> 0""",
)
def missing_filter(spark, sf):
    value = (
        F.when(F.col("o_orderstatus") == "P", F.lit(float("nan")))
        .when(F.col("o_orderstatus") == "F", F.lit(0.0))
        .otherwise(F.col("o_totalprice"))
    )
    return M.drop_missing(table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), value.alias("value")))


@query(
    "dense_response",
    f"""WITH {SQL_PARTS}, idx AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS new_cell FROM cells)
    SELECT g.gene, CAST(new_cell AS BIGINT) AS cell, coalesce(value, 0.0) AS value
    FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN idx LEFT JOIN expr e ON e.gene = g.gene AND e.cell = idx.cell""",
)
def dense_response(spark, sf):
    expr = parts_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    return M.densify(S.slice_cells(expr.values, indexed), indexed.count())


@query("first_genes", f"WITH {SQL_PARTS} SELECT DISTINCT gene FROM expr ORDER BY gene LIMIT 100")
def first_genes(spark, sf):
    return S.first_genes(parts_expression(spark, sf).values, 100)


@query("gene_list", f"WITH {SQL_PARTS} SELECT DISTINCT gene FROM expr")
def gene_list(spark, sf):
    return parts_expression(spark, sf).genes()


@query("cell_sub_sample", "SELECT CAST(count(*) // 2 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS first_cell, CAST(count(*) // 2 - 1 AS BIGINT) AS last_cell FROM supplier")
def cell_sub_sample(spark, sf):
    """A random half of the cells; what is compared is its size and dense numbering."""
    expr = parts_expression(spark, sf)
    half = S.sub_sample(expr, expr.nr_cells() // 2)
    return half.cells.agg(F.count(F.lit(1)).alias("cells"), F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))


@query("shuffled_positions", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS position FROM orders")
def shuffled_positions(spark, sf):
    """Positions of a seeded shuffle: a permutation of 0..n-1."""
    return hash_position(table(spark, sf, "orders"), "o_orderkey", 666).select("position")


@query(
    "disjoint_cell_subsets",
    """WITH rest AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))
    SELECT CAST(i AS INTEGER) AS subset, CAST(least(40, n - 40 * i) AS BIGINT) AS cells
    FROM (SELECT count(*) AS n, unnest(range(0, CAST(ceil(count(*) / 40.0) AS BIGINT))) AS i FROM rest)""",
)
def disjoint_cell_subsets(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    excluded = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"))
    subsets = S.disjoint_subsets(cells, excluded, 40)
    return subsets.groupBy("subset").agg(F.countDistinct("cell").alias("cells"))


@query(
    "phase_partition",
    """WITH c AS (SELECT c_custkey AS cell, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    w AS (SELECT cell, i // 40 AS win, CAST(ceil(n / 40.0) AS BIGINT) - 2 AS last FROM c)
    SELECT cell, CAST(last - least(win, last) AS INTEGER) AS phase FROM w WHERE last - least(win, last) >= 1""",
)
def phase_partition(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    indexed = S.index_cells(cells)
    return S.assign_phases(indexed, indexed.count(), 40, skip=1).select("cell", "phase")


@query(
    "fold_sizes",
    """WITH n AS (SELECT count(*) AS n FROM customer)
    SELECT CAST(f AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS test_cells,
      CAST(n - (n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END) AS BIGINT) AS train_cells
    FROM n CROSS JOIN (SELECT unnest(range(0, 5)) AS f)""",
)
def fold_sizes(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    total = cells.count()
    folds = S.assign_folds(cells, total, 5)
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("test_cells"))
    return sizes.withColumn("train_cells", F.lit(total) - F.col("test_cells"))


@query(
    "train_test_split",
    "SELECT CAST(count(*) AS BIGINT) AS cells, true AS disjoint, true AS complete FROM customer",
)
def train_test_split(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    train, test = S.split_folds(S.assign_folds(cells, cells.count(), 5), 0)
    both = train.select("cell", F.lit(1).alias("a")).unionByName(test.select("cell", F.lit(2).alias("a")))
    per_cell = both.groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
    left = cells.join(per_cell, "cell", "left")
    return left.agg(
        F.count(F.lit(1)).alias("cells"), (F.max("k") == 1).alias("disjoint"), F.every(F.col("k").isNotNull()).alias("complete")
    )


@query(
    "cell_difference",
    "SELECT c_custkey AS cell FROM customer EXCEPT SELECT s_suppkey FROM supplier",
)
def cell_difference(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    return S.cell_difference(cells, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell")))


@query(
    "gene_intersection",
    f"WITH {SQL_PARTS} SELECT gene FROM expr INTERSECT SELECT gene FROM cand",
)
def gene_intersection(spark, sf):
    return S.keep_genes(parts_expression(spark, sf).genes(), part_regulators(spark, sf))


@query(
    "matrix_dimensions",
    f"WITH {SQL_PARTS} SELECT (SELECT CAST(count(DISTINCT gene) AS BIGINT) FROM expr) AS genes, (SELECT CAST(count(*) AS BIGINT) FROM cells) AS cells",
)
def matrix_dimensions(spark, sf):
    return M.dimensions(parts_expression(spark, sf))


@query(
    "labelled_cell_rows",
    f"""WITH {SQL_EVENTS}, r AS (
      SELECT cell, string_agg(CAST(idx AS VARCHAR) || ':' || CAST(CAST(value AS BIGINT) AS VARCHAR), ' ' ORDER BY idx) AS entries
      FROM expr JOIN (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS idx FROM (SELECT DISTINCT gene FROM expr WHERE gene <> 'view')) USING (gene) GROUP BY cell)
    SELECT cells.cell, coalesce(v.value, 0.0) AS label, coalesce(entries, '') AS entries
    FROM cells LEFT JOIN (SELECT cell, value FROM expr WHERE gene = 'view') v USING (cell) LEFT JOIN r USING (cell)""",
)
def labelled_cell_rows(spark, sf):
    """Cell-major rows without one gene, labelled with that gene's dense response."""
    expr = events_expression(spark, sf)
    rest = M.drop_column(expr.values, "view")
    index = S.regulator_index(rest, rest.select("gene").distinct()).select(F.col("regulator").alias("gene"), F.col("ridx").alias("idx"))
    view = expr.values.filter("gene = 'view'").select("cell", "value")
    response = expr.cells.join(view, "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("label"))
    rows = M.labelled_rows(M.cell_major(rest, index), response)
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["value"].cast("long").cast("string"))), " ")
    return rows.select("cell", "label", text.alias("entries"))


@query(
    "sampled_cells",
    f"SELECT cell FROM {draws.shuffled_sql('(SELECT s_suppkey AS cell FROM supplier)', 'cell', 666, draws.SAMPLES)} WHERE position < (SELECT count(*) // 2 FROM supplier)",
)
def sampled_cells(spark, sf):
    """The cells of a random half."""
    cells = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"))
    return S.random_cells(cells, cells.count() // 2)


@query(
    "cell_subsets",
    f"""SELECT cell, CAST(position // 40 AS INTEGER) AS subset FROM {draws.shuffled_sql(
        '(SELECT c_custkey AS cell FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))', 'cell', 666, draws.SAMPLES)}""",
)
def cell_subsets(spark, sf):
    """Members of random disjoint subsets."""
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    return S.disjoint_subsets(cells, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell")), 40)


@query(
    "cell_folds",
    f"SELECT cell, CAST(position % 5 AS INTEGER) AS fold FROM {draws.shuffled_sql('(SELECT c_custkey AS cell FROM customer)', 'cell', 666, draws.FOLDS)}",
)
def cell_folds(spark, sf):
    """Members of the random folds."""
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    return S.assign_folds(cells, cells.count(), 5)


@query(
    "estimation_genes",
    f"""SELECT gene FROM {draws.shuffled_sql("(SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS gene FROM lineitem)", 'gene', 666, draws.GENES)} WHERE position < 20""",
)
def estimation_genes(spark, sf):
    """The default random set of genes whose boosting rounds are estimated."""
    return S.random_genes(parts_expression(spark, sf).genes(), 20)
