"""Readers and writers: tables are written in a layout and read back through the matching reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from regweave.catalog.registry import query
from regweave.catalog.tables import (
    SQL_EMBED,
    SQL_EDGES,
    SQL_EVENTS,
    SQL_LABELLED,
    SQL_PARTS,
    embedding_expression,
    events_expression,
    nation_edges,
    part_regulators,
    parts_expression,
    table,
)
from regweave.operators import edges as E
from regweave.operators import select as S
from regweave.operators.correlation import spearman
from regweave.operators import matrix as M
from regweave.operators.matrix import pack
from regweave.session import scratch_path, write_once
from regweave.sinks import writers as W
from regweave.sources import csc
from regweave.sources import text as T

SQL_USED = "used AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic FROM cells)"


def _parts_file(spark, sf):
    path = scratch_path(spark, "gene-major")
    W.save_matrix_slice(parts_expression(spark, sf), path, compression="lz4")
    return path


@query(
    "gene_major_matrix",
    f"WITH {SQL_PARTS}, {SQL_USED} SELECT gene, CAST(ic AS INTEGER) AS cell, value FROM expr JOIN used USING (cell)",
)
def gene_major_matrix(spark, sf):
    return T.read_gene_major(spark, _parts_file(spark, sf)).values


@query(
    "gene_major_cells",
    f"WITH {SQL_PARTS}, {SQL_USED} SELECT CAST(ic AS INTEGER) AS cell FROM used",
)
def gene_major_cells(spark, sf):
    return T.read_gene_major(spark, _parts_file(spark, sf)).cells


@query(
    "numbered_lines",
    f"""WITH {SQL_PARTS} SELECT 'gene' AS first_field, CAST(0 AS BIGINT) AS line_no UNION ALL
    SELECT gene, row_number() OVER (ORDER BY gene) FROM (SELECT DISTINCT gene FROM expr)""",
)
def numbered_lines(spark, sf):
    lines = T.numbered_lines(spark, _parts_file(spark, sf))
    return lines.select(F.substring_index("value", "\t", 1).alias("first_field"), "line_no")


@query("skipped_headers", f"WITH {SQL_PARTS} SELECT gene FROM (SELECT DISTINCT gene FROM expr) ORDER BY gene OFFSET 2")
def skipped_headers(spark, sf):
    return T.skip_lines(spark, _parts_file(spark, sf), 3).select(F.substring_index("value", "\t", 1).alias("gene"))


@query(
    "matrix_slice_lines",
    f"""WITH {SQL_PARTS}, g AS (SELECT DISTINCT gene FROM expr), c AS (SELECT cell FROM cells)
    SELECT g.gene || chr(9) || string_agg(CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR), chr(9) ORDER BY c.cell) AS value
    FROM g CROSS JOIN c LEFT JOIN expr e ON e.gene = g.gene AND e.cell = c.cell GROUP BY g.gene
    UNION ALL SELECT 'gene' || chr(9) || string_agg(CAST(cell AS VARCHAR), chr(9) ORDER BY cell) FROM c""",
)
def matrix_slice_lines(spark, sf):
    return spark.read.text(_parts_file(spark, sf))


SQL_SPARSE = """
cells AS (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS cell FROM orders
  UNION SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) FROM lineitem),
genes AS (SELECT CAST(c_custkey AS VARCHAR) AS gene FROM customer),
expr AS (
  SELECT CAST(o_custkey AS VARCHAR) AS gene, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS cell, CAST(count(*) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2)
"""


def orders_by_month(spark, sf):
    """Orders of customers by month; customers without orders and months in which goods were only shipped have no entry."""
    month = lambda day: (F.year(day) * 12 + F.month(day)).cast("long").alias("cell")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("gene"), month("o_orderdate"))
    cells = orders.select("cell").union(table(spark, sf, "lineitem").select(month("l_shipdate"))).distinct()
    values = orders.groupBy("gene", "cell").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return M.Expression(values, cells, names=table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("gene")))


@query(
    "matrix_with_empty_cells",
    f"""WITH {SQL_SPARSE} SELECT g.gene || chr(9) || string_agg(CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR), chr(9) ORDER BY c.cell) AS value
    FROM genes g CROSS JOIN cells c LEFT JOIN expr e ON e.gene = g.gene AND e.cell = c.cell GROUP BY g.gene
    UNION ALL SELECT 'gene' || chr(9) || string_agg(CAST(cell AS VARCHAR), chr(9) ORDER BY cell) FROM cells""",
)
def matrix_with_empty_cells(spark, sf):
    """Cells and genes without any entry keep their column and their line."""
    path = scratch_path(spark, "sparse")
    W.save_matrix_slice(orders_by_month(spark, sf), path)
    return spark.read.text(path)


@query(
    "dimensions_with_empty_cells",
    f"WITH {SQL_SPARSE} SELECT (SELECT CAST(count(*) AS BIGINT) FROM genes) AS genes, (SELECT CAST(count(*) AS BIGINT) FROM cells) AS cells",
)
def dimensions_with_empty_cells(spark, sf):
    path = scratch_path(spark, "sparse")
    W.save_matrix_slice(orders_by_month(spark, sf), path)
    return M.dimensions(T.read_gene_major(spark, path))


@query("regulator_names", "SELECT DISTINCT trim(p_name) AS gene FROM part WHERE trim(p_name) <> ''")
def regulator_names(spark, sf):
    path = scratch_path(spark, "names")
    names = table(spark, sf, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("value"))
    names.unionByName(table(spark, sf, "nation").select(F.lit("  ").alias("value"))).write.text(path)
    return T.read_names(spark, path)


@query("cell_subset_file", "SELECT CAST(c_custkey AS INTEGER) AS cell FROM customer")
def cell_subset_file(spark, sf):
    path = scratch_path(spark, "cells")
    cells = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("value"))
    cells.unionByName(table(spark, sf, "region").select(F.lit("").alias("value"))).write.text(path)
    return T.read_cell_subset(spark, path)


def _embedding_file(spark, sf):
    path = scratch_path(spark, "condition-major")
    emb = table(spark, sf, "embeddings")
    values = F.transform("embedding", lambda v: v.cast("double").cast("string"))
    names = F.transform("embedding", lambda _, i: F.format_string("g%03d", i))
    body = emb.select(F.col("vec_id").alias("k"), F.array_join(values, "\t").alias("value"))
    header = emb.select(F.array_join(names, "\t").alias("value")).distinct().select(F.lit(-1).cast("long").alias("k"), "value")
    header.unionByName(body).orderBy("k").select("value").write.text(path)
    return path


@query(
    "condition_major_matrix",
    f"""WITH {SQL_EMBED}, i AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic FROM cells)
    SELECT gene, CAST(ic AS INTEGER) AS cell, value FROM expr JOIN i USING (cell)""",
)
def condition_major_matrix(spark, sf):
    return T.read_condition_major(spark, _embedding_file(spark, sf)).values


@query(
    "wide_csv_vectors",
    f"""WITH {SQL_EMBED} SELECT gene, CAST(count(*) AS BIGINT) AS conditions, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM expr GROUP BY gene""",
)
def wide_csv_vectors(spark, sf):
    """Header and types from the file itself, one assembled vector per condition."""
    path = scratch_path(spark, "wide")
    emb = table(spark, sf, "embeddings")
    width = emb.agg(F.max(F.size("embedding"))).first()[0]
    emb.select(*[F.col("embedding")[i].cast("double").alias(f"g{i:03d}") for i in range(width)]).write.csv(path, sep="\t", header=True)
    df, genes = T.read_wide_csv(spark, path)
    names = F.array(*[F.lit(g) for g in genes])
    return (
        df.select(F.posexplode("expression").alias("p", "v"))
        .filter("v <> 0")
        .groupBy(F.element_at(names, F.col("p") + 1).alias("gene"))
        .agg(F.count(F.lit(1)).alias("conditions"), F.round(F.sum("v"), 6).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    )


@query(
    "annotated_matrix",
    f"WITH {SQL_EVENTS}, {SQL_USED} SELECT gene, CAST(ic AS INTEGER) AS cell, value FROM expr JOIN used USING (cell)",
)
def annotated_matrix(spark, sf):
    path = scratch_path(spark, "annotated")
    expr = events_expression(spark, sf)
    lines = W.matrix_lines(expr.values, "gene", "cell", "value", "gene", as_type="int", cols=expr.cells)
    body = lines.filter("line_order <> ''").select(
        F.concat(F.lit("9"), "line_order").alias("k"), F.regexp_replace("value", "^([^\t]+)\t", "$1\tgroup\t").alias("value")
    )
    meta = events_expression(spark, sf).cells.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"), "n"
    ).select(
        F.format_string("0%02d", "i").alias("k"),
        F.when(F.col("i") < 10, F.format_string("meta%d\t%d", "i", "n")).otherwise(F.lit("")).alias("value"),
    )
    meta.unionByName(body).orderBy("k").select("value").write.text(path)
    return T.read_annotated(spark, path).values


def _csc(spark, sf):
    """The parts matrix as stored CSC tables."""
    expr = parts_expression(spark, sf).store()
    genes = expr.genes()
    names = write_once(
        S.regulator_index(expr.values, genes).select(F.col("regulator").alias("gene"), F.col("ridx").alias("gene_idx")), "gene-names"
    )
    parts = csc.to_csc(expr.values, names, S.index_cells(expr.cells))
    return [write_once(p, n) for p, n in zip(parts, ("indptr", "indices", "data"))] + [names]


SQL_CSC = "ci AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic FROM cells), gi AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gx FROM (SELECT DISTINCT gene FROM expr))"


@query("csc_matrix", f"WITH {SQL_PARTS}, {SQL_CSC} SELECT gene, CAST(ic AS BIGINT) AS cell, value FROM expr JOIN ci USING (cell)")
def csc_matrix(spark, sf):
    indptr, indices, data, names = _csc(spark, sf)
    return csc.name_genes(csc.csc_entries(indptr, indices, data), names)


@query(
    "csc_pointers",
    f"""WITH {SQL_PARTS}, {SQL_CSC}, n AS (SELECT ic, count(gene) AS k FROM ci LEFT JOIN expr USING (cell) GROUP BY ic)
    SELECT CAST(ic + 1 AS BIGINT) AS pos, CAST(sum(k) OVER (ORDER BY ic) AS BIGINT) AS start FROM n UNION ALL SELECT 0, 0""",
)
def csc_pointers(spark, sf):
    return _csc(spark, sf)[0]


@query(
    "csc_top_cells_and_genes",
    f"""WITH {SQL_PARTS}, {SQL_CSC} SELECT CAST(ic AS BIGINT) AS cell, ridx AS gene_idx, value FROM expr JOIN ci USING (cell) JOIN regs ON gene = regulator
    WHERE ic < (SELECT count(*) // 2 FROM cells)""",
)
def csc_top_cells_and_genes(spark, sf):
    """The reader's own options: the first half of the cells, only regulator genes, re-indexed."""
    indptr, indices, data, names = _csc(spark, sf)
    regs = S.regulator_index(names, part_regulators(spark, sf))
    index = names.join(regs, names["gene"] == regs["regulator"]).select("gene_idx", F.col("ridx").alias("new_idx"))
    return csc.csc_entries(indptr, indices, data, csc.csc_dimensions(indptr, names)[0] // 2, index)


@query(
    "csc_gene_vectors",
    f"""WITH {SQL_PARTS}, {SQL_CSC} SELECT gene, CAST(count(*) AS INTEGER) AS stored, string_agg(CAST(ic AS VARCHAR), ',' ORDER BY ic) AS indices
    FROM expr JOIN ci USING (cell) GROUP BY gene""",
)
def csc_gene_vectors(spark, sf):
    indptr, indices, data, names = _csc(spark, sf)
    packed = pack(csc.name_genes(csc.csc_entries(indptr, indices, data), names), csc.csc_dimensions(indptr, names)[0])
    return packed.select("gene", F.size("indices").alias("stored"), F.array_join("indices", ",").alias("indices"))


@query("parquet_expression", f"WITH {SQL_PARTS}, i AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS ic FROM cells) SELECT gene, CAST(ic AS INTEGER) AS cell, value FROM expr JOIN i USING (cell)")
def parquet_expression(spark, sf):
    expr = parts_expression(spark, sf)
    indexed = S.index_cells(expr.cells)
    path = scratch_path(spark, "packed")
    W.save_expression(S.slice_cells(expr.values, indexed), path, indexed.count(), "packed")
    return csc.read_expression_parquet(spark, path)


@query("csv_expression", f"WITH {SQL_PARTS} SELECT gene, cell, value FROM expr")
def csv_expression(spark, sf):
    path = scratch_path(spark, "csv")
    W.save_expression(parts_expression(spark, sf).values, path, fmt="csv")
    return spark.read.csv(path, header=True, schema="gene string, cell long, value double")


@query(
    "saved_edges",
    f"WITH {SQL_LABELLED} SELECT regulator, target, CAST(CAST(gain AS FLOAT) AS DOUBLE) AS gain, include FROM labelled",
)
def saved_edges(spark, sf):
    path = scratch_path(spark, "edges")
    W.save_edges(E.with_labels(nation_edges(spark, sf)), path)
    back = T.read_edges(spark, path, include_flags=True)
    return back.withColumn("gain", F.col("gain").cast("float").cast("double"))


@query("saved_edges_3_columns", f"WITH {SQL_EDGES} SELECT regulator, target, CAST(CAST(gain AS FLOAT) AS DOUBLE) AS gain, CAST(1 AS INTEGER) AS include FROM edges")
def saved_edges_3_columns(spark, sf):
    path = scratch_path(spark, "edges3")
    W.save_edges(nation_edges(spark, sf), path, include_flags=False)
    return T.read_edges(spark, path).withColumn("gain", F.col("gain").cast("float").cast("double"))


@query(
    "relabelled_saved_edges",
    f"""WITH {SQL_LABELLED} SELECT regulator, target, round(gain / sum(gain) OVER (PARTITION BY target), 4) AS gain, include FROM labelled""",
)
def relabelled_saved_edges(spark, sf):
    """Labels and normalization added later to a stored edge list."""
    path = scratch_path(spark, "stored")
    W.save_edges_parquet(nation_edges(spark, sf), path)
    out = E.normalize(E.with_labels(spark.read.parquet(path)))
    return out.select("regulator", "target", F.round("gain", 4).alias("gain"), "include")


@query(
    "edges_matrix_output",
    f"""WITH {SQL_EDGES}, r AS (SELECT DISTINCT regulator FROM edges), t AS (SELECT DISTINCT target FROM edges)
    SELECT r.regulator, t.target, round(coalesce(gain, 0), 2) AS gain FROM r CROSS JOIN t LEFT JOIN edges USING (regulator, target)""",
)
def edges_matrix_output(spark, sf):
    path = scratch_path(spark, "matrix")
    W.save_output(nation_edges(spark, sf), path, "matrix")
    lines = T.numbered_lines(spark, path).select("line_no", F.posexplode(F.split("value", "\t")).alias("p", "v")).filter("p > 0 OR line_no > 0")
    names = lines.filter("line_no = 0").select("p", F.col("v").alias("target"))
    rows = lines.filter("line_no > 0 AND p = 0").select("line_no", F.col("v").alias("regulator"))
    body = lines.filter("line_no > 0 AND p > 0").join(names, "p").join(rows, "line_no")
    return body.select("regulator", "target", F.round(F.col("v").cast("double"), 2).alias("gain"))


@query(
    "correlation_file",
    f"""WITH {SQL_EMBED}, r AS (SELECT gene, cell, rank() OVER w + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rk FROM (
      SELECT g.gene, c.cell, coalesce(value, 0) AS value FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN cells c
      LEFT JOIN expr e ON e.gene = g.gene AND e.cell = c.cell) WINDOW w AS (PARTITION BY gene ORDER BY value))
    SELECT a.gene AS tf, b.gene, round(corr(a.rk, b.rk), 4) AS corr FROM r a JOIN r b USING (cell) GROUP BY 1, 2""",
)
def correlation_file(spark, sf):
    """The correlation matrix as text (header, one line per regulator), read back."""
    expr = embedding_expression(spark, sf)
    regs = S.regulator_index(expr.values, expr.genes())
    path = scratch_path(spark, "correlation")
    W.save_correlation(spearman(expr.values, regs, expr.nr_cells()), path)
    fields = T.numbered_lines(spark, path).select("line_no", F.posexplode(F.split("value", "\t")).alias("p", "v"))
    names = fields.filter("line_no = 0 AND p > 0").select("p", F.col("v").alias("gene"))
    rows = fields.filter("line_no > 0 AND p = 0").select("line_no", F.col("v").alias("tf"))
    body = fields.filter("line_no > 0 AND p > 0").join(names, "p").join(rows, "line_no")
    return body.select("tf", "gene", F.round(F.col("v").cast("double"), 4).alias("corr"))
