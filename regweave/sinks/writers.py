"""Writers for edges, matrices and reports."""

from __future__ import annotations

import dataclasses
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave import constants as C
from regweave.operators.edges import sort_by_gain, sort_by_names
from regweave.operators.matrix import Expression, pack
from regweave.operators.ordering import position_by_range
from regweave.session import write_once

ZEROS = 64  # zeros of a run that are written at once
COLUMNS_PER_FILE = 64  # a matrix of more columns is dealt to more files, up to the number of shuffle partitions


def edge_lines(edges: DataFrame, include_flags: bool = True, delimiter: str = C.DEFAULT_DELIMITER) -> DataFrame:
    """Edge rows as delimited text, gains in single precision as in the exchange format."""
    cols = ["regulator", "target", F.col("gain").cast("float").cast("string")]
    if include_flags:
        cols.append(F.col("include").cast("string"))
    return edges.select(F.concat_ws(delimiter, *cols).alias("value"))


def save_edges(
    edges: DataFrame,
    path: str,
    include_flags: bool = True,
    delimiter: str = C.DEFAULT_DELIMITER,
    single_file: bool = False,
    mode: str = "error",
) -> None:
    """Ordered text edge list with 3 or 4 columns.

    Part files follow the gain order, so reading them by name gives the sorted list. ``single_file``
    funnels everything through one task and is meant for truncated lists.
    """
    ordered = sort_by_gain(edges)
    if single_file:
        ordered = edges.coalesce(1).sortWithinPartitions(F.desc("gain"), "regulator", "target")
    edge_lines(ordered, include_flags, delimiter).write.mode(mode).text(path)


def save_edges_parquet(edges: DataFrame, path: str, by_phase: bool = False, mode: str = "error") -> None:
    """Sorted Parquet, one directory per phase on request."""
    if by_phase:
        out = edges.repartition("phase", F.pmod(F.xxhash64("target"), F.lit(64)))
        out = out.sortWithinPartitions("phase", "regulator", "target", F.desc("gain"))
        out.write.mode(mode).partitionBy("phase").parquet(path)
    else:
        sort_by_names(edges).write.mode(mode).parquet(path)


def _zeros(count: Column, unit: str) -> Column:
    """``unit`` written ``count`` times, mostly in copies of a longer text."""
    return F.concat(F.repeat(F.lit(unit * ZEROS), F.floor(count / ZEROS).cast("int")), F.repeat(F.lit(unit), (count % ZEROS).cast("int")))


def _filled(cells: Column, width: int, as_type: str, delimiter: str) -> Column:
    """The text of a row of ``width`` columns from its sorted entries (_c, _real, _v): each entry and the zeros up to the next."""
    text = lambda v: v.cast(as_type).cast("string")
    unit = delimiter + {"int": "0"}.get(as_type, "0.0")

    def run(e: Column, i: Column) -> Column:
        gap = F.coalesce(F.get(cells, i + 1)["_c"], F.lit(width)) - e["_c"]
        known = F.concat(text(e["_v"]), _zeros(gap - 1, unit))
        unknown = F.when(gap > 1, F.concat(F.lit(unit[len(delimiter) :]), _zeros(gap - 2, unit)))  # an entry without a value has no field
        return F.when(gap > 0, F.coalesce(known, unknown))

    return F.array_join(F.transform(cells, run), delimiter)


def _matrix_rows(
    entries: DataFrame, row: str, col: str, value: str, corner: str, delimiter: str, as_type: str, rows: DataFrame | None, cols: DataFrame | None, spread: bool = False, keep: bool = False
) -> tuple[DataFrame, Column]:
    """Rows of the matrix with their entries, a range of names per partition where ``spread``, and the column that is a row's text.

    With ``keep`` names that only have entries outside ``cols`` stay as rows of zeros.
    """
    if cols is None:
        entries = write_once(entries.select(row, col, value), "matrix-entries")
    names = (entries.select(col) if cols is None else cols).toDF("_name").filter("_name IS NOT NULL").distinct()
    indexed = write_once(position_by_range(names, "_name", "_c"), "matrix-columns")
    width = indexed.count()
    spark = entries.sparkSession
    # the header is one row of all column names, so a table of them fits a task as well
    found = entries.join(F.broadcast(indexed), entries[col] == indexed["_name"], "left")
    sparse = found.select(
        F.col(row).cast("string").alias("line_order"),
        F.lit(1).alias("_kind"),
        F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").cast("int").alias("_c"), F.lit(1).alias("_real"), F.col(value).cast("double").alias("_v"))).alias("_e"),
        F.lit(None).cast("string").alias("_line"),
    )
    kind = sparse.schema["_e"].dataType
    if not keep:
        sparse = sparse.filter("_e IS NOT NULL")
    first = F.struct(F.lit(0).alias("_c"), F.lit(0).alias("_real"), F.lit(0.0).alias("_v")).cast(kind)
    if rows is not None:
        named = rows.toDF("_row").distinct().select(F.col("_row").cast("string").alias("line_order"), F.lit(1).alias("_kind"), first.alias("_e"), F.lit(None).cast("string").alias("_line"))
        sparse = sparse.unionByName(named)
    if width == 0:
        sparse = sparse.limit(0)
    header = indexed.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_name"))), lambda e: e["_name"].cast("string")), delimiter).alias("_line")
    ).select(F.lit("").alias("line_order"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_e"), "_line")
    every = sparse.unionByName(header)
    if spread:
        cores = spark.sparkContext.defaultParallelism
        parts = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), width // COLUMNS_PER_FILE))
        every = every.repartitionByRange(parts, "line_order")
    cells = F.sort_array(F.collect_list("_e"))
    cells = cells if rows is not None else F.concat(F.array(first), cells)
    grouped = every.groupBy("line_order", "_kind").agg(cells.alias("_cells"), F.max("_line").alias("_line"))
    if spread:
        grouped = grouped.sortWithinPartitions("line_order", "_kind")
    line = F.when(F.col("_kind") == 0, F.concat_ws(delimiter, F.lit(corner), "_line")).otherwise(
        F.concat_ws(delimiter, "line_order", _filled(F.col("_cells"), width, as_type, delimiter))
    )
    return grouped, line


def matrix_lines(
    entries: DataFrame,
    row: str,
    col: str,
    value: str,
    corner: str,
    delimiter: str = C.DEFAULT_DELIMITER,
    as_type: str = "double",
    rows: DataFrame | None = None,
    cols: DataFrame | None = None,
) -> DataFrame:
    """``line_order, value``: a header of sorted column names, then one line per row name.

    ``rows`` and ``cols`` are one-column tables of all names; without ``rows`` the names in ``entries`` count, without
    ``cols`` the columns with entries. Columns are numbered by name. Only entries are shuffled: a row's entries meet in
    one array, and the zeros between them are written as text. One line of text holds one row (and the header all column
    names); that is the format.
    """
    grouped, line = _matrix_rows(entries, row, col, value, corner, delimiter, as_type, rows, cols)
    return grouped.select("line_order", line.alias("value"))


def save_matrix(
    entries: DataFrame,
    row: str,
    col: str,
    value: str,
    corner: str,
    path: str,
    delimiter: str = C.DEFAULT_DELIMITER,
    as_type: str = "double",
    rows: DataFrame | None = None,
    cols: DataFrame | None = None,
    compression: str = "none",
    keep: bool = False,
) -> None:
    """The lines of :func:`matrix_lines` as text, sorted by range; the header sorts first.

    Entries are shuffled and sorted; lines, which may be very much longer, are made while they are written.
    """
    grouped, line = _matrix_rows(entries, row, col, value, corner, delimiter, as_type, rows, cols, True, keep)
    grouped.select(line.alias("value")).write.text(path, compression=compression)


def save_output(edges: DataFrame, path: str, output_format: str = "list", include_flags: bool = False, delimiter: str = C.DEFAULT_DELIMITER) -> None:
    """The three output formats: edge list, regulator x target matrix, Parquet."""
    if output_format == "list":
        save_edges(edges, path, include_flags, delimiter)
    elif output_format == "matrix":
        save_matrix(edges, "regulator", "target", "gain", "regulator", path, delimiter)
    elif output_format == "parquet":
        save_edges_parquet(edges, path)
    else:
        raise ValueError(f"unknown output format: {output_format}")


def save_matrix_slice(expr: Expression, path: str, delimiter: str = C.DEFAULT_DELIMITER, compression: str = "none") -> None:
    """Dense integer matrix text ``gene, <cell ids>``: all genes and cells, also those without entries."""
    names = None if expr.names is None else expr.genes()
    save_matrix(expr.values, "gene", "cell", "value", "gene", path, delimiter, "int", names, expr.cells.select("cell"), compression, keep=names is None)


def save_correlation(corr: DataFrame, path: str, delimiter: str = C.DEFAULT_DELIMITER) -> None:
    """Correlation matrix text: header of genes, one line per regulator."""
    save_matrix(corr.select("tf", "gene", F.col("corr").cast("float").alias("corr")), "tf", "gene", "corr", ".", path, delimiter, "float")


def save_expression(values: DataFrame, path: str, nr_cells: int | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Convert an expression table in one distributed write: packed Parquet, long Parquet or CSV."""
    if fmt == "packed":
        pack(values, nr_cells).write.mode(mode).parquet(path)
    elif fmt == "parquet":
        values.write.mode(mode).parquet(path)
    elif fmt == "csv":
        values.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def run_report(spark, config, started: datetime, finished: datetime, params, measured: dict[str, int]) -> DataFrame:
    """One key/value row per item: configuration, resolved parameters, sizes of the matrix, times."""
    items = {f"config.{k}": v for k, v in dataclasses.asdict(config).items()}
    resolved = dataclasses.asdict(params)
    items |= {f"boost.{k}": v for k, v in resolved.pop("boost").items()} | {f"params.{k}": v for k, v in resolved.items()}
    items |= {f"matrix.{k}": v for k, v in measured.items()}
    items |= {
        "started": started.isoformat(timespec="seconds"),
        "finished": finished.isoformat(timespec="seconds"),
        "seconds": round((finished - started).total_seconds(), 1),
        "rounds": params.nr_rounds,
    }
    rows = [(k, json.dumps(v, default=str)) for k, v in items.items()]
    return spark.createDataFrame(rows, "key string, value string")


def save_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.coalesce(1).write.mode(mode).json(path)
