"""Readers for text matrices and lists. All parsing is column expressions; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regweave import constants as C
from regweave.functions.scalar import split_line
from regweave.functions.vectors import assemble, assemble_ml
from regweave.operators.matrix import Expression, drop_missing
from regweave.session import write_once

ALL_MISSING = (float("nan"), 0.0)
#: runs of zero fields and the marks that stand for them, in the order they are looked for; and the fields each byte stands for
RUNS = (("\t0" * 64, "\x01"), ("\x01" * 16, "\x02"), ("\t0" * 8, "\x03"))
FIELDS = np.zeros(256, np.int32)
FIELDS[[ord("\t"), 1, 2, 3]] = 1, 64, 1024, 8
SPECIAL = "%{}[]*?\\"  # in a path, these would be read as a pattern or an escape
FIELDS_PER_BATCH = 1 << 16


def _shrunk(lines: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns, _plain, _text``: lines with long runs of zero fields written as marks, so that a wide sparse line is short.

    A line that holds a mark of its own stays as it is and is called plain: it would not grow back to its length.
    """
    text, size = F.col("value"), F.octet_length("_short")
    for run, mark in RUNS:
        text = F.replace(text, F.lit(run), F.lit(mark))
    lines = lines.select("value", *columns, text.alias("_short"))
    for _, mark in RUNS:
        times = F.octet_length("_short") - F.octet_length(F.replace(F.col("_short"), F.lit(mark), F.lit("")))
        size = size + times * (len(_expanded(mark.encode())) - 1)
    kept = [c for c in lines.columns if c not in ("value", "_short")]
    lines = lines.select(*kept, "value", "_short", (size != F.octet_length("value")).alias("_plain"))
    return lines.select(*kept, "_plain", F.when(F.col("_plain"), F.col("value")).otherwise(F.col("_short")).alias("_text"))


def _expanded(line: bytes) -> bytes:
    for run, mark in reversed(RUNS):
        line = line.replace(mark.encode(), run.encode())
    return line


def _grown(value: Column) -> Column:
    for run, mark in reversed(RUNS):
        value = F.replace(value, F.lit(mark), F.lit(run))
    return value


def _tagged_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``_plain, _text, line_no``: lines, shrunk unless plain, with their global index over the files in path order.

    Lines are tagged with their file, block and position once and stored, because another reading may
    cut the files into other blocks. Lines are then counted per block (one row per input split) and
    the block's offset is added to the position inside the block.
    """
    lines = _shrunk(
        spark.read.text(path),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    lines = write_once(lines, "tagged-lines", "zstd")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("_file", "_block")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    blocks = write_once(blocks, "line-blocks")
    placed = lines.join(F.broadcast(blocks), ["_file", "_block"], "left")
    known = F.assert_true(F.col("_offset").isNotNull(), "a line has no block offset")
    number = F.when(known.isNull(), F.col("_offset") + F.col("_id") - F.col("_first"))
    return placed.select("_plain", "_text", number.alias("line_no"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, line_no``: lines with their global index over the files in path order."""
    lines = _tagged_lines(spark, path)
    return lines.select(F.when(F.col("_plain"), F.col("_text")).otherwise(_grown(F.col("_text"))).alias("value"), "line_no")


def skip_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines after the first n of the whole input. Only the files that hold those n lines are numbered."""
    every = spark.read.text(path)
    files = sorted(every.inputFiles())
    if n == 0 or not files:
        return every
    if any(c in f for f in files for c in SPECIAL):  # would not be read again as written
        return numbered_lines(spark, path).filter(F.col("line_no") >= n).select("value")
    head, seen = 0, 0
    while seen < n and head < len(files):
        seen += spark.read.text(files[head]).limit(n - seen).count()
        head += 1
    out = numbered_lines(spark, files[:head]).filter(F.col("line_no") >= n).select("value")
    return out.unionByName(spark.read.text(files[head:])) if head < len(files) else out


def _fields(line: bytes, plain: bool, sep: int) -> tuple[bytes, int, list[int], list[bytes]]:
    """A line's first field, the number of further fields, and those of them that are not ``0``: their numbers and texts.

    A line is shrunk unless plain; its runs of zeros are counted, not written out.
    """
    if plain:
        first, *rest = line.split(bytes([sep]))
        at = [i for i, x in enumerate(rest) if x != b"0"]
        return first, len(rest), at, [rest[i] for i in at]
    b = np.frombuffer(line, np.uint8)
    steps = FIELDS[b]
    ends = np.flatnonzero(steps)  # a separator or a mark
    if not len(ends):
        return line, 0, [], []
    stops = np.append(ends[1:], len(b))
    single = b[ends] == sep
    if (~single & (stops - ends > 1)).any():  # the last zero of a run is the beginning of another text, as in 0.5
        return _fields(_expanded(line), True, sep)
    kept = np.flatnonzero(single & ~((stops - ends == 2) & (b[np.minimum(ends + 1, len(b) - 1)] == ord("0"))))
    upto = np.cumsum(steps[ends])
    texts = [line[i:j] for i, j in zip((ends[kept] + 1).tolist(), stops[kept].tolist())]
    return line[: ends[0]], int(upto[-1]), (upto[kept] - 1).tolist(), texts


def _parsed(lines: DataFrame) -> DataFrame:
    """``gene, width, at, raw`` of every line: its name, number of values, and the values that are not ``0``, stored."""
    sep = ord(C.DEFAULT_DELIMITER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for plain, line in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                rows.append(_fields(line.as_py(), plain.as_py(), sep))
                size += len(rows[-1][2])
                if size > FIELDS_PER_BATCH:
                    yield _record(rows)
                    rows, size = [], 0
            if rows:
                yield _record(rows)

    return write_once(_shrunk(lines).mapInArrow(work, "gene binary, width int, at array<int>, raw array<binary>"), "parsed-lines", "zstd")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    gene, width, at, raw = zip(*rows)
    starts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]), pa.int32())
    flat = [pa.array([x for xs in column for x in xs], kind) for column, kind in ((at, pa.int32()), (raw, pa.binary()))]
    lists = [pa.ListArray.from_arrays(starts, f) for f in flat]
    return pa.RecordBatch.from_arrays([pa.array(gene, pa.binary()), pa.array(width, pa.int32()), *lists], ["gene", "width", "at", "raw"])


def _cells_of(width: DataFrame) -> DataFrame:
    """``cell`` 0..max-1 from a one-column table of line widths."""
    top = width.agg(F.coalesce(F.max(F.col(width.columns[0])), F.lit(0)).alias("w"))
    return top.filter(F.col("w") > 0).select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("cell"))


def _entries(parts: DataFrame, first_value: int, missing: Iterable[float], keep: Column | None = None) -> DataFrame:
    """Long entries from ``gene, parts``: values start at the 1-based field ``first_value``."""
    cells = parts.select("gene", F.posexplode(F.slice("parts", first_value, F.size("parts"))).alias("cell", "_raw"))
    if keep is not None:
        cells = cells.filter(keep)
    return drop_missing(cells.select("gene", "cell", F.col("_raw").try_cast("double").alias("value")), missing)


def read_gene_major(
    spark: SparkSession,
    path: str,
    nr_headers: int = 1,
    delimiter: str = C.DEFAULT_DELIMITER,
    missing: Iterable[float] = ALL_MISSING,
    regex: bool = False,
) -> Expression:
    """One gene per line: name, then one value per cell.

    Fields that are just ``0`` are counted, not split, where zero is missing and the delimiter is a tab.
    """
    missing = tuple(missing)
    if 0.0 in missing and not regex and delimiter == C.DEFAULT_DELIMITER:
        rows = _parsed(skip_lines(spark, path, nr_headers))
        gene = F.trim(F.col("gene").cast("string")).alias("gene")
        entries = rows.select(gene, F.explode(F.arrays_zip("at", "raw")).alias("e"))
        entries = entries.select("gene", F.col("e.at").alias("cell"), F.trim(F.col("e.raw").cast("string")).try_cast("double").alias("value"))
        return Expression(drop_missing(entries, missing), _cells_of(rows.select("width")), names=rows.select(gene))
    parts = skip_lines(spark, path, nr_headers).select(split_line(F.col("value"), delimiter, regex).alias("parts"))
    parts = parts.select(F.element_at("parts", 1).alias("gene"), "parts")
    names = parts.select("gene")
    return Expression(_entries(parts, 2, missing), _cells_of(parts.select(F.size("parts") - 1)), names=names)


def read_annotated(spark: SparkSession, path: str, delimiter: str = C.DEFAULT_DELIMITER) -> Expression:
    """Metadata lines and a blank line, then gene, a label to ignore, and one count per cell."""
    lines = numbered_lines(spark, path).filter(F.col("line_no") > C.ANNOTATED_META_LINES)
    parts = lines.select(split_line(F.col("value"), delimiter).alias("parts"))
    parts = parts.select(F.element_at("parts", 1).alias("gene"), "parts")
    entries = _entries(parts, 3, (), F.col("_raw") != "0").filter(F.col("value").isNotNull())
    return Expression(entries, _cells_of(parts.select(F.size("parts") - 2)), names=parts.select("gene"))


def read_condition_major(
    spark: SparkSession, path: str, delimiter: str = C.DEFAULT_DELIMITER, missing: Iterable[float] = ALL_MISSING
) -> Expression:
    """Header of gene names, then one condition per line; transposed without collecting."""
    lines = numbered_lines(spark, path).select("line_no", split_line(F.col("value"), delimiter).alias("parts"))
    names = lines.filter(F.col("line_no") == 0).select(F.posexplode("parts").alias("_col", "gene"))
    body = lines.filter(F.col("line_no") > 0)
    entries = (
        body.select((F.col("line_no") - 1).cast("int").alias("cell"), F.posexplode("parts").alias("_col", "_raw"))
        .join(names, "_col")
        .select("gene", "cell", F.col("_raw").try_cast("double").alias("value"))
    )
    cells = body.select((F.col("line_no") - 1).cast("int").alias("cell"))
    return Expression(drop_missing(entries, tuple(missing)), cells, names=names.select("gene"))


def read_wide_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = C.DEFAULT_DELIMITER,
    schema: StructType | str | None = None,
    ml_vector: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Headed table as one ``expression`` vector per row, plus the column (gene) names.

    Types are inferred unless a schema is given; give one for large inputs, it saves a full pass.
    """
    reader = spark.read.option("header", True).option("sep", delimiter)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    genes = df.columns
    if ml_vector:
        return assemble_ml(df, genes).select("expression"), genes
    return df.select(assemble(*[f"`{g}`" for g in genes]).alias("expression")), genes


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank trimmed lines as ``gene`` (regulator and target lists)."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).filter(F.col("gene") != "").distinct()


def read_cell_subset(spark: SparkSession, path: str) -> DataFrame:
    """One cell index per line, as ``cell``."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("v"))
        .filter(F.col("v") != "")
        .select(F.col("v").cast("int").alias("cell"))
    )


def read_edges(
    spark: SparkSession, path: str, delimiter: str = C.DEFAULT_DELIMITER, include_flags: bool = False
) -> DataFrame:
    """A saved edge list; without flags everything counts as included."""
    schema = "regulator string, target string, gain double" + (", include int" if include_flags else "")
    edges = spark.read.csv(path, sep=delimiter, schema=schema)
    return edges if include_flags else edges.withColumn("include", F.lit(1))
