"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bitmasks.

Components become integers ``floor(SCALE * x)``; a vector is cut into PARTS equal parts and every part position has a
codebook of ENTRIES integer entries, trained by Lloyd rounds. Training data never leave the tasks: a round is one scan
that sums parts per entry, and only those sums (ENTRIES rows per component) reach the driver.

Nearest entry of a part (``Slices``): the entries are sorted along every dimension, and ``prefix[k]`` is the bitmask of
the first k of them. The entry next to the part along the most spread dimension gives an initial radius: the nearest
entry lies within it, so in every dimension it lies in the range ``x - radius .. x + radius``, whose entries are
``prefix[hi] & ~prefix[lo]``. The ANDed masks hold all entries in the box, and only these are compared exactly.

Defined cases: vectors that are null or hold null or non-finite components are dropped; so are vectors whose length is
no positive multiple of PARTS or differs from that of the kept row with the smallest vec_id (parts must be equal).
Components beyond +-2**27 after scaling (|x| from 32,768) are clamped there, which keeps all sums within 64 bits.
Repeated rows count as often as they occur; seeds with equal vec_id follow their components; a null vec_id sorts last
and is carried along. Fewer than ENTRIES rows give fewer entries. No rows give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave.operators.skew import salted_join
from regweave.session import write_once

SCALE = 4096
PARTS = 8
ENTRIES = 16  # at most 64: entry sets are uint64 masks
ROUNDS = 6
LIMIT = 1 << 27
LABEL_ROWS_PER_SALT = 1_000_000
_HEX = np.array([f"{i:02x}" for i in range(256)])


class Slices:
    """One codebook, sorted along every dimension with prefix masks of its entries."""

    def __init__(self, book: np.ndarray):
        self.book = book
        order = np.argsort(book, axis=0, kind="stable")
        self.order = order
        self.coords = np.ascontiguousarray(np.take_along_axis(book, order, axis=0).T)
        bits = np.uint64(1) << order.T.astype(np.uint64)
        self.prefix = np.zeros((book.shape[1], len(book) + 1), np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=self.prefix[:, 1:])
        self.pilot = int(np.argmax(self.coords[:, -1] - self.coords[:, 0]))

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number not below the distance to the nearest entry."""
        line = self.coords[self.pilot]
        at = np.clip(np.searchsorted(line, x[:, self.pilot]), 0, len(line) - 1)
        entry = self.order[at, self.pilot]
        square = ((x - self.book[entry]) ** 2).sum(axis=1)
        r = np.sqrt(square.astype(np.float64)).astype(np.int64)
        r += r * r < square
        return r + (r * r < square)  # the float root may be one short for large squares

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the box of the given radius."""
        mask = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
        for j, line in enumerate(self.coords):
            lo = np.searchsorted(line, x[:, j] - radius, side="left")
            hi = np.searchsorted(line, x[:, j] + radius, side="right")
            mask &= self.prefix[j, hi] & ~self.prefix[j, lo]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry (ties to the lower one) and its squared distance."""
        mask = self.candidates(x, self.radius(x))
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.zeros(len(x), np.int64)
        for e, entry in enumerate(self.book):
            rows = np.flatnonzero((mask >> np.uint64(e)) & np.uint64(1))
            square = ((x[rows] - entry) ** 2).sum(axis=1)
            closer = square < best[rows]
            rows = rows[closer]
            best[rows], index[rows] = square[closer], e
        return index, best


def integer_vectors(table: DataFrame, *keep: str | Column) -> DataFrame:
    """``*keep, v``: kept rows with their scaled components."""
    vector = F.col("embedding")
    usable = vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    scaled = F.transform(
        vector,
        lambda x: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * x.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long"),
    )
    even = (F.size("v") > 0) & (F.size("v") % PARTS == 0)
    return table.filter(usable).select(*keep, scaled.alias("v")).filter(even)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) after the Lloyd rounds; ``None`` without vectors. ``vectors``: vec_id, v."""
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not seeds:
        return None
    dims = len(seeds[0].v)
    width = dims // PARTS
    books = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        current = books

        def sums(batches: Iterator[pa.RecordBatch], books=current) -> Iterator[pa.RecordBatch]:
            slices = [Slices(b) for b in books]
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                x = _matrix(batch.column("v"), dims)
                for p, s in enumerate(slices):
                    part = x[:, p * width : (p + 1) * width]
                    index, _ = s.nearest(part)
                    np.add.at(total[p], index, part)
                    count[p] += np.bincount(index, minlength=len(count[p]))
            slot = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.reshape(-1)), pa.array(np.repeat(count.reshape(-1), width))], ["slot", "s", "n"])

        # one row per component of the codebooks, whatever the number of vectors
        found = vectors.select("v").mapInArrow(sums, "slot long, s long, n long").groupBy("slot").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
        total, count = np.zeros(books.size, np.int64), np.zeros(books.size, np.int64)
        at = found.column("slot").to_numpy()
        total[at], count[at] = found.column("s").to_numpy(), found.column("n").to_numpy()
        moved = np.floor_divide(total, np.maximum(count, 1))
        books = np.where(count > 0, moved, books.reshape(-1)).reshape(books.shape)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector (columns vec_id, label, v)."""
    width = books.shape[2]
    dims = PARTS * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), np.int64)
            for p, s in enumerate(slices):
                index, square = s.nearest(x[:, p * width : (p + 1) * width])
                code = code + _HEX[index].astype(object)
                error += square
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
            )

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long")


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(table: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector of ``vec_id, embedding, label``."""
    ids = F.col("vec_id").cast("long").alias("vec_id")
    stored = write_once(integer_vectors(table, ids, F.col("label").cast("string").alias("label")), "integer-vectors")
    first = stored.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if first is None:
        return table.sparkSession.createDataFrame([], schema)
    same = stored.filter(F.size("v") == first.n)
    books = train(same)
    # nulls are a label of their own; a frequent label is split over tasks
    group = F.concat(F.when(F.col("label").isNull(), "0").otherwise("1"), F.coalesce("label", F.lit("")))
    coded = write_once(encode(same, books).withColumn("_group", group), "codes")
    totals = coded.groupBy("_group").agg(F.sum("error").alias("label_error"))
    joined = salted_join(coded, totals, "_group", "vec_id", pairs_per_salt=LABEL_ROWS_PER_SALT)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    ctes = [
        f"""k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""p AS (SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k CROSS JOIN (SELECT unnest(range({parts})) AS part))""",
        f"b0 AS (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, part, e, x, dist FROM (
            SELECT rid, p.part, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN b{r} b ON p.part = b.part)
            QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY dist, e) = 1)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
                SELECT part, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)"""
            )
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e)")
    ctes.append(
        f"""coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)"""
    )
    ctes.append(
        f"""digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, e, i)) AS h FROM (SELECT part, e, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS y FROM b{rounds}))"""
    )
    return f"""WITH {", ".join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM coded JOIN k USING (rid) CROSS JOIN digest"""
