"""Best-fit packing after a Martello-Toth dominance reduction, over the whole corpus at once.

Only lengths decide where a piece goes, and a length is at most ROOM, so the plan is made on the number of pieces of
every length (at most ROOM numbers, whatever the corpus): sets of lengths that provably dominate every alternative are
fixed (``reduce_lengths``), and what remains is placed best fit, longest first (``best_fit``), both for all equal
pieces at once. A plan is a list of *bin types*: how many sequences hold which lengths. At most three types are added
per length and step, and a type has at most 90 different lengths (1 + 2 + ... + 90 = 4095), so its size has a bound.

Spark does the rest: one scan tokenizes and cuts the documents and numbers the pieces of a length within its task;
counts per (task, length) are turned into global numbers by a window over the tasks; a piece then finds its sequence
and place from its length and number alone. No text is shuffled and no group holds a corpus.

The dominance tests for a piece j with room c - s(j) left: no other piece fits (alone); the largest that fits fills the
sequence; at most one more piece fits (the two smallest do not); at most two more fit and the largest that fits is at
least as long as the best pair, or it is part of that pair and no other pair can take its place.

Defined cases: a null or empty text has only the end id; repeated rows (also of one doc_id) are packed one by one; a
null doc_id is carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regweave.llm.packing import WordTokenizer, default_tokenizer
from regweave.session import write_once

ROOM = 4096
END_ID = 1
SLICE_BYTES = 4 << 20
_state: dict = {}

#: one bin type: number of sequences, and (length, pieces of it) for each of them
BinType = tuple[int, tuple[tuple[int, int], ...]]


class _Below:
    """The largest length up to x that still has pieces; lengths only ever run out."""

    def __init__(self, left: list[int]):
        self.left = left
        self.jump = list(range(len(left)))

    def __call__(self, x: int) -> int:
        path = []
        while x > 0 and not self.left[x]:
            path.append(x)
            x = min(self.jump[x], x - 1)
        for p in path:
            self.jump[p] = x
        return max(x, 0)


def _smallest(left: list[int], start: int, without: int, many: int) -> list[int]:
    """The ``many`` smallest pieces, one piece of length ``without`` set aside."""
    out: list[int] = []
    for s in range(start, len(left)):
        n = left[s] - (s == without)
        if n > 0:
            out += [s] * min(n, many - len(out))
        if len(out) == many:
            break
    return out


def _best_pair(left: list[int], without: int, room: int) -> tuple[int, int] | None:
    """Two pieces of the largest sum up to ``room``, the longer first."""
    sizes = [s for s in range(1, len(left)) if left[s] - (s == without) > 0]
    lo, hi, best = 0, len(sizes) - 1, None
    while lo <= hi:
        a, b = sizes[hi], sizes[lo]
        if a + b > room or (lo == hi and left[a] - (a == without) < 2):
            hi -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        lo += 1
    return best


def reduce_lengths(counts: list[int], room: int = ROOM) -> tuple[list[BinType], list[int]]:
    """Bin types fixed by dominance, and the pieces left per length (``counts[s]`` pieces have length s)."""
    left = list(counts)
    fixed: list[BinType] = []
    changed = True
    while changed:
        changed = False
        below = _Below(left)
        start = 1
        for s in range(room, 0, -1):
            while left[s]:
                while start < room and not left[start]:
                    start += 1
                gap = room - s
                small = _smallest(left, start, s, 3)
                if not small or small[0] > gap:
                    chosen: tuple[int, ...] = (s,)
                else:
                    mate = below(gap)
                    if mate == s and left[s] == 1:
                        mate = below(s - 1)
                    if mate == gap or len(small) == 1 or small[0] + small[1] > gap:
                        chosen = (s, mate)
                    elif len(small) == 2 or sum(small) > gap:
                        a, b = _best_pair(left, s, gap)
                        if mate >= a + b:
                            chosen = (s, mate)
                        elif mate == a and _no_other_pair(left, s, a, b, gap):
                            chosen = (s, a, b)
                        else:
                            break
                    else:
                        break
                need = {x: chosen.count(x) for x in chosen}
                times = min(left[x] // k for x, k in need.items())
                for x, k in need.items():
                    left[x] -= times * k
                fixed.append((times, tuple(sorted(need.items(), reverse=True))))
                changed = True
    return fixed, left


def _no_other_pair(left: list[int], s: int, a: int, b: int, gap: int) -> bool:
    """Between a and b lies at most one piece, or the two pieces next above b do not fit together."""
    between = [x for x in range(b + 1, a) for _ in range(min(2, left[x] - (x == s)))]
    if len(between) <= 1:
        return True
    return between[0] + between[1] > gap


def best_fit(counts: list[int], room: int = ROOM) -> list[BinType]:
    """Best fit, longest first: a piece goes where it leaves the least room; equal sequences are filled together."""
    open_bins: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []
    done: list[BinType] = []

    def put(free: int, many: int, content: tuple) -> None:
        if not many:
            return
        if free == 0:
            done.append((many, content))
            return
        if free not in open_bins:
            open_bins[free] = []
            insort(rooms, free)
        open_bins[free].append((many, content))

    for s in range(room, 0, -1):
        todo = counts[s]
        while todo:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                free, many, content = room, -(-todo // (room // s)), ()
            else:
                free = rooms[at]
                many, content = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                    rooms.pop(at)
            each = free // s
            full = min(many, todo // each)
            put(free - each * s, full, (*content, (s, each)))
            todo -= full * each
            if full < many and todo:
                put(free - todo * s, 1, (*content, (s, todo)))
                full, todo = full + 1, 0
            put(free, many - full, content)
    return done + [b for bins in open_bins.values() for b in bins]


def plan_sequences(counts: list[int], room: int = ROOM) -> dict[str, np.ndarray]:
    """Slots ordered by (length, first number): where the pieces of a length go in the order of their numbers."""
    fixed, left = reduce_lengths(counts, room)
    taken = [0] * (room + 1)
    rows, base = [], 0
    for many, content in fixed + best_fit(left, room):
        at = 0
        for s, each in content:
            rows.append((s, taken[s], base, each, at))
            taken[s] += many * each
            at += s * each
        base += many
    rows.sort()
    names = ("length", "first", "sequence", "each", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Some rows at a time, a few megabytes of text or one longer text."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        raw = (t.as_py() or "").encode()
        ids.append(i)
        texts.append(raw)
        size += len(raw)
        if size > SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def cut_documents(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, number``: pieces numbered by length within their task."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _state:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _state[path] = WordTokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        seen = np.zeros(room + 1, np.int64).tolist()
        task = TaskContext.get().partitionId()
        for batch in batches:
            for ids, texts in _slices(batch):
                rows = []
                for doc, raw in zip(ids, _state[path].encode(texts)):
                    raw = memoryview(raw + end)
                    n = len(raw) // 4
                    for k, s in enumerate(range(0, n, room)):
                        size = min(room, n - s)
                        rows.append((doc, k, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), task, seen[size]))
                        seen[size] += 1
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(_PIECE))

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in _PIECE.items()))


_PIECE = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "task": "long", "number": "long"}


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece."""
    pieces = write_once(cut_documents(docs, tokenizer, room), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per_task = write_once(per_task, "piece-counts")
    counts = [0] * (room + 1)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``room`` rows
        counts[length] = n
    slots = plan_sequences(counts, room)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["length", "task"]).withColumn("number", F.col("number") + F.col("before"))
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        start = np.searchsorted(slot["length"], np.arange(room + 2))
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                lo, hi = start[length[rows[0]]], start[length[rows[0]] + 1]
                at[rows] = lo + np.searchsorted(slot["first"][lo:hi], number[rows], side="right") - 1
            inside = number - slot["first"][at]
            sequence = slot["sequence"][at] + inside // slot["each"][at]
            offset = slot["offset"][at] + inside % slot["each"][at] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*_OUT])

    names = ("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.select(*names).mapInArrow(place, ", ".join(f"{k} {t}" for k, t in _OUT.items()))


_OUT = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"}
