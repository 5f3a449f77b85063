"""Boosted stumps on sparse targets: the residuals of a target are one number and the cells that differ from it.

A stump moves all cells without an entry of its regulator by the same leaf, so the residuals of a target stay a constant
plus differences in few cells, however many rounds are fitted. A histogram sums these differences only: over the codes
of the cells that differ. A regulator with no such cell has sums that follow from its counts. Between two codes with
differences the running sum is linear in the count and the gain convex, so the best split of such a run is at its ends,
as in :mod:`regweave.plans.first_round`. The codes of the best regulator are then all looked at, so that splits and ties
are those of :mod:`regweave.plans.histogram`.

A task holds the binned regulators of one phase and goes through the target blocks it was dealt, all rounds one after the
other. Entries of the targets are shuffled once, the regulators as often as there are tasks.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators import draws
from regweave.operators.features import Binned
from regweave.operators.ordering import hash_position
from regweave.params import BoostParams
from regweave.plans import blocks as B
from regweave.plans.histogram import LOG, LOSS, STATE_VERSION, HistogramBooster, Layout, _arrow, _fields, _names, lay_out
from regweave.session import drop_others, read_stored, scratch_path, write_once

DENSITY = 1 / 16  # above this share of entries whole residual arrays are faster
ENTRIES = 8_000_000  # binned regulator entries that a task holds
COUNTS = 16  # rows that the codes' counts come in
CHUNK = 1 << 16  # entries of a row of the packed regulators
PAIRS = 1 << 20  # (target, code) pairs summed at once
WHOLE = 1 << 30  # cells of a block: a phase is one block here
MERGED = 4  # differences are added up by cell when there are this many times more of them

_STATE = "tb int, cb int, base array<double>, idx array<bigint>, val array<double>, m array<struct<j: int, own: int, scale: double, name: string>>"


def fits(values: DataFrame, cells: DataFrame, binned: Binned, params: BoostParams) -> bool:
    """Whether stumps on a sparse matrix are asked for, whose regulators fit a task."""
    if params.max_depth != 1 or binned.cells.count() > ENTRIES:
        return False
    size = values.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gene").alias("genes")).first()
    return size["n"] <= DENSITY * size["genes"] * cells.count()


class StumpBooster(HistogramBooster):
    """The same calls and results as :class:`HistogramBooster`, for stumps."""

    def __init__(
        self,
        values: DataFrame,
        cells: DataFrame,
        binned: Binned,
        params: BoostParams,
        targets: DataFrame | None = None,
        nr_partitions: int | None = None,
        cells_per_block: int | None = None,
        totals: bool = False,
    ):
        self.params, self.binned, self.spark = params, binned, values.sparkSession
        if targets is not None:
            values = values.join(targets, "gene", "left_semi")
        self.nr_regulators = binned.regulators.count()
        self.targets_per_block, self.per_block = B.TARGETS, cells_per_block
        self.layout = lay_out(cells, WHOLE)
        self._prepare(values, nr_partitions, totals)
        self.state: str | None = None
        self.done = 0
        self._logs: list[DataFrame] = []
        self._left: DataFrame | None = None  # target blocks that go on, where not all do

    def _prepare(self, values: DataFrame, nr_partitions: int | None, totals: bool) -> None:
        per, layout = self.targets_per_block, self.layout
        index = write_once(hash_position(values.select("gene").distinct(), "gene", 0, "tid"), "targets")
        self.names = index.select("tid", F.col("gene").alias("target"))
        nr_blocks, nr_phases = -(-index.count() // per), max(len(layout.totals), 1)
        cores = self.spark.sparkContext.defaultParallelism
        self.copies = int(np.clip(-(-2 * cores // nr_phases), 1, max(nr_blocks, 1)))
        self.partitions = nr_partitions or min(nr_phases * self.copies, 64 * cores)
        cells = layout.cells
        if sum(layout.totals.values()) <= ENTRIES // 2:  # no longer than what a task holds anyway
            cells = F.broadcast(cells)
        tb, j = F.expr(f"cast(tid div {per} as int)").alias("tb"), F.expr(f"cast(tid % {per} as int)")
        at = values.join(cells, "cell").join(index, "gene")
        numbered = at.select(tb, "cb", (F.col("slot").cast("long") * per + j).alias("i"), "value")
        packed = numbered.groupBy("tb", "cb").agg(F.collect_list(F.struct("i", "value")).alias("e"))
        own = self.binned.regulators.select(F.col("regulator").alias("gene"), F.col("ridx").alias("own"))
        scale = F.lit(None).cast("double").alias("total")
        every = index.join(own, "gene", "left")
        if totals:  # the sum of a target's values, those outside the listed cells among them, in the place of its scale
            every, scale = every.join(values.groupBy("gene").agg(F.sum("value").alias("total")), "gene", "left"), F.coalesce("total", F.lit(0.0))
        entry = F.struct(j.alias("j"), F.coalesce("own", F.lit(-1)).cast("int").alias("own"), scale.alias("scale"), F.col("gene").alias("name"))
        listed = every.select(tb, entry.alias("m")).groupBy("tb").agg(F.array_sort(F.collect_list("m")).alias("m"))
        grid = listed.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nr_phases - 1))))
        start = grid.join(packed, ["tb", "cb"], "left").select(
            "tb", "cb", F.lit(None).cast("array<double>").alias("base"), F.col("e.i").alias("idx"), F.col("e.value").alias("val"), "m"
        )
        self.start = write_once(start, "sparse-entries")
        keyed = self.binned.cells.join(cells, "cell")
        code = (F.col("ridx").cast("long") * (1 << B.BIN_BITS) + F.col("bin")).alias("code")
        chunks = -(-self.binned.cells.count() // CHUNK)
        chunk = F.pmod(F.xxhash64("f", "cell"), F.lit(max(chunks, 1))).cast("int").alias("chunk")
        listed = keyed.select("cb", chunk, F.struct(code, F.col("slot").alias("pos")).alias("e")).groupBy("cb", "chunk").agg(F.collect_list("e").alias("e"))
        self.bins = write_once(listed.select("cb", "chunk", F.col("e.code").alias("code"), F.col("e.pos").alias("pos")), "sparse-bins")

    def _rows(self, named: bool = False) -> DataFrame:
        """The regulators of a phase, once per copy, before the target blocks dealt to it.

        Where ``named``, their names too, and the cells of every code, those outside the listed cells among them.
        """
        state = self.start if self.state is None else read_stored(self.spark, self.state, _STATE)
        if self._left is not None:
            state = state.join(self._left, "tb", "left_semi")
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1)))
        shared = self.bins.select(
            F.lit(0).alias("side"), "cb", copies.alias("g"), F.col("chunk").alias("tb"), "code", "pos",
            *[F.lit(None).cast(kind).alias(name) for name, kind in (f.split(" ", 1) for f in _STATE.split(", ", 5)[2:])],
        )
        if named:
            kind = shared.schema["m"].dataType
            one = F.struct(F.col("ridx").alias("j"), F.lit(None).cast("int").alias("own"), F.lit(None).cast("double").alias("scale"), F.col("regulator").alias("name"))
            names = self.binned.regulators.groupBy(F.floor(F.col("ridx") / CHUNK).cast("int").alias("tb")).agg(F.collect_list(one).cast(kind).alias("m"))
            keys = self.spark.range(1).select(F.lit(0).alias("side"), F.lit(0).alias("cb"), copies.alias("g"))
            code = (F.col("ridx").cast("long") * (1 << B.BIN_BITS) + F.col("bin")).alias("code")
            counts = self.binned.cells.groupBy(code).agg(F.count(F.lit(1)).cast("double").alias("n"))
            counts = counts.groupBy(F.pmod(F.xxhash64("code"), F.lit(COUNTS)).cast("int").alias("tb")).agg(F.collect_list(F.struct("code", "n")).alias("e"))
            counts = counts.select("tb", F.col("e.code").alias("code"), F.col("e.n").alias("val"))
            for rows in (names, counts):
                shared = shared.unionByName(keys.crossJoin(rows), allowMissingColumns=True)
        own = state.select(
            F.lit(1).alias("side"), "cb", (F.col("tb") % self.copies).alias("g"), "tb", F.lit(None).cast("array<bigint>").alias("code"), F.lit(None).cast("array<int>").alias("pos"),
            "base", "idx", "val", "m",
        )
        part = F.pmod(F.col("cb") * self.copies + F.col("g"), F.lit(self.partitions)).cast("int")
        return shared.union(own).repartitionById(self.partitions, part).sortWithinPartitions("cb", "g", "side", "tb")

    def boost(self, rounds: int, track_loss: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """Fit ``rounds`` more rounds: (split log of these rounds, losses or None), both stored."""
        turn, params, per, per_block = range(self.done, self.done + rounds), self.params, self.targets_per_block, self.per_block
        limits = self._limits(turn)
        phases = [(p, n, self.layout.fitted[p]) for p, n in sorted(self.layout.totals.items())]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (tb, cb), phase, _, *block in _blocks(batches, phases, params, limits, per_block):
                yield Targets(phase, *block, per).fit(tb, cb, turn, track_loss)

        schema = f"{_STATE}, log array<struct<{_fields(LOG)}>>, loss array<struct<{_fields(LOSS)}>>"
        stored = scratch_path(self.spark, "boosted")
        self._rows().mapInArrow(work, schema).write.parquet(stored, compression="zstd")
        self.state, self.done = stored, self.done + rounds
        log = read_stored(self.spark, stored, schema).select(F.explode("log").alias("e")).select("e.*")
        self._logs.append(log)
        return log, read_stored(self.spark, stored, schema).select(F.explode("loss").alias("e")).select("e.*") if track_loss else None

    def first_gains(self) -> DataFrame:
        """``regulator, target, gain``: every regulator's best gain for every target before the first round."""
        params, per = self.params, self.targets_per_block
        phases = [(p, n, self.layout.fitted[p]) for p, n in sorted(self.layout.totals.items())]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, phase, names, m, base, idx, val in _blocks(batches, phases, params, ({}, {}), None):
                block = Targets(phase, m, base, idx, val, per)
                gain = block.gains(phase.round(0))
                gain[[e["name"] is None for e in m]] = -np.inf
                own, regulators = pa.array([e["name"] for e in m], pa.string()), pa.array([names[int(r)] for r in phase.ridx], pa.string())
                step = max(1, CHUNK // max(len(phase.ridx), 1))
                for lo in range(0, len(m), step):
                    t, r = np.nonzero(gain[lo : lo + step] > params.min_gain)
                    columns = [regulators.take(pa.array(r)), own.take(pa.array(t + lo)), pa.array(gain[lo + t, r])]
                    yield pa.RecordBatch.from_arrays(columns, ["regulator", "target", "gain"])

        return self._rows(named=True).mapInArrow(work, "regulator string, target string, gain double")

    def keep_targets(self, left: DataFrame) -> None:
        """Go on with the target blocks that hold a target of ``left`` (target); the state of others is not carried on."""
        tb = F.expr(f"cast(tid div {self.targets_per_block} as int)").alias("tb")
        self._left = write_once(self.names.join(left.select("target"), "target", "left_semi").select(tb).distinct(), "blocks-left")

    def save(self, path: str) -> None:
        """Store everything a later session needs to go on: tables, and a manifest that is written last."""
        if self.done == 0:
            raise ValueError("nothing is boosted yet")
        state = read_stored(self.spark, self.state, _STATE)
        if self._left is not None:
            state = state.join(self._left, "tb", "left_semi")
        tables = {
            "state": state, "log": self.log(), "bins": self.bins, "names": self.names, "positions": self.layout.positions,
            "features": self.binned.features, "regulators": self.binned.regulators,
        }
        for name, table in tables.items():
            table.write.parquet(f"{path}/round-{self.done}/{name}", compression="zstd")
        manifest = {
            "version": STATE_VERSION, "engine": "stumps", "rounds": self.done, "params": dataclasses.asdict(self.params), "copies": self.copies,
            "nr_regulators": self.nr_regulators, "fitted": list(self.layout.fitted.items()), "totals": list(self.layout.totals.items()),
            "partitions": self.partitions, "per_block": self.per_block, "targets_per_block": self.targets_per_block,
        }
        line = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark, path: str) -> StumpBooster:
        """Go on from the round a manifest names; tables of other rounds below the path are deleted."""
        m = json.loads(spark.read.text(f"{path}/manifest").first().value)
        here = f"round-{m['rounds']}"
        drop_others(spark, path, keep={here, "manifest"})
        read = lambda name: spark.read.parquet(f"{path}/{here}/{name}")
        self = cls.__new__(cls)
        self.spark, self.params, self.done = spark, BoostParams(**m["params"]), m["rounds"]
        self.binned = Binned(None, read("features"), read("regulators"))
        sizes = {k: {p: n for p, n in m[k]} for k in ("fitted", "totals")}
        self.layout = Layout(None, None, read("positions"), sizes["fitted"], sizes["totals"], WHOLE)
        self.copies, self.partitions, self.per_block = m["copies"], m["partitions"], m["per_block"]
        self.targets_per_block, self.nr_regulators = m["targets_per_block"], m["nr_regulators"]
        self.bins, self.names, self.start, self._left = read("bins"), read("names"), None, None
        self.state, self._logs = f"{path}/{here}/state", [read("log")]
        return self


def _array(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.zeros(0, kind) if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(kind)


def _blocks(batches: Iterator[pa.RecordBatch], phases: list, params: BoostParams, limits: tuple[dict, dict], per_block: int | None) -> Iterator[tuple]:
    """Target blocks with the phase read before them: (tb, cb), phase, regulator names, then the block's columns."""
    at, codes, cells, names, counts, phase = None, [], [], {}, [], None
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in columns.items()}
            cb, g, tb = (row[n].as_py() for n in ("cb", "g", "tb"))
            if (cb, g) != at:
                at, codes, cells, names, counts, phase = (cb, g), [], [], {}, [], None
            if row["side"].as_py() == 0:
                if row["val"].values is not None:
                    counts.append((_array(row["code"], np.int64), _array(row["val"], float)))
                    continue
                codes.append(_array(row["code"], np.int64))
                cells.append(_array(row["pos"], np.int64))
                names |= {e["j"]: e["name"] for e in row["m"].as_py() or ()}
                continue
            if phase is None:
                phase = Phase(*phases[cb], codes, cells, params, limits, per_block, counts)
                codes, cells = [], []
            yield (tb, cb), phase, names, row["m"].as_py(), _array(row["base"], float), _array(row["idx"], np.int64), _array(row["val"], float)


class Phase:
    """The binned regulators of a phase: cells by code, codes by cell. Codes are numbered in order, regulators too.

    ``counts`` gives cells per code where not only the listed cells count.
    """

    def __init__(self, phase: int, n: int, nfit: int, codes: list, cells: list, params: BoostParams, limits: tuple[dict, dict], per_block: int | None, counts: list = ()):
        self.phase, self.n, self.nfit, self.params, self.limits, self.per_block = phase, n, nfit, params, limits, per_block
        code = np.concatenate([*codes, np.zeros(0, np.int64)])
        cell = np.concatenate([*cells, np.zeros(0, np.int64)])
        order = np.lexsort((cell, code))
        code, self.cells = code[order], cell[order].astype(np.int32)
        self.code, starts = np.unique(code, return_index=True)
        self.counts = None
        if counts:
            self.code, self.counts = (np.concatenate(c) for c in zip(*counts))
            order = np.argsort(self.code)
            self.code, self.counts = self.code[order], self.counts[order]
            starts = np.searchsorted(code, self.code)
        self.ptr = np.append(starts, len(code))
        ridx = self.code >> B.BIN_BITS
        self.ridx, self.first = np.unique(ridx, return_index=True)
        self.end = np.append(self.first[1:], len(ridx)).astype(np.int64)
        self.reg = np.repeat(np.arange(len(self.ridx)), self.end - self.first)
        by_cell = np.argsort(self.cells, kind="stable")
        self.codes = np.repeat(np.arange(len(self.code), dtype=np.int32), np.diff(self.ptr))[by_cell]
        self.cell_ptr = np.concatenate([[0], np.cumsum(np.bincount(self.cells, minlength=n))])
        self.turn, self.at = None, None

    def round(self, t: int) -> Round:
        """What a round draws; it does not change where everything is used."""
        key = t if self.params.subsample < 1 or self.params.colsample_bytree < 1 else -1
        if self.at != key:
            self.turn, self.at = Round(self, t), key
        return self.turn


class Round:
    """Counts of the cells drawn, per code, and the ends of every regulator's allowed counts."""

    def __init__(self, p: Phase, t: int):
        limit, params = p.limits[0].get((p.phase, t)), p.params
        pos = np.arange(p.n)
        self.sampled = pos < p.nfit
        if limit is not None:
            self.sampled &= draws.draw_keys(pos, params.seed, draws.ROWS, t) <= limit
        self.cnt = float(self.sampled.sum())
        none = not len(p.code)
        self.count = np.zeros(0) if none else p.counts if p.counts is not None else np.add.reduceat(self.sampled[p.cells].astype(float), p.ptr[:-1])
        total = np.cumsum(self.count)
        before = np.zeros(len(p.ridx)) if none else total[p.first] - self.count[p.first]
        self.upto = total - before[p.reg]
        self.all = np.zeros(0) if none else self.upto[p.end - 1]
        self.offered = B.offered(p.ridx << B.BIN_BITS, params, t, p.limits[1].get((0, t)))
        self.miss = self.cnt - self.all
        self.floor = floor = max(params.min_child_weight, 1e-12)
        # the smallest and largest running count of a regulator's codes at which both sides keep enough cells
        present, self.ends = self.count > 0, []
        for d in (0, 1):
            left = self.upto + (self.miss[p.reg] if d else 0)
            low = np.where(present & (left >= floor), self.upto, np.inf)
            high = np.where(present & (self.cnt - left >= floor), self.upto, -np.inf)
            self.ends.append((np.zeros(0), np.zeros(0)) if none else (np.minimum.reduceat(low, p.first), np.maximum.reduceat(high, p.first)))
        start = np.where(present, self.upto, np.inf)
        self.start = np.zeros(0) if none else np.minimum.reduceat(start, p.first)
        # a regulator without differences: its gain depends on the number of cells on the side without missing ones
        (lo0, hi0), (lo1, hi1) = self.ends
        ok = [(lo0 <= hi0) & self.offered, (lo1 <= hi1) & self.offered]
        regs = np.concatenate([np.flatnonzero(o) for o in ok for _ in (0, 1)])
        sizes = np.concatenate([lo0[ok[0]], hi0[ok[0]], (self.all - lo1)[ok[1]], (self.all - hi1)[ok[1]]])
        self.sizes, which = np.unique(sizes, return_inverse=True)
        self.options = [np.full(len(p.ridx), len(self.sizes)) for _ in range(4)]
        at = 0
        for i, option in enumerate(self.options):  # every regulator's up to four sizes, as numbers of sizes
            some = np.flatnonzero(ok[i // 2])
            option[some] = which[at : at + len(some)]
            at += len(some)
        order = np.lexsort((regs, which))
        self.regs, self.regs_ptr = regs[order], np.searchsorted(which[order], np.arange(len(self.sizes) + 1))

    def lowest(self, k: int, taken: np.ndarray) -> int:
        """The first regulator of a size that is not taken, or -1."""
        a, z, step = self.regs_ptr[k], self.regs_ptr[k + 1], 64
        while a < z:
            some = self.regs[a : min(a + step, z)]
            free = ~taken[some]
            i = int(free.argmax())
            if free[i]:
                return int(some[i])
            a, step = a + step, step * 8
        return -1


class Targets:
    """A block of targets in a phase: ``base`` per target, and differences (target, cell, value)."""

    def __init__(self, p: Phase, m: list[dict], base: np.ndarray, idx: np.ndarray, val: np.ndarray, per: int):
        self.p, self.m, self.per, width = p, m, per, len(m)
        self.own = np.array([e["own"] for e in m], np.int64)
        self.j, self.pos, self.val = idx % per, idx // per, val
        if len(base):
            self.base, self.scale = base, np.array([e["scale"] for e in m])
        else:
            self.base = np.full(width, -p.params.base_score)
            self.scale = np.bincount(self.j, val * val, width) + 1
        own = np.searchsorted(p.ridx, self.own)
        known = own < len(p.ridx)
        known[known] = p.ridx[own[known]] == self.own[known]
        self.own_reg = np.where(known, own, -1)
        self.merged = len(val)

    def fit(self, tb: int, cb: int, turn: range, track_loss: bool) -> pa.RecordBatch:
        p, log, loss = self.p, [], []
        for t in turn:
            now = p.round(t)
            if now.cnt > 0:
                log += [(p.phase, tb * self.per + j, t, 0, *e) for j, e in self.step(now)]
            if track_loss:
                loss += self.losses(t, tb)
        self.merge()
        return self.output(tb, cb, log, loss)

    def step(self, now: Round) -> list[tuple]:
        """One round: (target, (code, d, gain, cover)) of the splits that stay; the leaves are taken off."""
        params, width = self.p.params, len(self.base)
        use = now.sampled[self.pos]
        j, pos, val = self.j[use], self.pos[use], self.val[use]
        tot = self.base * now.cnt + np.bincount(j, val, width)
        keys, sums = self.sums(j, pos, val, now)
        reg, code, d, gain, left, n_left = self.search(now, tot, keys, sums)
        lam, out, new = params.reg_lambda, [], []
        weight = lambda s, n: params.eta * s / (n + lam) if n + lam > 0 else 0.0
        p = self.p
        for i in range(width):
            if reg[i] < 0 or gain[i] < params.gamma:
                self.base[i] -= weight(tot[i], now.cnt)
                continue
            k = code[i]
            out.append((i, (int(p.code[k]), int(d[i]), float(gain[i]), now.cnt)))
            w = weight(left[i], n_left[i]), weight(tot[i] - left[i], now.cnt - n_left[i])
            missing, other = (w[0], w[1]) if d[i] else (w[1], w[0])
            self.base[i] -= missing
            a, z = (k + 1, p.end[reg[i]]) if d[i] else (p.first[reg[i]], k + 1)
            cells = p.cells[p.ptr[a] : p.ptr[z]]
            new.append((np.full(len(cells), i), cells, np.full(len(cells), missing - other)))
        if new:
            self.j, self.pos, self.val = (np.concatenate([a, *b]) for a, b in zip((self.j, self.pos, self.val), zip(*new)))
            if len(self.val) > MERGED * (self.merged + width):
                self.merge()
        return out

    def merge(self) -> None:
        """One difference per target and cell."""
        key = self.j * self.p.n + self.pos
        if len(key):
            order = np.argsort(key, kind="stable")
            key, val = key[order], self.val[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.val = np.add.reduceat(val, at)
            self.j, self.pos = key[at] // self.p.n, key[at] % self.p.n
        self.merged = len(self.val)

    def sums(self, j: np.ndarray, pos: np.ndarray, val: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray]:
        """``target * codes + code`` in order, and the sum of differences there; offered regulators, without a target's own."""
        p = self.p
        sizes = p.cell_ptr[pos + 1] - p.cell_ptr[pos]
        upto, done, found = np.cumsum(sizes), 0, []
        while done < len(pos):
            stop = max(done + 1, int(np.searchsorted(upto, upto[done] - sizes[done] + PAIRS, side="right")))
            found.append(self._sums(j[done:stop], pos[done:stop], val[done:stop], sizes[done:stop], now))
            done = stop
        return _added([k for k, _ in found], [s for _, s in found])

    def _sums(self, j: np.ndarray, pos: np.ndarray, val: np.ndarray, sizes: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        upto = np.cumsum(sizes)
        rows = np.repeat(np.arange(len(pos)), sizes)
        code = p.codes[np.arange(len(rows)) + np.repeat(p.cell_ptr[pos] - (upto - sizes), sizes)]
        target = j[rows]
        reg = p.reg[code]
        keep = (reg != self.own_reg[target]) if now.offered.all() else (reg != self.own_reg[target]) & now.offered[reg]
        key, value = (target * len(p.code) + code)[keep], val[rows][keep]
        if p.per_block is None:
            return _added([key], [value])
        # partial histograms of the blocks of cells, then their sum
        block = (pos // p.per_block)[rows][keep]
        parts, s = _added([block * (len(self.base) * len(p.code)) + key], [value])
        return _added([parts % (len(self.base) * len(p.code))], [s])

    def score(self, now: Round, tot: np.ndarray, t: np.ndarray, left: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Both sides' part of the gain of splits of targets ``t`` with ``n`` cells and the sum ``left`` on the left."""
        lam = self.p.params.reg_lambda
        with np.errstate(divide="ignore", invalid="ignore"):
            right = tot[t] - left
            right *= right
            right /= now.cnt - n + lam
            right += left * left / (n + lam)
        return right

    def touched(self, now: Round, tot: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets and regulators with differences in the regulator's cells, in order, and their best score (-inf: none is allowed)."""
        p = self.p
        t, k = np.divmod(keys, len(p.code))
        r = p.reg[k]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])))
        ft, fr = t[first], r[first]
        sizes = np.diff(np.append(first, len(t)))
        seg = np.repeat(np.arange(len(first)), sizes)
        running = np.cumsum(sums)
        y = running - (running[first] - sums[first])[seg]
        at, before = now.upto[k], now.upto[k] - now.count[k]
        last = np.append(before[1:], 0.0)
        ends = first + sizes - 1
        last[ends] = now.all[fr]
        base = self.base[ft]
        best = np.full(len(first), -np.inf)
        for d in (0, 1):
            lo, hi = now.ends[d][0][fr], now.ends[d][1][fr]
            extra = tot[ft] - y[ends] - base * now.all[fr] if d else np.zeros(len(first))
            miss = now.miss[fr] if d else np.zeros(len(first))
            # runs that begin at a code with a difference, and the one before the first of them
            runs = (t, y + extra[seg], base[seg], miss[seg], np.maximum(at, lo[seg]), np.minimum(last, hi[seg]))
            lead = (ft, extra, base, miss, np.maximum(now.start[fr], lo), np.minimum(before[first], hi))
            for tt, add, per, more, a, z in (runs, lead):
                ok = a <= z
                top = np.full(len(tt), -np.inf)
                for n in (a, z):
                    n = np.where(ok, n, 0.0)
                    np.maximum(top, self.score(now, tot, tt, add + per * n, n + more), out=top, where=ok)
                np.maximum(best, np.maximum.reduceat(top, first) if len(top) > len(best) else top, out=best)
        return ft, fr, best

    def gains(self, now: Round) -> np.ndarray:
        """(targets, regulators): the gain of each regulator's best split, -inf where none is allowed."""
        p, width = self.p, len(self.base)
        use = now.sampled[self.pos]
        j, pos, val = self.j[use], self.pos[use], self.val[use]
        tot = self.base * now.cnt + np.array([e["scale"] for e in self.m])
        every = np.arange(width)[:, None]
        plain = np.full((width, len(now.sizes) + 1), -np.inf)
        plain[:, :-1] = self.score(now, tot, every, self.base[:, None] * now.sizes, now.sizes[None, :])
        out = plain[:, now.options[0]]
        for option in now.options[1:]:
            np.maximum(out, plain[:, option], out=out)
        keys, sums = self.sums(j, pos, val, now)
        if len(keys):
            ft, fr, top = self.touched(now, tot, keys, sums)
            out[ft, fr] = top
        named = np.flatnonzero(self.own_reg >= 0)
        out[named, self.own_reg[named]] = -np.inf
        out -= (tot * tot / (now.cnt + p.params.reg_lambda))[:, None]
        return out

    def search(self, now: Round, tot: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per target: regulator (-1: no split), code, d, gain, left sum and left count of the best split."""
        p, params, width = self.p, self.p.params, len(self.base)
        scale, parent = 1e9 / self.scale, tot * tot / (now.cnt + params.reg_lambda)
        best_rank, best_reg = np.full(width, -np.inf), np.full(width, -1)

        def ranked(t, left, n, ok):
            """Gains and ranks of splits of targets ``t``."""
            gain = self.score(now, tot, t, left, n) - parent[t]
            return gain, np.where(ok & (gain > params.min_gain), np.rint(gain * scale[t]), -np.inf)

        taken = np.zeros((width, len(p.ridx)), bool)
        named = np.flatnonzero(self.own_reg >= 0)
        taken[named, self.own_reg[named]] = True
        if len(keys):
            ft, fr, top = self.touched(now, tot, keys, sums)
            taken[ft, fr] = True
            gain = top - parent[ft]
            rank = np.where(gain > params.min_gain, np.rint(gain * scale[ft]), -np.inf)
            starts = np.flatnonzero(np.append(True, ft[1:] != ft[:-1]))
            best = np.maximum.reduceat(rank, starts)
            who = ft[starts]
            equal = rank == np.repeat(best, np.diff(np.append(starts, len(ft))))
            best_reg[who] = np.where(best > -np.inf, np.minimum.reduceat(np.where(equal, fr, len(p.ridx)), starts), -1)
            best_rank[who] = best
        if len(now.sizes):
            every = np.arange(width)[:, None]
            rank = ranked(every, self.base[:, None] * now.sizes, now.sizes[None, :], True)[1]
            order = np.argsort(-rank, axis=1, kind="stable")
            for i in range(width):
                level, found = None, -1
                for k in order[i]:
                    x = rank[i, k]
                    if x == -np.inf or x < best_rank[i] or (found >= 0 and x < level):
                        break
                    low = now.lowest(k, taken[i])
                    if low >= 0 and (found < 0 or low < found):
                        level, found = x, low
                if found >= 0 and (level > best_rank[i] or found < best_reg[i]):
                    best_rank[i], best_reg[i] = level, found
        return self.refined(now, tot, keys, sums, best_reg, ranked)

    def refined(self, now: Round, tot: np.ndarray, keys: np.ndarray, sums: np.ndarray, reg: np.ndarray, ranked) -> tuple[np.ndarray, ...]:
        """All codes of each target's best regulator: highest rank, then lowest code, then missing cells right."""
        p, width = self.p, len(self.base)
        found = [reg.copy(), np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width), np.zeros(width), np.zeros(width)]
        who = np.flatnonzero(reg >= 0)
        if not len(who):
            return tuple(found)
        r = reg[who]
        sizes = p.end[r] - p.first[r]
        starts = np.cumsum(sizes) - sizes
        t = np.repeat(who, sizes)
        k = np.arange(len(t)) + np.repeat(p.first[r] - starts, sizes)
        at = np.searchsorted(keys, t * len(p.code) + k)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == (t * len(p.code) + k)[hit]
        extra = np.zeros(len(t))
        extra[hit] = sums[at[hit]]
        running = np.cumsum(extra)
        near = running - np.repeat(running[starts] - extra[starts], sizes) + self.base[t] * now.upto[k]
        whole = np.repeat(near[starts + sizes - 1], sizes)
        rr = p.reg[k]
        sides = []
        for d in (0, 1):
            left = near + (tot[t] - whole) if d else near
            n = now.upto[k] + (now.miss[rr] if d else 0.0)
            ok = (now.count[k] > 0) & (n >= now.floor) & (now.cnt - n >= now.floor)
            sides.append((*ranked(t, left, n, ok), left, n))
        rank = np.stack([s[1] for s in sides], axis=1).ravel()
        for i, a, z in zip(who, 2 * starts, 2 * (starts + sizes)):
            b = a + int(rank[a:z].argmax())
            d, row = b % 2, b // 2
            if rank[b] == -np.inf:
                found[0][i] = -1
                continue
            for column, value in zip(found[1:], (k[row], d, sides[d][0][row], sides[d][2][row], sides[d][3][row])):
                column[i] = value
        return tuple(found)

    def losses(self, t: int, tb: int) -> list[tuple]:
        """Sums of squares over fitted and held-out cells."""
        self.merge()
        p, width, out = self.p, len(self.base), []
        for late in (False, True):
            use = (self.pos >= p.nfit) == late
            j, val = self.j[use], self.base[self.j[use]] + self.val[use]
            rest = (p.n - p.nfit if late else p.nfit) - np.bincount(j, minlength=width)
            out.append((np.bincount(j, val * val, width) + rest * self.base * self.base).tolist())
        return [(p.phase, tb * self.per + j, t, a, b) for j, (a, b) in enumerate(zip(*out))]

    def output(self, tb: int, cb: int, log: list, loss: list) -> pa.RecordBatch:
        order = np.argsort(self.j, kind="stable")
        m = [{**e, "scale": float(s)} for e, s in zip(self.m, self.scale)]
        kind = pa.struct([("j", pa.int32()), ("own", pa.int32()), ("scale", pa.float64()), ("name", pa.string())])
        columns = {
            "tb": pa.array([tb], pa.int32()),
            "cb": pa.array([cb], pa.int32()),
            "base": pa.array([self.base], pa.list_(pa.float64())),
            "idx": pa.array([(self.pos * self.per + self.j)[order].astype(np.int64)], pa.list_(pa.int64())),
            "val": pa.array([self.val[order]], pa.list_(pa.float64())),
            "m": pa.array([m], pa.list_(kind)),
        }
        for name, rows, fields in (("log", log, LOG), ("loss", loss, LOSS)):
            columns[name] = pa.array([[dict(zip(_names(fields), e)) for e in rows]], pa.list_(_arrow(fields)))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their values."""
    key, value = (x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((keys, np.int64), (values, float)))
    if not len(key):
        return key, value
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(value[order], at)
