"""Boosting on partial histograms: one engine for stumps, deeper trees, row and column sampling, phases and held-out cells.

Cells are laid out in blocks of at most ``CELLS`` cells of one phase, fitted cells first; targets in blocks of ``TARGETS``.
The regulators are one packed bin list per cell block, the state is one residual array per (target block, cell block).
A tree level is: every (target block, cell block) sums its residuals per code (``Histogram``), histograms of a target
block and a range of regulators are added over the cell blocks after a shuffle on that key, the split search runs on
the sums, and a grouped maximum takes the best range. Only histograms are shuffled, never cells, residuals or pairs.
The residuals are rewritten once a round, and the version before is deleted.

Where every phase is a single cell block there is nothing to add up between blocks. The same steps then run one after
the other inside the task of a (target block, cell block), all rounds of a call in one job, with the same results.

Nothing that grows with the data is collected or broadcast by hand: the driver sees one row per phase (sizes) and one
number per phase and round (draw limits).
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators import draws
from regweave.operators.features import Binned
from regweave.operators.ordering import hash_position, position_by_range
from regweave.params import BoostParams
from regweave.plans import blocks as B
from regweave.session import drop_others, drop_stored, read_stored, scratch_path, write_once

STATE_VERSION = 1
ENTRIES_PER_BLOCK = 4_000_000  # packed bins of a cell block (8 bytes each)
CODES_PER_RANGE = 16_384  # codes of a range of regulators whose histograms are added in one place
CODES_TIMES_TARGETS = 1 << 22  # codes of one regulator times targets of a block
HELD_BYTES = 128 << 20  # histograms a task adds up before it hands them on

LOG = "phase int, tid long, round int, node int, code long, d int, gain double, cover double"
LOSS = "phase int, tid long, round int, sse_fit double, sse_test double"
_STATE = "tb int, cb int, idx array<int>, val array<double>, res binary"
_TREE = "node int, code long, d int, gain double, left double, n_left double, tot double, cnt double"


@dataclass(frozen=True)
class Layout:
    """``cells``: cell, cb, slot; ``blocks``: cb, phase, lo, n, nfit; sizes per phase on the driver."""

    cells: DataFrame
    blocks: DataFrame
    positions: DataFrame
    fitted: dict[int, int]
    totals: dict[int, int]
    block: int

    @property
    def nr_blocks(self) -> int:
        return sum(-(-n // self.block) for n in self.totals.values())

    @property
    def single(self) -> bool:
        """Every phase is one cell block."""
        return all(n <= self.block for n in self.totals.values())


def lay_out(cells: DataFrame, block: int) -> Layout:
    """``cells``: cell, phase, fit (one row per cell). Positions count within a phase, fitted cells first, by cell id."""
    keyed = cells.select("cell", "phase", "fit", F.struct("phase", (~F.col("fit")).alias("late"), "cell").alias("_key"))
    placed = write_once(position_by_range(keyed, "_key", "_g").drop("_key"), "cell-positions")
    sizes = placed.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fit").cast("long")).alias("nfit"), F.min("_g").alias("start"))
    rows = sorted(sizes.collect(), key=lambda r: r.phase)  # one row per phase
    spark = cells.sparkSession
    table, base = [], 0
    for r in rows:
        table.append((r.phase, r.n, r.nfit, r.start, base))
        base += -(-r.n // block)
    phases = F.broadcast(spark.createDataFrame(table, "phase int, n long, nfit long, start long, base int"))
    pos = F.col("_g") - F.col("start")
    placed = placed.join(phases, "phase").select(
        "cell", "phase", "fit", pos.alias("pos"), (F.col("base") + F.floor(pos / block)).cast("int").alias("cb"), (pos % block).cast("int").alias("slot")
    )
    i = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1))
    cbs = phases.select("phase", "n", "nfit", "base", i.alias("i")).select(
        (F.col("base") + F.col("i")).alias("cb"),
        "phase",
        (F.col("i").cast("long") * block).alias("lo"),
        F.least(F.lit(block).cast("long"), F.col("n") - F.col("i").cast("long") * block).cast("int").alias("n"),
        "nfit",
    )
    return Layout(
        placed.select("cell", "cb", "slot", "phase"), cbs, placed.filter("fit").select(F.col("phase").alias("group"), "pos"),
        {r.phase: r.nfit for r in rows}, {r.phase: r.n for r in rows}, block,
    )


class HistogramBooster:
    """``cells``: cell, phase, fit. Rounds are numbered on from ``first_round`` over all calls of :meth:`boost`."""

    def __init__(
        self,
        values: DataFrame,
        cells: DataFrame,
        binned: Binned,
        params: BoostParams,
        targets: DataFrame | None = None,
        nr_partitions: int | None = None,
        cells_per_block: int | None = None,
    ):
        self.params, self.binned = params, binned
        self.spark = values.sparkSession
        if targets is not None:
            values = values.join(targets, "gene", "left_semi")
        self.nr_regulators = binned.regulators.count()
        codes = binned.features.groupBy("ridx").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("top"), F.sum("k").alias("all")).first()
        self.targets_per_block = int(np.clip(CODES_TIMES_TARGETS // max(codes["top"] or 1, 1), 1, B.TARGETS))
        self.per_range = max(1, int(CODES_PER_RANGE * self.nr_regulators / max(codes["all"] or 1, 1)))
        entries = binned.cells.count() / max(cells.count(), 1)
        block = cells_per_block or int(np.clip(ENTRIES_PER_BLOCK / max(entries, 1.0), 16, B.CELLS))
        self.layout = lay_out(cells, min(block, 1 << B.SLOT_BITS))
        self._prepare(values, nr_partitions)
        self.state: str | None = None
        self.done = 0
        self._logs: list[DataFrame] = []
        self._saved: str | None = None  # a state that belongs to a stored manifest is never deleted here

    def _prepare(self, values: DataFrame, nr_partitions: int | None) -> None:
        per, layout = self.targets_per_block, self.layout
        index = write_once(hash_position(values.select("gene").distinct(), "gene", 0, "tid"), "targets")
        self.names = index.select("tid", F.col("gene").alias("target"))
        nr_blocks = -(-index.count() // per)
        nr_cell_blocks = layout.nr_blocks
        cores = self.spark.sparkContext.defaultParallelism
        # copies of a cell block's bins: enough to spread the target blocks when there are few cell blocks
        self.copies = int(np.clip(-(-4 * cores // max(nr_cell_blocks, 1)), 1, max(nr_blocks, 1)))
        self.partitions = nr_partitions or max(4 * cores, min(nr_cell_blocks * self.copies, 64 * cores))
        at = values.join(index, "gene").join(layout.cells, "cell")
        tb, j = F.expr(f"cast(tid div {per} as int)").alias("tb"), F.expr(f"cast(tid % {per} as int)")
        numbered = at.select("tid", "phase", tb, j.alias("j"), "cb", "slot", "value")
        packed = numbered.groupBy("tb", "cb").agg(F.collect_list(F.struct((F.col("slot") * per + F.col("j")).alias("i"), "value")).alias("e"))
        grid = self.spark.range(nr_blocks).select(F.col("id").cast("int").alias("tb")).repartition(cores)
        grid = grid.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(max(nr_cell_blocks, 1) - 1))))
        start = grid.join(packed, ["tb", "cb"], "left").select(
            "tb", "cb", F.col("e.i").alias("idx"), F.col("e.value").alias("val"), F.lit(None).cast("binary").alias("res")
        )
        self.start = write_once(start, "residual-entries")
        own = self.binned.regulators.select(F.col("regulator").alias("gene"), F.col("ridx").alias("own"))
        squares = numbered.groupBy("tid", "phase").agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
        phases = F.explode(F.array(*[F.lit(p).cast("int") for p in sorted(layout.totals)])) if layout.totals else F.lit(0)
        every = index.join(own, "gene", "left").withColumn("phase", phases).join(squares, ["tid", "phase"], "left")
        meta = every.select(tb, "phase", j.alias("j"), F.coalesce("own", F.lit(-1)).alias("own"), (F.coalesce("sq", F.lit(0.0)) + 1).alias("scale"))
        self.meta = write_once(meta.groupBy("tb", "phase").agg(F.array_sort(F.collect_list(F.struct("j", "own", "scale"))).alias("m")), "target-blocks")
        codes = self.binned.cells.join(layout.cells, "cell").select(
            "cb", ((F.col("ridx").cast("long") * (1 << B.BIN_BITS) + F.col("bin")) * (1 << B.SLOT_BITS) + F.col("slot")).alias("k")
        )
        bins = codes.groupBy("cb").agg(F.sort_array(F.collect_list("k")).alias("keys"))
        self.bins = write_once(layout.blocks.join(bins, "cb", "left"), "packed-bins")

    # -- rows -------------------------------------------------------------------------------------------------

    def _rows(self, extra: DataFrame | None = None) -> DataFrame:
        """State joined with its cell block's bins; both sides dealt by (cell block, copy), so nothing is shuffled twice."""
        state = self.start if self.state is None else read_stored(self.spark, self.state, _STATE)
        keyed = state.withColumn("_g", F.col("tb") % self.copies).repartition(self.partitions, "cb", "_g")
        copied = self.bins.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1)))).repartition(self.partitions, "cb", "_g")
        rows = keyed.join(copied.hint("shuffle_hash"), ["cb", "_g"]).drop("_g").join(self.meta, ["tb", "phase"])
        rows = rows.withColumn("per", F.lit(self.targets_per_block))
        return rows if extra is None else rows.join(extra, ["tb", "phase"], "left")

    def _limits(self, rounds: range) -> tuple[dict, dict]:
        p = self.params
        rows = cols = {}
        if p.subsample < 1:
            sizes = {g: draws.sample_size(p.subsample, n) for g, n in self.layout.fitted.items() if n}
            rows = draws.draw_limits(self.layout.positions, sizes, p.seed, draws.ROWS, list(rounds))
        if p.colsample_bytree < 1:
            names = self.binned.regulators.select(F.lit(0).alias("group"), F.col("ridx").alias("pos"))
            cols = draws.draw_limits(names, {0: draws.sample_size(p.colsample_bytree, self.nr_regulators)}, p.seed, draws.COLUMNS, list(rounds))
        return rows, cols

    # -- boosting ---------------------------------------------------------------------------------------------

    def boost(self, rounds: int, track_loss: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """Fit ``rounds`` more rounds: (split log of these rounds, losses or None), both stored."""
        turn = range(self.done, self.done + rounds)
        limits = self._limits(turn)
        out = self._in_tasks(turn, limits, track_loss) if self.layout.single else self._level_by_level(turn, limits, track_loss)
        self.done += rounds
        self._logs.append(out[0])
        return out

    def log(self) -> DataFrame:
        """The split log of all rounds so far."""
        return _union(self._logs)

    def _in_tasks(self, turn: range, limits: tuple[dict, dict], track_loss: bool) -> tuple[DataFrame, DataFrame | None]:
        params, per = self.params, self.targets_per_block

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _unpacked(batches, params):
                log, loss = [], []
                for t in turn:
                    sampled = row.sampled(t, limits[0], params)
                    use = B.offered(row.bins.code, params, t, limits[1].get((0, t)))
                    trees: list[list] = [[] for _ in row.own]
                    for level in range(params.max_depth):
                        node = None if level == 0 else row.nodes(trees)
                        for k in B.level_nodes(level):
                            if node is not None and not (node == k).any():
                                continue
                            h = B.histogram(row.bins, row.res, sampled, node, k)
                            for tree, e in zip(trees, B.entries_of(B.search(h, params, row.scale, row.own, use), h, k)):
                                tree += [e] if e else []
                    for j, tree in enumerate(trees):
                        splits, leaves = B.finish_tree(tree, params)
                        B.subtract_tree(row.bins, row.res, j, splits, leaves)
                        log += [(row.phase, row.tb * per + j, t, e[0], e[1], e[2], e[3], e[7]) for e in splits]
                    if track_loss:
                        loss += row.losses(t, per)
                yield row.output(log, loss)

        out = self._rows().mapInArrow(work, f"{_STATE}, log array<struct<{_fields(LOG)}>>, loss array<struct<{_fields(LOSS)}>>")
        stored = scratch_path(self.spark, "boosted")
        out.write.parquet(stored)
        self._advance(stored)
        kept = self.spark.read.parquet(stored)
        log = kept.select(F.explode("log").alias("e")).select("e.*")
        return log, kept.select(F.explode("loss").alias("e")).select("e.*") if track_loss else None

    def _level_by_level(self, turn: range, limits: tuple[dict, dict], track_loss: bool) -> tuple[DataFrame, DataFrame | None]:
        logs, losses = [], []
        for t in turn:
            trees: DataFrame | None = None
            for level in range(self.params.max_depth):
                found = write_once(self._searched(t, level, trees, limits), "level")
                trees = found if trees is None else trees.unionByName(found)
            whole = write_once(self._finished(trees, t), "trees")
            previous, self.state = self.state, self._updated(whole)
            if previous not in (None, self._saved):
                drop_stored(self.spark, previous)
            logs.append(whole.select(F.explode("log").alias("e")).select("e.*"))
            if track_loss:
                losses.append(write_once(self._losses(t), "losses"))
        return _union(logs), _union(losses) if track_loss else None

    def _searched(self, t: int, level: int, trees: DataFrame | None, limits: tuple[dict, dict]) -> DataFrame:
        """``tb, phase, j, _TREE``: the best split of every target's nodes of a level."""
        params, per_range, nr = self.params, self.per_range, self.nr_regulators
        ranges = -(-nr // per_range)
        grown = None if trees is None else _grouped(trees)
        key = ["tb", "phase", "node", "rg"]
        schema = "tb int, phase int, node int, rg int, code array<long>, s binary, n binary, tot array<double>, cnt array<double>, own array<int>, scale array<double>"

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = {}, 0
            for row in _unpacked(batches, params):
                sampled = row.sampled(t, limits[0], params)
                node = None if level == 0 else row.nodes(row.trees)
                for k in B.level_nodes(level):
                    if node is not None and not (node == k).any():
                        continue
                    h = B.histogram(row.bins, row.res, sampled, node, k)
                    cuts = np.searchsorted(h.code, (np.arange(ranges + 1) * per_range) << B.BIN_BITS)
                    for r in range(ranges):
                        a, b = cuts[r], cuts[r + 1]
                        piece = B.Histogram(h.code[a:b], h.s[a:b], h.n[a:b], h.tot, h.cnt)
                        at = (row.tb, row.phase, k, r)
                        if at in held:
                            size -= held[at][0].nbytes
                            held[at][0].add(piece)
                        else:
                            held[at] = (piece, row.own, row.scale)
                        size += held[at][0].nbytes
                if size > HELD_BYTES:
                    yield _histogram_rows(held)
                    held, size = {}, 0
            if held:
                yield _histogram_rows(held)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, h, own, scale = None, None, None, None
            for batch in batches:
                for row in batch.to_pylist():
                    at = tuple(row[c] for c in key)
                    width = len(row["tot"])
                    code = np.array(row["code"], np.int64)
                    n = np.frombuffer(row["n"])
                    piece = B.Histogram(
                        code, np.frombuffer(row["s"]).reshape(len(code), width), n.reshape(len(code), -1) if len(code) else np.zeros((0, 1 if level == 0 else width)),
                        np.array(row["tot"]), np.array(row["cnt"]),
                    )
                    if at == current:
                        h.add(piece)
                        continue
                    if current is not None:
                        yield _found_rows(current, h, params, t, limits[1], own, scale)
                    current, h, own, scale = at, piece, np.array(row["own"]), np.array(row["scale"])
            if current is not None:
                yield _found_rows(current, h, params, t, limits[1], own, scale)

        parts = self._rows(grown).mapInArrow(partial, schema)
        dealt = parts.repartition(self.partitions, *key).sortWithinPartitions(*key)
        found = dealt.mapInArrow(merged, f"tb int, phase int, j int, rank double, {_TREE}")
        names = [f.split()[0] for f in _TREE.split(", ")]
        order = F.struct("rank", -F.col("code"), -F.col("d"))
        best = found.groupBy("tb", "phase", "j", "node").agg(F.max_by(F.struct(*names), order).alias("b"))
        return best.select("tb", "phase", "j", *[F.col(f"b.{c}").alias(c) for c in names])

    def _finished(self, trees: DataFrame, t: int) -> DataFrame:
        """``tb, phase, trees, log``: pruned splits and leaf weights of every target of a block."""
        params, per = self.params, self.targets_per_block

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                out = []
                for row in rows:
                    log = []
                    for j, tree in _by_target(row["trees"]).items():
                        splits, _ = B.finish_tree(tree, params)
                        log += [(row["phase"], row["tb"] * per + j, t, e[0], e[1], e[2], e[3], e[7]) for e in splits]
                    out.append([dict(zip(_names(LOG), e)) for e in log])
                table = pa.table({**{c: batch.column(c) for c in ("tb", "phase", "trees")}, "log": pa.array(out, pa.list_(_arrow(LOG)))})
                yield from table.to_batches()

        return _grouped(trees).mapInArrow(work, f"tb int, phase int, trees array<struct<j: int, {_fields(_TREE)}>>, log array<struct<{_fields(LOG)}>>")

    def _updated(self, whole: DataFrame) -> str:
        """The next version of the state, with the finished trees taken off the residuals."""
        params = self.params

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _unpacked(batches, params):
                for j, tree in enumerate(row.trees):
                    B.subtract_tree(row.bins, row.res, j, *B.finish_tree(tree, params))
                yield row.output()

        path = scratch_path(self.spark, "residuals")
        self._rows(whole.select("tb", "phase", "trees")).mapInArrow(work, _STATE).write.parquet(path)
        return path

    def _losses(self, t: int) -> DataFrame:
        params, per = self.params, self.targets_per_block

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _unpacked(batches, params):
                columns = list(zip(*row.losses(t, per)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(LOSS))], _names(LOSS))

        parts = self._rows().mapInArrow(work, LOSS)
        return parts.groupBy("phase", "tid", "round").agg(F.sum("sse_fit").alias("sse_fit"), F.sum("sse_test").alias("sse_test"))

    def _advance(self, path: str) -> None:
        # logs are read from the same table, so the version before stays as long as its log may be wanted
        self.state = path

    # -- stored state -----------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Store everything a later session needs to go on: tables, and a manifest that is written last."""
        if self.done == 0:
            raise ValueError("nothing is boosted yet")
        tables = {
            "state": read_stored(self.spark, self.state, _STATE), "log": self.log(), "bins": self.bins, "meta": self.meta, "names": self.names,
            "blocks": self.layout.blocks, "positions": self.layout.positions, "features": self.binned.features, "regulators": self.binned.regulators,
        }
        for name, table in tables.items():
            table.write.parquet(f"{path}/round-{self.done}/{name}")
        manifest = {
            "version": STATE_VERSION, "engine": "histogram", "rounds": self.done, "params": dataclasses.asdict(self.params), "copies": self.copies,
            "targets_per_block": self.targets_per_block, "per_range": self.per_range, "nr_regulators": self.nr_regulators, "block": self.layout.block,
            "fitted": list(self.layout.fitted.items()), "totals": list(self.layout.totals.items()), "partitions": self.partitions,
        }
        line = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark, path: str) -> HistogramBooster:
        """Go on from the round a manifest names; tables of other rounds below the path are deleted."""
        m = json.loads(spark.read.text(f"{path}/manifest").first().value)
        if m["engine"] == "stumps" and m["version"] == STATE_VERSION:
            from regweave.plans.stumps import StumpBooster

            return StumpBooster.load(spark, path)
        if m["version"] != STATE_VERSION or m["engine"] != "histogram":
            raise ValueError(f"cannot read a stored state of {m['engine']} version {m['version']}")
        here = f"round-{m['rounds']}"
        drop_others(spark, path, keep={here, "manifest"})
        read = lambda name: spark.read.parquet(f"{path}/{here}/{name}")
        self = cls.__new__(cls)
        self.spark, self.params, self.done = spark, BoostParams(**m["params"]), m["rounds"]
        self.binned = Binned(None, read("features"), read("regulators"))
        sizes = {k: {p: n for p, n in m[k]} for k in ("fitted", "totals")}
        self.layout = Layout(None, read("blocks"), read("positions"), sizes["fitted"], sizes["totals"], m["block"])
        self.copies, self.partitions, self.per_range = m["copies"], m["partitions"], m["per_range"]
        self.targets_per_block, self.nr_regulators = m["targets_per_block"], m["nr_regulators"]
        self.bins, self.meta, self.names, self.start = read("bins"), read("meta"), read("names"), None
        self.state, self._logs = f"{path}/{here}/state", [read("log")]
        self._saved = self.state
        return self

    # -- results ----------------------------------------------------------------------------------------------

    def split_log(self, log: DataFrame) -> DataFrame:
        """``phase, target, round, node, regulator, threshold, missing_left, gain, cover``."""
        code = (F.col("ridx").cast("long") * (1 << B.BIN_BITS) + F.col("bin")).alias("code")
        return (
            log.join(self.binned.features.select(code, "regulator", "threshold"), "code")
            .join(self.names, "tid")
            .select("phase", "target", "round", "node", "regulator", "threshold", F.col("d").alias("missing_left"), "gain", "cover")
        )

    def losses(self, loss: DataFrame) -> DataFrame:
        """``target, round, train_loss, test_loss`` (root mean squares; null without cells of the kind)."""
        rows = [(p, n, self.layout.totals[p] - n) for p, n in self.layout.fitted.items()]
        sizes = F.broadcast(self.spark.createDataFrame(rows, "phase int, nfit long, ntest long"))
        rmse = lambda s, n: F.sqrt(F.try_divide(F.col(s), F.col(n)))
        return (
            loss.join(sizes, "phase")
            .join(self.names, "tid")
            .select("target", "round", rmse("sse_fit", "nfit").alias("train_loss"), rmse("sse_test", "ntest").alias("test_loss"))
        )

    def keep_targets(self, left: DataFrame) -> None:
        """Go on with the target blocks that hold a target of ``left`` (target); the state of others is not carried on."""
        tb = F.expr(f"cast(tid div {self.targets_per_block} as int)").alias("tb")
        wanted = self.names.join(left.select("target"), "target", "left_semi").select(tb).distinct()
        self.meta = write_once(self.meta.join(wanted, "tb", "left_semi"), "target-blocks")


# -- one (target block, cell block) -----------------------------------------------------------------------------


class _Row:
    """A state row with its cell block's bins and its targets."""

    def __init__(self, r: dict, bins: B.Bins, params: BoostParams, idx: np.ndarray | None, val: np.ndarray | None):
        self.tb, self.cb, self.phase, self.bins = r["tb"], r["cb"], r["phase"], bins
        self.lo, self.n, self.nfit = r["lo"], r["n"], r["nfit"]
        self.own = np.array([m["own"] for m in r["m"]], np.int64)
        self.scale = np.array([m["scale"] for m in r["m"]])
        self.params = params
        width = len(self.own)
        if r["res"] is not None:
            self.res = np.frombuffer(r["res"]).reshape(self.n, width).copy()
        else:
            self.res = np.full((self.n, width), -params.base_score)
            if idx is not None:
                self.res[idx // r["per"], idx % r["per"]] += val  # one entry per cell and target
        self.trees = [[] for _ in self.own]
        for j, tree in _by_target(r.get("trees") or []).items():
            self.trees[j] = tree

    def sampled(self, t: int, limits: dict, params: BoostParams) -> np.ndarray:
        pos = self.lo + np.arange(self.n)
        fit = pos < self.nfit
        limit = limits.get((self.phase, t))
        return fit if limit is None else fit & (draws.draw_keys(pos, params.seed, draws.ROWS, t) <= limit)

    def nodes(self, trees: list[list]) -> np.ndarray:
        return np.stack([B.route(self.bins, [e for e in tree if e[1] >= 0], self.n) for tree in trees], axis=1)

    def losses(self, t: int, per: int) -> list[tuple]:
        cut = int(np.clip(self.nfit - self.lo, 0, self.n))
        square = self.res * self.res
        fit, test = square[:cut].sum(axis=0).tolist(), square[cut:].sum(axis=0).tolist()
        return [(self.phase, self.tb * per + j, t, a, b) for j, (a, b) in enumerate(zip(fit, test))]

    def output(self, log: list | None = None, loss: list | None = None) -> pa.RecordBatch:
        columns = {
            "tb": pa.array([self.tb], pa.int32()),
            "cb": pa.array([self.cb], pa.int32()),
            "idx": pa.array([None], pa.list_(pa.int32())),
            "val": pa.array([None], pa.list_(pa.float64())),
            "res": pa.array([np.ascontiguousarray(self.res).tobytes()], pa.binary()),
        }
        for name, rows, fields in (("log", log, LOG), ("loss", loss, LOSS)):
            if rows is not None:
                kinds = _arrow(fields)
                parts = [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f.type) for f in kinds]
                inner = pa.StructArray.from_arrays(parts, fields=list(kinds))
                columns[name] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), inner)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _unpacked(batches: Iterator[pa.RecordBatch], params: BoostParams) -> Iterator[_Row]:
    """Rows one by one; the bins of a cell block are unpacked once for successive rows."""
    last, bins = None, None
    for batch in batches:
        keys = batch.column("keys")
        rest = batch.select([n for n in batch.schema.names if n not in ("keys", "idx", "val")])
        for i in range(batch.num_rows):
            r = rest.slice(i, 1).to_pylist()[0]
            if r["cb"] != last:
                packed = keys[i].values
                last, bins = r["cb"], B.Bins(np.zeros(0, np.int64) if packed is None else packed.to_numpy(zero_copy_only=False))
            idx, val = (batch.column(c)[i].values for c in ("idx", "val"))
            yield _Row(r, bins, params, *(None if x is None else x.to_numpy(zero_copy_only=False) for x in (idx, val)))


def _by_target(trees: list[dict]) -> dict[int, list[B.Entry]]:
    out: dict[int, list[B.Entry]] = {}
    for e in sorted(trees, key=lambda e: e["node"]):
        out.setdefault(e["j"], []).append(tuple(e[c] for c in _names(_TREE)))
    return out


def _grouped(trees: DataFrame) -> DataFrame:
    return trees.groupBy("tb", "phase").agg(F.collect_list(F.struct("j", *_names(_TREE))).alias("trees"))


def _histogram_rows(held: dict) -> pa.RecordBatch:
    keys = list(held)
    hs = [held[k] for k in keys]
    columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(4)] + [
        pa.array([h.code for h, _, _ in hs], pa.list_(pa.int64())),
        pa.array([np.ascontiguousarray(h.s).tobytes() for h, _, _ in hs], pa.binary()),
        pa.array([np.ascontiguousarray(h.n).tobytes() for h, _, _ in hs], pa.binary()),
        pa.array([h.tot for h, _, _ in hs], pa.list_(pa.float64())),
        pa.array([h.cnt for h, _, _ in hs], pa.list_(pa.float64())),
        pa.array([own.astype(np.int32) for _, own, _ in hs], pa.list_(pa.int32())),
        pa.array([scale for _, _, scale in hs], pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["tb", "phase", "node", "rg", "code", "s", "n", "tot", "cnt", "own", "scale"])


def _found_rows(at: tuple, h: B.Histogram, params: BoostParams, t: int, limits: dict, own: np.ndarray, scale: np.ndarray) -> pa.RecordBatch:
    tb, phase, k, _ = at
    best = B.search(h, params, scale, own, B.offered(h.code, params, t, limits.get((0, t))))
    rows = [(tb, phase, j, rank, *e) for j, (rank, e) in enumerate(zip(best.rank.tolist(), B.entries_of(best, h, k))) if e]
    fields = _arrow(f"tb int, phase int, j int, rank double, {_TREE}")
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _fields(fields: str) -> str:
    """``a int, b long`` as struct fields."""
    return ", ".join(": ".join(f.split()) for f in fields.split(", "))


def _arrow(fields: str) -> pa.DataType:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.struct([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
