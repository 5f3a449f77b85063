"""Numpy steps on one block of targets and one block of cells: histograms, split search, routing.

A *code* is ``ridx << 24 | bin``. The bins of a cell block are packed as sorted longs ``code << 16 | slot`` where a slot is
a cell's place in its block; missing (zero) values are not listed. Residuals are a (cells, targets) array.
"""

from __future__ import annotations

import numpy as np

from regweave.operators import draws
from regweave.params import BoostParams

BIN_BITS, SLOT_BITS = 24, 16
TARGETS = 64  # targets of a block
CELLS = 4096  # cells of a block, at most 2**SLOT_BITS
GATHER = 1 << 21  # residuals gathered at once
SEARCH = 2048  # bins searched at once: such arrays stay in cache


class Bins:
    """The packed bins of a cell block."""

    def __init__(self, keys: np.ndarray):
        code = keys >> SLOT_BITS
        self.slots = keys & ((1 << SLOT_BITS) - 1)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.ptr = np.concatenate([starts, [len(keys)]])
        self.code = code[starts]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """(codes, targets): the rows of ``x`` added over the cells of each code."""
        out = np.empty((len(self.code), x.shape[1]))
        lo, step = 0, max(GATHER // x.shape[1], 1)
        while lo < len(self.code):
            hi = max(lo + 1, int(np.searchsorted(self.ptr, self.ptr[lo] + step, side="right")) - 1)
            a, b = self.ptr[lo], self.ptr[hi]
            np.add.reduceat(x[self.slots[a:b]], self.ptr[lo:hi] - a, axis=0, out=out[lo:hi])
            lo = hi
        return out

    def go_left(self, code: int, missing_left: int, cells: int) -> np.ndarray:
        """Which cells a split sends left."""
        r = code >> BIN_BITS
        a, c, b = self.ptr[np.searchsorted(self.code, [r << BIN_BITS, code + 1, (r + 1) << BIN_BITS])]
        left = np.full(cells, bool(missing_left))
        left[self.slots[a:c]] = True
        left[self.slots[c:b]] = False
        return left


class Histogram:
    """Residual sums and counts per code and target of one tree node; histograms of cell blocks add up."""

    def __init__(self, code: np.ndarray, s: np.ndarray, n: np.ndarray, tot: np.ndarray, cnt: np.ndarray):
        self.code, self.s, self.n, self.tot, self.cnt = code, s, n, tot, cnt

    def add(self, other: Histogram) -> None:
        self.tot, self.cnt = self.tot + other.tot, self.cnt + other.cnt
        if len(self.code) == len(other.code) and (self.code == other.code).all():
            self.s, self.n = self.s + other.s, self.n + other.n
            return
        code = np.union1d(self.code, other.code)
        s, n = np.zeros((len(code), self.s.shape[1])), np.zeros((len(code), self.n.shape[1]))
        for h in (self, other):
            at = np.searchsorted(code, h.code)
            s[at] += h.s
            n[at] += h.n
        self.code, self.s, self.n = code, s, n

    @property
    def nbytes(self) -> int:
        return self.s.nbytes + self.n.nbytes


def histogram(bins: Bins, res: np.ndarray, sampled: np.ndarray, node: np.ndarray | None, k: int) -> Histogram:
    """Node ``k`` over the sampled cells of a block; without ``node`` all cells are in it, and counts are shared."""
    if node is None:
        n = np.add.reduceat(sampled[bins.slots].astype(float), bins.ptr[:-1])[:, None] if len(bins.code) else np.zeros((0, 1))
        x = np.where(sampled[:, None], res, 0.0)
        cnt = np.array([float(sampled.sum())])  # one number for all targets
    else:
        inside = (node == k) & sampled[:, None]
        x = np.where(inside, res, 0.0)
        n, cnt = bins.sums(inside.astype(float)), inside.sum(axis=0).astype(float)
    return Histogram(bins.code, bins.sums(x), n, x.sum(axis=0), cnt)


def offered(code: np.ndarray, params: BoostParams, round_nr: int, limit: int | None) -> np.ndarray:
    """Codes of the regulators drawn for a round."""
    if limit is None:
        return np.ones(len(code), bool)
    return draws.draw_keys(code >> BIN_BITS, params.seed, draws.COLUMNS, round_nr) <= limit


class Best:
    """Each target's best split so far: ``rank`` is the rounded relative gain, ties go to the lowest code, then d = 0."""

    FIELDS = ("rank", "code", "d", "gain", "left", "n_left")

    def __init__(self, targets: int):
        self.rank, self.gain = np.full(targets, -np.inf), np.zeros(targets)
        self.code, self.d = np.full(targets, -1, np.int64), np.zeros(targets, np.int64)
        self.left, self.n_left = np.zeros(targets), np.zeros(targets)

    def offer(self, **found: np.ndarray) -> None:
        better = (found["rank"] > self.rank) | ((found["rank"] == self.rank) & (found["code"] < self.code))
        for name in self.FIELDS:
            getattr(self, name)[better] = found[name][better]


def search(h: Histogram, params: BoostParams, scale: np.ndarray, own: np.ndarray, use: np.ndarray) -> Best:
    """Best split of every target over the codes marked in ``use``; ``own`` is a target's own regulator or -1."""
    best = Best(len(h.tot))
    keep = np.flatnonzero(use & (h.n > 0).any(axis=1))
    code, lam = h.code[keep], params.reg_lambda
    ridx = code >> BIN_BITS
    first_of = np.flatnonzero(np.concatenate([[True], ridx[1:] != ridx[:-1]])) if len(code) else np.zeros(0, np.int64)
    parent = h.tot * h.tot / (h.cnt + lam) if lam else np.divide(h.tot * h.tot, h.cnt, out=np.zeros_like(h.tot), where=h.cnt > 0)
    floor = max(params.min_child_weight, 1e-12)
    columns = np.arange(len(h.tot))
    at = 0
    while at < len(first_of):
        lo = first_of[at]
        nxt = max(at + 1, int(np.searchsorted(first_of, lo + SEARCH, side="right")) - 1)
        nxt = len(first_of) if lo + SEARCH >= len(code) else nxt
        hi = first_of[nxt] if nxt < len(first_of) else len(code)
        first = first_of[at:nxt] - lo
        last = np.concatenate([first[1:], [hi - lo]]) - 1
        reg = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [hi - lo]])))
        near, n_near = _running(h.s[keep[lo:hi]], first, reg), _running(h.n[keep[lo:hi]], first, reg)
        present = h.n[keep[lo:hi]] > 0
        banned = [(i, r) for i, r in enumerate(own) if r >= 0 and ridx[lo] <= r <= ridx[hi - 1]]
        for d in (0, 1):
            left = near + (h.tot - near[last])[reg] if d else near
            n_left = n_near + (h.cnt - n_near[last])[reg] if d else n_near
            n_right = h.cnt - n_left
            ok = present & (n_left >= floor) & (n_right >= floor)
            right = h.tot - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left * left / (n_left + lam)
                right *= right
                right /= n_right + lam
            gain += right
            gain -= parent
            rank = np.where(ok & (gain > params.min_gain), np.rint(gain * (1e9 / scale)), -np.inf)
            for i, r in banned:
                rank[ridx[lo:hi] == r, i] = -np.inf
            top = rank.argmax(axis=0)
            n_at = n_left[top, columns] if n_left.shape[1] > 1 else n_left[top, 0]
            best.offer(
                rank=rank[top, columns], code=code[lo:hi][top], d=np.full(len(top), d), gain=gain[top, columns], left=left[top, columns], n_left=n_at
            )
        at = nxt
    return best


def _running(x: np.ndarray, first: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """Running sums that start again at every regulator."""
    total = np.cumsum(x, axis=0)
    before = np.zeros((len(first), x.shape[1]))
    before[1:] = total[first[1:] - 1]
    return total - before[reg]


#: one entry of a tree while it grows: node, code (-1: no split), missing_left, gain, left sum, left count, node sum, node count
Entry = tuple[int, int, int, float, float, float, float, float]


def finish_tree(entries: list[Entry], params: BoostParams) -> tuple[list[Entry], dict[int, float]]:
    """Splits that stay (bottom-up, a split below ``gamma`` over two leaves goes) and the weight of every leaf."""
    splits = {e[0]: e for e in entries if e[1] >= 0}
    for k in sorted(splits, reverse=True):
        if splits[k][3] < params.gamma and 2 * k + 1 not in splits and 2 * k + 2 not in splits:
            del splits[k]

    def weight(s: float, n: float) -> float:
        return params.eta * s / (n + params.reg_lambda) if n + params.reg_lambda > 0 else 0.0

    leaves = {}
    if 0 not in splits:
        leaves = {0: weight(e[6], e[7]) for e in entries if e[0] == 0}
    for k, e in splits.items():
        for child, s, n in ((2 * k + 1, e[4], e[5]), (2 * k + 2, e[6] - e[4], e[7] - e[5])):
            if child not in splits:
                leaves[child] = weight(s, n)
    return [splits[k] for k in sorted(splits)], leaves


def route(bins: Bins, splits: list[Entry], cells: int) -> np.ndarray:
    """The node every cell of the block ends in."""
    node = np.zeros(cells, np.int16)
    for k, code, d, *_ in splits:
        left = bins.go_left(code, d, cells)
        inside = slice(None) if k == 0 else node == k
        node[inside] = np.where(left[inside], 2 * k + 1, 2 * k + 2)
    return node


def subtract_tree(bins: Bins, res: np.ndarray, i: int, splits: list[Entry], leaves: dict[int, float]) -> None:
    """Take one target's leaf weights off its residuals."""
    table = np.zeros(max(leaves, default=0) + 1)
    table[list(leaves)] = list(leaves.values())
    res[:, i] -= table[route(bins, splits, len(res))]


def level_nodes(level: int) -> range:
    return range((1 << level) - 1, (1 << (level + 1)) - 1)


def entries_of(best: Best, h: Histogram, k: int) -> list[Entry | None]:
    """One tree entry per target that has cells in node ``k``."""
    columns = [best.code, best.d, best.gain, best.left, best.n_left, h.tot, np.broadcast_to(h.cnt, h.tot.shape)]
    return [(k, *row) if row[-1] > 0 else None for row in zip(*(c.tolist() for c in columns))]
