"""Exact split search without a limit on distinct values: every value that a node's rows hold is a candidate.

A level takes two passes over the rows' blocks. The first sums gradients by (node, feature, range of
values), with each range's least and largest value; prefix sums over ranges give the gain at every
boundary between ranges, and for the candidates inside a range a bound: a gain is convex in the left
side's sums, which inside a range stay in a box spanned by the negative and the positive gradients there,
so no candidate beats the best corner. The second pass sends only rows in ranges whose bound reaches
the node's best boundary, summed by value in each task, to the task of their (node, feature, range); the
first pass's prefix sums come along as that range's start. So what moves is a few ranges of the rows,
no task holds more than one range at a time, and the driver gets one row a node and a bit a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grow import Grower, cells_of, flat, unpack_cells
from .split import Penalty, Split
from .tree import Tree

#: Ranges of values of a feature, by rows: one for each ROWS_A_RANGE, within these.
LEAST_RANGES, MOST_RANGES, ROWS_A_RANGE = 256, 16_384, 20_000
EPS = 1e-6

BLOCKS = "n int, x binary, bins binary, g binary, h binary"
COARSE = "node int, f int, sums binary"
FOUND = "node int, f int, gain double, forward int, place double, threshold double, lsum array<bigint>, total array<bigint>, bound binary, carry binary"
FINE = "node int, f int, range int, start binary, v binary, sums binary"
NAMES = [x.split()[0] for x in FOUND.split(", ")]
KINDS = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())


def ranges_for(rows: int) -> int:
    return max(LEAST_RANGES, min(MOST_RANGES, rows // ROWS_A_RANGE))


def column_facts(df: DataFrame, width: int, rows: int) -> tuple[list[float], list[bool]]:
    """By feature the share of rows that hold it, and whether it has one value. A row a feature and task moves."""

    def run(batches):
        n, lo, hi = np.zeros(width, np.int64), np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            x = batch.column(0).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            n += (~np.isnan(x)).sum(axis=0)
            if len(x):
                lo, hi = np.fmin(lo, np.fmin.reduce(x, axis=0)), np.fmax(hi, np.fmax.reduce(x, axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(n), pa.array(lo), pa.array(hi)], names=["f", "n", "lo", "hi"])

    got = df.select("features").mapInArrow(run, "f int, n bigint, lo double, hi double").groupBy("f").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    found = {r["f"]: r for r in got}
    return [found[f]["n"] / max(rows, 1) if f in found else 0.0 for f in range(width)], [f not in found or found[f]["lo"] >= found[f]["hi"] for f in range(width)]


def value_blocks(df: DataFrame, width: int, scales: tuple[float, float]) -> DataFrame:
    """df: features, bins (ranges), g, h. Like grow.blocks, with the values themselves."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                g, h = ((flat(batch.column(c), float) * s).astype("<i8").tobytes() for c, s in zip(("g", "h"), scales, strict=True))
                x = batch.column("features").flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
                row = [pa.array([batch.num_rows], pa.int32()), *(pa.array([v], pa.binary()) for v in (x.astype("<f8").tobytes(), cells_of(batch.column("bins"), width).tobytes(), g, h))]
                yield pa.RecordBatch.from_arrays(row, names=["n", "x", "bins", "g", "h"])

    return df.select("features", "bins", "g", "h").mapInArrow(run, BLOCKS)


def opened(batch: pa.RecordBatch, width: int):
    """x (rows, features), ranges (-1: missing), g, h of each block."""
    for n, x, bins, g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        cells = np.frombuffer(bins, "<u2" if len(bins) == 2 * width * n else "<u4").reshape(n, width)
        yield np.frombuffer(x, "<f8").reshape(n, width), unpack_cells(cells), np.frombuffer(g, "<i8"), np.frombuffer(h, "<i8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coarse sums of two tasks: layers g, h, rows, negative g, negative h add up; least and largest values compare."""
    return np.concatenate([a[:5] + b[:5], np.minimum(a[5:6], b[5:6]), np.maximum(a[6:], b[6:])])


def coarse_sums(df: DataFrame, tree: Tree, nodes: list[int], sizes: list[int]) -> DataFrame:
    """COARSE by task: layers of doubles (whole numbers below 2**52, and values) by range, missing last."""
    width, edges = tree.width, np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)]).astype(np.int64)
    cells = int(edges[-1])
    slot = np.full(len(tree.nodes), -1, np.int64)
    slot[nodes] = np.arange(len(nodes))

    def run(batches):
        acc = np.zeros((7, len(nodes) * cells))
        acc[5], acc[6] = np.inf, -np.inf
        for batch in batches:
            for x, bins, g, h in opened(batch, width):
                at = slot[tree.leaves(x)]
                rows = np.flatnonzero(at >= 0)
                if not len(rows):
                    continue
                bins, x = bins[rows], x[rows]
                index = (at[rows][:, None] * cells + edges[:-1] + np.where(bins < 0, np.array(sizes), bins)).ravel()
                for layer, v in enumerate((g[rows], h[rows], np.ones(len(rows)), np.minimum(g[rows], 0), np.minimum(h[rows], 0))):
                    acc[layer] += np.bincount(index, np.repeat(v.astype(float), width), acc.shape[1])
                values, there = x.ravel(), bins.ravel() >= 0
                np.minimum.at(acc[5], index[there], values[there])
                np.maximum.at(acc[6], index[there], values[there])
        out: list[list] = [[], [], []]
        for i, node in enumerate(nodes):
            for f in range(width):
                part = acc[:, i * cells + edges[f] : i * cells + edges[f + 1]]
                if part[2].any():
                    for column, value in zip(out, (node, f, part.tobytes()), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["node", "f", "sums"])

    return df.mapInArrow(run, COARSE)


class Scan:
    """What all candidates of a node and feature share: totals, penalties, and which scans are made."""

    def __init__(self, f: int, total: np.ndarray, missing: np.ndarray, scale, p: Penalty, bounds, forward: bool, backward: bool):
        """total, missing: g, h, rows as whole numbers."""
        self.f, self.total, self.missing, self.scale, self.p, self.bounds = f, total, missing, np.array([*scale, 1.0]), p, bounds
        self.scans = [1] * forward + [0] * backward
        self.sign = p.monotone[f] if p.monotone and f < len(p.monotone) else 0
        self.parent = float(p.gain(total[0] / scale[0], total[1] / scale[1], *bounds))

    def gains(self, left: np.ndarray) -> np.ndarray:
        """left: (3, candidates) whole sums of the left side."""
        (gl, hl, _), (gr, hr, _) = left / self.scale[:, None], (self.total[:, None] - left) / self.scale[:, None]
        p, b = self.p, self.bounds
        out = p.gain(gl, hl, *b) + p.gain(gr, hr, *b) - self.parent
        bad = (hl <= 0) | (hr <= 0) | (hl < p.min_child_weight) | (hr < p.min_child_weight)
        if self.sign:
            wl, wr = p.weight(gl, hl, *b), p.weight(gr, hr, *b)
            bad |= wl > wr if self.sign > 0 else wl < wr
        return np.where(bad, -np.inf, out)

    def upper(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A side's gain as a convex function, not set to 0 where there is no hessian."""
        p, h = self.p, np.maximum(h, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sign(g) * np.maximum(np.abs(g) - p.alpha, 0)
            if not (p.max_delta or p.monotone):
                return np.where(t == 0, 0.0, t * t / (h + p.lam))
            w = -t / (h + p.lam)
            w = np.clip(np.where(np.isnan(w), 0.0, w), -p.max_delta or -np.inf, p.max_delta or np.inf)
            w = np.clip(w, *self.bounds)
            out = -(2 * g * w + (h + p.lam) * w * w + 2 * p.alpha * np.abs(w))
            return np.where(np.isfinite(w), out, np.inf)

    def bound(self, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that a left side of start plus a part between low and high (2, ranges: g, h) can gain, over the scans made."""
        best = np.full(start.shape[1], -np.inf)
        for forward in self.scans:
            at = start[:2] + (0 if forward else self.missing[:2, None])
            for g in (at[0] + low[0], at[0] + high[0]):
                for h in (at[1] + low[1], at[1] + high[1]):
                    l, r = (g / self.scale[0], h / self.scale[1]), ((self.total[0] - g) / self.scale[0], (self.total[1] - h) / self.scale[1])
                    best = np.maximum(best, self.upper(*l) + self.upper(*r) - self.parent)
        return best

    def best(self, below: np.ndarray, thresholds: np.ndarray, row: list, lowest: float | None = None, highest: float | None = None) -> list:
        """The better of row (gain, forward, place, threshold, lsum) and the candidates.

        below: (3, candidates) sums of present values under each threshold, in rising order. highest, lowest: the node's
        largest and least value, if the splits of missing rows against all others are wanted.
        """
        for forward in self.scans:
            left, cut = below, thresholds
            if forward and highest is not None:
                left, cut = np.append(left, (self.total - self.missing)[:, None], axis=1), np.append(cut, highest + (abs(highest) + EPS))
            elif not forward:
                left = left + self.missing[:, None]
                if lowest is not None:
                    left, cut = np.concatenate([self.missing[:, None], left], axis=1), np.append(lowest - (abs(lowest) + EPS), cut)
                left, cut = left[:, ::-1], cut[::-1]
            if not len(cut):
                continue
            gains = self.gains(left)
            i = int(np.argmax(gains))  # of equal gains the scan's first
            if np.isfinite(gains[i]):
                found = [float(gains[i]), forward, float(-cut[i] if forward else cut[i]), float(cut[i]), [int(v) for v in left[:, i]]]
                row = max(row, found, key=lambda r: r[:3]) if row else found
        return row


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values; the lower value where the middle falls on the upper one."""
    middle = (low + high) / 2
    return np.where(middle == high, low, middle)


def emit(rows: list):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def coarse_search(parts: DataFrame, scans) -> DataFrame:
    """FOUND by (node, feature): the best boundary between ranges, each range's bound, and the sums below it. scans(node, f, total, missing): a Scan or None."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(n, "node", "f").sortWithinPartitions("node", "f").select("node", "f", "sums")

    def solve(node, f, sums):
        total, held = sums[:3].sum(axis=1), sums[:, :-1]
        scan = scans(node, f, total, sums[:3, -1])
        whole = [int(v) for v in total]
        if scan is None or not held[2].any():
            return node, f, None, None, None, None, None, whole, None, None
        full = np.flatnonzero(held[2])
        upto = np.cumsum(held[:3, full], axis=1)
        cut = between(held[6, full[:-1]], held[5, full[1:]])
        best = scan.best(upto[:, :-1], cut, [], held[5, full[0]], held[6, full[-1]])
        start = np.zeros((3, held.shape[1]))
        start[:, full] = upto - held[:3, full]
        bound = scan.bound(start, held[3:5], held[:2] - held[3:5])
        bound[held[5] >= held[6]] = -np.inf  # one value, or none: nothing inside
        gain, forward, place, threshold, lsum = best or [None] * 5
        return node, f, gain, forward, place, threshold, lsum, whole, bound.tobytes(), np.concatenate([start, np.broadcast_to(sums[:3, -1:], start.shape)]).astype("<i8").T.tobytes()

    def run(batches):
        at, held = None, None
        for batch in batches:
            out = []
            for node, f, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = np.frombuffer(data).reshape(7, -1)
                if at != (node, f):
                    if at:
                        out.append(solve(*at, held))
                    at, held = (node, f), sums
                else:
                    held = merged(held, sums)
            if out:
                yield emit(out)
        if at:
            yield emit([solve(*at, held)])

    return rows.mapInArrow(run, FOUND)


def open_ranges(found: DataFrame, least: dict[int, float]) -> dict[tuple[int, int], np.ndarray]:
    """By (node, feature) the ranges whose bound reaches the node's best boundary, as bits: a bit a range reaches the driver."""

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for node, f, bound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.frombuffer(bound) >= least[node] - 1e-9 * abs(least[node]) if bound is not None else np.zeros(0, bool)
                if bits.any():
                    for column, value in zip(out, (node, f, np.packbits(bits).tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["node", "f", "bits"])

    got = found.select("node", "f", "bound").mapInArrow(run, "node int, f int, bits binary").collect()
    return {(r["node"], r["f"]): np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool) for r in got}


def by_value(key: np.ndarray, v: np.ndarray, sums: np.ndarray):
    """Entries (key, value, sums (3, n)) summed by key and value, in that order."""
    order = np.lexsort((v, key))
    key, v, sums = key[order], v[order], sums[:, order]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (v[1:] != v[:-1])]))
    return key[starts], v[starts], np.add.reduceat(sums, starts, axis=1)


def fine_batch(columns) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "f", "range", "start", "v", "sums"])


def fine_rows(df: DataFrame, tree: Tree, open_: dict, found: DataFrame, sizes: list[int]) -> DataFrame:
    """FINE: of each task the values and sums of each open range's rows, and (start set) the sums below the range and of missing rows."""
    width, most = tree.width, max(sizes)
    slots = {key: i for i, key in enumerate(open_)}
    names = list(open_)
    table = np.full((len(tree.nodes), width), -1, np.int64)  # by node and feature its place in `names`
    for (node, f), i in slots.items():
        table[node, f] = i
    bits = np.zeros((len(names), most + 1), bool)
    for i, key in enumerate(names):
        bits[i, : min(most, len(open_[key]))] = open_[key][:most]

    def run(batches):
        held: list = []
        for batch in batches:
            for x, bins, g, h in opened(batch, width):
                slot = table[tree.leaves(x)]
                ok = (slot >= 0) & (bins >= 0)
                ok &= bits[slot, np.where(ok, bins, most)]
                row, f = np.nonzero(ok)
                if len(row):
                    held.append(by_value(slot[row, f] * most + bins[row, f], x[row, f], np.stack([g[row], h[row], np.ones(len(row), np.int64)])))
            if len(held) > 64:
                held = [by_value(*(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))]
        if not held:
            return
        key, v, sums = by_value(*(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = [*starts[1:].tolist(), len(key)]
        for i in range(0, len(starts), 1024):
            rows = []
            for a, b in zip(starts[i : i + 1024].tolist(), ends[i : i + 1024], strict=True):
                (node, f), r = names[int(key[a]) // most], int(key[a]) % most
                rows.append((node, f, r, None, v[a:b].tobytes(), np.ascontiguousarray(sums[:, a:b]).tobytes()))
            yield fine_batch(zip(*rows, strict=True))

    def starts(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for node, f, total, carry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, f) not in open_:
                    continue
                each = np.frombuffer(carry, "<i8").reshape(-1, 6)
                for r in np.flatnonzero(open_[node, f][: len(each)]).tolist():
                    for column, value in zip(out, (node, f, r, np.append(each[r], total).astype("<i8").tobytes(), None, None), strict=True):
                        column.append(value)
            yield fine_batch(out)

    return df.mapInArrow(run, FINE).unionByName(found.select("node", "f", "total", "carry").mapInArrow(starts, FINE))


def fine_search(rows: DataFrame, scans) -> DataFrame:
    """FOUND by (node, feature, range): the best candidate between two values inside the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "node", "f", "range").sortWithinPartitions("node", "f", "range").select("node", "f", "range", "start", "v", "sums")

    def solve(node, f, held):
        start = next((s for s, _, _ in held if s is not None), None)
        parts = [(np.frombuffer(v), np.frombuffer(s, np.int64).reshape(3, -1)) for _, v, s in held if v is not None]
        if start is None or not parts:
            return None
        start = np.frombuffer(start, "<i8").reshape(3, 3)  # below, missing, total
        v = np.concatenate([a for a, _ in parts])
        _, v, sums = by_value(np.zeros(len(v), np.int64), v, np.concatenate([b for _, b in parts], axis=1))
        scan = scans(node, f, start[2].astype(float), start[1].astype(float))
        if scan is None or len(v) < 2:
            return None
        below = start[0][:, None] + np.cumsum(sums, axis=1)[:, :-1]
        best = scan.best(below.astype(float), between(v[:-1], v[1:]), [])
        return (node, f, *best, [int(x) for x in start[2]], None, None) if best else None

    def run(batches):
        at, held = None, []
        for batch in batches:
            out = []
            for node, f, r, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (node, f, r):
                    if at:
                        out.append(solve(*at[:2], held))
                    at, held = (node, f, r), []
                held.append(rest)
            if out := [x for x in out if x]:
                yield emit(out)
        if at and (row := solve(*at[:2], held)):
            yield emit([row])

    return rows.mapInArrow(run, FOUND)


def best_by_node(found: DataFrame) -> DataFrame:
    """node, s, total: the best candidate (of equal gains the smaller feature's, then the scan's first)."""
    what = F.struct("gain", (-F.col("f")).alias("order"), "forward", "place", "f", "threshold", "lsum")
    return found.groupBy("node").agg(F.max(F.when(F.col("gain").isNotNull(), what)).alias("s"), F.max("total").alias("total"))


class ExactGrower(Grower):
    """Grows by exact search. dense, constant: by feature the share of rows that hold it, and whether it has one value."""

    LAYERS = 7

    def __init__(self, cuts, *, dense: list[float], constant: list[bool], opt_dense: float = 1.0, **settings):
        super().__init__(cuts, 1, exact=True, **settings)
        d = self.p.direction
        self.scans = {f: (d == "right" or (d == "learn" and dense[f] < opt_dense and not constant[f]), d != "right") for f in range(len(cuts))}

    def evaluated(self, df: DataFrame, tree: Tree, nodes: list[int]) -> list[tuple[int, Split]]:
        settings = {node: (self.bounds[node], frozenset(set(self.constraints.allowed(self.paths[node])) & set(self.columns(tree.nodes[node].depth)))) for node in nodes}
        scale, p, directions = self.scale, self.p, self.scans

        def scans(node, f, total, missing):
            bounds, allowed = settings[node]
            return Scan(f, total, missing, scale, p, bounds, *directions[f]) if f in allowed else None

        found = coarse_search(coarse_sums(df, tree, nodes, self.sizes), scans).persist()
        first = best_by_node(found).collect()
        least = {r["node"]: r["s"]["gain"] if r["s"] else EPS for r in first}
        self.opened = open_ranges(found, {n: max(g, EPS) for n, g in least.items()})
        rows = first
        if self.opened:
            slim = found.select(*[F.lit(None).cast("binary").alias(c) if c in ("bound", "carry") else c for c in NAMES])
            rows = best_by_node(slim.unionByName(fine_search(fine_rows(df, tree, self.opened, found, self.sizes), scans))).collect()
        found.unpersist()
        out = {node: Split() for node in nodes}
        sums = lambda v: (np.array(v[:1], float) / scale[0], np.array(v[1:2], float) / scale[1])
        for node, s, total in rows:
            self.rows[node] = total[-1]
            if node == 0:
                self.settle(tree, 0, *sums(total))
            if s is not None:
                right = [a - b for a, b in zip(total, s["lsum"], strict=True)]
                out[node] = Split(s["gain"], s["f"], 0, s["threshold"], not s["forward"], None, sums(s["lsum"]), sums(right))
                self.sides[node] = (s["lsum"][-1], right[-1])
        return list(out.items())
