"""Tree growth: the driver keeps the tree and a queue of nodes, Spark sums histograms and searches splits.

Rows are held as blocks (bins and gradients of many rows in one row of bytes). A level is one job: each
task walks its blocks down the tree and sums gradients by (node, feature, bin); the sums of a pair
(parent, feature) meet in one task, which adds them up, takes the other child as what the parent has
beyond them, and searches both for splits. The driver receives one row a node. Only the child of fewer
rows is summed from rows. Gradients are fixed-point whole numbers, so the sums do not depend on how rows
are dealt.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import Constraints, Penalty, Split, feature_split, threshold_of
from .tree import Node, Tree

#: Whole sums stay below 2**52, so that doubles add them exactly.
BITS = 52
#: Nodes that one job evaluates, and bytes of sums that a task may hold at a time.
BATCH, MOST_BYTES = 256, 128 << 20
#: Tables of sums that build on each other by subtraction: plans grow fast with their number, so then both children are summed from rows.
MOST_CHAIN = 4
#: Leaves whose children a job of best-first growth looks at.
AHEAD = 16


def fixed_scale(bound: float) -> float:
    """The power of two that takes sums of at most `bound` below 2**BITS."""
    return 2.0 ** (BITS - 1 - int(np.ceil(np.log2(bound)))) if bound > 0 else 1.0


def cell_type(most: int) -> str:
    """Cells of 16 bits hold bins below 65,535 (which stands for missing), wider features take 32 bits."""
    return "<u2" if most < 65535 else "<u4"


def pack_bins(bins: np.ndarray, kind: str = "<u2") -> pa.Array:
    """A row of cells for each row of bins; -1 is missing."""
    rows, width = bins.shape
    cells = np.where(bins < 0, np.iinfo(kind[1:]).max, bins).astype(kind)
    size = width * cells.itemsize
    offsets = np.arange(rows + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())]).cast(pa.binary())


def cells_of(column: pa.Array, width: int) -> np.ndarray:
    """(rows, features) as packed."""
    if not len(column) or not width:
        return np.zeros((len(column), width), "<u2")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u2" if len(data) == 2 * width * len(column) else "<u4").reshape(len(column), width)


def unpack_cells(cells: np.ndarray) -> np.ndarray:
    bins = cells.astype(np.int64)
    bins[cells == np.iinfo(cells.dtype).max] = -1
    return bins


def unpack_bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, features) of bins, -1 where missing."""
    return unpack_cells(cells_of(batch.column("bins"), width))


def flat(column: pa.Array, kind=None) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False) if kind is None else column.flatten().to_numpy(zero_copy_only=False).astype(kind)


BLOCKS = "n int, bins binary, g binary, h binary"


def blocks(df: DataFrame, width: int, scales: tuple[float, float]) -> DataFrame:
    """df: bins, g, h (arrays of DOUBLE). A row for each batch of rows: their cells and their gradients as whole numbers of the scales."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                g, h = ((flat(batch.column(c), float) * s).astype("<i8").tobytes() for c, s in zip(("g", "h"), scales, strict=True))
                row = [pa.array([batch.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in (cells_of(batch.column("bins"), width).tobytes(), g, h))]
                yield pa.RecordBatch.from_arrays(row, names=["n", "bins", "g", "h"])

    return df.select("bins", "g", "h").mapInArrow(run, BLOCKS)


SUMS = "pair int, f int, kind int, sums binary"
FOUND = "node int, f int, sums binary, gain double, bin int, default_left boolean, cats array<int>, lsum array<bigint>, total array<bigint>"


def partial_sums(df: DataFrame, tree: Tree, nodes: dict[int, int], sizes: list[int], outputs: int) -> DataFrame:
    """Sums by (node, feature, bin) of each task's blocks. nodes: by node the pair that it belongs to.

    A feature's sums are whole numbers (g and h by output, rows) by bin, and a last bin for missing values.
    """
    width, layers = tree.width, 2 * outputs + 1
    slot = np.full(len(tree.nodes), -1, np.int64)
    slot[list(nodes)] = np.arange(len(nodes))
    pairs, names = list(nodes.values()), list(nodes)
    edges = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)]).astype(np.int64)
    cells = int(edges[-1])

    def run(batches):
        acc = np.zeros((layers, len(pairs) * cells), np.int64)
        for batch in batches:
            for n, bins, g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(bins, "<u2" if len(bins) == 2 * width * n else "<u4").reshape(n, width)
                bins = unpack_cells(own)
                at = slot[tree.leaves_by_bin(bins)]
                rows = np.flatnonzero(at >= 0)
                if not len(rows):
                    continue
                bins, at = bins[rows], at[rows]
                index = (at[:, None] * cells + edges[:-1] + np.where(bins < 0, np.array(sizes), bins)).ravel()
                values = [np.frombuffer(x, "<i8").reshape(n, outputs)[rows, k] for x in (g, h) for k in range(outputs)]
                if acc.shape[1] <= 4 * len(index):
                    for layer, v in enumerate(values):
                        # Whole numbers below 2**52 in all, so doubles add them exactly.
                        acc[layer] += np.bincount(index, np.repeat(v.astype(float), width), acc.shape[1]).astype(np.int64)
                    acc[-1] += np.bincount(index, minlength=acc.shape[1])
                else:
                    for layer, v in enumerate(values):
                        np.add.at(acc[layer], index, np.repeat(v, width))
                    np.add.at(acc[-1], index, 1)
        out: list[list] = [[], [], [], []]
        for i, pair in enumerate(pairs):
            for f in range(width):
                part = acc[:, i * cells + edges[f] : i * cells + edges[f + 1]]
                if part[-1].any():
                    for column, value in zip(out, (pair, f, names[i], part.tobytes()), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["pair", "f", "kind", "sums"])

    return df.mapInArrow(run, SUMS)


def searched(parts: DataFrame, sizes: list[int], outputs: int, scale, p: Penalty, categorical, other: dict[int, int], settings: dict[int, tuple]) -> DataFrame:
    """Whole sums and the best split of each (node, feature). parts: pair, f, kind (the node, or -1 for the pair's parent), sums.

    other: by pair the node whose sums are the parent's beyond those at hand. settings: by node what
    bounds its weights and the features it may split on (None: all).
    """
    layers, n = 2 * outputs + 1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(n, "pair", "f").sortWithinPartitions("pair", "f").select("pair", "f", "kind", "sums")
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in FOUND.split(", ")]

    def search(node, f, sums):
        k = sizes[f]
        g, h, count = sums[:outputs] / scale[0], sums[outputs : 2 * outputs] / scale[1], sums[-1]
        total = sums.sum(axis=1)
        bounds, allowed = settings[node]
        s = Split()
        if allowed is None or f in allowed:
            s = feature_split(f, g[:, :k], h[:, :k], count[:k], (total[:outputs] / scale[0], total[outputs:-1] / scale[1]), int(total[-1]), p, f in categorical, bounds)
        whole = total.tolist()
        if s.feature < 0:
            return node, f, sums.tobytes(), None, None, None, None, None, whole
        if s.categories is not None:
            right = np.isin(np.arange(k), list(s.categories))
            left = np.append(~right, s.default_left)
        else:
            left = np.append(np.arange(k) <= s.bin, s.default_left)
        return node, f, sums.tobytes(), s.gain, s.bin, s.default_left, sorted(s.categories) if s.categories is not None else None, sums[:, left].sum(axis=1).tolist(), whole

    def solve(pair, f, held):
        out = []
        for node, sums in held.items():
            if node >= 0:
                out.append(search(node, f, sums))
        if pair in other and -1 in held:
            rest = held[-1] - sum(sums for node, sums in held.items() if node >= 0)
            if rest[-1].any():
                out.append(search(other[pair], f, rest))
        return out

    def run(batches):
        at, held = None, {}
        for batch in batches:
            out = []
            for pair, f, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (pair, f):
                    if at:
                        out += solve(*at, held)
                    at, held = (pair, f), {}
                sums = np.frombuffer(data, np.int64).reshape(layers, -1)
                held[kind] = held[kind] + sums if kind in held else sums
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if at and (out := solve(*at, held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, FOUND)


def best_of_nodes(found: DataFrame) -> DataFrame:
    """A row for each node: its best split (of equal gains the smaller feature's), and its sums."""
    what = F.struct("gain", (-F.col("f")).alias("order"), "f", "bin", "default_left", "cats", "lsum")
    return found.groupBy("node").agg(F.max(F.when(F.col("gain").isNotNull(), what)).alias("s"), F.max("total").alias("total"))


def copy_stats(a: Node, b: Node) -> None:
    b.weight, b.value, b.cover = a.weight, a.value, a.cover


class Grower:
    #: Numbers that a task sums by bin; by default g and h by output, and rows.
    LAYERS = 0

    def __init__(self, cuts, outputs=1, *, penalty: Penalty, eta=0.3, gamma=0.0, max_depth=6, max_leaves=0, lossguide=False, categorical=(), interactions=None, columns=None, exact=False, ahead=AHEAD):
        self.cuts, self.outputs, self.p, self.eta, self.gamma = cuts, outputs, penalty, eta, gamma
        self.max_depth, self.max_leaves, self.lossguide, self.categorical = max_depth, max_leaves, lossguide, frozenset(categorical)
        self.constraints = Constraints(interactions, len(cuts))
        self.columns = columns or (lambda depth: range(len(cuts)))
        self.exact, self.ahead = exact, ahead

    def sizes_of(self):
        """How many bins each feature has."""
        return [len(c) for c in self.cuts]

    def grow(self, df: DataFrame, scale: tuple[float, float]) -> Tree:
        """df: blocks, with gradients times `scale` (a power of two each for g and h)."""
        tree = Tree(len(self.cuts))
        self.bounds, self.paths = {0: (-np.inf, np.inf)}, {0: frozenset()}
        self.rows, self.held, self.sides, self.chain = {}, {}, {}, {}  # by node: its rows, the table that has its sums, the rows of either side, tables before that one
        self.scale, self.sizes, self.jobs = scale, self.sizes_of(), 0
        most = max(2, MOST_BYTES // (8 * (self.LAYERS or 2 * self.outputs + 1) * max(1, int(np.sum(self.sizes)) + len(self.sizes))))
        most -= most % 2  # siblings stay together

        def evaluate(nodes: list[int]) -> list[tuple[int, Split]]:
            out = []
            for i in range(0, len(nodes), most):
                out += self.evaluated(df, tree, nodes[i : i + most])
                self.jobs += 1
            return out

        grown = self.best_first(tree, evaluate) if self.lossguide else self.by_level(tree, evaluate)
        self.let_go(set())
        return grown

    def by_level(self, tree: Tree, evaluate) -> Tree:
        leaves, queue = 1, deque(evaluate([0]))
        while queue:
            batch: list[tuple[int, Split]] = []
            depth = tree.nodes[queue[0][0]].depth
            while queue and tree.nodes[queue[0][0]].depth == depth and len(batch) < BATCH:
                node, s = queue.popleft()
                if self.valid(tree, node, s, leaves):
                    batch.append((node, s))
                    leaves += 1
            if not batch:
                continue
            fresh = [child for node, s in batch for child in self.apply(tree, node, s)]
            open_ = [c for c in fresh if self.open(tree, c, leaves)]
            queue.extend(evaluate(open_))
            self.let_go({n for n, _ in queue} | set(open_))  # of a finished level nothing is read again but the sums of what is in the queue
        return tree

    def best_first(self, tree: Tree, evaluate) -> Tree:
        """The leaf of the largest gain is split next. One job looks ahead: it splits the best leaves of the queue and evaluates all their children.

        tree holds what is looked at; the tree that is returned takes the splits in the order of the queue, which refuses some.
        """
        final, leaves, known = Tree(tree.width), 1, dict(evaluate([0]))
        copy_stats(tree.nodes[0], final.nodes[0])
        queue = [(-known[0].gain, 0, 0)]  # gain, number in the final tree, number here
        while queue:
            _, number, node = heapq.heappop(queue)
            s = known[node]
            if not self.valid(final, number, s, leaves):
                break
            leaves += 1
            if tree.nodes[node].leaf:
                ahead = [node]
                spare = min(self.ahead - 1, self.max_leaves - leaves if self.max_leaves else self.ahead)
                for _, other, n in heapq.nsmallest(max(0, spare), queue):
                    if tree.nodes[n].leaf and self.valid(final, other, known[n], 0):
                        ahead.append(n)
                children = [c for n in ahead for c in self.apply(tree, n, known[n])]
                known.update(evaluate([c for c in children if self.open(tree, c, leaves)]))
            n = tree.nodes[node]
            for child, own in zip((n.left, n.right), final.split(number, feature=n.feature, threshold=n.threshold, bin=n.bin, default_left=n.default_left, categories=n.categories, gain=n.gain), strict=True):
                copy_stats(tree.nodes[child], final.nodes[own])
                if self.open(final, own, leaves) and child in known:
                    heapq.heappush(queue, (-known[child].gain, own, child))
        return final

    def open(self, tree: Tree, node: int, leaves: int) -> bool:
        return (not self.max_depth or tree.nodes[node].depth < self.max_depth) and (not self.max_leaves or leaves < self.max_leaves)

    def let_go(self, needed: set[int]) -> None:
        kept = {id(t) for n, t in self.held.items() if n in needed}
        for t in {id(t): t for t in self.held.values() if id(t) not in kept}.values():
            t.unpersist()
        self.held = {n: t for n, t in self.held.items() if n in needed}

    def paired(self, tree: Tree, nodes: list[int]) -> tuple[dict, dict, dict]:
        """Of two siblings only the one of fewer rows is summed from rows: by summed node its pair, by pair the other child, and the table that holds the parent's sums."""
        summed, other, parents = {}, {}, {}
        for node in nodes:
            pair = tree.nodes[node].parent
            sibling = next((x for x in nodes if x != node and tree.nodes[x].parent == pair), None) if pair >= 0 else None
            if pair < 0 or sibling is None or pair not in self.held or self.chain[pair] >= MOST_CHAIN:
                summed[node] = node if pair < 0 or sibling is None else pair
            elif (self.rows[node], node) < (self.rows[sibling], sibling):
                summed[node], other[pair], parents[pair] = pair, sibling, self.held[pair]
        link = 1 + max((self.chain[p] for p in parents), default=-1)
        self.chain.update(dict.fromkeys(nodes, link))
        return summed, other, parents

    def settings_of(self, tree: Tree, nodes: list[int], kind) -> dict[int, tuple]:
        """By node its weight bounds and the features it may split on (None: all)."""
        every, settings = range(len(self.cuts)), {}
        for node in nodes:
            free, drawn = self.constraints.allowed(self.paths[node]), self.columns(tree.nodes[node].depth)
            allowed = every if free == every and drawn == every else set(free) & set(drawn)  # no set of all features where nothing is barred
            settings[node] = (self.bounds[node], None if len(allowed) == len(every) else kind(allowed))
        return settings

    def evaluated(self, df: DataFrame, tree: Tree, nodes: list[int]) -> list[tuple[int, Split]]:
        """Each node with its best split."""
        summed, other, parents = self.paired(tree, nodes)
        parts = partial_sums(df, tree, summed, self.sizes, self.outputs)
        for table in {id(t): t for t in parents.values()}.values():
            own = [p for p, t in parents.items() if t is table]
            parts = parts.unionByName(table.where(F.col("node").isin(own)).select(F.col("node").alias("pair"), "f", F.lit(-1).alias("kind"), "sums"))
        settings = self.settings_of(tree, nodes, frozenset)
        found = searched(parts, self.sizes, self.outputs, self.scale, self.p, self.categorical, other, settings).persist()
        k, out = self.outputs, {node: Split() for node in nodes}
        sums = lambda v: (np.array(v[:k], float) / self.scale[0], np.array(v[k : 2 * k], float) / self.scale[1])
        for node, s, total in best_of_nodes(found).collect():
            self.rows[node], self.held[node] = total[-1], found
            if node == 0:
                self.settle(tree, 0, *sums(total))
            if s is not None:
                right = [a - b for a, b in zip(total, s["lsum"], strict=True)]
                out[node] = Split(s["gain"], s["f"], s["bin"], 0.0, s["default_left"], frozenset(s["cats"]) if s["cats"] is not None else None, sums(s["lsum"]), sums(right))
                out[node].threshold = threshold_of(out[node], self.cuts[s["f"]])
                self.sides[node] = (s["lsum"][-1], right[-1])
        return list(out.items())

    def settle(self, tree: Tree, i: int, G, H) -> None:
        lo, hi = self.bounds[i]
        w = self.p.weight(np.asarray(G, float), np.asarray(H, float), lo, hi)
        n = tree.nodes[i]
        n.weight, n.value, n.cover = (w, self.eta * w, float(np.mean(H))) if self.outputs > 1 else (float(w[0]), self.eta * float(w[0]), float(H[0]))

    def valid(self, tree: Tree, node: int, s: Split, leaves: int) -> bool:
        if not s.gain > 1e-6 or np.mean(s.left[1]) == 0 or np.mean(s.right[1]) == 0:
            return False
        if s.gain < self.gamma and not self.exact:
            return False
        if self.max_depth and tree.nodes[node].depth >= self.max_depth:
            return False
        return not (self.max_leaves and leaves >= self.max_leaves)

    def apply(self, tree: Tree, node: int, s: Split) -> list[int]:
        a, b = tree.split(node, feature=s.feature, threshold=s.threshold, bin=s.bin, default_left=s.default_left, categories=s.categories, gain=s.gain)
        self.rows[a], self.rows[b] = self.sides[node]
        lo, hi = self.bounds[node]
        self.bounds[a] = self.bounds[b] = (lo, hi)
        for child, (G, H) in ((a, s.left), (b, s.right)):
            self.settle(tree, child, G, H)
            self.paths[child] = self.paths[node] | {s.feature}
        c = self.p.monotone[s.feature] if self.p.monotone and s.feature < len(self.p.monotone) else 0
        if c:
            mid = (np.atleast_1d(tree.nodes[a].weight)[0] + np.atleast_1d(tree.nodes[b].weight)[0]) / 2
            self.bounds[a], self.bounds[b] = ((lo, mid), (mid, hi)) if c > 0 else ((mid, hi), (lo, mid))
        return [a, b]
