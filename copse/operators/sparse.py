"""Training on sparse rows: entries (feature, value), of which a row holds few, whatever the number of features.

Every (feature, bin) is a cell with a number of its own, so a binned row is a short list of cells and a block
of rows is two lists, the cells in order and their rows. Histograms are lists too: the cells that a node's
rows hold, with their sums. What is missing is a node's total less what is present, and totals of
children are known from the parent's split, so no task and no row is ever as wide as the features. Cells
are dealt to tasks in chunks, and a task searches all features of a chunk in one pass of arrays.

Cuts may be as many as the entries. Tasks hold those of the features of most entries; entries of the others go to
the tasks that have their features' cuts, and come back to their rows as cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import MOST_CODES, Sketch, Summary, summary_budget
from .grow import Grower, flat
from .split import Penalty, Split, feature_split, threshold_of
from .tree import Tree

#: Cells searched together, and cut values that the driver and each task may hold.
CHUNK, MOST_CUTS = 4096, 2_000_000
#: Features whose values meet in one task, and values of a feature up to which they are sent as they are.
TOGETHER, FEW = 256, 256
#: Lists of a chunk's sums that are added up at once.
ADDED = 64
#: Numbers that a task holds before it sends them on.
MOST_HELD, MOST_SENT = 2_000_000, 250_000
#: Tasks from whose number on summaries are merged in two steps.
MANY_TASKS = 256
PACKED = "n int, ids binary, w binary, sizes binary, f binary, v binary"
SUMMARY = "chunk int, part int, f binary, v binary, w binary, c binary, lo binary, hi binary"
CUTS = "chunk int, f binary, sizes binary, c binary, v binary"
SENT = "dest int, kind int, a binary, b binary, c binary"
BLOCKS = "n int, rows binary, cells binary, g binary, h binary"
SUMS = "pair int, chunk int, kind int, cells binary, sums binary"
FOUND = "node int, chunk int, cells binary, sums binary, gain double, f int, bin int, default_left boolean, cats array<int>, lsum array<bigint>"
KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()))
NAMES = [x.split()[0] for x in FOUND.split(", ")]


class Layout:
    """Which cells a feature has: those from edges[f] on."""

    def __init__(self, cuts, categorical=()):
        self.categorical = frozenset(categorical)
        self.sizes = cuts.sizes if isinstance(cuts, Cuts) else np.array([len(c) for c in cuts], np.int64)
        edges = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        if edges[-1] >= 1 << 31:
            raise ValueError("the features have over 2**31 bins; take a smaller max_bin")
        self.edges = edges.astype(np.int32)

    def feature(self, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, cells, "right") - 1

    def column(self, rows: np.ndarray, cells: np.ndarray, f: int):
        """Rows that hold a feature, and their bins, of lists in the order of cells."""
        a, b = np.searchsorted(cells, self.edges[f : f + 2])
        return rows[a:b], cells[a:b] - self.edges[f]


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
    return list(zip(starts, [*starts[1:], len(key)][: len(starts)], strict=True))


def entry_arrays(column: pa.Array):
    """Row, feature, value of each entry of a column of lists of (f, v)."""
    size = np.diff(np.asarray(column.offsets))
    inner = column.flatten()
    f, v = inner.flatten()
    return np.repeat(np.arange(len(column)), size), np.asarray(f), np.asarray(v, float)


# ---- cuts and bins


def batch_of(schema: str, columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def packed(df: DataFrame, weight: str = "weight") -> DataFrame:
    """PACKED: blocks of rows, their ids, weights, numbers of entries and the entries. df: row_id, entries, weight."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("entries")
                _, f, v = entry_arrays(column)
                ids, w = (np.asarray(batch.column(c)) for c in ("row_id", "w"))
                arrays = (ids.astype("<i8"), w.astype("<f8"), np.diff(np.asarray(column.offsets)).astype("<i4"), f.astype("<i4"), v.astype("<f8"))
                yield batch_of(PACKED, [[batch.num_rows], *([x.tobytes()] for x in arrays)])

    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col(weight).cast("double").alias("w"), "entries").mapInArrow(run, PACKED)


def unpacked(batch: pa.RecordBatch):
    """Ids, weights, features and values of the entries of each block."""
    for _, ids, w, sizes, f, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        sizes = np.frombuffer(sizes, "<i4")
        yield np.repeat(np.frombuffer(ids, "<i8"), sizes), np.repeat(np.frombuffer(w, "<f8"), sizes), np.frombuffer(f, "<i4"), np.frombuffer(v, "<f8")


class Cuts:
    """Cuts of every feature: those of the features of most entries at hand, others in a table (CUTS)."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, values: np.ndarray, table: DataFrame, categorical=()):
        # at: where a feature's cuts begin in values; -1 if they are in the table only
        self.sizes, self.at, self.values, self.table, self.categorical = sizes, at, values, table, frozenset(categorical)

    def __len__(self) -> int:
        return len(self.sizes)

    @property
    def whole(self) -> bool:
        return bool((self.at >= 0).all())

    def __getitem__(self, f: int) -> np.ndarray:
        n = int(self.sizes[f])
        if f in self.categorical:
            return np.arange(n)
        if self.at[f] >= 0:
            return self.values[self.at[f] : self.at[f] + n]
        for r in self.table.where(F.col("chunk") == f // TOGETHER).collect():
            own, sizes = np.frombuffer(r["f"], "<i4"), np.frombuffer(r["sizes"], "<i4")
            i = int(np.searchsorted(own, f))
            end = int(np.where(np.isin(own, list(self.categorical)), 0, sizes)[: i + 1].sum())
            return np.frombuffer(r["v"], "<f8")[end - n : end]
        raise KeyError(f)

    def unpersist(self) -> None:
        self.table.unpersist()


def bins_among(f: np.ndarray, v: np.ndarray, at: np.ndarray, sizes: np.ndarray, values: np.ndarray, categorical=frozenset()) -> np.ndarray:
    """Bins of entries, like cuts.bin_array of each; all features at once. at, sizes: where each feature's cuts lie in values."""
    start = np.asarray(at[f], np.int64)
    cats = np.isin(f, list(categorical)) if categorical else None
    lo, hi = start.copy(), start + np.asarray(sizes[f], np.int64) - 1
    if cats is not None:
        hi[cats] = lo[cats]
    while True:
        todo = np.flatnonzero(lo < hi)
        if not len(todo):
            break
        mid = (lo[todo] + hi[todo]) >> 1
        above = values[mid] <= v[todo]
        lo[todo[above]] = mid[above] + 1
        hi[todo[~above]] = mid[~above]
    out = np.where(np.isnan(v), -1, lo - start)
    if cats is not None:
        ok = cats & (v >= 0) & (v < sizes[f]) & (v == np.floor(v))
        out[cats] = np.where(ok, np.where(ok, v, 0).astype(np.int64), -1)[cats]
    return out


def distinct(parts: list) -> list[np.ndarray]:
    """Features, values, weights, numbers of entries, once each and in order."""
    f, v, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((v, f))
    f, v = f[order], v[order]
    starts = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (v[1:] != v[:-1])])) if len(f) else np.zeros(0, np.int64)
    if not len(starts):
        return [f, v, w, c]
    return [f[starts], v[starts], np.add.reduceat(w[order], starts), np.add.reduceat(c[order], starts)]


def split_off(held: list[np.ndarray], most: int) -> tuple[list[np.ndarray], list[tuple[int, list[np.ndarray]]]]:
    """What features of at most so many values hold, and one by one what the others do."""
    f = held[0]
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(f)))
    many = sizes > most
    if not many.any():
        return held, []
    return [x[np.repeat(~many, sizes)] for x in held], [(int(f[a]), [x[a : a + n] for x in held]) for a, n in zip(starts[many].tolist(), sizes[many].tolist(), strict=True)]


def sparse_cuts(df: DataFrame, width: int, max_bin: int, categorical=(), n: int | None = None) -> Cuts:
    """Cuts of every feature (df: PACKED, persisted) in one job; features that no row holds have one bin."""
    tasks, rows = df.select(F.spark_partition_id().alias("p"), "n").agg(F.coalesce(F.max("p") + 1, F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = summary_budget(max_bin, rows if n is None else n)
    fan, cats = math.isqrt(tasks) if tasks > MANY_TASKS else 1, np.array(sorted(categorical), np.int64)
    tobytes = lambda *arrays: [np.asarray(x, t).tobytes() for x, t in zip(arrays, ("<i4", "<f8", "<f8", "<i8", "<f8", "<f8"), strict=False)]

    def partition(batches):
        part = TaskContext.get().partitionId() % fan  # the same if the task runs again
        held, waiting, least = [], 0, 0
        sketches: dict[int, Sketch] = {}
        counts: dict[int, int] = {}
        top: dict[int, list] = {}

        def sketch(many):
            for k, (_, v, w, c) in many:
                sketches.setdefault(k, Sketch(budget)).push(v, w)
                counts[k] = counts.get(k, 0) + int(c.sum())

        def sent(stored):
            few, many = split_off(stored, FEW)
            sketch(many)
            f = few[0]
            for a, b in runs(f // TOGETHER):
                yield [int(f[a]) // TOGETHER, part, *tobytes(*(x[a:b] for x in few)), b"", b""]

        for batch in batches:
            for _, w, f, v in unpacked(batch):
                ok = (w > 0) & ~np.isnan(v)
                f, v, w = f[ok], v[ok], w[ok]
                if len(cats):
                    own = np.isin(f, cats)
                    order = np.argsort(f[own], kind="stable")
                    codes = v[own][order]
                    for a, b in runs(f[own][order]):
                        k, x = int(f[own][order[a]]), codes[a:b]
                        if x.min() < 0 or (x != np.floor(x)).any() or x.max() >= MOST_CODES:
                            raise ValueError(f"feature {k}: categories must be whole numbers from 0 on, below {MOST_CODES}")
                        at = top.setdefault(k, [-1.0, 0])
                        at[:] = max(at[0], float(x.max())), at[1] + b - a
                    f, v, w = f[~own], v[~own], w[~own]
                held.append((f, v, w, np.ones(len(f), np.int64)))
                waiting += len(f)
                if waiting > 250_000 + least // 2:
                    held = [distinct(held)]
                    held[0], many = split_off(held[0], 2 * budget)
                    sketch(many)
                    if len(held[0][0]) > MOST_HELD:
                        yield batch_of(SUMMARY, zip(*sent(held[0]), strict=True))
                        held = []
                    least, waiting = len(held[0][0]) if held else 0, 0
        out = list(sent(distinct(held))) if held else []
        out += [[k // TOGETHER, part, *tobytes([k], [t], [1.0], [c]), b"", b""] for k, (t, c) in top.items()]
        for k, own in sketches.items():
            s = own.summary()
            out.append([k // TOGETHER, part, *tobytes([k], s.v, s.w, [counts[k]], s.lo, s.hi)])
        for i in range(0, len(out), 4096):
            yield batch_of(SUMMARY, zip(*out[i : i + 4096], strict=True))

    def merge(finish: bool):
        def added(parts):
            """Like distinct, of a categorical feature only the largest code."""
            f, v, w, c = distinct(parts)
            codes = np.isin(f, cats)
            if codes.any():
                starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                last = np.append(starts[1:], len(f)) - 1
                c[last] = np.where(codes[last], np.add.reduceat(c, starts), c[last])
                codes[last] = False
                f, v, w, c = (x[~codes] for x in (f, v, w, c))
            return [f, v, w, c]

        def done(at, parts, summaries, counts):
            f, v, w, c = added(parts) if parts else [np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
            for k in summaries:
                a, b = np.searchsorted(f, [k, k + 1])
                summaries[k], counts[k] = summaries[k].merge(Summary.exact(v[a:b], w[a:b])), counts[k] + int(c[a:b].sum())
            if summaries:
                rest = ~np.isin(f, list(summaries))
                f, v, w, c = f[rest], v[rest], w[rest], c[rest]
            if not finish:
                rows = [[at[0], at[1], *tobytes(f, v, w, c), b"", b""]] if len(f) else []
                for k, s in summaries.items():
                    s = s.prune(budget)
                    rows.append([at[0], at[1], *tobytes([k], s.v, s.w, [counts[k]], s.lo, s.hi)])
                return batch_of(SUMMARY, zip(*rows, strict=True)) if rows else None
            (f, v, w, c), many = split_off([f, v, w, c], max_bin)
            cut: dict[int, np.ndarray] = {k: s.prune(budget).cuts(max_bin) for k, s in summaries.items()}
            for k, (_, x, y, z) in many:
                cut[k], counts[k] = Summary.exact(x, y).prune(budget).cuts(max_bin), int(z.sum())
            starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(f)))
            upper = np.append(v[1:], 0.0)[: len(v)]
            last = v[starts + sizes - 1]
            upper[starts + sizes - 1] = last + (np.abs(last) + 1e-5)  # above every value
            if len(cats):
                codes = np.isin(f[starts], cats)
                upper = upper[~np.repeat(codes, sizes)]
                sizes = np.where(codes, last + 1, sizes).astype(np.int64)
            plain = [f[starts], sizes, np.add.reduceat(c, starts) if len(c) else c]
            if cut:  # put among the others, by feature
                names = np.concatenate([plain[0], list(cut)])
                lengths = np.where(np.isin(plain[0], cats), 0, sizes)
                pieces = [*np.split(upper, np.cumsum(lengths)[:-1] if len(lengths) else []), *cut.values()] if len(lengths) else list(cut.values())
                order = np.argsort(names, kind="stable")
                upper = np.concatenate([pieces[i] for i in order.tolist()])
                plain = [names[order], np.concatenate([sizes, [len(x) for x in cut.values()]])[order], np.concatenate([plain[2], [counts[k] for k in cut]])[order]]
            f, sizes, c = plain
            return batch_of(CUTS, [[at[0]], *([np.asarray(x, t).tobytes()] for x, t in ((f, "<i4"), (sizes, "<i4"), (c, "<i8"), (upper, "<f8")))]) if len(f) else None

        def run(batches):
            at, parts, waiting, summaries, counts = None, [], 0, {}, {}
            for batch in batches:
                for chunk, part, *arrays in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    key = (chunk, 0 if finish else part)
                    if key != at:
                        if at and (got := done(at, parts, summaries, counts)):
                            yield got
                        at, parts, waiting, summaries, counts = key, [], 0, {}, {}
                    f, v, w, c, lo, hi = (np.frombuffer(x, t) for x, t in zip(arrays, ("<i4", "<f8", "<f8", "<i8", "<f8", "<f8"), strict=True))
                    if len(lo):
                        k = int(f[0])
                        s = Summary(v, lo, hi, w)
                        s = summaries[k].merge(s) if k in summaries else s
                        summaries[k], counts[k] = s.prune(budget) if len(s.v) > 2 * budget else s, counts.get(k, 0) + int(c[0])
                        continue
                    parts.append((f, v, w, c))
                    waiting += len(f)
                    if waiting > 500_000 + 2 * len(parts[0][0]):
                        parts = [added(parts)]
                        parts[0], many = split_off(parts[0], 2 * budget)
                        for k, (_, x, y, z) in many:
                            s = Summary.exact(x, y)
                            s = summaries[k].merge(s) if k in summaries else s
                            summaries[k], counts[k] = s.prune(budget), counts.get(k, 0) + int(z.sum())
                        waiting = len(parts[0][0])
            if at and (got := done(at, parts, summaries, counts)):
                yield got

        return run

    m = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.mapInArrow(partition, SUMMARY)
    if fan > 1:
        parts = parts.repartition(m, "chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(merge(False), SUMMARY)
    table = parts.repartition(m, "chunk").sortWithinPartitions("chunk").mapInArrow(merge(True), CUTS).persist()
    sizes, at, count = np.ones(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
    for r in table.select("f", "sizes", "c").collect():  # three numbers a feature
        f = np.frombuffer(r["f"], "<i4")
        sizes[f], count[f] = np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["c"], "<i8")
    lengths = np.where(count > 0, sizes, 0)
    lengths[cats] = 0
    order = np.argsort(-count, kind="stable")
    order = order[lengths[order] > 0]
    at[order] = np.where(np.cumsum(lengths[order]) <= MOST_CUTS, 0, -1)
    if len(cats):
        at[cats] = 0
    held = (at >= 0) & (lengths > 0)
    at[held] = np.cumsum(lengths[held]) - lengths[held]
    values = np.full(int(lengths[held].sum()) + 1, 1e-5)
    at[count == 0] = len(values) - 1  # the one cut of features that no row holds
    for r in table.mapInArrow(lambda batches: only(batches, held, cats), CUTS).collect():
        f, v = np.frombuffer(r["f"], "<i4"), np.frombuffer(r["v"], "<f8")
        if len(f):
            long = lengths[f]
            values[np.repeat(at[f] - np.cumsum(long) + long, long) + np.arange(len(v))] = v
    return Cuts(sizes.astype(np.int32), at.astype(np.int32), values, table, categorical)  # as these go to every task


def only(batches, wanted: np.ndarray, cats: np.ndarray):
    """CUTS of the wanted numeric features."""
    for batch in batches:
        for chunk, *arrays in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            f, sizes, c, v = (np.frombuffer(x, t) for x, t in zip(arrays, ("<i4", "<i4", "<i8", "<f8"), strict=True))
            own, long = wanted[f], np.where(np.isin(f, cats), 0, sizes)
            if own.any():
                yield batch_of(CUTS, [[chunk], *([x.tobytes()] for x in (f[own], sizes[own], c[own], v[np.repeat(own, long)]))])


def add_cells(df: DataFrame, layout: Layout, cuts: Cuts) -> DataFrame:
    """df with `bins`: each row's cells (whole numbers of 32 bits). cuts: all at hand."""
    at, values, categorical = cuts.at, cuts.values, layout.categorical

    @F.arrow_udf("binary")
    def binned(entries: pa.Array) -> pa.Array:
        row, f, v = entry_arrays(entries)
        bins = bins_among(f, v, at, layout.sizes, values, categorical)
        ok = bins >= 0
        return packed_cells(row[ok], layout.edges[f[ok]] + bins[ok], len(entries))

    return df.withColumn("bins", binned("entries"))


def packed_cells(row: np.ndarray, cells: np.ndarray, n: int) -> pa.Array:
    """The cells of each of n rows, one after the other; row: of each cell, in order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cells.astype("<i4").tobytes())]).cast(pa.binary())


def row_cells(df: DataFrame, layout: Layout, cuts: Cuts) -> DataFrame:
    """row_id, bins (as add_cells) of rows that hold anything. df: PACKED.

    Entries of features whose cuts are in the table only go to the tasks of these, in packages by the features' chunks, and
    cells go back in packages by the rows' ids.
    """
    m = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, values, edges, sizes, categorical, dests = cuts.at, cuts.values, layout.edges, layout.sizes, layout.categorical, 8 * m
    wanted, cats = at < 0, np.array(sorted(categorical), np.int64)

    def packages(kind, dest, *arrays):
        order = np.argsort(dest, kind="stable")
        dest, arrays = dest[order], [x[order] for x in arrays]
        rows = [[int(dest[a]), kind, *(x[a:b].tobytes() for x in arrays), *[b""] * (3 - len(arrays))] for a, b in runs(dest)]
        return batch_of(SENT, zip(*rows, strict=True)) if rows else None

    def gathered(found, pack):
        """Batches of packages, of some MOST_SENT entries each."""
        held, waiting = [], 0
        for arrays in found:
            held.append(arrays)
            waiting += len(arrays[0])
            if waiting > MOST_SENT:
                if (got := pack(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
                    yield got
                held, waiting = [], 0
        if held and (got := pack(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield got

    def to_rows(ids, cells):
        return packages(0, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % dests, ids.astype("<i8"), cells.astype("<i4"))

    def at_hand(batches):
        def found():
            for batch in batches:
                for ids, _, f, v in unpacked(batch):
                    own = at[f] >= 0
                    f, v, ids = f[own], v[own], ids[own]
                    bins = bins_among(f, v, at, sizes, values, categorical)
                    ok = bins >= 0
                    yield ids[ok], edges[f[ok]] + bins[ok]

        return gathered(found(), to_rows)

    def away(batches):
        def found():
            for batch in batches:
                for ids, _, f, v in unpacked(batch):
                    own = at[f] < 0
                    yield f[own], v[own], ids[own]

        return gathered(found(), lambda f, v, ids: packages(1, f // TOGETHER % dests, f, v, ids))

    def cuts_sent(batches):
        for batch in only(batches, wanted, cats):
            for chunk, f, size, v in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                yield batch_of(SENT, [[chunk % dests], [0], [f], [size], [v]])

    def binned(batches):
        def found():
            dest, own, first = None, [], None
            for batch in batches:
                for d, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if d != dest:
                        dest, own, first = d, [], None
                    f, v = np.frombuffer(a, "<i4"), np.frombuffer(b, "<f8" if kind else "<i4")
                    if not kind:
                        own.append((f, v.astype(np.int64), np.frombuffer(c, "<f8")))
                        continue
                    if first is None:
                        names, long, cut = (np.concatenate(x) for x in zip(*own, strict=True))
                        start = np.cumsum(long) - long
                        order = np.argsort(names)
                        first = names[order], start[order], long[order]
                    k = np.searchsorted(first[0], f)
                    bins = bins_among(k, v, first[1], first[2], cut)
                    ok = bins >= 0
                    yield np.frombuffer(c, "<i8")[ok], edges[f[ok]] + bins[ok]

        return gathered(found(), to_rows)

    def by_row(batches):
        dest, held = None, []

        def done():
            ids, cells = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((cells, ids))
            ids, cells = ids[order], cells[order]
            once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (cells[1:] != cells[:-1])])  # rows of one id have the same entries
            ids, cells = ids[once], cells[once]
            new = np.concatenate([[True], ids[1:] != ids[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(ids[new]), packed_cells(np.cumsum(new) - 1, cells, int(new.sum()))], names=["row_id", "bins"])

        for batch in batches:
            for d, ids, cells in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if d != dest:
                    if held:
                        yield done()
                    dest, held = d, []
                held.append((np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<i4")))
        if held:
            yield done()

    found = df.mapInArrow(away, SENT).unionByName(cuts.table.mapInArrow(cuts_sent, SENT)).repartition(m, "dest").sortWithinPartitions("dest", "kind").mapInArrow(binned, SENT)
    found = found.unionByName(df.mapInArrow(at_hand, SENT))
    return found.repartition(m, "dest").sortWithinPartitions("dest").mapInArrow(by_row, "row_id bigint, bins binary")


def cells_in_order(bins: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells of a column of packed cells, in the order of cells."""
    offsets = np.frombuffer(bins.buffers()[1], np.int32, len(bins) + 1, bins.offset * 4) if len(bins) else np.zeros(1, np.int32)
    cells = np.frombuffer(bins.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<i4") if len(bins) and offsets[-1] > offsets[0] else np.zeros(0, "<i4")
    rows = np.repeat(np.arange(len(bins), dtype=np.int32), np.diff(offsets) // 4)
    order = np.argsort(cells, kind="stable")
    return rows[order], cells[order]


def sparse_blocks(df: DataFrame, scales: tuple[float, float]) -> DataFrame:
    """df: bins (cells), g, h. Like grow.blocks, with the cells of all rows in order."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows, cells = cells_in_order(batch.column("bins"))
                g, h = ((flat(batch.column(c), float) * s).astype("<i8").tobytes() for c, s in zip(("g", "h"), scales, strict=True))
                row = [pa.array([batch.num_rows], pa.int32()), *(pa.array([v], pa.binary()) for v in (rows.tobytes(), cells.tobytes(), g, h))]
                yield pa.RecordBatch.from_arrays(row, names=["n", "rows", "cells", "g", "h"])

    return df.select("bins", "g", "h").mapInArrow(run, BLOCKS)


def walk(tree: Tree, n: int, column, by_bin: bool) -> np.ndarray:
    """The leaf of each of n rows; column(f) gives the rows that hold f and their bins or values."""
    at, todo, goes = np.zeros(n, np.int64), [(0, np.arange(n))], np.zeros(n, bool)
    while todo:
        i, rows = todo.pop()
        node = tree.nodes[i]
        if node.leaf or not len(rows):
            at[rows] = i
            continue
        goes[rows] = node.default_left
        own, v = column(node.feature)
        if not by_bin:
            goes[own] = tree.goes_left(node, v)
        else:
            goes[own] = ~np.isin(v, list(node.categories)) if node.categories is not None else v <= node.bin
        left = goes[rows]
        todo += [(node.left, rows[left]), (node.right, rows[~left])]
    return at


def value_column(entries: pa.Array):
    """column(f) for walk, of a column of lists of (f, v)."""
    row, f, v = entry_arrays(entries)
    order = np.argsort(f, kind="stable")
    row, f, v = row[order], f[order], v[order]

    def column(k):
        a, b = np.searchsorted(f, [k, k + 1])
        return row[a:b], v[a:b]

    return column


# ---- sums and search


def summed(index: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by index, in its order."""
    if not len(index):
        return index, sums
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[starts], np.add.reduceat(sums[:, order], starts, axis=1)


def partial_sums(df: DataFrame, tree: Tree, nodes: dict[int, int], layout: Layout, outputs: int) -> DataFrame:
    """SUMS of each task's blocks, by node and chunk: the cells that the node's rows hold. nodes: by node the pair that it belongs to."""
    slot = np.full(len(tree.nodes), -1, np.int64)
    slot[list(nodes)] = np.arange(len(nodes))
    names, pairs, cells_in_all = list(nodes), list(nodes.values()), int(layout.edges[-1])

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            for n, rows, cells, g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, cells = np.frombuffer(rows, "<i4"), np.frombuffer(cells, "<i4")
                at = slot[walk(tree, n, lambda f: layout.column(rows, cells, f), True)][rows]  # noqa: B023
                ok = at >= 0
                own = rows[ok]
                values = [np.frombuffer(x, "<i8").reshape(n, outputs)[own, k] for x in (g, h) for k in range(outputs)]
                held.append(summed(at[ok] * cells_in_all + cells[ok], np.stack([*values, np.ones(len(own), np.int64)])))
                waiting += len(held[-1][0])
                if waiting > 1.5 * len(held[0][0]) + 200_000:
                    held = [summed(*(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))]
                    waiting = len(held[0][0])
        if not held:
            return
        index, sums = summed(*(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)))
        node, cell = index // cells_in_all, index % cells_in_all
        key = node * (cells_in_all // CHUNK + 1) + cell // CHUNK
        of = runs(key)
        for lo in range(0, len(of), 4096):
            rows = [(pairs[int(node[a])], int(cell[a]) // CHUNK, names[int(node[a])], cell[a:b].astype("<i4").tobytes(), np.ascontiguousarray(sums[:, a:b]).tobytes()) for a, b in of[lo : lo + 4096]]
            yield batch_of(SUMS, zip(*rows, strict=True))

    return df.mapInArrow(run, SUMS)


def best_of_cells(f: np.ndarray, bins: np.ndarray, sums: np.ndarray, total: np.ndarray, outputs: int, scale, p: Penalty, bounds, numeric: np.ndarray):
    """The best split over cells (features in order, bins in order): gain, feature, bin, default_left, left sums; None if none is valid.

    A side that starts or ends at empty bins has the same sums as at the next full one, so only cells
    with rows are candidates: forward, the last bin on the left; backward, the bin before the first on the right.
    """
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    sizes = np.diff(np.append(starts, len(f)))
    upto = np.cumsum(sums, axis=1)
    before = np.repeat(upto[:, starts] - sums[:, starts], sizes, axis=1)
    upto = upto - before  # within the feature
    present = np.repeat(upto[:, starts + sizes - 1], sizes, axis=1)
    missing = total[:, None] - present
    signs = np.array([p.monotone[k] if k < len(p.monotone) else 0 for k in f.tolist()]) if p.monotone else None
    best = None
    for default_left, left, name in ((False, upto, bins), (True, upto - sums + missing, bins - 1)):
        right = total[:, None] - left
        gl, hl, gr, hr = (x / s for side in (left, right) for x, s in ((side[:outputs], scale[0]), (side[outputs:-1], scale[1])))
        G, H = (total[:outputs] / scale[0])[:, None], (total[outputs:-1] / scale[1])[:, None]
        gains = (p.gain(gl, hl, *bounds) + p.gain(gr, hr, *bounds)).sum(axis=0) - p.gain(G, H, *bounds).sum()
        ml, mr = hl.mean(axis=0), hr.mean(axis=0)
        bad = ~numeric | (ml <= 0) | (mr <= 0) | (ml < p.min_child_weight) | (mr < p.min_child_weight)
        if signs is not None:
            wl, wr = p.weight(gl, hl, *bounds)[0], p.weight(gr, hr, *bounds)[0]
            bad |= (signs > 0) & (wl > wr) | (signs < 0) & (wl < wr)
        if default_left:
            bad |= missing[-1] == 0  # nothing is missing: forward has these splits
        gains = np.where(bad, -np.inf, gains)
        top = gains.max(initial=-np.inf)
        if not np.isfinite(top):
            continue
        same = np.flatnonzero(gains == top)
        own = same[f[same] == f[same[0]]]
        i = int(own[-1] if default_left else own[0])  # from above, the highest bin comes first
        if best is None or top > best[0] or (top == best[0] and f[i] < best[1]):
            best = (float(top), int(f[i]), int(name[i]), default_left, None, left[:, i].tolist())
    return best


def searched(parts: DataFrame, layout: Layout, outputs: int, scale, p: Penalty, other: dict[int, int], settings: dict[int, tuple], totals: dict[int, list[int]], parents: set[int]) -> DataFrame:
    """FOUND by (node, chunk). parts: SUMS; a kind of -1 is the pair's parent, whose sums beyond those at hand are the other child's. Sums are kept of nodes that may be parents."""
    layers, n = 2 * outputs + 1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(n, "pair", "chunk").sortWithinPartitions("pair", "chunk").select("pair", "chunk", "kind", "cells", "sums")

    def search(node, chunk, cells, sums):
        total, (bounds, allowed) = np.array(totals[node], np.int64), settings[node]
        f = layout.feature(cells)
        bins = cells - layout.edges[f]
        ok = np.ones(len(f), bool) if allowed is None else np.isin(f, allowed)
        cats = np.isin(f, list(layout.categorical)) if layout.categorical else np.zeros(len(f), bool)
        best = best_of_cells(f, bins, sums, total, outputs, scale, p, bounds, ok & ~cats) if len(f) else None
        for k in np.unique(f[ok & cats]).tolist():
            own = f == k
            dense = np.zeros((layers, int(layout.sizes[k])), np.int64)
            dense[:, bins[own]] = sums[:, own]
            g, h = dense[:outputs] / scale[0], dense[outputs:-1] / scale[1]
            s = feature_split(k, g, h, dense[-1], (total[:outputs] / scale[0], total[outputs:-1] / scale[1]), int(total[-1]), p, True, bounds)
            if s.feature >= 0 and (best is None or s.gain > best[0] or (s.gain == best[0] and k < best[1])):
                right = dense[:, sorted(s.categories)].sum(axis=1) + (0 if s.default_left else total - dense.sum(axis=1))
                best = (s.gain, k, -1, s.default_left, sorted(s.categories), (total - right).tolist())
        kept = (cells.astype("<i4").tobytes(), np.ascontiguousarray(sums).tobytes()) if node in parents else (b"", b"")
        return (node, chunk, *kept, *(best or [None] * 6))

    def whole(parts):
        return summed(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))) if len(parts) > 1 else parts[0]

    def solve(pair, chunk, held):
        out, held = [], {kind: whole(parts) for kind, parts in held.items()}
        for node, (cells, sums) in held.items():
            if node >= 0:
                out.append(search(node, chunk, cells, sums))
        if pair in other and -1 in held:
            cells, sums = [held[-1][0]], [held[-1][1]]
            for node, (c, s) in held.items():
                if node >= 0:
                    cells, sums = [*cells, c], [*sums, -s]
            cells, sums = summed(np.concatenate(cells), np.concatenate(sums, axis=1))
            full = sums[-1] > 0
            if full.any():
                out.append(search(other[pair], chunk, cells[full], sums[:, full]))
        return out

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    def run(batches):
        at, held = None, {}
        for batch in batches:
            out = []
            for pair, chunk, kind, cells, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (pair, chunk):
                    if at:
                        out += solve(*at, held)
                    at, held = (pair, chunk), {}
                held.setdefault(kind, []).append((np.frombuffer(cells, "<i4").astype(np.int64), np.frombuffer(data, np.int64).reshape(layers, -1)))
                if len(held[kind]) == ADDED:
                    held[kind] = [whole(held[kind])]
            if out:
                yield emit(out)
        if at and (out := solve(*at, held)):
            yield emit(out)

    return rows.mapInArrow(run, FOUND)


class SparseGrower(Grower):
    """Grows on sparse blocks."""

    def __init__(self, layout: Layout, cuts: Cuts, outputs: int = 1, **settings):
        super().__init__(cuts, outputs, **settings)
        self.layout, self.totals = layout, {}

    def sizes_of(self):
        return self.layout.sizes

    def grow(self, df: DataFrame, scale: tuple[float, float]) -> Tree:
        k = self.outputs

        def added(batches):
            total = np.zeros(2 * k + 1, np.int64)
            for batch in batches:
                for n, g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total += np.concatenate([*(np.frombuffer(x, "<i8").reshape(n, k).sum(axis=0) for x in (g, h)), [n]])
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * k + 1), pa.int32()), pa.array(total)], names=["i", "s"])

        got = dict(df.select("n", "g", "h").mapInArrow(added, "i int, s bigint").groupBy("i").agg(F.sum("s")).collect())
        self.totals = {0: [got.get(i, 0) for i in range(2 * k + 1)]}
        return super().grow(df, scale)

    def evaluated(self, df: DataFrame, tree: Tree, nodes: list[int]) -> list[tuple[int, Split]]:
        summed_, other, tables = self.paired(tree, nodes)
        k = self.outputs
        parts = partial_sums(df, tree, summed_, self.layout, k)
        for table in {id(t): t for t in tables.values()}.values():
            own = [q for q, t in tables.items() if t is table]
            parts = parts.unionByName(table.where(F.col("node").isin(own)).select(F.col("node").alias("pair"), "chunk", F.lit(-1).alias("kind"), "cells", "sums"))
        settings = self.settings_of(tree, nodes, lambda s: np.array(sorted(s)))
        parents = {n for n in nodes if not self.max_depth or tree.nodes[n].depth + 1 < self.max_depth}  # whose children are looked at
        found = searched(parts, self.layout, k, self.scale, self.p, other, settings, {n: self.totals[n] for n in nodes}, parents).persist()
        out = {node: Split() for node in nodes}
        sums = lambda v: (np.array(v[:k], float) / self.scale[0], np.array(v[k : 2 * k], float) / self.scale[1])
        if 0 in nodes:
            self.settle(tree, 0, *sums(self.totals[0]))
        what = F.struct("gain", (-F.col("f")).alias("order"), "f", "bin", "default_left", "cats", "lsum")
        for node, s in found.groupBy("node").agg(F.max(F.when(F.col("gain").isNotNull(), what)).alias("s")).collect():
            self.held[node] = found
            if s is not None:
                total = self.totals[node]
                right = [a - b for a, b in zip(total, s["lsum"], strict=True)]
                out[node] = Split(s["gain"], s["f"], s["bin"], 0.0, s["default_left"], frozenset(s["cats"]) if s["cats"] is not None else None, sums(s["lsum"]), sums(right))
                out[node].threshold = threshold_of(out[node], self.cuts[s["f"]])
                self.sides[node] = (s["lsum"], right)
        return list(out.items())

    def apply(self, tree: Tree, node: int, s: Split) -> list[int]:
        whole = self.sides[node]
        self.sides[node] = (whole[0][-1], whole[1][-1])
        children = super().apply(tree, node, s)
        for child, total in zip(children, whole, strict=True):
            self.totals[child] = list(total)
        return children
