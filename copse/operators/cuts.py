"""Quantile cuts: weighted summaries per feature, and the cut values read off them.

A summary is a sorted list of (value, rmin, rmax, weight). A task sketches its rows in levels, like a
binary counter; summaries of tasks are merged in two steps keyed by feature, so neither a task nor the
driver sees more than a bounded number of entries of a numeric feature. Of a categorical one only the
largest code is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTOR = 2
SUMMARY = "f int, part int, v array<double>, lo array<double>, hi array<double>, w array<double>"


def summary_budget(max_bin: int, n: int) -> int:
    """Entries kept of a feature of n values so that ranks are good to 1 / (2 max_bin)."""
    if n <= 0:
        return 1
    eps = 1 / min(max_bin, n) / FACTOR
    for level in range(1, 64):
        size = min(math.ceil(level / eps) + 1, n)
        if (1 << level) * size >= n:
            return size
    return n


class Summary:
    """A rank summary that can be merged and pruned."""

    def __init__(self, v, lo, hi, w):
        self.v, self.lo, self.hi, self.w = (np.asarray(x, float) for x in (v, lo, hi, w))

    @classmethod
    def exact(cls, values, weights):
        v, inverse = np.unique(values, return_inverse=True)
        w = np.bincount(inverse, weights, len(v)) if len(v) else np.zeros(0)
        hi = np.cumsum(w)
        return cls(v, hi - w, hi, w)

    def merge(self, other):
        """Ranks add; between another's entries a value's rank lies between its neighbours' bounds."""
        if not len(self.v) or not len(other.v):
            return self if len(self.v) else other
        v = np.union1d(self.v, other.v)
        lo, hi, w = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
        for s in (self, other):
            at = np.searchsorted(s.v, v, "left")
            there = (at < len(s.v)) & (s.v[np.minimum(at, len(s.v) - 1)] == v)
            below = np.maximum(at - 1, 0)
            nxt, prev = np.minimum(at, len(s.v) - 1), below
            lo += np.where(there, s.lo[nxt], np.where(at > 0, s.lo[prev] + s.w[prev], 0))
            hi += np.where(there, s.hi[nxt], np.where(at < len(s.v), s.hi[nxt] - s.w[nxt], s.hi[-1]))
            w += np.where(there, s.w[nxt], 0)
        return Summary(v, lo, hi, w)

    def prune(self, size: int):
        n = len(self.v)
        if n <= size or size < 3:
            return self
        begin, end = self.hi[0], self.lo[-1]
        want = 2 * (begin + np.arange(1, size - 1) * (end - begin) / (size - 1))
        mid = self.lo + self.hi
        at = np.searchsorted(mid, want, "right") - 1
        want, at = want[at < n - 1], np.maximum(at[at < n - 1], 1)
        at = np.minimum(at, n - 2)
        take_low = want < (self.lo[at] + self.w[at]) + (self.hi[at + 1] - self.w[at + 1])
        keep = np.unique(np.concatenate([[0], np.where(take_low, at, at + 1), [n - 1]]))
        return Summary(self.v[keep], self.lo[keep], self.hi[keep], self.w[keep])

    def cuts(self, max_bin: int) -> np.ndarray:
        """Upper bin bounds, strictly increasing; the last lies above every value."""
        n = len(self.v)
        if not n:
            return np.array([1e-5])
        if n <= max_bin:
            inner = self.v[1:].tolist()
        else:
            want = 2 * np.arange(1, max_bin) * self.hi[-1] / max_bin
            at = np.clip(np.searchsorted(self.lo + self.hi, want, "right") - 1, 0, n - 2)
            low = want < (self.lo[at] + self.w[at]) + (self.hi[at + 1] - self.w[at + 1])
            inner, last = [], 0
            for i in np.where(low, at, at + 1).tolist():
                i = max(i, last + 1)  # a rank that answers with a value already used moves to the next one
                if i >= n:
                    break
                inner.append(float(self.v[i]))
                last = i
        top = float(self.v[-1])
        return np.array([*inner, top + (abs(top) + 1e-5)])


class Sketch:
    """A feature's values as they come: full queues become summaries, and levels that overflow are pruned and carried on."""

    def __init__(self, limit: int):
        self.limit, self.levels = limit, []
        self.v, self.w = np.zeros(0), np.zeros(0)

    def push(self, values: np.ndarray, weights: np.ndarray) -> None:
        v, w = np.concatenate([self.v, values]), np.concatenate([self.w, weights])
        if len(v):  # neighbours of equal value are one entry
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            v, w = v[starts], np.add.reduceat(w, starts)
        full = 2 * self.limit
        while len(v) > full:
            self.carry(Summary.exact(v[:full], w[:full]))
            v, w = v[full:], w[full:]
        self.v, self.w = v, w

    def carry(self, s: Summary) -> None:
        for i in range(len(self.levels) + 1):
            if i == len(self.levels):
                self.levels.append(None)
            s = s.prune(self.limit)
            if self.levels[i] is not None:
                s = s.merge(self.levels[i])
                self.levels[i] = None
            if len(s.v) <= self.limit:
                self.levels[i] = s
                return

    def summary(self) -> Summary:
        if len(self.v):
            self.carry(Summary.exact(self.v, self.w))
            self.v, self.w = np.zeros(0), np.zeros(0)
        out = Summary([], [], [], [])
        for s in self.levels:
            if s is not None:
                out = out.merge(s).prune(self.limit)
        return out


#: Codes that a categorical feature may have.
MOST_CODES = 1 << 24


def feature_cuts(df: DataFrame, width: int, max_bin: int, categorical=(), weight: str = "weight", n: int | None = None) -> list[np.ndarray]:
    """Cuts of every feature of a frame's DataFrame (features, weight) in one job. n: its rows, where known."""
    budget = summary_budget(max_bin, df.count() if n is None else n)
    fan = max(1, math.isqrt(df.rdd.getNumPartitions()))
    cats = frozenset(categorical)

    def partition(batches):
        held = [Sketch(budget) for _ in range(width)]
        top = np.full(width, -1.0)
        for batch in batches:
            flat = batch.column("features").flatten().fill_null(float("nan"))
            x = np.asarray(flat, float).reshape(batch.num_rows, width)
            w = np.asarray(batch.column("w"), float)
            for f in range(width):
                ok = ~np.isnan(x[:, f]) & (w > 0)
                v = x[ok, f]
                if f in cats:
                    if len(v) and (v.min() < 0 or (v != np.floor(v)).any() or v.max() >= MOST_CODES):
                        raise ValueError(f"feature {f}: categories must be whole numbers from 0 on, below {MOST_CODES}")
                    top[f] = max(top[f], v.max(initial=-1))
                else:
                    held[f].push(v, w[ok])
        # A task that runs again gives the same key, so no summary is lost or counted twice.
        part = TaskContext.get().partitionId() % fan
        found = [Summary([top[f]], [0], [1], [1]) if f in cats and top[f] >= 0 else held[f].summary() for f in range(width)]
        rows = [(f, part, s.v.tolist(), s.lo.tolist(), s.hi.tolist(), s.w.tolist()) for f, s in enumerate(found) if len(s.v)]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["f", "part", "v", "lo", "hi", "w"])

    def merge(key, pdf):
        s = Summary([], [], [], [])
        for row in pdf.itertuples():
            s = s.merge(Summary(row.v, row.lo, row.hi, row.w))
            if key[0] in cats:
                s = Summary(s.v[-1:], s.lo[-1:], s.hi[-1:], s.w[-1:])
            elif len(s.v) > 2 * budget:
                s = s.prune(budget)
        return pd.DataFrame([(key[0], 0, s.v, s.lo, s.hi, s.w)], columns=["f", "part", "v", "lo", "hi", "w"])

    merge_key = lambda key, pdf: merge(key, pdf)
    parts = df.select("features", F.col(weight).alias("w")).mapInArrow(partition, SUMMARY)
    if fan > 1:
        parts = parts.groupBy("f", "part").applyInPandas(merge_key, SUMMARY)
    parts = parts.groupBy("f").applyInPandas(merge_key, SUMMARY)
    out: list[np.ndarray] = [np.array([1e-5])] * width
    for row in parts.collect():  # a bounded summary per feature
        s = Summary(row["v"], row["lo"], row["hi"], row["w"])
        out[row["f"]] = np.arange(s.v[-1] + 1) if row["f"] in cats else s.prune(budget).cuts(max_bin)
    return out


def bin_array(v: np.ndarray, cuts: np.ndarray, categorical: bool) -> np.ndarray:
    """Bins of a column; -1 for missing values, and for codes that are no category."""
    if categorical:
        ok = (v >= 0) & (v < len(cuts)) & (v == np.floor(v))
        return np.where(ok, np.where(ok, v, 0).astype(np.int64), -1)
    at = np.minimum(np.searchsorted(cuts, v, "right"), len(cuts) - 1)
    return np.where(np.isnan(v), -1, at)
