"""Coordinate descent for linear boosters on the driver, over second moments summed by Spark."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import entry_arrays, summed


def moments(df: DataFrame, width: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of g x (outputs, width + 1) and h x x' (outputs, width + 1, width + 1); the last x is 1, missing is 0.

    df: features, g, h. Each task adds up its rows; a row of sums per task is all that moves.
    """
    n = width + 1

    def sums(batches):
        a, b = np.zeros((outputs, n)), np.zeros((outputs, n, n))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("features").flatten().fill_null(0.0)).reshape(-1, width)
            x = np.hstack([x, np.ones((len(x), 1))])
            g, h = (np.array(batch.column(c).flatten(), float).reshape(-1, outputs) for c in ("g", "h"))
            for k in range(outputs):
                ok = h[:, k] >= 0
                a[k] += g[ok, k] @ x[ok]
                b[k] += (x[ok] * h[ok, k][:, None]).T @ x[ok]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b.ravel()]).tolist()])], names=["s"])

    got = df.select("features", "g", "h").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    flat = np.zeros(outputs * (n + n * n))
    for i, v in got.groupBy("i").agg(F.sum("v")).collect():
        flat[i] = v
    return flat[: outputs * n].reshape(outputs, n), flat[outputs * n :].reshape(outputs, n, n)


def batch_moments(df: DataFrame, width: int, outputs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of each row batch, in their order. df: batch, features, g, h. One job; the driver holds one batch's sums at a time."""
    n = width + 1
    size = outputs * (n + n * n)

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            number = batch.column("batch").to_numpy()
            x = np.array(batch.column("features").flatten().fill_null(0.0)).reshape(-1, width)
            x = np.hstack([x, np.ones((len(x), 1))])
            g, h = (np.array(batch.column(c).flatten(), float).reshape(-1, outputs) for c in ("g", "h"))
            for b in np.unique(number).tolist():
                own = number == b
                parts = []
                for k in range(outputs):
                    ok = own & (h[:, k] >= 0)
                    parts.append((g[ok, k] @ x[ok], (x[ok] * h[ok, k][:, None]).T @ x[ok]))
                flat = np.concatenate([*(a for a, _ in parts), *(m.ravel() for _, m in parts)])
                held[b] = held[b] + flat if b in held else flat
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["batch", "s"])

    def added(batches):
        at, total = None, np.zeros(size)
        for batch in batches:
            out = []
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at:
                    if at is not None:
                        out.append((at, total.tolist()))
                    at, total = b, np.zeros(size)
                total = total + np.array(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([s for _, s in out], pa.list_(pa.float64()))], names=["batch", "s"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["batch", "s"])

    parts = df.mapInArrow(sums, "batch int, s array<double>")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = parts.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(added, "batch int, s array<double>").orderBy("batch")
    for row in whole.toLocalIterator(prefetchPartitions=True):
        flat = np.array(row["s"])
        yield flat[: outputs * n].reshape(outputs, n), flat[outputs * n :].reshape(outputs, n, n)


#: Features whose products are summed together: a square of so many numbers in a task and on the driver.
MOST = 2048
#: Features of a block whose products are a list instead, and pairs of features that its rows may hold.
MOST_LISTED, MOST_PAIRS = 1 << 21, 1 << 21
#: Features whose listed sums meet in one task.
TOGETHER = 1 << 16
LISTED = "k int, chunk int, code binary, sums binary"


def entries_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature, value of what a batch's rows hold, of dense or sparse rows."""
    if "entries" in batch.schema.names:
        return entry_arrays(batch.column("entries"))
    flat = batch.column("features").flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    row, f = np.nonzero(flat)
    return row, f, flat[row, f]


def block_moments(df: DataFrame, block: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of r x (outputs, block) and h x x' (outputs, block, block) over the features of a block.

    df: features or entries, g, h. delta: (width + 1, outputs), what weights have moved by since g was computed; r = g + h x'delta is what
    is left. A task holds one square of the block's size; its rows are added up by the row of the square.
    """
    m, outputs = len(block), delta.shape[1]
    place = np.full(len(delta), -1, np.int64)
    place[block] = np.arange(m)

    def sums(batches):
        a, b = np.zeros((outputs, m)), np.zeros((outputs, m, m))
        for batch in batches:
            row, f, v = entries_of(batch)
            n = batch.num_rows
            inside = place[f] >= 0
            own, at, value = row[inside], place[f[inside]], v[inside]
            order = np.argsort(own, kind="stable")
            own, at, value = own[order], at[order], value[order]
            held = np.bincount(own, minlength=n)
            for k, (left, hess) in enumerate(residuals(batch, row, f, v, delta)):
                a[k] += np.bincount(at, left[own] * value, m)
                if (held.astype(float) ** 2).sum() < 8.0 * n * m:  # few entries a row: their pairs
                    first = np.repeat(np.cumsum(held) - held, held)
                    many = held[own]
                    i = np.repeat(np.arange(len(own)), many)
                    j = np.repeat(first, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                    np.add.at(b[k].reshape(-1), at[i] * m + at[j], hess[own[i]] * value[i] * value[j])
                else:
                    for lo in range(0, n, 1024):
                        part = (own >= lo) & (own < lo + 1024)
                        x = np.zeros((min(1024, n - lo), m))
                        np.add.at(x, (own[part] - lo, at[part]), value[part])
                        b[k] += (x * hess[lo : lo + 1024, None]).T @ x
        rows = [(k * m + i, a[k, i : i + 1].tobytes() + np.ascontiguousarray(b[k, i]).tobytes()) for k in range(outputs) for i in range(m) if a[k, i] or np.any(b[k, i])]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["i", "s"])

    def added(batches):
        at, total = None, None
        for batch in batches:
            out = []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        out.append((at, total.tobytes()))
                    at, total = i, np.zeros(len(s) // 8)
                total = total + np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["i", "s"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["i", "s"])

    held = "entries" if "entries" in df.columns else "features"
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.select(held, "g", "h").mapInArrow(sums, "i bigint, s binary").repartition(tasks, "i").sortWithinPartitions("i").mapInArrow(added, "i bigint, s binary")
    a, b = np.zeros((outputs, m)), np.zeros((outputs, m, m))
    for r in parts.collect():  # a square of the block's size
        s = np.frombuffer(r["s"])
        k, i = divmod(r["i"], m)
        a[k, i], b[k, i] = s[0], s[1:]
    return a, b


def residuals(batch: pa.RecordBatch, row: np.ndarray, f: np.ndarray, v: np.ndarray, delta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is left of a batch's gradients after delta, and its second ones, by output; both 0 where a row does not count."""
    n, outputs = batch.num_rows, delta.shape[1]
    g, h = (np.array(batch.column(c).flatten(), float).reshape(-1, outputs) for c in ("g", "h"))
    for k in range(outputs):
        left = g[:, k] + h[:, k] * (np.bincount(row, v * delta[f, k], n) + delta[-1, k])
        yield np.where(h[:, k] >= 0, left, 0.0), np.maximum(h[:, k], 0.0)


def pairs_of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one row (each once, the earlier first). row: of each entry, in order."""
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    later = np.repeat(np.append(starts[1:], len(row)), np.diff(np.append(starts, len(row)))) - np.arange(len(row)) - 1
    i = np.repeat(np.arange(len(row)), later)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)


def listed_moments(df: DataFrame, blocks: list[np.ndarray], delta: np.ndarray, products: bool = True) -> list[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """By output, the sums of r x and h x x over its block, and those of h x x' as a list: first place, second place, sum.

    Like block_moments, with products only of features that some row holds together. blocks: the features of each output, rising.
    """
    outputs = len(blocks)

    def sums(batches):
        held: dict[int, list] = {k: [] for k in range(2 * outputs)}  # by output its features, then by output its pairs
        for batch in batches:
            if not batch.num_rows:
                continue
            row, f, v = entries_of(batch)
            for k, (left, hess) in enumerate(residuals(batch, row, f, v, delta)):
                m = len(blocks[k])
                at = np.minimum(np.searchsorted(blocks[k], f), m - 1) if m else np.zeros(len(f), np.int64)
                inside = blocks[k][at] == f if m else np.zeros(len(f), bool)
                own, at, value = row[inside], at[inside], v[inside]
                put(held[k], at, np.stack([left[own] * value, hess[own] * value * value]))
                if products:
                    i, j = pairs_of(own)
                    put(held[outputs + k], at[i] * m + at[j], (hess[own[i]] * value[i] * value[j])[None])
        out: list[list] = [[], [], [], []]
        for k, parts in held.items():
            if parts:
                code, s = joined(parts)
                chunk = code // (TOGETHER * (len(blocks[k - outputs]) if k >= outputs else 1))
                edges = [*np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])).tolist(), len(chunk)] if len(chunk) else [0]
                for a, b in zip(edges, edges[1:], strict=False):
                    for column, value in zip(out, (k, int(chunk[a]), code[a:b].tobytes(), np.ascontiguousarray(s[:, a:b]).tobytes()), strict=True):
                        column.append(value)
        yield listed_batch(out)

    def added(batches):
        at, parts = None, []
        for batch in batches:
            for k, chunk, code, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (k, chunk):
                    if at:
                        yield whole(at, parts)
                    at, parts = (k, chunk), []
                code = np.frombuffer(code, np.int64)
                put(parts, code, np.frombuffer(s).reshape(-1, len(code)), True)
        if at:
            yield whole(at, parts)

    def whole(at, parts):
        code, s = joined(parts)
        return listed_batch([[x] for x in (*at, code.tobytes(), s.tobytes())])

    held = "entries" if "entries" in df.columns else "features"
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got: list[list] = [[] for _ in range(2 * outputs)]
    parts = df.select(held, "g", "h").mapInArrow(sums, LISTED).repartition(tasks, "k", "chunk").sortWithinPartitions("k", "chunk").mapInArrow(added, LISTED)
    for r in parts.collect():  # MOST_LISTED features and MOST_PAIRS pairs at most
        code = np.frombuffer(r["code"], np.int64)
        got[r["k"]].append((code, np.frombuffer(r["sums"]).reshape(-1, len(code))))
    out = []
    for k, block in enumerate(blocks):
        a, square, m = np.zeros(len(block)), np.zeros(len(block)), max(1, len(block))
        for code, s in got[k]:
            a[code], square[code] = s
        code, s = (np.concatenate(x, axis=-1) for x in zip(*got[outputs + k], strict=True)) if got[outputs + k] else (np.zeros(0, np.int64), np.zeros((1, 0)))
        out.append((a, square, (code // m, code % m, s[0])))
    return out


def put(held: list, code: np.ndarray, sums: np.ndarray, distinct: bool = False) -> None:
    """Sums by code, taken to those held; held lists are added up when they have grown by a million."""
    held.append((code, sums) if distinct else summed(code, sums))
    if sum(len(c) for c, _ in held[1:]) > 4 * len(held[0][0]) + 1_000_000:
        held[:] = [joined(held)]


def joined(held: list) -> tuple[np.ndarray, np.ndarray]:
    return summed(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))) if len(held) > 1 else held[0]


def listed_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["k", "chunk", "code", "sums"])


def pairs_by_block(df: DataFrame, orders: list[np.ndarray], width: int, size: int) -> list[np.ndarray]:
    """For blocks of size places, twice, four times so many and so on: the pairs of entries that rows hold in each (an upper bound of a block's products). One job."""
    places = max(map(len, orders), default=0)
    levels = 1
    while size << (levels - 1) < places and size << levels <= MOST_LISTED:
        levels += 1
    counts = [-(-places // (size << level)) for level in range(levels)]
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    plain = all(len(o) == width and (o == np.arange(width)).all() for o in orders)
    times, tables = 1, []
    if plain:
        times = len(orders)
    else:  # the places of each feature, which may be none or several
        for o in orders:
            at = np.argsort(o, kind="stable")
            tables.append((at, np.searchsorted(o[at], np.arange(width + 1))))

    def run(batches):
        total = np.zeros(starts[-1], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, f, _ = entries_of(batch)
            for at, ends in tables or [(None, None)]:
                own, place = row, f
                if at is not None:
                    many = ends[f + 1] - ends[f]
                    own = np.repeat(row, many)
                    place = at[np.repeat(ends[f], many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)]
                code, n = np.unique(own.astype(np.int64) * (counts[0] << levels) + place // size, return_counts=True)
                row_of, block = code // (counts[0] << levels), code % (counts[0] << levels)
                for level in range(levels):
                    total[starts[level] : starts[level + 1]] += np.bincount(block, n * (n - 1) / 2, counts[level]).astype(np.int64)
                    block = block >> 1
                    first = np.flatnonzero(np.concatenate([[True], (row_of[1:] != row_of[:-1]) | (block[1:] != block[:-1])])) if len(block) else np.zeros(0, np.int64)
                    if len(first):
                        row_of, block, n = row_of[first], block[first], np.add.reduceat(n, first)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(total[i] * times)], names=["i", "n"])

    found = np.zeros(starts[-1])
    held = "entries" if "entries" in df.columns else "features"
    for i, n in df.select(held).mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n")).collect():
        found[i] = n
    return [found[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def cut_into_blocks(df: DataFrame, orders: list[np.ndarray], width: int, size: int) -> list[tuple[int, int, bool]]:
    """First and end place of each block, and whether its products are a list: the largest blocks with few enough pairs, or of size places and a square."""
    places = max(map(len, orders), default=0)
    if places <= size:
        return [(0, places, False)] if places else []
    pairs = pairs_by_block(df, orders, width, size)

    def cut(level: int, b: int):
        lo = b * (size << level)
        if pairs[level][b] <= MOST_PAIRS:
            return [(lo, min(places, lo + (size << level)), True)]
        if level == 0:
            return [(lo, min(places, lo + size), False)]
        return [x for half in (2 * b, 2 * b + 1) if half < len(pairs[level - 1]) for x in cut(level - 1, half)]

    return [x for b in range(len(pairs[-1])) for x in cut(len(pairs) - 1, b)]


def descend_blocks(df: DataFrame, weights: np.ndarray, *, eta: float, lam: float, alpha: float, total: float, selector: str = "cyclic", top_k: int = 0, rng: random.Random | None = None) -> float:
    """One round over any number of features, in blocks: the same steps as descend, a job for each block.

    A block's gradients are summed anew from what earlier blocks have left, so no product between blocks is needed. A block has MOST
    features and all their products, or as many as have few products that are not 0.
    """
    width, outputs = weights.shape[0] - 1, weights.shape[1]
    lam, alpha = lam * total, alpha * total
    if selector == "greedy":
        raise ValueError(f"the selector greedy looks at all features after each step, which takes at most {MOST}")
    delta = np.zeros_like(weights)
    for k, (g, h) in enumerate(bias_sums(df, outputs)):
        delta[-1, k] = eta * -g / h if h > 0 else 0.0
    if selector == "thrifty":
        first = np.zeros((outputs, width))
        for lo in range(0, width, MOST_LISTED):
            block = np.arange(lo, min(width, lo + MOST_LISTED))
            for k, (a, square, _) in enumerate(listed_moments(df, [block] * outputs, delta, products=False)):
                first[k, block] = np.abs(steps(a, square, weights[block, k], alpha, lam))
        orders = [np.argsort(-s, kind="stable")[: top_k or width] for s in first]
    elif selector == "cyclic":
        orders = [np.arange(width)] * outputs
    else:
        orders = [np.array(list(order(selector, width, None, None, None, alpha, lam, top_k, rng)), np.int64) for _ in range(outputs)]
    size = MOST if selector == "cyclic" else max(1, MOST // outputs)  # outputs may have other features each
    for lo, hi, listed in cut_into_blocks(df, orders, width, size):
        parts = [o[lo:hi] for o in orders]
        if listed:
            descend_listed(listed_moments(df, [np.unique(o) for o in parts], delta), parts, weights, delta, eta, alpha, lam)
            continue
        block = np.unique(np.concatenate(parts))
        place = {int(f): i for i, f in enumerate(block)}
        a, b = block_moments(df, block, delta)
        for k, part in enumerate(parts):
            for f in part.tolist():
                i = place[f]
                d = eta * step(a[k, i], b[k, i, i], weights[f, k] + delta[f, k], alpha, lam)
                delta[f, k] += d
                a[k] += b[k][:, i] * d
    weights += delta
    return float(np.abs(delta).max(initial=0.0))


def descend_listed(sums: list, parts: list[np.ndarray], weights: np.ndarray, delta: np.ndarray, eta: float, alpha: float, lam: float) -> None:
    """The steps of a block from listed_moments, taken to delta. Features that no row holds with another one of the block go all at once."""
    for k, ((a, square, (i, j, v)), part) in enumerate(zip(sums, parts, strict=True)):
        block, places, many = np.unique(part, return_inverse=True, return_counts=True)
        i, j, v = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v])
        by = np.argsort(i, kind="stable")
        j, v = j[by], v[by]
        ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(block)))])
        alone = (np.diff(ends) == 0) & (many == 1)
        own = block[alone]
        delta[own, k] += eta * steps(a[alone], square[alone], weights[own, k] + delta[own, k], alpha, lam)
        for p in places[~alone[places]].tolist():
            f = block[p]
            d = eta * step(a[p], square[p], weights[f, k] + delta[f, k], alpha, lam)
            delta[f, k] += d
            a[p] += square[p] * d
            near = slice(ends[p], ends[p + 1])
            a[j[near]] += v[near] * d


def steps(g: np.ndarray, h: np.ndarray, w: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    """step of each feature."""
    g2, h2 = g + lam * w, np.where(h < 1e-5, 1.0, h + lam)
    d = np.where(w - g2 / h2 >= 0, np.maximum(-(g2 + alpha) / h2, -w), np.minimum(-(g2 - alpha) / h2, -w))
    return np.where(h < 1e-5, 0.0, d)


def step(g: float, h: float, w: float, alpha: float, lam: float) -> float:
    if h < 1e-5:
        return 0.0
    g2, h2 = g + lam * w, h + lam
    if w - g2 / h2 >= 0:
        return max(-(g2 + alpha) / h2, -w)
    return min(-(g2 - alpha) / h2, -w)


def descend(weights: np.ndarray, a: np.ndarray, b: np.ndarray, *, eta: float, lam: float, alpha: float, total: float, selector: str = "cyclic", top_k: int = 0, rng: random.Random | None = None) -> float:
    """One round in place: bias first, then each feature once. weights (width + 1, outputs). The largest change."""
    width, outputs = weights.shape[0] - 1, weights.shape[1]
    lam, alpha = lam * total, alpha * total
    largest = 0.0
    for k in range(outputs):
        grad, hess = a[k].copy(), b[k]
        if hess[-1, -1] > 0:
            d = eta * -grad[-1] / hess[-1, -1]
            weights[-1, k] += d
            grad += hess[:, -1] * d
            largest = max(largest, abs(d))
        for f in order(selector, width, grad, hess, weights[:, k], alpha, lam, top_k, rng):
            if f is None:
                break
            d = eta * step(grad[f], hess[f, f], weights[f, k], alpha, lam)
            weights[f, k] += d
            grad += hess[:, f] * d
            largest = max(largest, abs(d))
    return largest


def bias_sums(df: DataFrame, outputs: int) -> list[tuple[float, float]]:
    """Sums of g and h by output. df: g, h."""
    of = lambda c, k: F.sum(F.when(F.get("h", F.lit(k)) >= 0, F.get(c, F.lit(k))))
    got = df.agg(*[F.coalesce(of(c, k), F.lit(0.0)) for k in range(outputs) for c in ("g", "h")]).first()
    return [(got[2 * k], got[2 * k + 1]) for k in range(outputs)]


def descend_batches(weights: np.ndarray, bias: list[tuple[float, float]], batches, *, eta: float, lam: float, alpha: float, total: float, selector: str = "cyclic", top_k: int = 0, rng: random.Random | None = None) -> float:
    """One round of one batch after the other: the bias on all rows, then in each batch every feature once, from the weights that the batches before have left.

    bias: sums of g and h by output; batches: moments. A batch's gradients are those of the round's start, moved by the bias and
    by its own steps only. Features come in one order for all batches.
    """
    width, outputs = weights.shape[0] - 1, weights.shape[1]
    lam, alpha, before = lam * total, alpha * total, weights.copy()
    shifts = [eta * -g / h if h > 0 else 0.0 for g, h in bias]
    weights[-1] += shifts
    features = None
    for a, b in batches:
        for k, shift in enumerate(shifts):
            a[k] += b[k][:, -1] * shift
        if features is None:
            features = list(order(selector, width, a[0], b[0], weights[:, 0], alpha, lam, top_k, rng))
        for f in features:
            for k in range(outputs):
                d = eta * step(a[k][f], b[k][f, f], weights[f, k], alpha, lam)
                weights[f, k] += d
                a[k] += b[k][:, f] * d
    return float(np.abs(weights - before).max(initial=0.0))


def order(selector, width, grad, hess, w, alpha, lam, top_k, rng):
    """Features in the order that a selector draws them; greedy looks again after every step."""
    n = top_k or width
    rng = rng or random.Random(0)
    if selector == "cyclic":
        yield from range(width)
    elif selector == "shuffle":
        yield from rng.sample(range(width), width)
    elif selector == "random":
        for _ in range(width):
            yield rng.randrange(width)
    elif selector == "greedy":
        for _ in range(min(n, width)):
            best = max(range(width), key=lambda f: abs(step(grad[f], hess[f, f], w[f], alpha, lam)), default=None)
            if best is None or step(grad[best], hess[best, best], w[best], alpha, lam) == 0:
                return
            yield best
    else:  # thrifty: by the size of the first step
        yield from sorted(range(width), key=lambda f: -abs(step(grad[f], hess[f, f], w[f], alpha, lam)))[:n]
