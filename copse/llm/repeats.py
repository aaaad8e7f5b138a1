"""Exact removal of byte strings that occur twice (LENGTH bytes or more), over all documents.

Column-wise construction of the whole collection's transform takes as many rounds as the longest text
has bytes, each a pass over all files so far; see the README for why that cannot be afforded. Here the
collection is first cut down to short contexts, and those are ordered column by column:

* Anchors: every window of LENGTH bytes has its least GRAM-byte string (by hash); equal windows have it
  at the same place. About one byte in a hundred is an anchor.
* A context is what windows over an anchor can reach: REACH bytes before it to REACH bytes behind it.
  A context that occurs twice makes all its windows repeats.
* Contexts that occur once, in anchor classes that hold others, are ordered by insertion of one symbol
  of every context per round, outward from the anchor: round l refines the classes of equal common
  prefixes of length l (reversed left sides and right sides each). A window that reaches l bytes to the
  left is a repeat if another context shares its left class of l and its right class of REACH - l.

Classes of over BIG contexts are not ordered in one task; their windows are hashed and counted by a
distributed aggregation instead. Work is on anchors and contexts; the texts themselves move only in
the joins that fetch contexts and apply the result, and not even there while the other side is small.

Defined results: a null text is empty; texts of under LENGTH bytes keep all; documents are told apart
by doc_id (null is one) and text, and rows that repeat both count as two documents and lose every
window; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dup import mix64, powers
from .passages import shared_passages

LENGTH, GRAM = 400, 200
REACH = LENGTH - GRAM
BIG = 50_000
#: Elements of lists, or classes, up to which the other side of a join is broadcast (some 30 bytes each).
SMALL = 2_000_000
SEGMENT = 1 << 20
#: Contexts ordered at a time.
BATCH = 8_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_U64 = np.iinfo(np.uint64).max


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sliding(values: np.ndarray, width: int, ufunc, fill) -> np.ndarray:
    """ufunc (minimum or maximum) over every stretch of width values, in two running passes."""
    blocks = -(-len(values) // width)
    held = np.full(blocks * width, fill, np.uint64)
    held[: len(values)] = values
    held = held.reshape(blocks, width)
    ahead = ufunc.accumulate(held, axis=1).ravel()
    back = ufunc.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return ufunc(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up, self.down = powers(_BASE, SEGMENT + length), powers(_INVERSE, SEGMENT + length)

    def segment(self, data: bytes) -> np.ndarray:
        b, k = np.frombuffer(data, np.uint8), self.gram
        n, width = len(b), self.length - self.gram + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * self.up[:n], out=total[1:])
        value = mix64((total[k:] - total[:-k]) * self.down[: n - k + 1])
        least = sliding(value, width, np.minimum, _U64)
        # A place is an anchor if it holds the minimum of any window over it.
        edge = np.zeros(width - 1, np.uint64)
        most = sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0)
        return np.flatnonzero(most == value)

    def places(self, data: bytes) -> list[int]:
        found: list[int] = []
        for at in range(0, len(data) - self.length + 1, SEGMENT):
            new = (self.segment(data[at : at + SEGMENT + self.length - 1]) + at).tolist()
            if found:
                new = [p for p in new if p > found[-1]] if new and new[0] > found[-1] else sorted(set(found) | set(new))[len(found) :]
            found += new
        return found


PLACES = "k bigint, c bigint, doc bigint, h bigint, pos int, hi int"


def anchor_table(docs: DataFrame) -> DataFrame:
    """An anchor a row: k (hash of its gram), c (of its context), its place, and where its context ends."""
    schema = common.arrow_schema(PLACES)

    def make():
        anchors, digest = Anchors(), xxhash.xxh3_64_intdigest

        def step(batch):
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), [[], [], [], [], [], []]
                for doc, h, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.utf8(part, "text"), strict=True):
                    for p in anchors.places(data):
                        hi = min(len(data), p + LENGTH)
                        left = min(p, REACH)
                        row = (signed(digest(data[p : p + GRAM])), signed(digest(data[p - left : hi], left)), doc, h, p, hi)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(docs, make, PLACES)


def dense(keys: np.ndarray) -> np.ndarray:
    """Class numbers in order of the keys."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    number = np.zeros(len(keys), np.int64)
    number[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
    return number


def columns_of(parts: list[bytes]) -> np.ndarray:
    """Symbols by (column, context), 256 where a text ends."""
    out = np.full((len(parts), REACH), 256, np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T)


def repeated_windows(classes: np.ndarray, left: list[bytes], right: list[bytes], known: np.ndarray) -> np.ndarray:
    """Whether the window that reaches l bytes to the left repeats, by (context, l = 0..REACH).

    left: reversed, nearest byte first. known: contexts that occur more than once.
    """
    n = len(classes)
    lengths_left, lengths_right = np.array([*map(len, left)]), np.array([*map(len, right)])
    sides = []
    for symbols in (columns_of(left), columns_of(right)):
        number = dense(classes)
        rounds = np.zeros((REACH + 1, n), np.int32)
        rounds[0] = number
        for column in range(REACH):  # insert a symbol of every context
            number = dense(number * 257 + symbols[column])
            rounds[column + 1] = number
        sides.append(rounds)
    out = np.zeros((n, REACH + 1), bool)
    for reach in range(REACH + 1):
        whole = np.flatnonzero((lengths_left >= reach) & (lengths_right >= REACH - reach))
        if not len(whole):
            continue
        keys = sides[0][reach][whole].astype(np.int64) * n + sides[1][REACH - reach][whole]
        order = np.argsort(keys, kind="stable")
        held = keys[order]
        same = held[1:] == held[:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out[whole, reach] = twice | known[whole]
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(a, b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


CONTEXTS = "k bigint, g bigint, n bigint, m bigint, doc bigint, h bigint, pos int, lhs binary, rhs binary"
COVERS = "doc bigint, h bigint, lo int, hi int"


def context_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The two sides of every wanted context. wanted: doc, h, k, n (its occurrences), m (its class's contexts), pos."""
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("k", "n", "m", "pos")).alias("asked"))
    lists = common.materialise(lists.toDF("d", "i", "asked"), "asked")
    on = common.same(F.col("doc"), F.col("d")) & (F.col("h") == F.col("i"))
    rows = common.join_small(docs, lists, on, most=SMALL, weigh=F.sum(F.size("asked") + 1)).select("doc", "h", "text", "asked")
    schema = common.arrow_schema(CONTEXTS)

    def make():
        def step(batch):
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for doc, h, data, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.utf8(part, "text"), part.column(3).to_pylist(), strict=True):
                    for a in asked:
                        p = a["pos"]
                        lhs, rhs = data[max(0, p - REACH) : p][::-1], data[p + GRAM : p + LENGTH]
                        out.append((a["k"], signed(xxhash.xxh3_64_intdigest(data[p : p + GRAM], 1)), a["n"], a["m"], doc, h, p, lhs, rhs))
                columns = zip(*out, strict=True) if out else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(rows, make, CONTEXTS)


def ordered_covers(contexts: DataFrame) -> DataFrame:
    """Stretches of repeated windows of contexts that occur once, by ordering whole classes."""
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contexts.select("k", "g", "n", "doc", "h", "pos", "lhs", "rhs").repartition(n, "k").sortWithinPartitions("k", "g")
    schema = common.arrow_schema(COVERS)

    def solve(held):
        keys = [(r[0], r[1]) for r in held]
        classes = np.cumsum([0] + [a != b for a, b in zip(keys, keys[1:], strict=False)])
        known = np.array([r[2] > 1 for r in held])
        flags = repeated_windows(classes, [r[6] for r in held], [r[7] for r in held], known)
        out = [[], [], [], []]
        for i in np.flatnonzero(flags.any(axis=1) & ~known):
            _, _, _, doc, h, pos, _, _ = held[i]
            for a, b in runs(flags[i]):
                for column, value in zip(out, (doc, h, pos - b, pos - a + LENGTH), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches):
        held = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= BATCH:
                last = held[-1][:2]  # its class may go on
                cut = len(held)
                while cut and held[cut - 1][:2] == last:
                    cut -= 1
                if cut:
                    yield solve(held[:cut])
                    held = held[cut:]
        if held:
            yield solve(held)

    return rows.mapInArrow(run, COVERS)


WINDOWS = "w binary, n bigint, doc bigint, h bigint, lo int"


def counted_covers(contexts: DataFrame) -> DataFrame:
    """The same by counting hashed windows, for classes that no task should hold."""
    schema = common.arrow_schema(WINDOWS)

    def make():
        def step(batch):
            for at in range(0, batch.num_rows, 64):
                out = [[], [], [], [], []]
                for k, g, n, _, doc, h, pos, lhs, rhs in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    side = lhs[::-1]
                    for reach in range(max(0, REACH - len(rhs)), min(REACH, len(lhs)) + 1):
                        own = b"%d,%d,%d," % (k, g, reach) + side[len(side) - reach :] + rhs[: REACH - reach]
                        for column, value in zip(out, (xxhash.xxh3_128_digest(own), n, doc, h, pos - reach), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        return step

    windows = common.materialise(common.map_batches(contexts, make, WINDOWS), "windows")
    twice = common.materialise(windows.groupBy("w").agg(F.sum("n").alias("s")).where("s > 1").select(F.col("w").alias("v")), "twice")
    return windows.join(twice, F.col("w") == F.col("v")).where("n = 1").select("doc", "h", "lo", (F.col("lo") + LENGTH).alias("hi"))


def merged(pairs) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def covers(docs: DataFrame, big: int = BIG) -> DataFrame:
    """d, i (a document's doc_id and text hash) and its repeated stretches as flat pairs. docs: doc, h, text."""
    table = common.materialise(anchor_table(docs), "anchors")
    again = common.materialise(table.groupBy("k").count().where("count > 1").select("k"), "again")
    table = common.materialise(common.join_small(table, again, "k", most=SMALL), "places")
    contexts = table.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "pos")).alias("at"))
    contexts = common.materialise(contexts, "contexts")
    twice = common.materialise(contexts.where("n > 1").select(F.col("k").alias("k2"), F.col("c").alias("c2")), "twice")
    whole = table.join(twice, (F.col("k") == F.col("k2")) & (F.col("c") == F.col("c2")))
    whole = whole.select("doc", "h", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("lo"), "hi").where(F.col("hi") - F.col("lo") >= LENGTH)
    # Only classes with a context that occurs once, beside others, are left to be ordered.
    kinds = contexts.groupBy("k").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select(F.col("k").alias("k3"), "m")
    kinds = common.materialise(kinds, "kinds")
    wanted = contexts.join(kinds, F.col("k") == F.col("k3")).select("at.*", "k", "n", "m")
    sides = common.materialise(context_table(docs, wanted), "sides")
    found = whole.unionByName(ordered_covers(sides.where(F.col("m") <= big)))
    if kinds.where(F.col("m") > big).limit(1).count():
        found = found.unionByName(counted_covers(sides.where(F.col("m") > big)))
    lists = found.groupBy("doc", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    ddl = "d bigint, i bigint, stretches array<int>"
    schema = common.arrow_schema(ddl)

    def make():
        def step(batch):
            flat = [[x for pair in merged((p["lo"], p["hi"]) for p in s) for x in pair] for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, schema.field(2).type)], schema=schema)

        return step

    return common.map_batches(lists, make, ddl)


def with_stretches(docs: DataFrame, doc_id: str, text: str, big: int = BIG) -> DataFrame:
    """docs with `stretches` (null: nothing repeats) and `n_shared` (null: none) for each row."""
    h = F.xxhash64(common.text_or_empty(text))
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc"), h.alias("h"), common.text_or_empty(text).alias("text"))
    found = covers(plain, big).unionByName(shared_passages(plain), allowMissingColumns=True)
    found = common.materialise(found.groupBy("d", "i").agg(F.max("stretches").alias("stretches"), F.max("n_shared").alias("n_shared")), "stretches")
    on = common.same(F.col(doc_id).cast("bigint"), F.col("d")) & (h == F.col("i"))
    return common.join_small(docs, found, on, "left", most=SMALL, weigh=F.sum(F.coalesce(F.size("stretches"), F.lit(0)) + 1)).drop("d", "i")


def without(data: bytes, stretches) -> bytes:
    parts, at = [], 0
    for lo, hi in zip(stretches[::2], stretches[1::2], strict=True):
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint"


def removed(docs: DataFrame, big: int = BIG) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and n_shared: its word passages that other documents hold (passages.py)."""
    joined = with_stretches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")), "doc_id", "text", big)
    schema = common.arrow_schema(REMOVED)

    def make():
        def step(batch):
            out = []
            for doc, data, stretches, shared in zip(batch.column(0).to_pylist(), common.utf8(batch, "text"), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                left = without(data, stretches or [])
                out.append((doc, len(data), len(data) - len(left), len(stretches or []) // 2, hashlib.sha256(left).hexdigest(), shared or 0))
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(joined.select("doc_id", "text", "stretches", "n_shared"), make, REMOVED)
