"""Documents that share passages of WORDS words or more, whatever white space stands between them.

* Anchors: every window of WORDS words has its least GRAM-word string (by hash); equal windows have it at
  the same place. Anchor strings that one document alone holds are told apart by a first count.
* A context is an anchor with the REACH words before and behind it. A context that two documents hold is
  a shared passage as it stands. Of contexts that share an anchor only, each of the REACH + 1 windows
  around the anchor is a key, and equal keys of different contexts are shared passages.

Passages that repeat inside one document alone do not count. A word of the surroundings is compared by 16 bits
of its hash, an anchor by 64. Defined results: a null text is empty; texts of under WORDS words share
nothing; rows that repeat doc_id and text are documents of their own; an empty table gives no rows; very
long texts are anchored in segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dup import Hasher, chunks, mix64, powers

WORDS, GRAM = 51, 40
REACH = WORDS - GRAM
SEGMENT = 1 << 18
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class WordAnchors:
    def __init__(self):
        self.hasher = Hasher()
        self.up, self.down = powers(_BASE, SEGMENT + WORDS), powers(_INVERSE, SEGMENT + WORDS)

    def words(self, text: bytes) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(self.hasher.words(c)[1] for c in chunks(text))])

    def segment(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .repeats import sliding

        n, width = len(w), REACH + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(w * self.up[:n], out=total[1:])
        value = mix64((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        least = sliding(value, width, np.minimum, np.iinfo(np.uint64).max)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == value)
        return at, value[at]

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the anchors."""
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(w) - WORDS + 1, SEGMENT):
            p, k = self.segment(w[at : at + SEGMENT + WORDS - 1])
            places.append(p + at)
            keys.append(k)
        p, first = np.unique(np.concatenate(places), return_index=True)
        return p, np.concatenate(keys)[first]


def anchor_keys(docs: DataFrame) -> DataFrame:
    """keys: the different anchor keys of each document."""

    def make():
        anchors = WordAnchors()

        def step(batch):
            for at in range(0, batch.num_rows, 512):
                keys = [np.unique(anchors.find(anchors.words(t))[1]).view(np.int64) for t in common.utf8(batch.slice(at, 512), "text")]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                yield pa.RecordBatch.from_arrays([flat.cast(pa.list_(pa.int64()))], names=["keys"])

        return step

    return common.map_batches(docs.select("text"), make, "keys array<bigint>")


CONTEXTS = "k bigint, c bigint, lhs binary, rhs binary, doc bigint, h bigint, r bigint"


def contexts(docs: DataFrame, shared: common.Seen) -> DataFrame:
    """Each document's different contexts of anchors that others hold too: nearest words first, two bytes a word. docs: doc, h, text."""
    schema = common.arrow_schema(CONTEXTS)

    def make():
        anchors, row = WordAnchors(), TaskContext.get().partitionId() << 40

        def step(batch):
            nonlocal row
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), [[] for _ in schema]
                for doc, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.utf8(part, "text"), strict=True):
                    w = anchors.words(text)
                    places, keys = anchors.find(w)
                    ok = shared.has(keys)
                    low, seen = w.astype("<u2").tobytes(), set()
                    for p, k in zip(places[ok].tolist(), keys[ok].view(np.int64).tolist(), strict=True):
                        a, b = max(0, p - REACH), p + GRAM
                        rhs = low[2 * b : 2 * (b + REACH)]
                        lhs = b"".join(low[2 * i : 2 * i + 2] for i in range(p - 1, a - 1, -1))
                        c = xxhash.xxh3_64_intdigest(lhs + b"|" + rhs, k & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                        if c not in seen:
                            seen.add(c)
                            for column, value in zip(out, (k, c, lhs, rhs, doc, h, row), strict=True):
                                column.append(value)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(docs, make, CONTEXTS)


def shared_passages(docs: DataFrame) -> DataFrame:
    """d, i (a document's doc_id and text hash) and n_shared, its different anchored passages that other documents hold. docs: doc, h, text."""
    counted = anchor_keys(docs).select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1")
    shared = common.Seen(common.materialise(counted, "anchors"), 2)
    rows = common.materialise(contexts(docs, shared), "contexts")
    whole = (F.length("lhs") + F.length("rhs")) / 2 >= REACH
    sides = [F.first(x).alias(x) for x in ("lhs", "rhs")]
    each = rows.where(whole).groupBy("k", "c").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), *sides)
    each = common.materialise(each, "each")
    several = common.materialise(each.groupBy("k").agg(F.count("*").alias("m"), F.max(F.col("lo") == F.col("hi")).alias("alone")).where("m > 1 AND alone").select(F.col("k").alias("k2")), "several")
    # The windows around an anchor that two contexts share: l words before it, the rest behind it.
    windows = common.join_small(each, several, F.col("k") == F.col("k2")).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(REACH))))
    windows = windows.where((F.length("lhs") >= 2 * F.col("l")) & (F.length("rhs") >= 2 * (REACH - F.col("l"))))
    key = F.xxhash64("k", "l", F.substring(F.col("lhs"), F.lit(1), 2 * F.col("l")), F.substring(F.col("rhs"), F.lit(1), 2 * (REACH - F.col("l"))))
    windows = common.materialise(windows.select("c", "lo", "hi", key.alias("w")), "windows")
    twice = common.materialise(windows.groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(F.col("w").alias("v")), "twice")
    found = common.join_small(windows, twice, F.col("w") == F.col("v")).select("c").union(each.where("lo <> hi").select("c")).distinct()
    found = common.materialise(found.toDF("c2"), "found")
    return common.join_small(rows, found, F.col("c") == F.col("c2")).groupBy("doc", "h").agg(F.count_distinct("c").alias("n_shared")).toDF("d", "i", "n_shared")
