"""Best-fit decreasing packing of token sequences, planned on lengths and applied to rows.

Best-fit decreasing looks only at lengths, and there are at most `capacity` of them. The plan is
therefore made on the driver from the histogram of lengths: bins with equal remaining capacity form
classes of bin-number intervals, and a segment tree over remaining capacities finds the tightest
class that holds a length in logarithmic time. A whole interval is filled in one step, since best fit
puts equal lengths into the bin just used for as long as they fit. The plan's size depends on the
number of lengths, not of rows. Each row then finds its place by its rank among rows of its length;
ranks come from counts by (length, salt) and a window inside one of those, so a length that a third
of all rows has is spread over all tasks.

Defined results: a null or empty text is one piece of one token (the end mark); repeated rows are
packed as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

CAPACITY = 2048
END = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Cached chunks of a tokenizer; the cache starts anew when it is full.
CACHE = 200_000


def special_tokens(path: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


class Encoder:
    """Ids of a byte-level BPE vocabulary, equal to those of its tokenizers file, as little-endian unsigned 32-bit numbers.

    The ids of a text are those of its chunks between single spaces, which the pre-tokenizer never
    joins; chunks recur, so they are cached. A text with special tokens or with white space other
    than single spaces at chunk borders goes whole to the library.
    """

    def __init__(self, path: str, special: list[str]):
        self.path = path
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[str, bytes] = {}
        self.fast = self._ranked(path)

    @cached_property
    def tokenizer(self):
        """The library, which few texts need where there is a faster one: some 30 MB of each worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary in a faster library where its file lies beside; None elsewhere."""
        import base64
        import os

        import tiktoken

        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks == path or not os.path.exists(ranks):
            return None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The pattern of byte-level pre-tokenizers, fixed by the vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.fast is None or (self.special and self.special.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return self.whole(text)
        chunks = text.split(" ")
        cache = self.cache
        first = chunks[0]
        if not first or first[-1].isspace():
            return self.whole(text)
        ids = [self.whole(first)]
        for chunk in chunks[1:]:
            got = cache.get(chunk)
            if got is None:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return self.whole(text)
                got = self.whole(" " + chunk)
                if len(chunk) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[chunk] = got
            ids.append(got)
        return b"".join(ids)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    schema, special = common.arrow_schema(PIECES), special_tokens(tokenizer)

    def make():
        encoder = Encoder(tokenizer, special)
        end_mark = struct.pack("<I", END)

        def step(batch):
            out = [[], [], [], [], []]
            for part in common.parts(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end_mark
                    n, start = len(ids) // 4, 0
                    head = n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        end = head + piece * capacity
                        for column, value in zip(out, (doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                            column.append(value)
                        start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text")), make, PIECES)


class Open:
    """A segment tree over remaining capacities: which have open bins, and the least that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)

    def put(self, at: int, there: bool) -> None:
        i = at + self.size
        self.tree[i] = there
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def least(self, at: int) -> int | None:
        """The least capacity >= at with an open bin."""
        i = at + self.size
        if self.tree[i]:
            return at
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.tree[2 * i])
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, lo, hi, sequence, each, offset): the items of that length with ranks lo..hi-1 go
    to the bins from `sequence` on, `each` to a bin, the first of a bin at `offset`.
    """
    out, bins, tree = [], {}, Open(capacity)
    used = 0

    def free(left: int, start: int, n: int) -> None:
        if left:
            bins.setdefault(left, deque()).append((start, n))
            tree.put(left, True)

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            left = tree.least(length)
            if left is None:
                each = capacity // length
                start, n, left = used, -(-(count - rank) // each), capacity
                used += n
            else:
                start, n = bins[left].popleft()
                if not bins[left]:
                    tree.put(left, False)
                each = left // length
            full = min(n, (count - rank) // each)
            if full:
                out.append((length, rank, rank + full * each, start, each, capacity - left))
                rank += full * each
                free(left - each * length, start, full)
            if full < n:
                rest = count - rank
                if rest:
                    out.append((length, rank, count, start + full, each, capacity - left))
                    rank = count
                    free(left - rest * length, start + full, 1)
                    full += 1
                free(left, start + full, n - full) if full < n else None
    return out


def place(rows: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """rows (doc_id, piece, length and more) with sequence_id and offset. Reads rows more than once."""
    spark: SparkSession = rows.sparkSession
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}
    steps = spark.createDataFrame(plan(lengths, capacity), "length bigint, __lo bigint, __hi bigint, __seq bigint, __each bigint, __off bigint")
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # The steps that a (length, salt) group's ranks run through.
    own = base.join(steps, "length").where("__lo < __base + __n AND __hi > __base").drop("__n")
    ranked = salted.withColumn("__rank", F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    got = ranked.join(own, ["length", "__salt"]).where("__rank + __base >= __lo AND __rank + __base < __hi")
    at = F.col("__rank") + F.col("__base") - F.col("__lo")
    return got.select(
        *rows.columns,
        (F.col("__seq") + F.floor(at / F.col("__each"))).cast("bigint").alias("sequence_id"),
        (F.col("__off") + at % F.col("__each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document with its place. tokenizer: path of a tokenizers file."""
    return place(common.materialise(pieces(docs, tokenizer, capacity), "pieces"), capacity)
