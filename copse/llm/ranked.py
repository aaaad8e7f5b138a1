"""Ranked lexical search over all documents: Block-Max WAND on an inverted index in shards of documents.

Index. A task numbers the documents that it reads and closes a shard when it holds MOST_POSTINGS; a
shard's postings never leave the task that read its texts, so building moves nothing between
executors. A posting list is cut into blocks of BLOCK documents. A block keeps its first and last
document, the largest share of a score that one of its documents brings (its maximum impact), and its
document gaps and counts in the fewest bytes that hold them. Impacts depend on the corpus's number of
documents and of terms, which one aggregation counts first.

Search. The lists of a block of items' terms meet by shard. There, the shallow pointers of all terms move
over the merged block boundaries: between two boundaries each term stands on one block (or between
blocks), and the sum of the blocks' maxima bounds every score. Stretches whose bound is below
the tenth best score so far are skipped and their blocks stay compressed; of the others the most promising come
first, so that the threshold rises early. A task keeps an item's best documents from shard to shard.
The pivot of the textbook loop, the first document whose terms' maxima can reach the threshold, is
found here for all stretches at once, in arrays.

Defined results: a null or wordless text is no document (it has no terms) and is never returned; rows
with equal doc_id are documents of their own, and a null doc_id comes after all others of equal score;
an item without terms, and a null item text, return nothing; items are rows, so items of equal item_id
are ranked separately (with equal results); an empty table gives an empty result. A very long text is
one document of its shard, which may then hold more postings than MOST_POSTINGS.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 128
#: Postings and documents after which a shard is closed.
MOST_POSTINGS, MOST_DOCS = 2_000_000, 65_536
#: Terms (with those of other items again) of the items that are searched together; they are broadcast.
MOST_TERMS = 1_000_000
TOP = 10
INDEX = "shard string, term binary, df int, firsts binary, lasts binary, maxima binary, ends binary, payload binary"
FOUND = "item int, doc_id bigint, score bigint"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a term stand for themselves, capitals for small letters, all others for a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a document's score, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    if total == 0 or 75 * int(n.max(initial=0)) * docs < 1 << 63:
        return 25 + 75 * n * docs // max(total, 1)
    return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)


# ---- blocks


def widths_of(largest: np.ndarray) -> np.ndarray:
    """Bytes (1, 2 or 4) that hold numbers up to `largest`."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.int64)


def packed(values: np.ndarray, block: np.ndarray, starts: np.ndarray, widths: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each block's values, in its width, at its place in out."""
    own = at[block] + (np.arange(len(values)) - starts[block]) * widths[block]
    for byte in range(int(widths.max(initial=0))):
        rows = widths[block] > byte
        out[own[rows] + byte] = values[rows] >> (8 * byte) & 255


def encode(ids: np.ndarray, docs: np.ndarray, tf: np.ndarray, u: np.ndarray, terms: int, size: int = BLOCK):
    """Lists by term id (postings sorted by term and document): df, and by block first, last, maximum, end of its bytes; offsets of blocks and bytes."""
    df = np.bincount(ids, minlength=terms)
    begin = np.concatenate([[0], np.cumsum(df)])
    blocks_of = -(-df // size)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    block = first_block[ids] + (np.arange(len(ids)) - begin[ids]) // size
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(block))
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = 0  # a block's first document stands beside it
    maxima = np.maximum.reduceat(u, starts)
    wide, wide_tf = widths_of(np.maximum.reduceat(gaps, starts)), widths_of(np.maximum.reduceat(tf, starts))
    sizes = 1 + (ends - starts) * (wide + wide_tf)
    place = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(place[-1]), np.uint8)
    out[place[:-1]] = wide | wide_tf << 4
    packed(gaps, block, starts, wide, place[:-1] + 1, out)
    packed(tf, block, starts, wide_tf, place[:-1] + 1 + (ends - starts) * wide, out)
    return df, first_block, docs[starts], docs[ends - 1], maxima, place, out


def decode(block: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of one block's bytes."""
    wide, wide_tf = int(block[0]) & 15, int(block[0]) >> 4
    n = (len(block) - 1) // (wide + wide_tf)
    docs = first + np.cumsum(block[1 : 1 + n * wide].view(f"<u{wide}").astype(np.int64))
    return docs, block[1 + n * wide :].view(f"<u{wide_tf}").astype(np.int64)


def ragged(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    size = data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class Shard:
    """The postings of the documents read so far."""

    def __init__(self, block: int = BLOCK):
        self.block, self.numbers = block, dict[bytes, int]()
        self.ids, self.tf, self.per_doc, self.n, self.doc_ids = [], [], [], [], []

    def add(self, doc_id, text: bytes) -> None:
        counts = Counter(terms_of(text))
        if not counts:
            return
        numbers = self.numbers
        self.ids += [numbers.setdefault(t, len(numbers)) for t in counts]
        self.tf += counts.values()
        self.per_doc.append(len(counts))
        self.n.append(counts.total())
        self.doc_ids.append(doc_id)

    def full(self, postings: int, docs: int) -> bool:
        return len(self.ids) >= postings or len(self.n) >= docs

    def rows(self, name: str, docs: int, total: int) -> pa.RecordBatch:
        """A row for each term, and one without a term for the documents: their ids in lasts, their sizes in maxima."""
        ids, tf, n = np.array(self.ids, np.int64), np.array(self.tf, np.int64), np.array(self.n, np.int64)
        doc = np.repeat(np.arange(len(n)), self.per_doc)
        order = np.argsort(ids, kind="stable")
        ids, tf, doc = ids[order], tf[order], doc[order]
        df, at, firsts, lasts, maxima, ends, payload = encode(ids, doc, tf, impact(tf, norm(n, docs, total)[doc]), len(self.numbers), self.block)
        rel = ends[1:] - np.repeat(ends[at[:-1]], np.diff(at))
        lists = [ragged(x.astype("<i4"), at) for x in (firsts, lasts)] + [ragged(maxima.astype("<i8"), at), ragged(rel.astype("<i4"), at), ragged(payload, ends[at])]
        known = np.array([x is not None for x in self.doc_ids])
        own = [np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(), n.astype("<i8").tobytes(), known.tobytes()]
        own = [pa.array([x], pa.binary()) for x in (b"", own[0], own[1], own[2], b"")]
        columns = [pa.array([name] * (len(df) + 1)), pa.array([None, *self.numbers], pa.binary()), pa.array([len(n), *df.tolist()], pa.int32()), *(pa.concat_arrays([a, b]) for a, b in zip(own, lists, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INDEX.split(", ")])


# ---- index


@dataclass
class Index:
    """rows: INDEX; docs, total: documents with terms and their terms with repeats."""

    rows: DataFrame
    docs: int
    total: int


def term_counts(docs: DataFrame) -> DataFrame:
    """docs, terms: a batch's documents with terms and their terms with repeats, by the splitting that the index uses."""

    def make():
        def step(batch):
            sizes = [len(terms_of(text)) for text in common.utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["docs", "terms"])

        return step

    return common.map_batches(docs.select("text"), make, "docs bigint, terms bigint")


def build_index(docs: DataFrame, block: int = BLOCK, most_postings: int = MOST_POSTINGS, most_docs: int = MOST_DOCS) -> Index:
    """Index every row of docs (doc_id, text), in tables of the shared folder."""
    n, total = term_counts(docs).agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches):
        from pyspark import TaskContext

        part, number, shard = TaskContext.get().partitionId(), 0, Shard(block)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.utf8(batch, "text"), strict=True):
                shard.add(doc_id, text)
                if shard.full(most_postings, most_docs):
                    yield shard.rows(f"{part}-{number}", n, total)
                    number, shard = number + 1, Shard(block)
        if shard.n:
            yield shard.rows(f"{part}-{number}", n, total)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, INDEX)
    return Index(common.materialise(rows, "index"), n, total)


# ---- search


class Lists:
    """One shard's lists of the terms at hand. Decoded blocks are kept for the items that come after."""

    def __init__(self):
        self.lists: dict[bytes, tuple] = {}
        self.decoded: dict[bytes, dict[int, tuple]] = {}
        self.blocks_read = 0

    def documents(self, ids: bytes, sizes: bytes, known: bytes, docs: int, total: int) -> None:
        self.doc_ids, self.known = np.frombuffer(ids, "<i8"), np.frombuffer(known, bool)
        self.m = norm(np.frombuffer(sizes, "<i8"), docs, total)

    def add(self, term: bytes, firsts, lasts, maxima, ends, payload) -> None:
        self.lists[term] = (np.frombuffer(firsts, "<i4").astype(np.int64), np.frombuffer(lasts, "<i4").astype(np.int64), np.frombuffer(maxima, "<i8"), np.frombuffer(ends, "<i4"), np.frombuffer(payload, np.uint8))
        self.decoded[term] = {}

    def block(self, term: bytes, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        held = self.decoded[term]
        if i not in held:
            firsts, _, _, ends, payload = self.lists[term]
            docs, tf = decode(payload[ends[i - 1] if i else 0 : ends[i]], int(firsts[i]))
            held[i] = docs, impact(tf, self.m[docs])
            self.blocks_read += 1
        return held[i]


def best_documents(shard: Lists, weights: list[tuple[bytes, int]], top: int, held: list) -> list:
    """The `top` best (score, order, doc_id) of held and the shard's documents. weights: by term, times its repeats in the item."""
    weights = [(t, w) for t, w in weights if t in shard.lists and w > 0]
    if not weights:
        return held
    # The shallow pointers: at each stretch between block boundaries, where each term's pointer stands.
    edges = np.unique(np.concatenate([x for t, _ in weights for x in (shard.lists[t][0], shard.lists[t][1] + 1)]))
    begins = edges[:-1]
    bound, stands = np.zeros(len(begins), np.int64), []
    for t, w in weights:
        firsts, lasts, maxima, _, _ = shard.lists[t]
        at = np.searchsorted(lasts, begins)
        on = (at < len(lasts)) & (firsts[np.minimum(at, len(lasts) - 1)] <= begins)
        at = np.where(on, at, -1)
        bound += np.where(on, w * maxima[at], 0)
        stands.append(at)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    done, step = 0, 8
    scores, mask = np.zeros(len(shard.doc_ids), np.int64), np.zeros(len(shard.doc_ids) + 1, bool)
    while done < len(order):
        take = order[done : done + step]
        if len(held) >= top:
            take = take[bound[take] >= held[0][0]]  # of equal score, the smaller doc_id may still win
            if not len(take):
                break
        turn = np.zeros(len(mask), np.int64)
        np.add.at(turn, begins[take], 1)
        np.add.at(turn, edges[take + 1], -1)
        mask = np.cumsum(turn) > 0
        for (t, w), at in zip(weights, stands, strict=True):
            need = np.unique(at[take])
            for i in need[need >= 0].tolist():
                docs, u = shard.block(t, i)
                inside = mask[docs]
                scores[docs[inside]] += w * u[inside]
        rows = np.flatnonzero(mask[:-1] & (scores > 0))
        if len(held) >= top:
            rows = rows[scores[rows] >= held[0][0]]
        elif len(rows) > 4 * top:
            rows = rows[scores[rows] >= np.partition(scores[rows], -top)[-top]]
        for r in rows.tolist():
            # A heap with the worst on top: low score, and of equal scores the larger doc_id, null the largest.
            entry = (int(scores[r]), (bool(shard.known[r]), -int(shard.doc_ids[r])))
            if len(held) < top:
                heapq.heappush(held, entry)
            elif entry > held[0]:
                heapq.heapreplace(held, entry)
        done, step = done + step, 2 * step
    return held


def search_block(index: Index, items: list[tuple[int, Counter]], top: int) -> DataFrame:
    """The best documents of the items at hand (item number, terms): FOUND, at most `top` rows an item and task."""
    spark = index.rows.sparkSession
    wanted = spark.createDataFrame([(t,) for t in {t for _, c in items for t in c}], "term binary")  # at most MOST_TERMS, or one item's
    held = index.rows.join(F.broadcast(wanted), "term", "left_semi")
    df = {bytes(r["term"]): r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * d + 1))) for t, d in df.items()}
    plans = spark.sparkContext.broadcast([(i, [(t, n * weight[t]) for t, n in sorted(c.items()) if t in weight]) for i, c in items])
    docs, total = index.docs, index.total
    shards = index.rows.where("term IS NULL").unionByName(held)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.repartition(n, "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())

    def run(batches):
        best: dict[int, list] = {}
        at, lists = None, None

        def solve():
            for i, weights in plans.value:
                best[i] = best_documents(lists, weights, top, best.get(i, []))

        for batch in batches:
            for shard, term, _, firsts, lasts, maxima, ends, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if lists:
                        solve()
                    at, lists = shard, Lists()
                if term is None:
                    lists.documents(lasts, maxima, ends, docs, total)
                else:
                    lists.add(term, firsts, lasts, maxima, ends, payload)
        if lists:
            solve()
        out = [(i, -key if known else None, score) for i, held in best.items() for score, (known, key) in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return shards.select(*[x.split()[0] for x in INDEX.split(", ")]).mapInArrow(run, FOUND)


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each row of items (item_id, text) against all documents.

    Items are searched together up to MOST_TERMS terms; more of them go in further blocks.
    """
    from pyspark.sql.window import Window as W

    spark = items.sparkSession
    words = F.regexp_count("text", F.lit(WORD))
    asked = items.select("item_id", "text", words.alias("n")).where("n > 0")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // MOST_TERMS) or 1
    if blocks > 1:  # rows that are the same in every pass
        asked = common.materialise(asked, "items")
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        own = [(i, Counter(terms_of(r["text"].encode()))) for i, r in enumerate(rows)]
        if not own:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        got = search_block(index, own, top).withColumn("rank", place).where(F.col("rank") <= top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build_index(docs), items)


_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS t FROM documents),
n AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS nd, coalesce(sum(n), 0)::BIGINT AS total FROM n),
p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS w FROM d) GROUP BY r, w),
f AS (SELECT w, floor(1000 * ln((2 * (SELECT nd FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p GROUP BY w),
q AS (SELECT i, item_id, w, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS.format('text')}) AS w FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // total))))::BIGINT AS score
  FROM q JOIN p USING (w) JOIN f USING (w) JOIN n USING (r), g GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
