"""Near-duplicate classes by Order MinHash and banded alignment.

Texts are sequences of words, sketched by their five-word shingles. An Order MinHash band draws the
MINIMA smallest occurrence-labelled shingles under its own hash and keys on them in text order, so that
two texts meet in a band if they share shingles and keep their order. Texts that meet are verified by
aligning their words inside the band of diagonals that a similarity of SIMILARITY allows: they are near
if the alignment holds at least that share of the longer text's words. One changed word breaks five
shingles, so edited copies that align at 0.9 often share only half of their shingles; the bands are many
enough (BANDS) to find those, and the alignment alone decides.

Equal texts are one node from the start. In each bucket a leader is drawn (the member that meets most
others) and all members are aligned with it, dealt to (leader, salt) groups of GROUP rows. Buckets whose
members still lie in several components are compared member by member while they hold at most BLOCK. The
members of larger ones are dealt anew by the rarest of their words: texts that share SIMILARITY of their
words share one of the rarest in the same order of all words (a prefix filter), so no pair is lost, and
texts that only share a common passage part. Where blocks of all these members that meet each other make
fewer rows than their rare words do, they are dealt so. Of the pairs that meet, those that cannot share
enough of their words by their sizes and a few more rare words are dropped before texts are sent. No pairs
are listed, no group is capped. Links, labels and buckets stay distributed; each round is cut by tables in
the shared folder.

Defined results: a null text is empty; texts without words are near only to equal texts; texts of
fewer than five words are near only to texts of the same words; rows that repeat doc_id and text are
copies of one another; the class id is the least doc_id of the class (null only if none has one); an
empty table gives no rows; a very long text costs its words times the band's width over 64.
"""

from __future__ import annotations

import math
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, BANDS, MINIMA, SIMILARITY = 5, 32, 3, 0.8
GROUP = 64
#: Bytes hashed at a time.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_U64 = np.iinfo(np.uint64).max


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of the words of texts, a chunk of bytes at a time."""

    def __init__(self):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up, self.down = powers(_BASE, CHUNK + 1), powers(inverse, CHUNK + 1)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = powers(_BASE, n), powers(inverse, n)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins, and its hash."""
        b = np.frombuffer(data, np.uint8)
        self.grow(len(b) + 1)
        inside = np.concatenate([[False], ~_SPACE[b], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * self.up[: len(b)], out=total[1:])
        return start, mix64((total[end] - total[start]) * self.down[start])


@cache
def hasher() -> Hasher:
    return Hasher()


def chunks(data: bytes):
    """Slices of at most about CHUNK bytes that end at white space where there is any."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut > at:
                end = cut
            else:
                after = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
                end = min(after, default=len(data))
        yield data[at:end]
        at = end


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts laid end to end, and each text's number of them."""
    number = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for j, factor in enumerate(powers(_STEP, WORDS)):
        out += padded[j : j + n] * factor
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - first[owner]
    scale = powers(_STEP, WORDS)
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        own = hashes[first[i] : first[i] + counts[i]]
        out[first[i]] = (own * scale[: len(own)]).sum()
    return mix64(out[place < number[owner]]), number


def labelled(shingle: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct within a text by the number of the occurrence."""
    owner = np.repeat(np.arange(len(number), dtype=np.uint64), number)
    key = shingle + mix64(owner)
    order = np.argsort(key, kind="stable")
    held = key[order]
    again = np.flatnonzero(held[1:] == held[:-1]) + 1
    if not len(again):
        return shingle
    out, run = shingle.copy(), np.zeros(len(key), np.uint64)
    fresh = np.ones(len(key), bool)
    fresh[again] = False
    begins = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    run[order] = (np.arange(len(key)) - begins).astype(np.uint64)
    return np.where(run > 0, mix64(out + run * _BASE), out)


def bands(shingle: np.ndarray, number: np.ndarray, count: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """Band keys (texts, count) of texts that have shingles."""
    texts = len(number)
    out = np.zeros((texts, count), np.uint64)
    if not len(shingle):
        return out
    label = labelled(shingle, number)
    starts = np.concatenate([[0], np.cumsum(number)[:-1]])
    owner = np.repeat(np.arange(texts), number)
    for t in range(count):
        m = mix64(label ^ mix64(np.array([t + 1], np.uint64)))
        at = np.full((texts, minima), len(shingle), np.int64)
        for k in range(minima):
            least = np.minimum.reduceat(m, starts)
            found = np.flatnonzero(m == least[owner])
            found = found[m[found] != _U64]
            texts_found, first = np.unique(owner[found], return_index=True)
            at[texts_found, k] = found[first]
            m[found[first]] = _U64
        at.sort(axis=1)
        value = np.concatenate([shingle, np.ones(1, np.uint64)])[at]
        key = np.full(texts, t + 1, np.uint64)
        for k in range(minima):
            key = mix64(key * _STEP + value[:, k])
        out[:, t] = key
    return out


SKETCH = "doc_id bigint, th binary, bands array<bigint>"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (a 128-bit hash of the text) and band keys of every row; no bands for texts without words."""
    schema = common.arrow_schema(SKETCH)

    def make():
        hasher = Hasher()

        def emit(ids, hashes, data, counts):
            counts = np.array(counts, np.int64)
            held = counts > 0
            shingle, number = shingles(np.concatenate(data) if data else np.zeros(0, np.uint64), counts[held])
            keys = bands(shingle, number).view(np.int64)
            rows, at = [], 0
            for has in held:
                rows.append(keys[at].tolist() if has else [])
                at += has
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(rows, schema.field(2).type)], schema=schema)

        def step(batch):
            ids, hashes, data, counts, size = [], [], [], [], 0
            rows = (row for part in common.parts(batch) for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.utf8(part, "text"), strict=True))
            for doc, th, text in rows:
                own = [hasher.words(c)[1] for c in chunks(text)]
                ids.append(doc)
                hashes.append(th)
                data += own
                counts.append(sum(map(len, own)))
                size += len(text)
                if size >= CHUNK:
                    yield emit(ids, hashes, data, counts)
                    ids, hashes, data, counts, size = [], [], [], [], 0
            if ids:
                yield emit(ids, hashes, data, counts)

        return step

    return common.map_batches(docs.select("doc_id", "th", "text"), make, SKETCH)


class Text:
    """A text as words that can be aligned with others."""

    #: Places in one block of a word's mask.
    SPAN = 1 << 13

    def __init__(self, text: bytes):
        self.text, self.words = text, text.split()

    @cached_property
    def labelled(self) -> frozenset[int]:
        """The words, each with the number of its occurrence."""
        seen: dict[bytes, int] = {}
        out = set()
        for w in self.words:
            k = seen.get(w, 0)
            seen[w] = k + 1
            out.add(hash((w, k)))
        return frozenset(out)

    @cached_property
    def labels(self) -> np.ndarray:
        """Hashes of the labelled words."""
        own = [hasher().words(c)[1] for c in chunks(self.text)]
        return labelled(np.concatenate([np.zeros(0, np.uint64), *own]), np.array([len(self.words)])).view(np.int64)

    @cached_property
    def masks(self) -> list[dict[bytes, int]]:
        """By block of SPAN places: the places of each word as bits."""
        out = []
        for at in range(0, len(self.words), self.SPAN):
            own: dict[bytes, int] = {}
            for i, w in enumerate(self.words[at : at + self.SPAN]):
                own[w] = own.get(w, 0) | 1 << i
            out.append(own)
        return out

    def near_to(self, other: Text) -> bool:
        n, m = len(self.words), len(other.words)
        if self.words == other.words:
            return n > 0
        need = math.ceil(SIMILARITY * max(n, m) - 1e-9)
        if min(n, m) < max(need, WORDS) or len(self.labelled & other.labelled) < need:
            return False
        return self.aligned(other.words, need) >= need

    def aligned(self, other: list[bytes], need: int) -> int:
        """The longest alignment with other among those that leave the band of `need` aligned words nowhere.

        An alignment of `need` words skips at most n - need of the own and m - need of the other ones, so
        word j of the other meets own places j - back to j + ahead only. The bits are those of that
        window; it moves up by one place a word, and bits that leave it are final.
        """
        n, m = len(self.words), len(other)
        back, ahead = m - need, n - need
        width = back + ahead + 1
        full, top = (1 << width) - 1, 1 << (width - 1)
        masks, span = self.masks, self.SPAN
        first = masks[0] if len(masks) == 1 else None
        row, steps = full, 0  # a zero bit is a step of the alignment
        for j, w in enumerate(other):
            low = j - back
            if first is not None:
                mask = first.get(w)
                hits = 0 if mask is None else mask >> low if low >= 0 else mask << -low
            else:
                hits = 0
                for block in range(max(low, 0) // span, min(len(masks), (low + width - 1) // span + 1)):
                    mask = masks[block].get(w)
                    if mask is not None:
                        shift = block * span - low
                        hits |= mask << shift if shift >= 0 else mask >> -shift
            u = row & hits & full
            if u:
                row = ((row + u) | (row - u)) & full
            steps += not row & 1
            row = row >> 1 | top
        return steps + width - row.bit_count()


#: Items counted at a time, and columns of a table of which sets hold which.
ITEMS, COLUMNS = 1 << 20, 1 << 12


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each left set shares with each right one; items are counted in turns of about ITEMS."""
    both, n = left + right, len(left)
    out = np.zeros((n, len(right)), np.float32)
    turns = -(-sum(map(len, both)) // ITEMS)
    for turn in range(turns):
        own = [x if turns == 1 else x[x % turns == turn] for x in both]
        owner = np.repeat(np.arange(len(both)), [len(x) for x in own])
        values, column = np.unique(np.concatenate(own), return_inverse=True)
        held = np.zeros((2, len(values)), bool)
        held[(owner >= n).astype(int), column] = True
        meets = held.all(axis=0)
        keep = meets[column]
        owner, column, width = owner[keep], (np.cumsum(meets) - 1)[column[keep]], int(meets.sum())
        for at in range(0, width, COLUMNS):
            some = (column >= at) & (column < at + COLUMNS)
            cells = np.zeros((len(both), min(COLUMNS, width - at)), np.float32)
            cells[owner[some], column[some] - at] = 1
            out += cells[:n] @ cells[n:].T
    return out


def candidates(left: list[Text], right: list[Text]) -> np.ndarray:
    """Whether a left and a right text share as many labelled words as near texts do."""
    size = [np.array([len(t.words) for t in x]) for x in (left, right)]
    need = np.ceil(SIMILARITY * np.maximum.outer(*size) - 1e-9)
    return shared([t.labels for t in left], [t.labels for t in right]) >= np.maximum(need, 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b: a's leader) that align. texts: th, text."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    sizes = common.materialise(sizes.withColumnRenamed("b", "leader"), "leaders")
    dealt = common.join_small(pairs, sizes, F.col("b") == F.col("leader")).drop("leader")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).select(F.col("b").alias("leader"), "salt", F.col("a").alias("th"), F.lit(1).alias("kind"))
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("th"), F.lit(0).alias("kind"))
    rows = dealt.unionByName(heads).join(texts, "th")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "leader", "salt").sortWithinPartitions("leader", "salt", "kind").select("leader", "th", "kind", "text")
    schema = common.arrow_schema("a binary, b binary")

    def run(batches):
        leader = held = None
        for batch in batches:
            a, b = [], []
            for head, th, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)), common.utf8(batch, "text"), strict=True):
                if kind == 0:
                    leader, held = head, Text(text)
                elif leader == head and held.near_to(Text(text)):
                    a.append(th)
                    b.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "a binary, b binary")


def starred(edges: DataFrame) -> DataFrame:
    """Fewer edges of the same components: each a keeps one b, and its other bs are tied to that one."""
    held = edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"))  # bounded by the buckets of a text
    held = common.materialise(held, "stars")
    tied = held.select(F.explode("all").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return held.select("a", F.col("m").alias("b")).unionByName(tied)


def components(edges: DataFrame) -> DataFrame:
    """v, label: each vertex of the edges (a, b) with the least vertex of its component."""
    edges = starred(edges)
    both = common.materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = common.materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = common.join_small(both, labels.toDF("w", "l"), F.col("b") == F.col("w")).groupBy("a").agg(F.min("l").alias("l"))
        new = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        # Follow the label to its own label.
        jump = common.join_small(new, labels.toDF("w", "l"), F.col("label") == F.col("w"), "left")
        new = common.materialise(jump.select("v", "old", F.least("label", F.coalesce("l", "label")).alias("label")), "labels")
        done = new.where("old <> label").limit(1).count() == 0
        labels = new.drop("old")
        if done:
            return labels


def node_classes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """th, label: nodes of components of more than one text.

    docs: doc_id, th, text. nodes: th, rep (its least doc_id), bands.
    """
    member = nodes.select("th", F.explode("bands").alias("key"))
    sizes = common.materialise(member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    member = common.join_small(member, sizes, "key")
    member = common.materialise(member, "members")
    score = common.materialise(member.groupBy("th").agg(F.sum("n").alias("score")).toDF("s", "score"), "scores")
    member = common.materialise(common.join_small(member.drop("n"), score, F.col("th") == F.col("s")).drop("s"), "scored")
    # One row holds each candidate's text.
    wanted = score.join(nodes.select("th", "rep"), F.col("s") == F.col("th")).select(F.col("th").alias("t"), "rep")
    wanted = common.materialise(wanted, "wanted")
    texts = common.join_small(docs, wanted, common.same(F.col("doc_id"), F.col("rep")) & (F.col("th") == F.col("t"))).select("th", "text")
    texts = common.materialise(texts, "texts")
    # First every bucket's members against one leader, which settles nearly all links of a group of copies.
    heads = member.groupBy("key").agg(F.max(F.struct("score", "th"))["th"].alias("b"))
    heads = common.materialise(heads, "heads")
    pairs = common.join_small(member, heads, "key").where("th <> b").select(F.col("th").alias("a"), "b").distinct()
    pairs = common.materialise(pairs, "pairs")
    links = common.materialise(verified(pairs, texts), "links")
    labels = components(links).toDF("v", "label")
    # Then the members of buckets that still lie in several components, against each other.
    own = common.join_small(member, labels, F.col("th") == F.col("v"), "left").select("key", "th", F.coalesce("label", "th").alias("label"))
    own = common.materialise(own, "labelled")
    mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    mixed = common.materialise(mixed, "mixed")
    mixed = common.materialise(common.join_small(own, mixed, "key"), "mixed")
    few, many = mixed.where(F.col("n") <= BLOCK), mixed.where(F.col("n") > BLOCK).select("th", "label").distinct()
    whole = few.select("key", *(F.lit(0).alias(c) for c in ("p", "q", "blk")), "label", "th")
    more = blockwise(whole, texts, nodes.select(F.col("th").alias("t2"), F.col("bands").alias("keys"), F.lit(0).alias("size")))
    if many.limit(1).count():
        prefixes = common.materialise(rare_words(many, texts), "prefixes")
        each = prefixes.select("th", "label", F.explode(F.slice("keys", F.lit(1), F.col("deal"))).alias("key"))
        shared = each.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
        shared = common.materialise(shared, "shared")
        n, main = prefixes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
        if block_rows(n, main) <= (shared.agg(F.sum("n")).first()[0] or 0):
            each = prefixes.select(F.lit(ALL).cast("bigint").alias("key"), "th", "label", F.lit(n).alias("n"))
        else:
            each = common.join_small(each, shared, "key")
        more = more.unionByName(blockwise(paired_blocks(each), texts, prefixes.select(F.col("th").alias("t2"), "keys", "size")))
    return components(links.unionByName(common.materialise(more, "more"))).toDF("v", "label")


BLOCK = 256
#: The key of members that are not dealt by words (words have none below 0).
ALL = -1
#: A near text shares so many of the keys of a text of n words: n over this, rounded up.
MORE = 20
#: Cells of the word counts that order words by rarity; their number is what the driver receives.
CELLS = 1 << 18
#: Bytes of texts whose words a task keeps between groups.
CACHE = 16 << 20


def cell(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % CELLS


def needed(size):
    """Words that a text of so many shares with a near one at least."""
    return np.ceil(SIMILARITY * np.asarray(size) - 1e-9).astype(np.int64)


def rare_words(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """th, label, size, deal, keys: each text of rows (th, label), its words and hashes of its rarest labelled words, rarest first.

    The first `deal` are so many that two texts of SIMILARITY share one: all but SIMILARITY of a text's
    words, and one more. With all but SIMILARITY and k more of both, they share k; keys has the k of MORE.
    Rarity is counted over these texts by hash cells; it only orders the words, alike for all texts.
    """
    held = common.materialise(common.join_small(texts, rows, "th").select("th", "label", "text"), "hot")

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in common.utf8(batch, "text"):
                np.add.at(total, [cell(w) for w in text.split()], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    counts = held.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(CELLS, np.int64)
    often[counts["cell"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ddl = "th binary, label binary, size int, deal int, keys array<bigint>"
    schema = common.arrow_schema(ddl)

    def step(batches):
        for batch in batches:
            keys, sizes, deals = [], [], []
            for text in common.utf8(batch, "text"):
                words, seen, own = text.split(), {}, []
                for w in words:
                    k = seen.get(w, 0)
                    seen[w] = k + 1
                    # Not seeded by k: short words of other seeds have equal hashes.
                    own.append((int(often[cell(w)]), xxhash.xxh3_64_intdigest(b"%b %d" % (w, k) if k else w) >> 1))
                own.sort()
                rest = len(own) - int(needed(len(own)))
                keys.append([h for _, h in own[: rest + max(-(-len(own) // MORE), 1)]])
                sizes.append(len(own))
                deals.append(rest + 1)
            own = [pa.array(sizes, pa.int32()), pa.array(deals, pa.int32()), pa.array(keys, schema.field(4).type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], schema=schema)

    return held.mapInArrow(step, ddl)


def sides(group):
    """The rows of a group's two blocks, and which pairs of them have different labels, no key before the group's in common and may be near.

    rows: key, p, q, blk, label, th, keys, at (keys before the group's), size. A pair with a key before this
    one is compared there. Where rows have a size, near texts agree in it to SIMILARITY and share as many
    of their keys as the shorter list has beyond the words that a near text may lack.
    """
    p, q = group[0][1:3]
    left = [row for row in group if row[3] == p]
    right = left if p == q else [row for row in group if row[3] == q]
    number = {label: i for i, label in enumerate({row[4] for row in group})}
    one, other = (np.array([number[row[4]] for row in side], np.int64) for side in (left, right))
    meet = one[:, None] != other[None, :]
    if p == q:
        meet = np.tril(meet, -1)
    if meet.any() and any(row[7] for row in group):
        meet &= shared([row[6][: row[7]] for row in left], [row[6][: row[7]] for row in right]) == 0
    if group[0][8]:
        sizes = [np.array([row[8] for row in side], np.int64) for side in (left, right)]
        meet &= np.minimum.outer(*sizes) >= needed(np.maximum.outer(*sizes))
        if meet.any():
            least = [np.array([len(row[6]) for row in side]) - n + needed(n) for side, n in zip((left, right), sizes, strict=True)]
            meet &= shared([row[6] for row in left], [row[6] for row in right]) >= np.minimum.outer(*least)
    return left, right, meet


def rows_of(batch):
    """The batch's rows, its lists of numbers as arrays."""
    columns = []
    for column in batch.columns:
        if pa.types.is_list(column.type):
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            columns.append([flat[x:y] for x, y in zip(ends, ends[1:], strict=False)])
        else:
            columns.append(column.to_pylist())
    return zip(*columns, strict=True)


def groups_of(batches, change=tuple):
    """Rows that agree in the first three columns, of batches sorted by these."""
    group = []
    for batch in batches:
        for row in rows_of(batch):
            if group and group[0][:3] != row[:3]:
                yield group
                group = []
            group.append(change(row))
    if group:
        yield group


def block_rows(n: int, main: int) -> int:
    """How many rows paired_blocks makes of a bucket of n members, `main` of them of one label."""
    first, rest = -(-main // BLOCK), max(-(-(n - main) // BLOCK), 1)
    return n if n <= BLOCK else main * rest + (n - main) * (first + rest)


def paired_blocks(rows: DataFrame) -> DataFrame:
    """key, p, q, blk, label, th: rows once per pair of blocks of their bucket. rows: key, th, label, n (the bucket's members).

    Members of the label that most of a bucket have are joined already: they fill blocks of their own,
    which meet the blocks of the other members only. So a bucket of one large component and some others
    costs its members times the blocks of these others, not the square of its size.
    """
    most = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"))
    most = common.materialise(most.select("key", F.col("most.label").alias("main"), F.col("most.c").alias("held")), "most")
    rows = common.join_small(rows, most, "key")
    whole, main = F.col("n") <= BLOCK, F.col("label") == F.col("main")
    first = F.when(whole, 0).otherwise(F.ceil(F.col("held") / BLOCK)).cast("int")
    rest = F.when(whole, 1).otherwise(F.greatest(F.ceil((F.col("n") - F.col("held")) / BLOCK), F.lit(1))).cast("int")
    at = F.xxhash64("th")
    own = F.when(~whole & main, F.pmod(at, F.greatest(first, F.lit(1)))).otherwise(first + F.pmod(at, rest)).cast("int")
    rows = rows.withColumn("blk", own).withColumn("other", F.explode(F.sequence(F.when(~whole & main, first).otherwise(F.lit(0)), first + rest - 1)))
    return rows.select("key", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "label", "th")


def blockwise(rows: DataFrame, texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links a, b that join members of different labels that share a bucket. rows: key, p, q, blk, label, th.

    A group of rows is two blocks of about BLOCK members of a bucket, so a task holds 2 * BLOCK texts and
    compares them in memory, but for those that links have joined already. A pair
    that meets in several buckets is compared in the first common one of its keys only; members that have
    no pair to compare in a group are told by the keys and sizes alone, before texts are sent.
    keyed: t2, keys, size (0: keys say nothing but where texts meet).
    """
    at = F.greatest(F.array_position("keys", F.col("key")).cast("int") - 1, F.lit(0))
    rows = rows.join(keyed, F.col("th") == F.col("t2")).withColumn("at", at)
    sent = F.when(F.col("size") > 0, F.col("keys")).otherwise(F.slice("keys", F.lit(1), F.col("at")))
    rows = rows.select("key", "p", "q", "blk", "label", "th", sent.alias("keys"), "at", "size")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "key bigint, p int, q int, blk int, label binary, th binary, keys array<bigint>, at int, size int"
    kept_schema, schema = common.arrow_schema(ddl), common.arrow_schema("a binary, b binary")

    def dealt(x):
        return x.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def meeting(batches):
        held = []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kept_schema, strict=True)], schema=kept_schema)

        for group in groups_of(batches):
            left, right, meet = sides(group)
            held += [left[i] for i in np.flatnonzero(meet.any(axis=1) | (meet.any(axis=0) if right is left else False))]
            if right is not left:
                held += [right[j] for j in np.flatnonzero(meet.any(axis=0))]
            if len(held) >= BLOCK:
                yield emit()
                held = []
        if held:
            yield emit()

    kept = common.materialise(dealt(rows).mapInArrow(meeting, ddl), "meeting")
    wanted = common.materialise(kept.select(F.col("th").alias("t3")).distinct(), "wanted")
    held = common.join_small(texts, wanted, F.col("th") == F.col("t3")).select("t3", F.col("text").cast("binary").alias("text"))
    kept = kept.join(common.materialise(held, "held"), F.col("th") == F.col("t3")).select("key", "p", "q", "blk", "label", "th", "keys", "at", "size", "text")

    def compare(group):
        a, b, joined = [], [], {}

        def root(label):
            while label in joined:
                label = joined[label]
            return label

        left, right, meet = sides(group)
        here, there = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
        if not len(here):
            return a, b
        meet[np.ix_(here, there)] &= candidates([left[i][9] for i in here], [right[j][9] for j in there])
        for i, j in np.argwhere(meet):
            one, other = left[i], right[j]
            mine, theirs = root(one[4]), root(other[4])
            if mine != theirs and one[9].near_to(other[9]):
                a.append(one[5])
                b.append(other[5])
                joined[mine] = theirs
        return a, b

    def run(batches):
        cache, size = {}, 0

        def change(row):
            nonlocal size
            if row[5] not in cache:
                if size >= CACHE:
                    cache.clear()
                    size = 0
                cache[row[5]] = Text(row[9])
                size += len(row[9])
            return *row[:9], cache[row[5]]

        for group in groups_of(batches, change):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in compare(group)], schema=schema)

    return dealt(kept).mapInArrow(run, "a binary, b binary")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text with the text hash that tells nodes apart."""
    text = common.text_or_empty()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("th"), text.alias("text"))


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th of every row; th, rep, class_th, class_id of every distinct text). docs: doc_id, th, text."""
    sketched = common.materialise(sketches(docs), "sketches")
    nodes = sketched.groupBy("th").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = common.materialise(nodes, "nodes")
    labels = node_classes(docs, nodes)
    own = nodes.select("th", "rep")
    named = common.materialise(own.join(labels.toDF("v", "label"), F.col("th") == F.col("v"), "left").select("th", "rep", F.coalesce("label", "th").alias("label")), "named")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "th")).alias("x"))
    least = common.materialise(least.select(F.col("label").alias("l"), F.col("x.th").alias("class_th"), F.col("x.rep").alias("class_id")), "least")
    return sketched.select("doc_id", "th"), common.join_small(named, least, F.col("label") == F.col("l")).select("th", "rep", "class_th", "class_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row."""
    rows, texts = text_classes(hashed(docs))
    texts = common.materialise(texts.select(F.col("th").alias("t"), "class_id"), "classes")
    return common.join_small(rows, texts, F.col("th") == F.col("t")).select("doc_id", "class_id")


def deduped_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one of the least doc_id."""
    inner, at = common.numbered(docs)
    plain = inner.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    rows, texts = text_classes(hashed(plain))
    stays = common.materialise(texts.where("th = class_th").select(F.col("th").alias("t"), F.col("rep").alias("r")), "stays")
    goes = common.join_small(rows, stays, (F.col("th") == F.col("t")) & common.same(F.col("doc_id"), F.col("r")), "left_anti").select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    goes = common.materialise(goes.distinct(), "goes")
    th = F.unhex(F.md5(common.text_or_empty(at["text"])))
    kept = common.join_small(inner, goes, common.same(F.col(at["doc_id"]).cast("bigint"), F.col("d")) & (th == F.col("t")), "left_anti")
    repeated = rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    if repeated:  # rows that repeat doc_id and text: one of them stays
        kept = kept.withColumn("__th", th).dropDuplicates([at["doc_id"], "__th"]).drop("__th")
    return common.renumbered(kept, docs)
