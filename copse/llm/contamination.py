"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of test items.

Both sides are normalised to words (small letters, digits, non-ASCII text). Every word of the items gets
a symbol, every other word one more, and a window of SPAN item words becomes a pattern; so a document
is read once, symbol by symbol, and matches are places in its list of words. Words keep their place in
the original text, to which hits are mapped.

The automaton is broadcast, so its size is bounded: items are cut into pieces that overlap by SPAN - 1
words, and pieces are dealt to automata of at most MOST_WORDS words each. Usually one holds them all and
documents are scanned in one map. With more, rows are numbered in a written table first, each automaton
scans all of them, and what it finds meets by row.

Defined results: a null text has no words; a document without words is clean; an item without words
matches nothing; an item of fewer than SPAN words is one window; an item without an id marks words but
is not listed; items that share an id are listed once; rows with equal doc_id are documents of their
own; an empty table of documents gives no rows, an empty table of items finds nothing. Texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ranked import WORD

SPAN = 10
#: Words of items (overlaps included) that one automaton holds: some 500 bytes each.
MOST_WORDS = 400_000
#: Words of a piece of a long item.
PIECE = 4096
#: Letters, digits and non-ASCII bytes stand for themselves, capitals for small letters, all others for a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
FOUND = "n_words bigint, n_hit bigint, items array<string>, starts array<int>, ends array<int>"


def normal(text: bytes) -> bytes:
    """As many bytes as text; words are what is not blank."""
    return text.translate(_WORD_BYTES)


def words_of(text: bytes) -> list[bytes]:
    return normal(text).split()


def symbol(i: int) -> str:
    """The i-th character that is not half of a pair."""
    return chr(i if i < 0xD800 else i + 0x800)


class Windows:
    """The automaton of some pieces. A pattern's value is its length and the ids of its items."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes], bool]], span: int = SPAN):
        """pieces: item id, words, and whether they are a whole item (which may be shorter than span)."""
        self.symbols: dict[bytes, str] = {}
        found: dict[str, set] = {}
        for item, words, whole in pieces:
            text = "".join([self.symbols.setdefault(w, symbol(len(self.symbols) + 1)) for w in words])
            own = [text] if whole and 0 < len(text) < span else [text[i : i + span] for i in range(len(text) - span + 1)]
            for window in own:
                found.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, items in found.items():
            self.automaton.add_word(window, (len(window), frozenset(items)))
        self.automaton.make_automaton()
        self.any = bool(found)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Stretches of hit words as rows (first, last + 1), and the items."""
        get = self.symbols.get
        starts, ends, sets = [], [], set()
        if self.any:
            for last, (n, items) in self.automaton.iter("".join([get(w, "\0") for w in words])):
                starts.append(last + 1 - n)
                ends.append(last + 1)
                sets.add(items)
        return merged(np.array([starts, ends], np.int64).T), set().union(*sets)


def merged(stretches: np.ndarray) -> np.ndarray:
    """Stretches in order, those that overlap or touch joined."""
    if len(stretches) < 2:
        return stretches.reshape(-1, 2)
    stretches = stretches[np.argsort(stretches[:, 0], kind="stable")]
    reach = np.maximum.accumulate(stretches[:, 1])
    new = np.flatnonzero(np.concatenate([[True], stretches[1:, 0] > reach[:-1]]))
    return np.stack([stretches[new, 0], reach[np.append(new[1:], len(stretches)) - 1]], axis=1)


def places(text: bytes, stretches: np.ndarray) -> tuple[list[int], list[int]]:
    """Stretches of words as code points of the original text, end exclusive."""
    if not len(stretches):
        return [], []
    runs = np.array([m.span() for m in _RUN.finditer(normal(text))])
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
    return before[runs[stretches[:, 0], 0]].tolist(), before[runs[stretches[:, 1] - 1, 1]].tolist()


def pieces_of(items: DataFrame, span: int) -> DataFrame:
    """item, words (at most PIECE + span), whole: the items' words in pieces that hold every window once or more."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), common.utf8(batch, "text"), strict=True):
                words = words_of(text)
                last = max(0, len(words) - span)
                for i in range(0, last + 1, PIECE):  # windows that begin within PIECE words
                    own = words[i : i + PIECE + span - 1]
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([own], pa.list_(pa.binary())), pa.array([i == 0 and len(own) == len(words)])], names=["item", "words", "whole"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words array<binary>, whole boolean")


def automata(items: DataFrame, span: int) -> Iterator[Windows]:
    """Automata that together hold all windows, each within MOST_WORDS (or one piece)."""
    n = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)) + span), F.lit(0))).first()[0]
    parts = -(-2 * n // MOST_WORDS) if n > MOST_WORDS else 1
    pieces = pieces_of(items, span)
    if parts > 1:
        pieces = common.materialise(pieces, "pieces")
    for part in range(parts):
        own = pieces.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part) if parts > 1 else pieces
        yield Windows([(r["item"], list(map(bytes, r["words"])), r["whole"]) for r in own.collect()], span)


def scanned(rows: DataFrame, keys: list[str], windows: Windows) -> DataFrame:
    """rows' keys with FOUND; keys are BIGINT columns."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    schema = ", ".join([*(f"{k} bigint" for k in keys), FOUND])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def run(batches):
        own = shared.value
        for batch in batches:
            out = []
            for text in common.utf8(batch, "text"):
                words = words_of(text)
                stretches, items = own.scan(words)
                starts, ends = places(text, stretches)
                out.append((len(words), int((stretches[:, 1] - stretches[:, 0]).sum()), sorted(i for i in items if i is not None), starts, ends))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.select(*keys, "text").mapInArrow(run, schema)


def find_items(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit, items, and the hit stretches (starts, ends: code points) of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = automata(items, span)
    first = next(made)
    second = next(made, None)
    if second is None:
        return scanned(rows, ["doc_id"], first)
    rows = common.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = scanned(rows, ["row", "doc_id"], first)
    while second is not None:
        found = found.unionByName(scanned(rows, ["row", "doc_id"], second).where("n_hit > 0"))
        second = next(made, None)
    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("items", "starts", "ends")}  # a few entries an automaton
    held = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists.values())
    return joined(held.withColumn("items", F.array_sort(F.array_distinct("items"))), rows)


def joined(held: DataFrame, rows: DataFrame) -> DataFrame:
    """Stretches of several automata as one list each, hit words counted anew."""
    schema = f"doc_id bigint, {FOUND}"

    def run(batches):
        for batch in batches:
            out = []
            for text, starts, ends in zip(common.utf8(batch, "text"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                before = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # bytes of code points
                runs = np.searchsorted(before, [m.start() for m in _RUN.finditer(normal(text))])
                spans = merged(np.array([starts, ends], np.int64).T)
                # Stretches end with a word, so those of two automata that are a blank apart stay two here.
                first, last = np.searchsorted(runs, spans[:, 0]), np.searchsorted(runs, spans[:, 1])
                words = merged(np.stack([first, last], axis=1))
                out.append((int((words[:, 1] - words[:, 0]).sum()), *places(text, words)))
            n, starts, ends = zip(*out, strict=True) if out else ([], [], [])
            lists = [pa.array(n, pa.int64()), batch.column("items"), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *lists], names=["doc_id", *[x.split()[0] for x in FOUND.split(", ")]])

    texts = rows.select("row", "text")
    return held.join(texts, "row").select("doc_id", "text", "n_words", "items", "starts", "ends").mapInArrow(run, schema)


def clean_documents(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """docs without the hit stretches (each becomes a blank); the columns are docs' own."""
    inner, at = common.numbered(docs)
    inner = inner.withColumn("__row", F.monotonically_increasing_id())
    inner = common.materialise(inner, "documents")
    found = find_items(inner.select(F.col("__row").alias("doc_id"), F.col(at["text"]).alias("text")), items, span).where("n_hit > 0")
    kept = F.aggregate(
        F.arrays_zip("starts", "ends"), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["text"], F.substring(F.col(at["text"]), a["at"] + 1, s["starts"] - a["at"]), F.lit(" ")).alias("text"), s["ends"].alias("at")),
        lambda a: F.concat(a["text"], F.substring(F.col(at["text"]), a["at"] + 1, F.length(at["text"]))),
    )
    got = inner.join(found.select(F.col("doc_id").alias("__row"), "starts", "ends"), "__row", "left")
    got = got.withColumn(at["text"], F.when(F.col("starts").isNotNull(), kept).otherwise(F.col(at["text"])))
    if "n_chars" in at:
        got = got.withColumn(at["n_chars"], F.when(F.col("starts").isNotNull(), F.length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return common.renumbered(got, docs)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_items(docs, items)
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
CONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS t FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS t FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(t), {SPAN}) AS n, array_to_string(t[i + 1 : i + least(len(t), {SPAN})], ' ') AS w
  FROM (SELECT *, unnest(range(greatest(len(t) - {SPAN}, 0) + 1)) AS i FROM b WHERE len(t) > 0)),
p AS (SELECT r, unnest(t) AS x, unnest(range(len(t))) AS i FROM d),
s AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS ten FROM p),
k AS (SELECT r, i, n, array_to_string(ten[1 : n], ' ') AS w FROM s, (SELECT DISTINCT n FROM w) WHERE len(ten) >= n),
m AS (SELECT r, i, n, item_id FROM k JOIN w USING (n, w)),
h AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
o AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)"""
