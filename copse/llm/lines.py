"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its number of tokens and its leading tokens; tokens that hold digits, at-signs or
schemes are variable fields. At a leaf the rest of the line is cut into PARTS stretches, and a
template is the line with one stretch left open, so lines that differ within one stretch (a quarter
of the rest at most) share a template. Lines of under SHORT tokens are only equal up to variable
fields. Lines that fit no recurring template are looked up by wide ones: any two of the stretches, the
leading tokens being one of them, are open while half of the tokens are not; of a short line of
LEAST_WIDE tokens or more, any one token. Wide templates count the documents (doc_id and text) that hold
such lines. Every template is one hash key, so templates are counted by one aggregation over all lines:
no order of arrival, and no leaf whose lines must meet in one task. Since a template recurs only if each of
its closed stretches does, stretches are counted first, and templates only of lines whose stretches recur.

A template that at least MIN_DOCS documents hold is recurring. Of its lines the first in the corpus (by
doc_id, then text hash, then line number) stays and all others are dropped. Lines of SHORT tokens or more
hardly repeat by chance: with long_docs, equal ones of them (all tokens, variable fields too) are recurring
from that many documents on, where they fit no recurring template. Short lines with an open token often
agree by chance, so these templates need SHORT_TIMES as many documents.

Defined results: a null text is empty, and stays null; blank lines are never dropped or counted; a
document that loses all lines keeps an empty text; documents are told apart by doc_id (null is one)
and text, and rows that repeat both are judged alike but count as documents of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, PARTS, SHORT, MIN_DOCS, LONG_DOCS = 3, 4, 8, 5, 2
LEAST_WIDE, SHORT_TIMES = 3, 4
#: The lowest bits of a key tell what it is of.
WHOLE, WIDE_SHORT, WIDE, TEMPLATE, KINDS = 0, 1, 2, 3, 3
ALL = (1 << 64) - 1
DIGIT = b"0123456789"
FIELD = b"<*>"
LINES = "doc bigint, h bigint, lines array<int>, tokens array<int>, parts array<bigint>, whole array<bigint>"
#: What the number of tokens adds to a key.
STEP = 0x9E3779B97F4A7C15


def signed(k: int, kind: int) -> int:
    k = k & ~KINDS | kind
    return k - (1 << 64) if k >> 63 else k


def mask(token: bytes) -> bytes:
    return FIELD if b"@" in token or b"://" in token or len(token.translate(None, DIGIT)) < len(token) else token


def fields(line: bytes) -> list[bytes]:
    """The line's tokens, variable fields masked."""
    tokens = line.split()
    if len(line.translate(None, DIGIT)) < len(line) or b"@" in line or b"://" in line:
        tokens = [mask(t) for t in tokens]
    return tokens


def edges_of(n: int) -> list[int]:
    """Where the stretches of a line of n tokens begin and end; a short line's tokens are stretches of one."""
    return list(range(n + 1)) if n < SHORT else [0, *(DEPTH + (n - DEPTH) * i // PARTS for i in range(PARTS + 1))]


def part_hashes(tokens: list[bytes]) -> list[int]:
    edges = edges_of(len(tokens))
    return [xxhash.xxh3_64_intdigest(b" ".join(tokens[a:b]), i) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def narrow_sets(n: int) -> list[tuple[int, ...]]:
    """Of lines of n tokens: which stretches each template leaves open."""
    return [()] if n < SHORT else [(i,) for i in range(1, PARTS + 1)]


def open_sets(n: int) -> tuple[list[int], list[tuple[int, ...]], int]:
    """Of lines of n tokens: the edges of the stretches, which of them each wide template leaves open, and its kind."""
    edges = edges_of(n)
    if n < SHORT:
        return edges, [(i,) for i in range(n)] if n >= LEAST_WIDE else [], WIDE_SHORT
    size = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    return edges, [x for x in combinations(range(PARTS + 1), 2) if 2 * sum(size[i] for i in x) <= n], WIDE


#: A number for each set of open stretches.
OPEN = {x: xxhash.xxh3_64_intdigest(b"%d" % i) for i, x in enumerate([*combinations(range(max(SHORT, PARTS + 1)), 2), *((i,) for i in range(SHORT)), ()])}


def keys_of(parts: list[int], n: int, sets, kind: int) -> list[int]:
    """A key for each set of open stretches: the closed ones' hashes (each knows its place), what is open, and n, added up."""
    total = sum(parts)
    return [signed(total - sum(parts[i] for i in x) + OPEN[x] + n * STEP & ALL, kind) for x in sets]


def template_keys(line: bytes) -> list[int]:
    """A key for each template that the line fits; none for a blank line."""
    tokens = fields(line)
    return keys_of(part_hashes(tokens), len(tokens), narrow_sets(len(tokens)), TEMPLATE) if tokens else []


def wide_keys(tokens: list[bytes]) -> list[int]:
    """A key for each wide template."""
    _, sets, kind = open_sets(len(tokens))
    return keys_of(part_hashes(tokens), len(tokens), sets, kind) if sets else []


def parsed_lines(docs: DataFrame) -> DataFrame:
    """docs: doc, h, text. A row for each document: its lines that are not blank by number, tokens, hashes of stretches (one after another) and of the whole."""
    schema = common.arrow_schema(LINES)

    def make():
        def step(batch):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                numbers, sizes, parts, whole, ends, part_ends = array("i"), array("i"), array("Q"), array("Q"), [0], [0]
                for text in common.utf8(part, "text"):
                    for n, line in enumerate(text.split(b"\n")):
                        tokens = fields(line)
                        if tokens:
                            numbers.append(n)
                            sizes.append(len(tokens))
                            parts.extend(part_hashes(tokens))
                            whole.append(xxhash.xxh3_64_intdigest(b" ".join(line.split()), 99))
                    ends.append(len(numbers))
                    part_ends.append(len(parts))
                flat = [np.array(numbers, np.int32), np.array(sizes, np.int32), np.array(parts, np.uint64).view(np.int64), np.array(whole, np.uint64).view(np.int64)]
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x)) for e, x in zip((ends, ends, part_ends, ends), flat, strict=True)]
                columns = [part.column(0), part.column(1), *(x.cast(f.type) for x, f in zip(lists, list(schema)[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return step

    return common.map_batches(docs, make, LINES)


def open_keys(parts: np.ndarray, often: np.ndarray, n: np.ndarray, sets, kind: int, allowed=None):
    """(rows, keys) of one set of open stretches after another, of lines whose closed stretches all occur often. parts: (lines, stretches)."""
    total, many = parts.sum(axis=1), often.sum(axis=1)
    for at, x in enumerate(sets):
        x = list(x)
        ok = many - often[:, x].sum(axis=1) == parts.shape[1] - len(x)
        if allowed is not None:
            ok &= allowed[at]
        rows = np.flatnonzero(ok)
        key = total[rows] - parts[rows][:, x].sum(axis=1) + np.uint64(OPEN[tuple(x)]) + n[rows].astype(np.uint64) * np.uint64(STEP)
        yield rows, key & ~np.uint64(KINDS) | np.uint64(kind)


def line_keys(parsed: DataFrame, often: common.Seen, twice: common.Seen | None) -> DataFrame:
    """doc, h, line, key, first (the document's first line with that key) of the templates that may recur."""
    ddl = "doc bigint, h bigint, line int, key bigint, first boolean"
    schema = common.arrow_schema(ddl)

    def make():
        def step(batch):
            doc, h = batch.column(0), batch.column(1)
            line, n, parts, whole = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2, 6))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            parts, whole = parts.view(np.uint64), whole.view(np.uint64)
            begin = np.concatenate([[0], np.cumsum(np.where(n < SHORT, n, PARTS + 1))]).astype(np.int64)
            recur, found = often.has(parts), []
            again = twice.has(parts) if twice else None
            for size in range(1, SHORT + 1):
                rows = np.flatnonzero(n == size if size < SHORT else n >= SHORT)
                if not len(rows):
                    continue
                k = min(size, PARTS + 1) if size == SHORT else size
                at = begin[rows][:, None] + np.arange(k)
                own, ok, tokens = parts[at], recur[at], n[rows]
                if size < SHORT:
                    wide = [(open_sets(size)[1], WIDE_SHORT, None)]
                else:
                    edge = np.stack([np.zeros_like(tokens), *(DEPTH + (tokens - DEPTH) * i // PARTS for i in range(PARTS + 1))], axis=1)
                    length, sets = np.diff(edge, axis=1), list(combinations(range(PARTS + 1), 2))
                    wide = [(sets, WIDE, [2 * length[:, list(x)].sum(axis=1) <= tokens for x in sets])]
                for sets, kind, allowed in [(narrow_sets(size), TEMPLATE, None), *wide]:
                    found += [(rows[r], key) for r, key in open_keys(own, ok, tokens, sets, kind, allowed)]
                if twice and size == SHORT:
                    r = rows[again[at].all(axis=1)]
                    found.append((r, whole[r] & ~np.uint64(KINDS) | np.uint64(WHOLE)))
            rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in found)])
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in found)])
            order = np.lexsort((rows, keys, owner[rows]))
            rows, keys = rows[order], keys[order]
            first = np.ones(len(rows), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (owner[rows[1:]] != owner[rows[:-1]])
            at = pa.array(owner[rows])
            yield pa.RecordBatch.from_arrays([doc.take(at), h.take(at), pa.array(line[rows]), pa.array(keys.view(np.int64)), pa.array(first)], schema=schema)

        return step

    return common.map_batches(parsed, make, ddl)


def drops(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int | None = None) -> DataFrame:
    """docs: doc, h, text. The lines to drop as doc, h, lines (numbers from 0), for documents that have any."""
    parsed = common.materialise(parsed_lines(docs), "lines")
    # A template recurs only if each of its closed stretches does; few lines are left to be counted exactly.
    stretches = parsed.select(F.explode("parts").alias("key")).groupBy("key").count()
    stretches = common.materialise(stretches.where(F.col("count") >= min(min_docs, long_docs or min_docs)), "stretches")
    each = common.materialise(line_keys(parsed, common.Seen(stretches, min_docs), common.Seen(stretches, long_docs) if long_docs is not None else None), "keys")
    kind = F.col("key").bitwiseAND(F.lit(KINDS))
    least = F.when(kind == WHOLE, F.lit(long_docs)).when(kind == WIDE_SHORT, F.lit(SHORT_TIMES * min_docs)).otherwise(F.lit(min_docs))
    counts = each.groupBy("key").agg(F.sum(F.col("first").cast("bigint")).alias("docs")).where(F.col("docs") >= least)
    counts = common.materialise(counts, "recurring")
    found = common.join_small(each.drop("first"), counts, "key")
    # Of a line's recurring templates the most frequent one counts.
    isin = lambda *kinds: F.when(kind.isin(*kinds), F.col("key"))
    best = F.max(F.when(kind == TEMPLATE, F.struct("docs", "key")))["key"]
    found = found.groupBy("doc", "h", "line").agg(best.alias("best"), F.collect_list(isin(WIDE, WIDE_SHORT)).alias("wide"), F.max(isin(WHOLE)).alias("whole"))
    found = common.materialise(found, "kinds")
    # One line that recurs does not make its open tokens fields: wide templates are counted again without such lines.
    wide = found.where("best IS NULL").select("doc", "h", "line", F.explode("wide").alias("key"))
    again = wide.groupBy("key").agg(F.count_distinct(F.struct("doc", "h")).alias("docs")).where(F.col("docs") >= least)
    wide = common.join_small(wide, common.materialise(again, "wide"), "key").select("doc", "h", "line", F.struct("docs", "key").alias("at"))
    sure = found.select("doc", "h", "line", F.struct(F.lit(0).cast("bigint").alias("docs"), F.coalesce("best", "whole").alias("key")).alias("at")).where("at.key IS NOT NULL")
    found = sure.unionByName(wide).groupBy("doc", "h", "line").agg(F.max("at")["key"].alias("key"))
    found = common.materialise(found, "found")
    keep = found.groupBy("key").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "h", "line")).alias("at")).select("key", "at.*")
    keep = common.materialise(keep.toDF("key", "none", "d0", "h0", "l0"), "firsts")
    found = common.join_small(found, keep, "key")
    other = ~(common.same(F.col("doc"), F.col("d0")) & (F.col("h") == F.col("h0")) & (F.col("line") == F.col("l0")))
    return found.where(other).groupBy("doc", "h").agg(F.collect_set("line").alias("lines"))


def with_drops(docs: DataFrame, doc_id: str, text: str, min_docs: int = MIN_DOCS, long_docs: int | None = None) -> DataFrame:
    """docs with __lines, the numbers of the lines that go (null: none)."""
    h = F.coalesce(F.xxhash64(text), F.lit(0).cast("bigint"))
    gone = drops(docs.select(F.col(doc_id).cast("bigint").alias("doc"), h.alias("h"), F.col(text).alias("text")), min_docs, long_docs)
    gone = common.materialise(gone.toDF("__d", "__g", "__lines"), "drops")
    on = common.same(F.col(doc_id).cast("bigint"), F.col("__d")) & (h == F.col("__g"))
    return docs.join(gone.hint("merge"), on, "left").drop("__d", "__g")  # what goes grows with the corpus, so the texts are shuffled


def without(text: bytes, gone) -> bytes:
    gone = set(gone)
    return b"\n".join(line for n, line in enumerate(text.split(b"\n")) if n not in gone)


def deduped_documents(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int | None = None) -> DataFrame:
    """docs without the dropped lines; n_chars, where there, follows the text."""
    inner, at = common.numbered(docs)
    joined = with_drops(inner, at["doc_id"], at["text"], min_docs, long_docs)
    t, g = joined.columns.index(at["text"]), joined.columns.index("__lines")

    def run(batches):
        for batch in batches:
            for part in common.parts(batch):
                texts = [None if x is None else without(x, y) if y else x for x, y in zip(part.column(t).cast(pa.binary()).to_pylist(), part.column(g).to_pylist(), strict=True)]
                columns = list(part.columns)
                columns[t] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    got = joined.mapInArrow(run, joined.schema)
    if "n_chars" in at:
        size = F.coalesce(F.length(at["text"]).cast(docs.schema["n_chars"].dataType), F.col(at["n_chars"]))
        got = got.withColumn(at["n_chars"], F.when(F.size("__lines") > 0, size).otherwise(F.col(at["n_chars"])))
    return common.renumbered(got, docs)


DIGESTS = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int | None = None) -> DataFrame:
    """doc_id, lines that are not blank, lines dropped, and the digest of the text that is left."""
    inner = docs.select(F.col("doc_id").cast("bigint").alias("c0"), F.col("text").alias("c1"))
    joined = with_drops(inner, "c0", "c1", min_docs, long_docs)
    schema = common.arrow_schema(DIGESTS)

    def make():
        def step(batch):
            out = []
            for doc, text, gone in zip(batch.column(0).to_pylist(), common.utf8(batch, "c1"), batch.column(2).to_pylist(), strict=True):
                n = sum(1 for line in text.split(b"\n") if line.strip())
                out.append((doc, n, len(gone or ()), hashlib.sha256(without(text, gone or ())).hexdigest()))
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(joined.select("c0", "c1", "__lines"), make, DIGESTS)
