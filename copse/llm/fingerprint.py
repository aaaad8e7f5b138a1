"""I-Match fingerprints with DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band of shares of all documents. Its
lower share bounds the lexicon whatever the corpus: documents of d distinct terms on average have at
most d / LEAST terms at or above it, so it is broadcast (its rows are counted first). SUBSETS random
subsets of the lexicon overlap: a hash of the term puts it into two of them. For each subset a document's
distinct terms that lie in it are sorted and hashed; the fingerprint is the list of those hashes, each
with its subset's number (subsets without terms have none). Texts with under FEW terms in the band, as in
a rare language, are fingerprinted by all of their terms instead. Likeness is the share of equal hashes
among the subsets that either side has terms in.

The next document in doc_id order is found without a global order: doc_id quantiles cut the table
into ranges, a window inside a range gives the next text, and only each range's first row crosses to
the range before. Every later step keeps that partitioning, so texts are shuffled once.

Defined results: a null text is empty; a null doc_id comes before all others; rows with equal doc_id
are ordered by a hash of their text; after the last document comes the first (a single document is
its own next); a text without terms has an empty fingerprint; where no subset has terms, likeness is 1
for equal texts and else 0; an empty table gives no rows; columns besides doc_id and text are not read. A
range ends between different doc_ids only, so rows that repeat one doc_id are ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

#: Band of document frequency as shares of all documents, at least FLOOR documents.
LEAST, MOST, FLOOR = 1 / 100, 1 / 10, 2
SUBSETS, FEW = 64, 5
#: Hexadecimal digits of a subset's number and of its hash.
NUMBER, DIGITS = 2, 8
SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), SPLIT))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """The terms in the band."""
    n = docs.count()
    least, most = max(FLOOR, math.ceil(n * LEAST)), math.floor(n * MOST)
    df = docs.select(F.explode(terms(common.text_or_empty(text))).alias("term")).groupBy("term").count()
    return df.where((F.col("count") >= least) & (F.col("count") <= most) & (F.col("term") != "")).select("term")


def subsets_of(term: Column) -> Column:
    """The two subsets that hold a term."""
    digest = F.md5(term)
    at = lambda i: F.conv(F.substring(digest, i, 6), 16, 10).cast("bigint")
    one = at(1) % SUBSETS
    return F.array(one, (one + 1 + at(9) % (SUBSETS - 1)) % SUBSETS)


def entry(subset: Column, held: Column) -> Column:
    """A subset's number and the hash of its terms. held: a sorted array of terms."""
    return F.concat(F.lpad(F.lower(F.hex(subset)), NUMBER, "0"), F.substring(F.md5(F.array_join(held, " ")), 1, DIGITS))


def own_entries(text: Column) -> Column:
    """The entries of a text by all of its terms."""
    pairs = F.flatten(F.transform(F.filter(terms(text), lambda t: t != ""), lambda t: F.transform(subsets_of(t), lambda s: F.struct(s.alias("s"), t.alias("t")))))
    pairs = F.array_sort(pairs)
    numbers = F.array_distinct(F.transform(pairs, lambda p: p["s"]))
    return F.transform(numbers, lambda s: entry(s, F.transform(F.filter(pairs, lambda p: p["s"] == s), lambda p: p["t"])))


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= value, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda array: F.size(F.filter(array, lambda b: b <= value))
    coarse = count(F.array(*[F.lit(r[0]).cast("bigint") for r in rows]))
    fine = F.array(*[F.array(*[F.lit(b).cast("bigint") for b in r]) for r in rows])
    row = F.greatest(coarse - 1, F.lit(0))
    return (row * step + count(F.get(fine, row))).cast("int")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, __next (text), __range and __rn (a row's place in its range). docs: doc_id, text."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("__id", F.array(*map(F.lit, shares)), 20 * ranges).alias("q")).first()["q"] if shares else []
    rows = rows.withColumns({"__range": range_of(F.col("__id"), sorted(set(cuts or []))), "__tie": F.xxhash64("text")})
    # Each range's first row; at most `ranges` ids are broadcast.
    firsts = rows.groupBy("__range").agg(F.min("__id").alias("__id"))
    firsts = rows.join(F.broadcast(firsts.drop("__range")), "__id").groupBy("__range").agg(F.min(F.struct("__tie", "text"))["text"].alias("__first"))
    wrap = preceding(firsts, "__range", "__first")
    place = W.partitionBy("__range").orderBy("__id", "__tie")
    rows = rows.withColumns({"__lead": F.lead("text").over(place), "__rn": F.row_number().over(place)})
    return rows.join(wrap, "__range").select("doc_id", "text", F.coalesce("__lead", "__first").alias("__next"), "__range", "__rn")


def preceding(firsts: DataFrame, key: str, value: str) -> DataFrame:
    """Each range with the value of the range after it, the last one with the first one's. A row for each range."""
    order, everything = W.orderBy(key), W.orderBy(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return firsts.select(key, F.coalesce(F.lead(value).over(order), F.first(value).over(everything)).alias(value))


def likeness(left: str, right: str, equal: Column) -> Column:
    """left, right: columns that hold arrays of entries."""
    number = lambda x: F.transform(x, lambda e: F.substring(e, 1, NUMBER))
    held = F.size(F.array_union(number(left), number(right)))
    return F.when(held == 0, F.when(equal, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(left, right)) / held)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    slim = docs.select("doc_id", "text")
    words = common.materialise(lexicon(slim), "lexicon")
    rows = with_next(slim, ranges)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"__n": n, "__edited": F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("__next"), F.lit(1), k))})
    rows = rows.withColumns({"__sha": F.sha2("__edited", 256), "__same": F.col("text") == F.col("__edited"), "__samenext": F.col("text") == F.col("__next")})
    # A row with the term "" stands for the document itself, so that none is lost in the join; it holds the text.
    none = F.lit(None).cast("string")
    listed = lambda t: F.array_append(F.transform(terms(t), lambda x: F.struct(x.alias("term"), none.alias("t"))), F.struct(F.lit("").alias("term"), t.alias("t")))
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("__edited").alias("t")))
    keys, whole = ("__range", "__rn"), ("doc_id", "__n", "__sha", "__same", "__samenext")
    each = rows.select(*keys, *whole, F.explode(both).alias("b")).select(*keys, *whole, F.col("b.v").alias("v"), F.explode(listed(F.col("b.t"))).alias("x"))
    each = each.select(*keys, "v", F.col("x.term").alias("term"), F.col("x.t").alias("t"), *[F.when(F.col("x.t").isNotNull(), F.col(c)).alias(c) for c in whole])
    found = common.join_small(each, words.withColumn("known", F.lit(True)), "term", "left").where("known OR t IS NOT NULL")
    # -1 is the document's own group.
    found = found.withColumn("subset", F.explode(F.when(F.col("t").isNotNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(subsets_of(F.col("term")))))
    held = found.groupBy(*keys, "v", "subset").agg(F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.col("term")))).alias("held"), *[F.max(c).alias(c) for c in ("t", *whole)])
    code = F.when(F.col("subset") >= 0, entry(F.col("subset"), F.col("held")))
    texts = held.select(*keys, "v", code.alias("code"), F.when(F.col("subset") >= 0, F.size("held")).alias("k"), "t", *whole)
    texts = texts.groupBy(*keys, "v").agg(F.array_sort(F.collect_list("code")).alias("f"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), *[F.max(c).alias(c) for c in ("t", *whole)])
    texts = texts.select(*keys, "v", *whole, F.when(F.col("k") < 2 * FEW, own_entries(F.col("t"))).otherwise(F.col("f")).alias("f"))
    side = lambda v: F.max(F.when(F.col("v") == v, F.col("f")))
    docs2 = texts.groupBy(*keys).agg(side(0).alias("f"), side(1).alias("e"), *[F.max(c).alias(c) for c in whole])
    prints = common.materialise(docs2, "prints")
    wrap = preceding(prints.where("__rn = 1").select("__range", F.col("f").alias("__first")), "__range", "__first")
    place = W.partitionBy("__range").orderBy("__rn")
    prints = prints.withColumn("__lead", F.lead("f").over(place)).join(wrap, "__range").withColumn("g", F.coalesce("__lead", "__first"))
    return prints.select(
        "doc_id", F.col("__n").cast("bigint").alias("n_chars"), F.col("__sha").alias("edited_sha256"), F.array_join("f", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness("f", "e", F.col("__same")).alias("near_edited"), likeness("f", "g", F.col("__samenext")).alias("near_next"),
    )


def _like_sql(a: str, b: str, equal: str) -> str:
    held = f"len(list_distinct(list_transform(list_concat({a}, {b}), lambda e: substr(e, 1, {NUMBER}))))"
    return f"CASE WHEN {held} = 0 THEN CASE WHEN {equal} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect({a}, {b}))::DOUBLE / {held} END"


def fingerprint_sql() -> str:
    at = lambda i: f"('0x' || substr(md5(term), {i}, 6))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT count(*) AS n FROM d),
e AS (SELECT r, doc_id, t, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nx, length(t) AS k FROM d),
x AS (SELECT *, substr(t, 1, k - k // 4) || substr(nx, 1, k // 4) AS ed FROM e),
df AS (SELECT term, count(*) AS c FROM (SELECT unnest(list_distinct(string_split_regex(lower(t), '{SPLIT}'))) AS term FROM d) GROUP BY term),
lex AS (SELECT term FROM df, n WHERE term <> '' AND c >= greatest({FLOOR}, ceil(n * {LEAST})) AND c <= floor(n * {MOST})),
v AS (SELECT r, 0 AS v, t AS t FROM x UNION ALL SELECT r, 1, ed FROM x),
u AS (SELECT r, v, unnest(list_distinct(string_split_regex(lower(t), '{SPLIT}'))) AS term FROM v),
k AS (SELECT r, v, term, lex.term IS NOT NULL AS known, sum(CASE WHEN lex.term IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r, v) AS n FROM u LEFT JOIN lex USING (term) WHERE term <> ''),
q AS (SELECT r, v, term, {at(1)} % {SUBSETS} AS s1, {at(9)} % {SUBSETS - 1} AS s2 FROM k WHERE known OR n < {FEW}),
m AS (SELECT r, v, term, s1 AS s FROM q UNION ALL SELECT r, v, term, (s1 + 1 + s2) % {SUBSETS} FROM q),
c AS (SELECT r, v, printf('%0{NUMBER}x', s) || substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {DIGITS}) AS code FROM m GROUP BY r, v, s),
f AS (SELECT r, v, list_sort(list(code)) AS f FROM c GROUP BY r, v),
a AS (SELECT x.*, coalesce(f0.f, []) AS f, coalesce(f1.f, []) AS g FROM x LEFT JOIN f f0 ON f0.r = x.r AND f0.v = 0 LEFT JOIN f f1 ON f1.r = x.r AND f1.v = 1),
b AS (SELECT *, coalesce(lead(f) OVER (ORDER BY r), first_value(f) OVER (ORDER BY r)) AS nf FROM a)
SELECT doc_id, k::BIGINT AS n_chars, sha256(ed) AS edited_sha256, array_to_string(f, '') AS fingerprint, array_to_string(g, '') AS edited_fingerprint,
  {_like_sql('f', 'g', 't = ed')} AS near_edited, {_like_sql('f', 'nf', 't = nx')} AS near_next FROM b"""
