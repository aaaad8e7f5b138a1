"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key from its doc_id. The key space of a source is cut into equal ranges;
range totals give each range's start in the source's running total, and a window inside a range gives
each row's. A row is taken once per whole epoch that fits the source's budget and, in the last epoch,
for as many words as are left where the row begins. No window holds more than one range of one
source, so a source with a third of all rows is spread over all tasks. Only the table of sources (one
row each) passes through a window without a key.

Defined results: a null text has no words and is taken 0 times; a null source is a source of its own
and comes last; rows with equal doc_id (null too) have equal keys and are ordered by size, so equal
rows are interchangeable; an empty table gives an empty result. Other columns are carried along
unread unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_plan(totals: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets by source: __src, source_size, target.

    All sizes are shared by weight; a target stops at `most` times its source's size and the rest is
    shared again. In the order of cap by weight the capped sources come first, so one running sum
    finds the level at which the sharing ends.
    """
    by_name, by_ratio = W.orderBy("__src"), W.orderBy("__ratio", "__src")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    weight = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    df = totals.withColumn("__w", weight.cast("bigint")).withColumn("__cap", F.col("source_size") * most)
    df = df.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    heads = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    df = df.withColumn("__level", left.cast("double") / heads.cast("double"))
    open_level = F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(everything)
    target = F.least(F.col("__cap").cast("double"), F.coalesce(open_level * F.col("__w"), F.col("__cap").cast("double")))
    return df.select("__src", "source_size", target.alias("target"))


def mix(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights=WEIGHTS, most: int = MOST_EPOCHS, ranges: int | None = None) -> DataFrame:
    """df's columns with size, source_size, target and taken (words that the mix takes of the row).

    ranges: of a source's key space; four for each shuffle partition by default.
    """
    ranges = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    at = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")
    rows = df.withColumns({"size": size, "__src": name, "__key": digest}).withColumn("__range", F.floor(at * ranges / F.lit(1 << 28)).cast("int"))
    parts = rows.groupBy("__src", "__range").agg(F.sum("size").alias("__part"))
    plan = source_plan(parts.groupBy("__src").agg(F.sum("__part").alias("source_size")), weights, most)
    start = F.coalesce(F.sum("__part").over(W.partitionBy("__src").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__start", start).join(plan, "__src").drop("__part")
    inside = W.partitionBy("__src", "__range").orderBy("__key", key, "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["__src", "__range"])
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size") - F.col("__start") - F.col("__inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest))
    return rows.withColumn("taken", taken).drop("__src", "__range", "__key", "__start", "__inside")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: docs' own columns, a row for each epoch in which the row is taken.

    The last copy is cut after the words that the budget still holds (n_chars follows the text).
    """
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at = {c.lower(): f"c{i}" for i, c in enumerate(own)}
    text = at["text"]
    got = mix(inner, words(F.col(text)), at["source"], at["doc_id"], weights, most).where("taken > 0")
    got = got.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("taken") / F.col("size")))))
    left = F.col("taken") - (F.col("__copy") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, left.cast("int")), "")
    got = got.withColumn(text, F.when(left < F.col("size"), cut).otherwise(F.col(text)))
    if "n_chars" in at:
        got = got.withColumn(at["n_chars"], F.when(left < F.col("size"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("__n"))
    return mix(slim, F.col("__n")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w, source_size * {MOST_EPOCHS} AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
t AS (SELECT src, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN ratio > level THEN level END) OVER () * w, cap::DOUBLE)) AS target FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target,
  (e * size + greatest(0, least(size, floor(target)::BIGINT - e * source_size - before)))::BIGINT AS taken
FROM (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(target)::BIGINT // t.source_size ELSE 0 END AS e FROM p JOIN t USING (src))"""
