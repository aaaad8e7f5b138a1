"""Running sums over all rows of a table without one task for all: ranges of the key first, then rows inside a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scalar import num

#: Ranges that the keys are cut into, by approximate quantiles.
RANGES = 200


def ranged(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """df with `__range`, the number of its key's range; equal keys share one."""
    cuts = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / ranges) for i in range(1, ranges)])).alias("q")).first()["q"] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")
    return df.withColumn("__range", F.size(F.filter(bounds, lambda b: b <= F.col(key))))


def running(df: DataFrame, key: str, sums: dict[str, Column], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with, for each name of sums, the sum up to and with its row in the order of key, and name + "0", the sum before it.

    Keys must be distinct (sum rows of equal key first). A range's total moves as one row, and a window sees one range.
    """
    order = F.desc if descending else F.asc
    d = ranged(df, key, ranges).withColumns({f"__{n}": c.cast("double") for n, c in sums.items()})
    before = W.orderBy(order("__range")).rowsBetween(W.unboundedPreceding, -1)  # over the ranges' totals only
    totals = d.groupBy("__range").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), num(0)).alias(f"__s_{n}") for n in sums])
    inside = W.partitionBy("__range").orderBy(order(key))
    upto, under = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    d = d.join(F.broadcast(starts), "__range")  # a row a range
    out = {}
    for n in sums:
        out[n] = F.col(f"__s_{n}") + F.sum(f"__{n}").over(upto)
        out[f"{n}0"] = F.col(f"__s_{n}") + F.coalesce(F.sum(f"__{n}").over(under), num(0))
    return d.withColumns(out).drop("__range", *[f"__{n}" for n in sums], *[f"__s_{n}" for n in sums])


def numbered(df: DataFrame, key: str, name: str = "n", ranges: int = RANGES) -> DataFrame:
    """df with `name`, its rows' numbers from 0 on in the order of key (rows of equal key in any order)."""
    d = ranged(df, key, ranges)
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = d.groupBy("__range").agg(F.count("*").alias("__t")).select("__range", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(key)) - 1
    return d.join(F.broadcast(starts), "__range").withColumn(name, F.col("__s") + place).drop("__range", "__s")
