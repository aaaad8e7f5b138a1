"""Embedding whitening: the covariance by MLlib's RowMatrix over exactly centred rows, its eigenvectors on
the driver, and the rows' components in a broadcast map.

A vector becomes whole numbers x = floor(256 c). The fit list holds every distinct x vector once, in a
written table: one aggregation gives its size n and sums S, a map gives the centred rows
(n x - S) / n, whose numerators are whole numbers, and computeGramianMatrix adds up their products in the
JVM in a tree. Only a matrix of dimension by dimension reaches the driver, and no more than MOST_DIMENSIONS
are taken. Rows are whitened by the same centred numbers times the components.

Defined results: a vector that is null, empty or holds null or non-finite entries is left out; so is one
whose length is not the commonest one's (of equally common, the longest); repeated rows are kept and
count once in the fit; a component without spread (eigenvalue under 1e-12 of the trace, as for one
distinct vector) has null as whitened and takes no part in identity_error, which is 0 if there is none;
explained is null where the trace is 0; a deviation beyond 64 bits is null; with fewer dimensions than
components, there are as many components as dimensions; no row at all gives an empty result. Entries
beyond 64 bits after scaling stop at the largest 64-bit number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4
#: A matrix of so many columns is 128 MB on the driver.
MOST_DIMENSIONS = 4096
FLAT = 1e-12
WHITE = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole(vector) -> F.Column:
    """Entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(2.0**63 - 1024)), F.lit(-(2.0**63)))).cast("bigint"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """df's rows with all entries present and finite, and their x."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))).withColumn("x", whole(F.col(vector)))


@dataclass
class Whitener:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # (dimensions, components), zero where there is no spread
    trace: float
    identity_error: float = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def from_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of rows, as whole numbers: 64-bit where those are sure to hold it, else Python's own."""
    most = max(map(abs, sums), default=0) + n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gramian(rows: DataFrame, column: str, dimensions: int) -> np.ndarray:
    """Sum of the products of the rows (arrays of doubles), added up in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, 0, dimensions).computeGramianMatrix().toArray()


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Components of the distinct x vectors of df; None if it has no usable row."""
    rows = usable(df, vector).select("x")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {MOST_DIMENSIONS} are taken")
    rows = common.materialise(rows.where(F.size("x") == d).distinct(), "fit")

    def summed(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = rows_of(batch.column("x"))
            n += len(x)
            # Halves of 32 bits add up exactly in 64 for any batch.
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(n), *map(str, total)], pa.string())], names=["i", "s"])

    parts = rows.mapInArrow(summed, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    got = {r["i"]: int(r["s"]) for r in parts}
    n, sums = got.pop(-1), [got[i] for i in range(d)]

    def centred(batches):
        for batch in batches:
            y = (from_centre(rows_of(batch.column("x")), n, sums) / n).astype(float)
            yield pa.RecordBatch.from_arrays([common_list(y)], names=["y"])

    covariance = gramian(rows.mapInArrow(centred, "y array<double>"), "y", d) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)  # one of the two signs, for good
    trace = float(np.trace(covariance))
    spread = values > FLAT * trace
    made = Whitener(n, sums, values, np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), 0.0), trace)
    made.identity_error = identity_error(rows, made, np.flatnonzero(spread))
    return made


def common_list(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def projected(x: np.ndarray, w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """Distances from the centre (n x - S), and whitened components, of rows."""
    y = from_centre(x, w.n, w.sums)
    return y, (y / w.n).astype(float) @ w.vectors


def identity_error(rows: DataFrame, w: Whitener, spread: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened fit list differs from the identity."""
    if not len(spread):
        return 0.0
    k = len(spread)

    def white(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([common_list(projected(rows_of(batch.column("x")), w)[1][:, spread])], names=["z"])

    z = rows.mapInArrow(white, "z array<double>")
    means = list(z.agg(*[F.avg(F.get("z", F.lit(i))).alias(f"m{i}") for i in range(k)]).first())
    centred = z.select(F.array(*[F.get("z", F.lit(i)) - float(m) for i, m in enumerate(means)]).alias("z"))
    return float(np.abs(gramian(centred, "z", k) / w.n - np.eye(k)).max())


def transform(df: DataFrame, w: Whitener, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """WHITE: a row for each usable row of df and component."""
    shared = df.sparkSession.sparkContext.broadcast(w)  # at most MOST_DIMENSIONS x components
    rows = usable(df, vector).where(F.size("x") == w.dimensions).select(F.col(key).cast("bigint").alias("vec_id"), "x")

    def run(frames):
        own = shared.value
        k = own.vectors.shape[1]
        explained = [float(e) / own.trace if own.trace > 0 else None for e in own.values]
        flat = ~own.vectors.any(axis=0)
        for pdf in frames:
            if not len(pdf):
                continue
            y, z = projected(np.stack(pdf["x"].to_numpy()), own)
            z[:, flat] = np.nan
            squares = [int(v) for v in (y.astype(object) ** 2).sum(axis=1)]
            yield pd.DataFrame({
                "vec_id": np.repeat(pdf["vec_id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)), "n": own.n,
                "deviation": pd.array(np.repeat(np.array([v if v < 1 << 63 else None for v in squares], object), k), dtype="Int64"),
                "whitened": pd.array(z.ravel(), dtype="Float64"), "explained": pd.array(explained * len(y), dtype="Float64"), "identity_error": own.identity_error,
            })

    white = rows.mapInPandas(run, WHITE)
    return white.withColumn("whitened", F.nanvl("whitened", F.lit(None).cast("double")))


def whiten(df: DataFrame) -> DataFrame:
    """The whitened components of every usable row of df (vec_id, embedding)."""
    w = fit(df)
    if w is None:
        return df.sparkSession.createDataFrame([], WHITE)
    return transform(df, w)
