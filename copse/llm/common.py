"""What the corpus operators share: durable intermediate tables and row-wise Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session of one process that names none gets one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="copse-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage in storage that outlives executors, and makes later readers see one
    fixed set of rows whatever is recomputed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/copse/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state built once per task: make() returns what turns one batch into batches."""

    def run(batches):
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


#: Rows of a batch whose texts are Python objects at once.
PART = 256


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a few rows. A worker keeps the memory that it has once taken, beside its executor's."""
    for at in range(0, batch.num_rows, PART):
        yield batch.slice(at, PART)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as bytes, null as empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow types that mapInArrow's output columns must have."""
    kinds = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
        T.BinaryType: pa.binary(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
    }
    fields = []
    for field in T._parse_datatype_string(ddl).fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            fields.append(pa.field(field.name, pa.list_(kinds[type(kind.elementType)])))
        else:
            fields.append(pa.field(field.name, kinds[type(kind)]))
    return pa.schema(fields)


def same(left, right):
    """Equality of keys in joins that also matches null with null."""
    return left.eqNullSafe(right)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Rows up to which join_small broadcasts its right side, which it counts first.
SMALL = 200_000


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = SMALL, weigh=None) -> DataFrame:
    """Join with a side that is usually small: broadcast if counted as at most `most`, else shuffled.

    weigh: an aggregate that measures right in rows of plain size, where its rows hold lists.
    """
    size = right.agg(weigh if weigh is not None else F.count("*")).first()[0] or 0
    return left.join(F.broadcast(right) if size <= most else right, on, how)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... and the new name by old (lower-case) name, so that no own name clashes."""
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    return inner, {c.lower(): f"c{i}" for i, c in enumerate(df.columns)}


def renumbered(inner: DataFrame, df: DataFrame) -> DataFrame:
    return inner.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


class Seen:
    """Which 64-bit keys occur often enough, as bits by hash: no such key is missed, a few others pass.

    It holds MOST_BITS at most, however many keys there are; the fuller it is, the more others pass,
    which exact counts then refuse. So it saves shuffles and decides nothing.
    """

    BLOCK, LEAST_BITS, MOST_BITS = 1 << 19, 1 << 19, 1 << 28

    def __init__(self, counted: DataFrame, least: int):
        """counted: key, count."""
        spark, held = counted.sparkSession, counted.where(F.col("count") >= least).select("key")
        bits = self.LEAST_BITS
        n = held.count()
        while bits < min(16 * n, self.MOST_BITS):
            bits *= 2
        block = self.BLOCK
        cells = held.select(F.pmod("key", F.lit(bits)).alias("cell")).withColumn("block", F.floor(F.col("cell") / block))

        def fill(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                cell = batch.column(0).to_numpy()
                for b in np.unique(cell // block).tolist():
                    own = out.setdefault(b, np.zeros(block, bool))
                    own[cell[cell // block == b] - b * block] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in out.values()], pa.binary())], names=["block", "bits"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        data = np.zeros(bits // 8, np.uint8)
        for b, own in cells.repartition(n, "block").select("cell").mapInArrow(fill, "block bigint, bits binary").collect():  # MOST_BITS at most
            data[b * block // 8 : (b + 1) * block // 8] |= np.frombuffer(own, np.uint8)
        self.bits, self.data = bits, spark.sparkContext.broadcast(data)

    def __getstate__(self):
        return self.bits, self.data

    def __setstate__(self, state):
        self.bits, self.data = state

    def has(self, key: np.ndarray) -> np.ndarray:
        cell = key.view(np.int64) % self.bits
        return (self.data.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
