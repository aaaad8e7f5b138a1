"""Training frames: a DataFrame with agreed column names, and the checks a matrix must pass.

Columns: row_id BIGINT, features ARRAY<DOUBLE> (null: missing), label ARRAY<DOUBLE>, weight DOUBLE,
and, where given, base_margin ARRAY<DOUBLE>, label_lower, label_upper, qid.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.running import numbered

NUMERIC, CATEGORICAL = "q", "c"
_KINDS = {"int": NUMERIC, "float": NUMERIC, "i": NUMERIC, "q": NUMERIC, "c": CATEGORICAL}
MOST_CODES = 1 << 24


def parse_kind(name: str) -> str:
    if name not in _KINDS:
        raise ValueError(f"unknown feature type: {name}")
    return _KINDS[name]


def present(value: Column, missing: float | None = None) -> Column:
    """null where a value is NaN or the sentinel; zero is a value."""
    value = value.cast("double")
    gone = F.isnan(value) if missing is None else F.isnan(value) | (value == missing)
    return F.when(gone, None).otherwise(value)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    width: int
    names: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    feature_weights: tuple[float, ...] = ()
    extra: dict = field(default_factory=dict)

    def with_columns(self, **columns: Column) -> Frame:
        return replace(self, df=self.df.withColumns(columns))

    def with_labels(self, *labels: Column) -> Frame:
        return self.with_columns(label=F.array(*[c.cast("double") for c in labels]))

    def with_weights(self, weight: Column) -> Frame:
        return self.with_columns(weight=weight.cast("double"))

    def with_margin(self, *margin: Column) -> Frame:
        return self.with_columns(base_margin=F.array(*[c.cast("double") for c in margin]))

    def with_bounds(self, lower: Column, upper: Column) -> Frame:
        got = self.with_columns(label_lower=lower.cast("double"), label_upper=upper.cast("double"))
        if got.df.where("label_lower > label_upper OR isnan(label_lower) OR isnan(label_upper) OR label_lower IS NULL OR label_upper IS NULL").limit(1).count():
            raise ValueError("lower label bounds must not exceed upper ones")
        return got

    def with_qid(self, qid: Column) -> Frame:
        got = self.with_columns(qid=qid)
        if got.df.where("qid IS NULL").limit(1).count():
            raise ValueError("every row needs a query id")
        return got

    def with_names(self, names: Sequence[str]) -> Frame:
        names = tuple(names)
        if names and (len(names) != self.width or len(set(names)) != len(names) or any(set(n) & set("[]<") for n in names)):
            raise ValueError("feature names: one per column, unique, without [ ] <")
        return replace(self, names=names)

    def with_kinds(self, kinds: Sequence[str]) -> Frame:
        kinds = tuple(map(parse_kind, kinds))
        if kinds and len(kinds) != self.width:
            raise ValueError("feature types: one per column")
        return replace(self, kinds=kinds)

    def with_feature_weights(self, weights: Sequence[float]) -> Frame:
        weights = tuple(map(float, weights))
        if len(weights) != self.width or any(not 0 <= w < float("inf") for w in weights):
            raise ValueError("feature weights: finite, not negative, one per column")
        return replace(self, feature_weights=weights)

    def is_categorical(self, f: int) -> bool:
        return bool(self.kinds) and self.kinds[f] == CATEGORICAL

    @property
    def sparse(self) -> bool:
        """Whether rows hold lists of entries instead of a cell for each feature."""
        return "features" not in self.df.columns and "entries" in self.df.columns

    # ---- what a matrix says about itself

    def num_row(self) -> int:
        return self.df.count()

    def num_nonzero(self) -> int:
        """Values that are present (zero is one)."""
        return self.column_sizes().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def is_dense(self) -> bool:
        """Whether every row holds every column."""
        held = F.size("entries") if self.sparse else F.size(F.filter("features", lambda v: v.isNotNull()))
        return not self.df.where(held < self.width).limit(1).count()

    def row(self, row_id: int) -> dict[int, float]:
        """What a row holds, by column."""
        cells = self.df.where(F.col("row_id") == row_id).select(F.explode("entries").alias("e")).select("e.f", "e.v") if self.sparse else self.df.where(F.col("row_id") == row_id).select(F.posexplode("features").alias("f", "v")).where("v IS NOT NULL")
        return {r["f"]: r["v"] for r in cells.collect()}

    def with_group_sizes(self, sizes: Sequence[int]) -> Frame:
        """Query ids from the sizes of successive runs of rows, in the order of row_id."""
        ends = [int(e) for e in itertools.accumulate(sizes)]
        if any(n < 1 for n in sizes) or (ends[-1] if ends else 0) != self.num_row():
            raise ValueError("group sizes must be positive and add up to the rows")
        bounds = self.df.sparkSession.createDataFrame([(i, e - n, e) for i, (e, n) in enumerate(zip(ends, sizes, strict=True))], "qid bigint, __from bigint, __to bigint")
        held = numbered(self.df.drop("qid"), "row_id", "__n")
        # Each query's rows by number: an equi-join, so that no row meets all queries.
        rows = bounds.select("qid", F.explode(F.sequence(F.col("__from"), F.col("__to") - 1)).alias("__n"))
        return replace(self, df=held.join(rows, "__n").drop("__n"))

    def column_sizes(self) -> DataFrame:
        """f, n: the values that each column holds. One pass and one row before it is turned; of a sparse frame, only columns that hold any."""
        if self.sparse:
            return self.df.select(F.explode("entries").alias("e")).groupBy(F.col("e.f").alias("f")).agg(F.count("*").alias("n"))
        counts = self.df.agg(*[F.count(F.get("features", F.lit(i))).alias(f"n{i}") for i in range(self.width)])
        pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"n{i}").alias("n")) for i in range(self.width)])
        return counts.select(F.explode(pairs).alias("p")).select("p.f", "p.n")

    def transposed(self) -> DataFrame:
        """f, row_id, v of every value that is present."""
        if self.sparse:
            return self.df.select("row_id", F.explode("entries").alias("e")).select("e.f", "row_id", "e.v")
        return self.df.select("row_id", F.posexplode("features").alias("f", "v")).where("v IS NOT NULL").select("f", "row_id", "v")

    def column_pages(self, rows_per_batch: int) -> DataFrame:
        """batch, f, rank, row_id, v: each column of each batch of rows (in the order of row_id) by rising value, in the partition of its batch and column."""
        if rows_per_batch < 1:
            raise ValueError("a batch holds one row at least")
        held = numbered(self.df.select("row_id", "entries" if self.sparse else "features"), "row_id", "__n")
        batch = F.floor(F.col("__n") / rows_per_batch).cast("int").alias("batch")
        if self.sparse:
            cells = held.select(batch, "row_id", F.explode("entries").alias("e")).select("batch", "row_id", "e.f", "e.v")
        else:
            cells = held.select(batch, "row_id", F.posexplode("features").alias("f", "v")).where("v IS NOT NULL")
        rank = F.row_number().over(W.partitionBy("batch", "f").orderBy("v", "row_id")) - 1  # of a batch's rows at most
        return cells.select("batch", "f", rank.alias("rank"), "row_id", "v")


def from_dense(df: DataFrame, columns: Sequence[Column | str], row_id: Column | str, missing: float | None = None) -> Frame:
    """Named numeric columns as a frame; keeps df's other columns out."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    got = df.select(of(row_id).cast("bigint").alias("row_id"), F.array(*[present(of(c), missing) for c in columns]).alias("features"), *[c for c in df.columns if c not in ("row_id", "features")])
    names = tuple(c for c in columns if isinstance(c, str))
    return Frame(got.withColumn("weight", F.lit(1.0)), len(columns), names if len(names) == len(columns) else ())


def from_sparse(entries: DataFrame, width: int, missing: float | None = None) -> Frame:
    """row_id, f, v entries as a frame; a column outside the width is an error."""
    if entries.where((F.col("f") < 0) | (F.col("f") >= width)).limit(1).count():
        raise ValueError(f"a column index is not below {width}")
    held = entries.select("row_id", F.col("f").cast("int").alias("f"), present(F.col("v"), missing).alias("v"))
    rows = held.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at(F.col("m"), i))
    return Frame(rows.select("row_id", cells.alias("features"), F.lit(1.0).alias("weight")), width)


def from_long(entries: DataFrame, width: int, rows: DataFrame | None = None, missing: float | None = None) -> Frame:
    """row_id, f, v entries as a sparse frame: a row keeps the list of what it holds (`entries`, by feature), never a cell for each feature.

    rows: row_id and further columns of all rows, also of those without entries. Of entries that name one
    cell twice the largest counts. A column outside the width is an error, which shows when rows are read.
    """
    name = F.when((F.col("f") >= 0) & (F.col("f") < width), F.col("f").cast("int")).otherwise(F.raise_error(F.lit(f"a column index is not below {width}")).cast("int"))
    held = entries.select("row_id", name.alias("f"), present(F.col("v"), missing).alias("v")).where("v IS NOT NULL")
    # Entries move once, to their rows' tasks, where lists are made; of a cell named twice the last of a sorted list is the largest.
    got = held.repartition("row_id").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("e"))
    last = F.filter("e", lambda x, i: (i == F.size("e") - 1) | (F.get("e", i + 1)["f"] != x["f"]))
    got = got.select("row_id", F.when(F.size(F.array_distinct("e.f")) == F.size("e"), F.col("e")).otherwise(last).alias("entries"))
    if rows is not None:
        got = rows.join(got, "row_id", "left")
    empty = F.array().cast("array<struct<f:int,v:double>>")
    return Frame(got.withColumns({"entries": F.coalesce("entries", empty), "weight": F.lit(1.0)}), width)


def parse_libsvm(lines: DataFrame, text: str = "value", row_id: str = "row_id") -> DataFrame:
    """row_id, label, entries (map of index to value), bad (the first bad token or null). Blank lines go."""
    tokens = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda t: t != "")
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    cell = lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).try_cast("int").alias("k"), F.split_part(t, F.lit(":"), F.lit(2)).try_cast("double").alias("v"))
    wrong = lambda t: cell(t)["k"].isNull() | cell(t)["v"].isNull() | (cell(t)["k"] < 0)
    df = lines.where(F.size(tokens) > 0).select(row_id, F.get(tokens, F.lit(0)).alias("__y"), rest.alias("__r"))
    bad = F.coalesce(F.when(F.col("__y").try_cast("double").isNull(), F.col("__y")), F.get(F.filter("__r", wrong), F.lit(0)))
    entries = F.map_from_entries(F.transform(F.filter("__r", lambda t: ~wrong(t)), cell))
    return df.select(row_id, F.col("__y").try_cast("double").alias("label"), entries.alias("entries"), bad.alias("bad"))


def from_libsvm(spark: SparkSession, path: str, width: int | None = None) -> Frame:
    """`label index:value ...` lines; indices are taken as they stand, counted from 0."""
    return from_libsvm_lines(spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id()), width)


def from_libsvm_lines(lines: DataFrame, width: int | None = None) -> Frame:
    """The same of lines at hand: row_id, value."""
    parsed = parse_libsvm(lines)
    bad = parsed.where("bad IS NOT NULL").orderBy("row_id").first()  # the first line of those that are wrong
    if bad:
        raise ValueError(f"row {bad['row_id']}: bad token {bad['bad']!r}")
    if width is None:
        largest = parsed.agg(F.max(F.array_max(F.map_keys("entries"))).alias("m")).first()["m"]
        width = 0 if largest is None else largest + 1
    cells = F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda i: F.try_element_at(F.col("entries"), i)) if width else F.array().cast("array<double>")
    got = parsed.select("row_id", F.transform(cells, lambda v: present(v)).alias("features"), F.array("label").alias("label"), F.lit(1.0).alias("weight"))
    return Frame(got, width)
