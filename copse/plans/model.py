"""Models: prediction, explanation, importances, and storage."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import objectives
from ..functions.scalar import num, sigmoid, softmax
from ..operators import explain, linear, sparse
from ..operators.grow import cells_of, unpack_cells
from ..operators.tree import Tree
from ..sources.frame import Frame

KINDS = ("value", "margin", "leaf", "contribution", "approx_contribution", "interaction", "approx_interaction")
TREES = (
    "tree_id int, grp int, round int, tree_weight double, node int, parent int, lft int, rgt int, split_index int, threshold double, default_left boolean, "
    "cats array<int>, leaf_value array<double>, gain double, cover double, base_weight array<double>, deleted boolean"
)


def choose_dropped(trees: list, p: dict, rng: random.Random) -> list:
    """The trees that a dart round, or a prediction as in training, leaves out: one draw a tree."""
    if not trees or rng.random() < p.get("skip_drop", 0.0):
        return []
    rate, total = p.get("rate_drop", 0.0), sum(s.weight for s in trees)
    share = lambda s: rate * len(trees) * s.weight / total if p.get("sample_type") == "weighted" and total else rate
    out = [s for s in trees if rng.random() < share(s)]
    return out or ([rng.choice(trees)] if p.get("one_drop") else [])


@dataclass
class Stump:
    """A tree of an ensemble with its output, its weight and the round that made it."""

    tree: Tree
    group: int
    weight: float = 1.0
    round: int = 0


def wide(column: pa.Array, width: int) -> np.ndarray:
    """(rows, features) of a column of arrays, NaN where missing."""
    flat = column.flatten().cast(pa.float64())
    return flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(column), width)


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return wide(batch.column(column), width)


def arrays(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def leaf_finder(cells: pa.Array, width: int, by_bins: bool, layout=None):
    """What gives the leaves of a tree for the rows of a column: dense or sparse, of bins or of values."""
    if layout is not None:  # sparse bins
        rows, own = sparse.cells_in_order(cells)
        return lambda tree: sparse.walk(tree, len(cells), lambda f: layout.column(rows, own, f), True)
    if pa.types.is_list(cells.type) and pa.types.is_struct(cells.type.value_type):
        column = sparse.value_column(cells)
        return lambda tree: sparse.walk(tree, len(cells), column, False)
    x = unpack_cells(cells_of(cells, width)) if by_bins else wide(cells, width)
    return lambda tree: tree.leaves_by_bin(x) if by_bins else tree.leaves(x)


def add_margin(df: DataFrame, stumps: list[Stump], width: int, outputs: int, by_bins: bool = False, column: str = "margin", layout=None) -> DataFrame:
    """df with weighted leaf values added to its margin array; every other column passes through. layout: of the cells of sparse rows' bins."""
    if not stumps:
        return df

    tables = [s.tree.values() * s.weight for s in stumps]

    # Only the margin and what is walked go to Python; the other columns stay where they are.
    @F.arrow_udf("array<double>")
    def added(margin: pa.Array, cells: pa.Array) -> pa.Array:
        m = np.array(margin.flatten().to_numpy(zero_copy_only=False)).reshape(len(margin), outputs)
        if len(margin):
            leaves = leaf_finder(cells, width, by_bins, layout)
            for s, table in zip(stumps, tables, strict=True):
                values = table[leaves(s.tree)]
                if values.shape[1] == outputs and outputs > 1:
                    m += values
                else:
                    m[:, s.group] += values[:, 0]
        return arrays(m)

    return df.withColumn(column, added(F.col(column), F.col("bins" if by_bins else "features" if "features" in df.columns else "entries")))


@dataclass
class Model:
    booster: str
    objective: str
    objective_params: dict
    width: int
    outputs: int
    base_score: list[float]  # as margins
    stumps: list[Stump] = field(default_factory=list)
    linear: np.ndarray | None = None  # (width + 1, outputs)
    names: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    history: list[tuple[int, str, str, float]] = field(default_factory=list)
    best_iteration: int | None = None
    best_score: float | None = None

    @property
    def rounds(self) -> int:
        return max((s.round for s in self.stumps), default=-1) + 1

    @property
    def num_trees(self) -> int:
        return len(self.stumps)

    def in_range(self, iterations: tuple[int, int] = (0, 0)) -> list[Stump]:
        lo, hi = iterations
        if lo == hi == 0:
            return self.stumps
        hi = hi or self.rounds
        if not 0 <= lo < hi <= self.rounds:
            raise ValueError(f"iteration range {iterations} is not within {self.rounds} rounds")
        return [s for s in self.stumps if lo <= s.round < hi]

    def check_features(self, frame: Frame) -> None:
        if frame.width != self.width:
            raise ValueError(f"{frame.width} features given, {self.width} expected")
        if self.names and frame.names and self.names != frame.names:
            raise ValueError("feature names differ from those of training")

    def start(self, df: DataFrame) -> DataFrame:
        """df with the margin array before any tree: base_margin where there is one, else the base score."""
        base = F.array(*map(num, self.base_score))
        if "base_margin" in df.columns:
            given = F.col("base_margin")
            spread = F.when(F.size(given) == self.outputs, given).when(F.size(given) == 1, F.array_repeat(F.get(given, F.lit(0)), self.outputs)).otherwise(base)
            base = F.coalesce(spread, base)
        return df.withColumn("margin", base)

    def margins(self, frame: Frame, iterations=(0, 0), stumps: list[Stump] | None = None) -> DataFrame:
        df = self.start(frame.df)
        if self.booster == "gblinear":
            return self.add_linear(df)
        return add_margin(df, self.in_range(iterations) if stumps is None else stumps, self.width, self.outputs)

    def add_linear(self, df: DataFrame) -> DataFrame:
        """df with the linear part added to its margin."""
        if "features" in df.columns and self.width <= linear.MOST:
            return df.withColumn("margin", self.linear_margin(F.col("features"), F.col("margin")))
        weights, outputs = self.linear, self.outputs

        # Too many weights for an expression: they go to the tasks with the function.
        @F.arrow_udf("array<double>")
        def added(margin: pa.Array, cells: pa.Array) -> pa.Array:
            m = np.array(margin.flatten().to_numpy(zero_copy_only=False)).reshape(len(margin), outputs) + weights[-1]
            if len(m):
                row, f, v = linear.entries_of(pa.RecordBatch.from_arrays([cells], names=["entries" if pa.types.is_struct(cells.type.value_type) else "features"]))
                for k in range(outputs):
                    m[:, k] += np.bincount(row, v * weights[f, k], len(m))
            return arrays(m)

        return df.withColumn("margin", added(F.col("margin"), F.col("features" if "features" in df.columns else "entries")))

    def linear_margin(self, x: Column, start: Column) -> Column:
        out = []
        for k in range(self.outputs):
            w = F.array(*[num(v) for v in self.linear[:-1, k]])
            dot = F.aggregate(F.zip_with(x, w, lambda v, c: F.coalesce(v * c, num(0))), num(0), lambda a, v: a + v)
            out.append(F.get(start, F.lit(k)) + dot + float(self.linear[-1, k]))
        return F.array(*out)

    def transform(self, margin: Column) -> Column:
        """Margins to predictions, both arrays."""
        o = self.objective
        if o == "multi:softprob":
            return softmax(margin)
        if o == "multi:softmax":
            return F.array((F.array_position(margin, F.array_max(margin)) - 1).cast("double"))
        if o == "reg:quantileerror":
            return F.sort_array(margin)
        if o == "reg:expectileerror":
            return objectives.expectile_transform(margin, self.outputs)
        if o in ("reg:logistic", "binary:logistic"):
            return F.transform(margin, sigmoid)
        return F.transform(margin, objectives.create(o, **self.objective_params).transform)

    def eval_transform(self, margin: Column) -> Column:
        if self.objective == "multi:softmax":
            return softmax(margin)
        return margin if self.objective == "survival:aft" else self.transform(margin)

    def predict(self, frame: Frame, kind: str = "value", iterations=(0, 0), validate_features: bool = True, training: bool = False, seed: int = 0) -> DataFrame:
        """frame's DataFrame with a `prediction` column: an array, nested for attributions."""
        if kind not in KINDS:
            raise ValueError(f"unknown prediction: {kind}")
        if training and kind not in ("value", "margin"):
            raise ValueError("training applies to value and margin only")
        if validate_features:
            self.check_features(frame)
        if kind in ("value", "margin"):
            stumps = None
            if training and self.booster == "dart":
                stumps = self.in_range(iterations)
                dropped = {id(s) for s in choose_dropped(stumps, self.objective_params, random.Random(seed))}
                stumps = [s for s in stumps if id(s) not in dropped]
            df = self.margins(frame, iterations, stumps)
            return df.withColumn("prediction", self.transform(F.col("margin")) if kind == "value" else F.col("margin")).drop("margin")
        if self.booster == "gblinear" and not frame.sparse:
            return self._linear_parts(frame, kind)
        if frame.sparse and (kind != "leaf" or self.booster == "gblinear"):
            raise ValueError(f"{kind} gives a number for each feature; make the frame dense (from_sparse) for it")
        stumps, width, outputs = self.in_range(iterations), self.width, self.outputs
        df = self.start(frame.df)
        shape = {"leaf": "array<bigint>"}.get(kind, "array<array<double>>" if "contribution" in kind else "array<array<array<double>>>")
        from pyspark.sql import types as T

        schema = T.StructType([*df.schema.fields, T.StructField("prediction", T._parse_datatype_string(shape))])

        def attribute(x, k, hidden=None):
            out = np.zeros((len(x), width + 1))
            for s in stumps:
                if s.group != k and len(np.atleast_1d(s.tree.nodes[0].value)) == 1:
                    continue
                out += s.weight * (explain.saabas(s.tree, x, k, hidden) if kind.startswith("approx") else explain.shap(s.tree, x, k, hidden))
            return out

        def run(batches):
            for batch in batches:
                if kind == "leaf":
                    leaves = leaf_finder(batch.column(batch.schema.names.index("features" if "features" in batch.schema.names else "entries")), width, False)
                    got = np.stack([leaves(s.tree) for s in stumps], axis=1) if stumps else np.zeros((batch.num_rows, 0), np.int64)
                else:
                    x = matrix(batch, "features", width)
                    base = np.array(batch.column("margin").flatten()).reshape(len(x), outputs)
                    parts = []
                    for k in range(outputs):

                        def one(hidden, k=k):
                            a = attribute(x, k, hidden)
                            a[:, -1] += base[:, k]
                            return a

                        parts.append(one(None) if "contribution" in kind else explain.interactions(one, width))
                    got = np.stack(parts, axis=1)
                column = pa.array(got.tolist(), pa_type(schema["prediction"].dataType))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "prediction"])

        return df.mapInArrow(run, schema).drop("margin")

    def _linear_parts(self, frame: Frame, kind: str) -> DataFrame:
        if kind == "leaf":
            raise ValueError("a linear model has no leaves")
        df = self.start(frame.df)
        rows = []
        for k in range(self.outputs):
            w = F.array(*[num(v) for v in self.linear[:-1, k]])
            own = F.zip_with("features", w, lambda v, c: F.coalesce(v * c, num(0)))
            parts = F.array_append(own, F.get("margin", F.lit(k)) + float(self.linear[-1, k]))
            if "interaction" in kind:
                parts = F.transform(parts, lambda v, i: F.transform(F.sequence(F.lit(0), F.lit(self.width)), lambda j: F.when(i == j, v).otherwise(num(0))))  # noqa: B023
            rows.append(parts)
        return df.withColumn("prediction", F.array(*rows)).drop("margin")

    # ---- importances and storage

    def trees_table(self, spark) -> DataFrame:
        """A row for each node of each tree."""
        rows = []
        for t, s in enumerate(self.stumps):
            for i, n in enumerate(s.tree.nodes):
                vec = lambda v: [float(x) for x in np.atleast_1d(v)]
                rows.append((t, s.group, s.round, float(s.weight), i, n.parent, n.left, n.right, n.feature, float(n.threshold), bool(n.default_left), sorted(n.categories) if n.categories is not None else None, vec(n.value), float(n.gain), float(n.cover), vec(n.weight), n.deleted))
        return spark.createDataFrame(rows, TREES)

    def scores(self, spark, kind: str = "weight") -> dict[str, float]:
        """Importances by feature; features that no split uses are absent."""
        key = lambda f: self.names[f] if self.names else f"f{f}"
        if self.booster == "gblinear":
            if kind != "weight":
                raise ValueError("a linear model has only the importance weight")
            return {key(f): float(self.linear[f, 0]) for f in range(self.width)}
        return {key(r["split_index"]): r[kind] for r in importance(self.trees_table(spark), kind).collect()}

    def save_trees(self, spark, path: str) -> None:
        self.trees_table(spark).write.parquet(path)

    def to_json(self) -> str:
        head = {
            "booster": self.booster, "objective": self.objective, "objective_params": {k: v for k, v in self.objective_params.items() if v is not None}, "num_feature": self.width, "num_output": self.outputs,
            "base_margin": list(map(float, self.base_score)), "feature_names": list(self.names), "feature_types": list(self.kinds), "best_iteration": self.best_iteration, "best_score": self.best_score,
        }
        if self.linear is not None:
            body = {"weights": self.linear.ravel().tolist()}
        else:
            body = {"trees": [s.tree.to_json(i) for i, s in enumerate(self.stumps)], "tree_info": [s.group for s in self.stumps], "weight_drop": [s.weight for s in self.stumps], "rounds": [s.round for s in self.stumps]}
        return json.dumps({"learner": head, "model": body}, allow_nan=True)

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        h, b = d["learner"], d["model"]
        m = cls(h["booster"], h["objective"], h["objective_params"], h["num_feature"], h["num_output"], h["base_margin"], names=tuple(h["feature_names"]), kinds=tuple(h["feature_types"]), best_iteration=h["best_iteration"], best_score=h["best_score"])
        if "weights" in b:
            m.linear = np.array(b["weights"]).reshape(m.width + 1, m.outputs)
        else:
            m.stumps = [Stump(Tree.from_json(t), g, w, r) for t, g, w, r in zip(b["trees"], b["tree_info"], b["weight_drop"], b["rounds"], strict=True)]
        return m


def pa_type(kind):
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    return pa.int64() if isinstance(kind, T.LongType) else pa.float64()


def importance(trees: DataFrame, kind: str) -> DataFrame:
    """split_index and the importance of each feature that splits."""
    value = {"weight": F.count("*").cast("double"), "total_gain": F.sum("gain"), "gain": F.sum("gain") / F.count("*"), "total_cover": F.sum("cover"), "cover": F.sum("cover") / F.count("*")}
    if kind not in value:
        raise ValueError(f"unknown importance: {kind}")
    return trees.where("lft >= 0 AND NOT deleted").groupBy("split_index").agg(value[kind].alias(kind))
