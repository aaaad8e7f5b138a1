"""Prediction requests: what is checked before a prediction runs, its public configuration, and how its arrays nest."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frame import Frame, present
from .model import KINDS, Model

#: The public codes of the kinds of prediction.
CODES = {"value": 0, "margin": 1, "contribution": 2, "approx_contribution": 3, "interaction": 4, "approx_interaction": 5, "leaf": 6}


@dataclass(frozen=True)
class Request:
    """A prediction of a frame. `prediction` of the result nests as `shape` says: by row, without the number of rows.

    Without strict_shape, values and margins of one output are plain numbers, attributions of one output have no
    level for it, and leaves are one list. With it, outputs are always a level, and leaves nest by round,
    output and parallel tree; models of vector leaves are refused there, since their trees have no output.
    """

    kind: str = "value"
    iterations: tuple[int, int] = (0, 0)
    training: bool = False
    strict_shape: bool = False
    validate_features: bool = True
    seed: int = 0

    def check(self, model: Model | None = None) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown prediction: {self.kind}")
        begin, end = self.iterations
        if begin < 0 or end < 0 or (end and begin >= end):
            raise ValueError(f"iteration range {self.iterations} is empty or negative")
        if self.kind == "leaf" and begin:
            raise ValueError("leaves can leave out last rounds only: the range must begin at 0")
        if model is None:
            return
        if model.booster == "gblinear":
            if self.kind == "leaf":
                raise ValueError("a linear model has no leaves")
            if (begin, end) != (0, 0):
                raise ValueError("a linear model has no rounds to choose from")
        if self.kind == "leaf" and self.strict_shape:
            self.layout(model)

    def warnings(self) -> list[str]:
        found = []
        if self.training and self.kind not in ("value", "margin"):
            found.append("training holds for values and margins only and is ignored here")
        if self.strict_shape and self.kind == "leaf":
            found.append("strict leaves are refused for models with vector leaves")
        return found

    def config(self) -> str:
        """The public JSON configuration of the request."""
        return json.dumps({"type": CODES[self.kind], "training": self.training, "iteration_begin": self.iterations[0], "iteration_end": self.iterations[1], "strict_shape": self.strict_shape})

    def layout(self, model: Model) -> tuple[int, int, int]:
        """(rounds, outputs, parallel trees) of the trees in range, which must fill that grid in this order."""
        stumps = model.in_range(self.iterations)
        if any(np.size(n.value) > 1 for s in stumps for n in s.tree.nodes):
            raise ValueError("vector leaves have no strict shape")
        rounds = len({s.round for s in stumps})
        parallel = len(stumps) // max(rounds * model.outputs, 1)
        first = min((s.round for s in stumps), default=0)
        grid = [(first + a, b) for a in range(rounds) for b in range(model.outputs) for _ in range(parallel)]
        if [(s.round, s.group) for s in stumps] != grid:
            raise ValueError("the trees do not fill a grid of rounds, outputs and parallel trees")
        return rounds, model.outputs, parallel

    def shape(self, model: Model) -> tuple[int, ...]:
        """The levels of one row's prediction; () is a plain number."""
        if self.kind == "leaf":
            return self.layout(model) if self.strict_shape else (len(model.in_range(self.iterations)),)
        outputs = 1 if self.kind == "value" and model.objective == "multi:softmax" else model.outputs
        return (outputs, *self.inner(model)) if self.strict_shape or outputs > 1 else self.inner(model)

    def nested(self, model: Model, got: Column) -> Column:
        """got, as the model gives it (outputs are a level, leaves are flat), in this request's shape."""
        if self.kind != "leaf":
            return F.get(got, F.lit(0)) if self.shape(model) == self.inner(model) else got
        if not self.strict_shape:
            return got
        rounds, outputs, parallel = self.layout(model)
        if not parallel:  # no trees
            return F.transform(got, lambda leaf: F.array(F.array(leaf)))

        def cut(x, n, parts):
            return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(x, k * n + 1, F.lit(n)))

        return F.transform(cut(got, outputs * parallel, rounds), lambda one: cut(one, parallel, outputs))

    def inner(self, model: Model) -> tuple[int, ...]:
        """The shape below the level of outputs."""
        return () if self.kind in ("value", "margin") else (model.width + 1,) * (1 if "contribution" in self.kind else 2)

    def run(self, model: Model, frame: Frame) -> DataFrame:
        """frame's rows with their predictions."""
        self.check(model)
        training = self.training and self.kind in ("value", "margin")
        got = model.predict(frame, self.kind, self.iterations, self.validate_features, training, self.seed)
        return got.withColumn("prediction", self.nested(model, F.col("prediction")))


@dataclass(frozen=True)
class InplaceRequest(Request):
    """A prediction of plain columns, without a frame: values and margins only. missing: the number that stands for none; NaN and null always do."""

    missing: float | None = None

    def check(self, model: Model | None = None) -> None:
        super().check(model)
        if self.kind not in ("value", "margin"):
            raise ValueError(f"in-place prediction gives values and margins only, not {self.kind}")
        if self.training:
            raise ValueError("in-place prediction has no training form")
        if self.missing is not None and not math.isfinite(self.missing):
            raise ValueError("missing must be finite; NaN is missing without being named")

    def config(self) -> str:
        own = json.loads(super().config())
        strict = own.pop("strict_shape")
        return json.dumps({**own, "missing": float("nan") if self.missing is None else self.missing, "strict_shape": strict, "cache_id": 0})

    def run_columns(self, model: Model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """df's columns and `prediction`, whatever else they are called."""
        self.check(model)
        if "prediction" in df.columns:
            raise ValueError("the table has a column prediction already")
        if self.validate_features and model.names and tuple(columns) != model.names:
            raise ValueError("feature names differ from those of training")
        cells = F.array(*[present(F.col(f"`{c}`"), self.missing) for c in columns])
        inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), cells.alias("features"))
        return self.run(model, Frame(inner, len(columns))).select("row.*", "prediction")
