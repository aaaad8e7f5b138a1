"""Scoring of streams, and training on their batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from ..plans.model import Model
from ..plans.train import train
from ..sources.frame import Frame


def score(model: Model, frame: Frame, kind: str = "value") -> DataFrame:
    """A streaming frame's rows with predictions. Stateless, so no watermark is needed."""
    return model.predict(frame, kind)


def continue_training(model: Model | None, params: dict, as_frame: Callable[[DataFrame], Frame], rounds: int = 1):
    """A foreachBatch function that boosts a model further on each batch; held.model is the latest."""

    class Held:
        def __init__(self):
            self.model = model

        def __call__(self, batch: DataFrame, number: int) -> None:
            frame = as_frame(batch)
            if not frame.df.limit(1).count():
                return
            p = {**params, "seed": int(params.get("seed", 0)) + number}
            self.model = train(p, replace(frame), rounds, base=self.model)

    return Held()
