"""Prediction requests: checks, configurations, and how predictions nest."""

import json

import numpy as np
import pytest

from copse.plans.catalogue import fixed_model, grid_model, vector_model
from copse.plans.model import Model
from copse.plans.predict import InplaceRequest, Request
from copse.sources.frame import Frame

ROWS = [(1, [5.0, 0.01]), (2, [25.0, None]), (3, [None, 0.9])]


@pytest.fixture(scope="module")
def frame(spark):
    return Frame(spark.createDataFrame(ROWS, "row_id long, features array<double>"), 2)


def depth(value):
    return (len(value), *depth(value[0])) if isinstance(value, list) else ()


@pytest.mark.parametrize("make", [fixed_model, grid_model, vector_model])
@pytest.mark.parametrize("kind", ["value", "margin", "contribution", "approx_interaction", "leaf"])
def test_predictions_nest_as_the_shape_says(frame, make, kind):
    model, flat = make(), {}
    for strict in (False, True):
        ask = Request(kind, strict_shape=strict)
        if strict and kind == "leaf" and make is vector_model:
            with pytest.raises(ValueError, match="vector leaves"):
                ask.run(model, frame)
            continue
        got = {r.row_id: r.prediction for r in ask.run(model, frame).select("row_id", "prediction").collect()}
        assert {depth(v) for v in got.values()} == {ask.shape(model)}
        flat[strict] = np.concatenate([np.ravel(got[k]) for k in sorted(got)])
    assert len(flat) == 1 or (flat[False] == flat[True]).all()


def test_one_output_is_a_number_unless_strict():
    model = fixed_model()
    assert Request().shape(model) == () and Request(strict_shape=True).shape(model) == (1,)
    assert Request("contribution").shape(model) == (3,) and Request("contribution", strict_shape=True).shape(model) == (1, 3)
    assert Request("interaction").shape(grid_model()) == (2, 3, 3)
    assert Request("leaf", strict_shape=True).shape(grid_model()) == (2, 2, 2)
    assert Request("leaf", (0, 1), strict_shape=True).shape(grid_model()) == (1, 2, 2)
    uneven = grid_model()
    uneven.stumps.pop()
    with pytest.raises(ValueError, match="grid"):
        Request("leaf", strict_shape=True).check(uneven)


def test_checks_and_configurations():
    assert json.loads(Request("leaf", (0, 3), strict_shape=True).config()) == {"type": 6, "training": False, "iteration_begin": 0, "iteration_end": 3, "strict_shape": True}
    own = json.loads(InplaceRequest("margin", missing=-1.0).config())
    assert own == {"type": 1, "training": False, "iteration_begin": 0, "iteration_end": 0, "missing": -1.0, "strict_shape": False, "cache_id": 0}
    assert np.isnan(json.loads(InplaceRequest().config())["missing"])
    linear = Model("gblinear", "reg:squarederror", {}, 2, 1, [0.0], linear=np.zeros((3, 1)))
    refused = [(Request("else"), None), (Request("leaf", (1, 2)), None), (Request(iterations=(2, 2)), None), (Request("leaf"), linear), (Request(iterations=(0, 1)), linear)]
    refused += [(InplaceRequest("leaf"), None), (InplaceRequest(training=True), None), (InplaceRequest(missing=float("inf")), None), (InplaceRequest(missing=float("nan")), None)]
    for ask, model in refused:
        with pytest.raises(ValueError):
            ask.check(model)
    assert len(Request("leaf", training=True, strict_shape=True).warnings()) == 2 and not Request(training=True).warnings()


def test_in_place(spark):
    """Null, NaN and the sentinel are missing; the table's own columns keep their names; an empty table gives no rows."""
    rows = [(1, 5.0, -9.0, "a"), (2, 5.0, None, "b"), (3, 5.0, float("nan"), None), (4, 5.0, 0.3, "d")]
    df = spark.createDataFrame(rows, "row_id long, features double, `x 1` double, margin string")
    ask, model = InplaceRequest("margin", missing=-9.0), fixed_model()
    got = ask.run_columns(model, df, ["features", "x 1"])
    assert got.columns == [*df.columns, "prediction"]
    out = {r.row_id: (r.margin, round(r.prediction, 9)) for r in got.collect()}
    assert out == {1: ("a", 1.6), 2: ("b", 1.6), 3: (None, 1.6), 4: ("d", -0.4)}
    assert ask.run_columns(model, df.limit(0), ["features", "x 1"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        ask.run_columns(model, got, ["features", "x 1"])
