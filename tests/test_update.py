"""One round at a time, and when rows are drawn."""

import random

import pytest

from copse.plans.train import Trainer, train, update
from copse.plans.params import Params
from copse.sources.frame import Frame


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.random()], [rng.random()], 1.0) for i in range(400)]
    return Frame(spark.createDataFrame(rows, "row_id long, features array<double>, label array<double>, weight double"), 2)


def shapes(model):
    return [[(n.feature, round(n.threshold, 6), round(float(n.value), 6), round(n.cover, 4)) for n in s.tree.nodes] for s in model.stumps]


def test_updates_are_the_rounds_of_a_training(frame):
    params = {"max_depth": 2}
    model = train(params, frame, 1)
    for _ in range(2):
        model = update(model, params, frame)
    assert shapes(model) == shapes(train(params, frame, 3)) and [s.round for s in model.stumps] == [0, 1, 2]


def test_each_update_draws_anew(frame):
    params = {"max_depth": 1, "subsample": 0.5, "eta": 0.0001}  # margins hardly change, so like draws would give like trees
    model = train(params, frame, 1)
    for _ in range(2):
        model = update(model, params, frame)
    covers = [s.tree.nodes[0].cover for s in model.stumps]
    assert len(set(covers)) > 1 and all(120 < c < 280 for c in covers)
    again = update(train(params, frame, 1), params, frame, number=0)
    assert again.stumps[0].tree.nodes[0].cover == again.stumps[1].tree.nodes[0].cover


def test_a_share_of_all_rows_draws_nothing(spark, frame):
    grads = frame.df.selectExpr("row_id", "array(1D) AS g", "array(1D) AS h")
    assert Trainer(Params({}), frame).sampled(grads, 1) is grads
    empty = Trainer(Params({"subsample": 0.5}), frame)
    empty.rows = 0
    assert empty.sampled(grads, 1) is grads
    assert Trainer(Params({"subsample": 0.5}), frame).sampled(grads, 1) is not grads
