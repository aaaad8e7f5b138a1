import math

import numpy as np
import pytest

from copse.functions import objectives
from copse.operators.split import Penalty, best_split
from copse.plans.params import Params
from copse.plans.train import train
from copse.sources.frame import Frame


def test_default_direction():
    # Bins of one feature, and two rows without a value whose gradients are like those of the lower bin.
    g, h, n = np.array([[[4.0, -4.0]]]), np.array([[[2.0, 2.0]]]), np.array([[2, 2]])
    cuts, total = [np.array([0.5, 1.5])], ([4.0], [6.0])
    by = {d: best_split(g, h, n, total, 6, cuts, Penalty(direction=d), [0]) for d in ("learn", "left", "right")}
    assert by["learn"].default_left and by["left"].default_left and not by["right"].default_left
    assert by["right"].gain < by["left"].gain == by["learn"].gain
    # Left holds where nothing is missing, too.
    full = best_split(g, h, n, ([0.0], [4.0]), 4, cuts, Penalty(direction="left"), [0])
    assert full.default_left and full.threshold == 0.5


def test_default_direction_reaches_exact(spark):
    rows = [(i, [None if i % 3 == 0 else float(i % 3)], [5.0 if i % 3 == 2 else 0.0], 1.0) for i in range(30)]
    frame = Frame(spark.createDataFrame(rows, "row_id long, features array<double>, label array<double>, weight double"), 1)
    for direction, left in (("learn", True), ("left", True), ("right", False)):
        model = train({"tree_method": "exact", "max_depth": 1, "default_direction": direction}, frame, 1)
        assert model.stumps[0].tree.nodes[0].default_left == left


def test_ndcg_plain_gain(spark):
    y, s = [3.0, 0.0, 2.0], [0.1, 0.9, 0.5]
    df = spark.createDataFrame([("q", i, s[i], y[i]) for i in range(3)], "q string, i long, m double, y double")
    rank = sorted(range(3), key=lambda i: -s[i])
    d = lambda r: 1 / math.log2(r + 2)
    for exp in (True, False):
        gain = (lambda v: 2**v - 1) if exp else (lambda v: v)
        ideal = sum(gain(v) * d(r) for r, v in enumerate(sorted(y, reverse=True)))
        got = {(r.hi, r.lo): r["lambda"] for r in objectives.rank_pairs(df, "ndcg", "m", "y", "q", "i", normalise_scores=False, exp_gain=exp).collect()}
        for (a, b), value in got.items():
            delta = abs((gain(y[a]) - gain(y[b])) * (d(rank.index(a)) - d(rank.index(b)))) / ideal
            assert value == pytest.approx((1 / (1 + math.exp(-(s[a] - s[b]))) - 1) * delta)
        assert len(got) == 3


def test_refused_and_unused():
    with pytest.raises(ValueError, match="max_row_perbatch"):
        Params({"booster": "gblinear", "max_row_perbatch": 0})
    assert not Params({"booster": "gblinear", "max_row_perbatch": 50}).unused()
    assert Params({"booster": "gblinear", "linear_updater": "coord_descent", "max_row_perbatch": 50}).unused() == ["max_row_perbatch"]
    assert Params({"default_direction": "left"}).unused() == ["default_direction"] and not Params({"default_direction": "left", "tree_method": "exact"}).unused()
