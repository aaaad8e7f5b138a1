"""Exact search: every distinct value is a candidate, however many there are."""

import numpy as np
import pytest

from copse.operators import exact
from copse.plans.params import Params
from copse.plans.train import train

from .test_engine import brute_trees, frame_of, margins


@pytest.mark.parametrize("ranges,gone", [(3, 0.0), (16, 0.2), (256, 0.2)])
def test_continuous_columns(spark, monkeypatch, ranges, gone):
    """All values differ, so most candidates lie inside ranges."""
    monkeypatch.setattr(exact, "LEAST_RANGES", ranges)
    rng = np.random.default_rng(int(10 * gone) + ranges)
    x = rng.normal(size=(180, 3))
    x[rng.random(x.shape) < gone] = np.nan
    y = np.sin(3 * np.nan_to_num(x[:, 0])) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=180) * 0.1
    w = rng.uniform(0.5, 3, 180).round(2)
    frame = frame_of(spark, x, y, w)
    got = margins(train({"max_depth": 3, "tree_method": "exact"}, frame, 2), frame)[:, 0]
    assert np.allclose(got, brute_trees(x, y, w, 2, 3), atol=1e-6)


def test_more_values_than_a_histogram_holds(spark):
    """70,000 distinct values: the step between the two halves is found to the value."""
    x = np.arange(70_000.0)[:, None] / 7
    y = (x[:, 0] > x[41_234, 0]).astype(float)
    frame = frame_of(spark, x, y, parts=4)
    model = train({"max_depth": 1, "tree_method": "exact", "eta": 1.0, "lambda": 0.0}, frame, 1)
    root = model.stumps[0].tree.nodes[0]
    assert root.threshold == (x[41_234, 0] + x[41_235, 0]) / 2
    assert np.allclose(margins(model, frame)[:, 0], y)


def test_thresholds_lie_between_the_nodes_own_values(spark, monkeypatch):
    """A node that holds 1 and 5 splits at 3, whatever other nodes hold between."""
    monkeypatch.setattr(exact, "LEAST_RANGES", 2)
    x = np.array([[0, 1], [0, 5], [1, 2], [1, 3], [1, 4], [0, 1], [0, 5]], float)
    y = np.array([0.0, 1, 9, 9, 9, 0, 1])
    model = train({"max_depth": 2, "tree_method": "exact", "min_child_weight": 0, "lambda": 0}, frame_of(spark, x, y), 1)
    tree = model.stumps[0].tree
    assert tree.nodes[0].feature == 0 and tree.nodes[tree.nodes[0].left].threshold == 3.0


def test_directions(spark):
    """Full columns are scanned from above only, unless opt_dense_col or default_direction say otherwise."""
    x = np.arange(8.0)[:, None]
    y = np.array([0.0, 0, 1, 1, 1, 1, 0, 0])  # two equal splits
    cut = lambda **p: train({"max_depth": 1, "tree_method": "exact", "min_child_weight": 0, **p}, frame_of(spark, x, y), 1).stumps[0].tree.nodes[0]
    assert (cut().threshold, cut().default_left) == (5.5, True)
    assert (cut(default_direction="right").threshold, cut(default_direction="right").default_left) == (1.5, False)
    assert "opt_dense_col" not in Params({"tree_method": "exact", "opt_dense_col": 0.5}).unused()


def test_bounds_hold_for_all_penalties():
    """No candidate inside a range beats the range's bound."""
    rng = np.random.default_rng(0)
    for trial in range(60):
        p = exact.Penalty(*rng.choice([0.0, 1.0, 3.0], 2), rng.choice([0.0, 0.5]), 0.0, (int(rng.integers(-1, 2)),) if trial % 3 == 0 else ())
        g, h = rng.integers(-50, 50, 30).astype(float), rng.integers(0, 9, 30).astype(float)
        missing = np.array([float(rng.integers(-20, 20)), float(rng.integers(0, 5)), 2.0])
        total = np.array([g.sum(), h.sum(), 30.0]) + missing
        scan = exact.Scan(0, total, missing, (1.0, 1.0), p, (-np.inf, np.inf) if trial % 2 else (-0.4, 0.7), True, True)
        a, b = sorted(rng.integers(0, 31, 2))
        below = np.array([g[:a].sum(), h[:a].sum(), a])
        part = slice(a, b)
        low = np.array([[np.minimum(g[part], 0).sum()], [0.0]])
        bound = scan.bound(below[:, None], low, np.array([[np.maximum(g[part], 0).sum()], [h[part].sum()]]))[0]
        inside = below[:, None] + np.cumsum(np.stack([g[part], h[part], np.ones(b - a)]), axis=1)
        for forward in (True, False):
            gains = scan.gains(inside + (0 if forward else missing[:, None]))
            assert not len(gains) or gains.max() <= bound + 1e-9


def test_categories_are_refused(spark):
    frame = frame_of(spark, np.array([[5.0], [100.0]]), np.array([0.0, 1.0]), kinds=("c",))
    with pytest.raises(ValueError, match="exact .* hist"):
        train({"tree_method": "exact"}, frame, 1)
