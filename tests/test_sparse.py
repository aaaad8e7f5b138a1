"""Sparse frames give the trees of dense ones, and no row is as wide as the features."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import sparse
from copse.operators.cuts import Summary, bin_array, summary_budget
from copse.plans.train import train
from copse.sources.frame import from_long

from .test_engine import frame_of, margins


def both(spark, x, y, w=None, parts=3, **more):
    """The same rows as a dense and a sparse frame."""
    w = np.ones(len(x)) if w is None else w
    cells = [(int(i), int(f), float(x[i, f])) for i, f in zip(*np.nonzero(~np.isnan(x)), strict=True)]
    rows = spark.createDataFrame([(i, [float(v) for v in np.atleast_1d(y[i])], float(w[i])) for i in range(len(x))], "row_id long, label array<double>, w double")
    entries = spark.createDataFrame(cells, "row_id long, f int, v double").repartition(parts)
    held = from_long(entries, x.shape[1], rows).with_weights(F.col("w"))
    if more.get("kinds"):
        held = held.with_kinds(more["kinds"])
    return frame_of(spark, x, y, w, parts, **more), held


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(260, 12)), 1)
    x[rng.random(x.shape) < 0.8] = np.nan
    x[:5] = np.nan  # rows that hold nothing
    y = np.nan_to_num(2 * x[:, 0] - x[:, 3]) + np.isnan(x[:, 5]) + rng.normal(size=260) * 0.1
    return x, y, rng.uniform(0.5, 2, 260).round(2)


@pytest.mark.parametrize("params", [
    {"max_depth": 4}, {"grow_policy": "lossguide", "max_leaves": 6, "max_depth": 0}, {"tree_method": "approx", "max_depth": 2, "monotone_constraints": (1, 0, 0, -1)},
    {"max_depth": 3, "interaction_constraints": [[0, 3], [1, 5, 6]], "colsample_bytree": 0.7}, {"booster": "dart", "rate_drop": 0.5, "one_drop": True, "max_depth": 2, "max_bin": 4, "min_child_weight": 6},
])
def test_like_dense(spark, rows, params):
    dense, held = both(spark, *rows)
    assert held.sparse and not dense.sparse
    a, b = train(params, dense, 2), train(params, held, 2)
    assert np.allclose(margins(a, dense), margins(b, held), atol=1e-9)
    trees = [[(n.feature, n.threshold, n.default_left) for n in s.tree.nodes if not n.leaf] for m in (a, b) for s in m.stumps]
    half = len(trees) // 2
    assert trees[:half] == trees[half:]


def test_outputs_and_categories(spark, rows):
    x, y, w = rows
    codes = np.where(np.isnan(x[:, 2:3]), np.nan, np.abs(np.round(x[:, 2:3] * 3)))
    x = np.hstack([x[:, :2], codes])
    for params, label in (({"max_depth": 3}, y), ({"max_depth": 3, "multi_strategy": "multi_output_tree"}, np.stack([y, -2 * y], axis=1)), ({"objective": "multi:softprob", "num_class": 3, "max_depth": 2}, (np.abs(y) * 2 % 3).astype(int))):
        dense, held = both(spark, x, label, w, kinds=("q", "q", "c"))
        assert np.allclose(margins(train(params, dense, 2), dense), margins(train(params, held, 2), held), atol=1e-9)


def test_continue_and_leaves(spark, rows):
    dense, held = both(spark, *rows)
    a, b = train({"max_depth": 2}, dense, 2), train({"max_depth": 2}, held, 2)
    a, b = train({"max_depth": 2}, dense, 1, base=a), train({"max_depth": 2}, held, 1, [("train", held)], base=b)
    assert np.allclose(margins(a, dense), margins(b, held)) and len(b.history) == 1
    leaf = lambda m, f: [r["prediction"] for r in m.predict(f, "leaf").orderBy("row_id").collect()]
    assert leaf(a, dense) == leaf(b, held)
    with pytest.raises(ValueError, match="dense"):
        b.predict(held, "contribution")
    with pytest.raises(ValueError, match="sparse"):
        train({"tree_method": "exact"}, held, 1)
    assert {(r["f"], r["n"]) for r in held.column_sizes().collect()} == {(f, int(n)) for f, n in enumerate((~np.isnan(rows[0])).sum(axis=0))}
    assert {tuple(r) for r in held.transposed().collect()} == {tuple(r) for r in dense.transposed().collect()}


def test_many_features(spark, monkeypatch):
    """A hundred thousand features: chunks are searched apart, and partitioning does not matter."""
    rng = np.random.default_rng(7)
    n, width = 4000, 100_000
    f = rng.integers(0, width, (n, 6))
    f[:, 0] = np.where(rng.random(n) < 0.5, 77_777, 12)
    y = np.where(f[:, 0] == 77_777, 3.0, 0.0)
    entries = spark.createDataFrame([(i, int(k), float(1 + k % 3)) for i in range(n) for k in f[i]], "row_id long, f int, v double")
    rows = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "row_id long, y double")
    models = [train({"max_depth": 2, "eta": 1.0, "lambda": 0.0}, from_long(entries.repartition(p), width, rows).with_labels(F.col("y")), 1) for p in (2, 5)]
    assert json.loads(models[0].to_json())["model"] == json.loads(models[1].to_json())["model"]
    assert models[0].stumps[0].tree.nodes[0].feature in (12, 77_777)
    got = models[0].predict(from_long(entries, width, rows), "margin").orderBy("row_id").collect()
    assert np.allclose([r["prediction"][0] for r in got], y)


def test_odd_entries(spark):
    entries = spark.createDataFrame([(1, 0, 2.0), (1, 0, 5.0), (2, 1, float("nan")), (3, 1, None), (4, 2, -1.0)], "row_id long, f int, v double")
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "row_id long")
    got = {r["row_id"]: [tuple(e) for e in r["entries"]] for r in from_long(entries, 3, rows, missing=-1.0).df.collect()}
    assert got == {1: [(0, 5.0)], 2: [], 3: [], 4: [], 5: []}
    with pytest.raises(Exception, match="not below 2"):
        from_long(entries, 2).df.collect()


def test_lists_of_cells():
    """Sums of lists, and columns of a block."""
    index, sums = sparse.summed(np.array([5, 2, 5]), np.array([[1, 2, 3]]))
    assert index.tolist() == [2, 5] and sums.tolist() == [[2, 4]]
    layout = sparse.Layout([np.arange(3.0), np.arange(2.0), np.arange(4.0)])
    assert layout.feature(np.array([0, 2, 3, 5, 8])).tolist() == [0, 0, 1, 2, 2]
    assert [c.tolist() for c in layout.column(np.array([7, 1, 3]), np.array([1, 3, 4]), 1)] == [[1, 3], [0, 1]]


def test_what_a_matrix_says(spark, rows):
    dense, held = both(spark, *rows)
    for frame in (dense, held):
        assert frame.num_nonzero() == int((~np.isnan(rows[0])).sum()) and not frame.is_dense()
        assert frame.row(20) == {f: v for f, v in enumerate(rows[0][20].tolist()) if not np.isnan(v)}
    assert frame_of(spark, np.ones((3, 2)), np.ones(3)).is_dense()
    got = dense.with_group_sizes([100, 1, 159]).df.groupBy("qid").agg(F.min("row_id"), F.max("row_id"), F.count("*")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 99, 100), (1, 100, 100, 1), (2, 101, 259, 159)]
    for wrong in ([100, 160, 1], [260, 0], []):
        with pytest.raises(ValueError, match="group sizes"):
            dense.with_group_sizes(wrong)


@pytest.mark.parametrize("params", [{"max_depth": 3}, {"tree_method": "approx", "max_depth": 2, "objective": "reg:squaredlogerror", "base_score": 1.0}])
def test_more_cuts_than_tasks_hold(spark, rows, monkeypatch, params):
    """Entries go to where their features' cuts are, and the trees are those of dense rows."""
    x, y, w = rows
    dense, held = both(spark, x, np.abs(y), w)
    want = train(params, dense, 2)
    for name, value in (("MOST_CUTS", 60), ("TOGETHER", 2), ("FEW", 15), ("MOST_SENT", 30), ("ADDED", 2), ("MANY_TASKS", 1)):
        monkeypatch.setattr(sparse, name, value)
    got = train(params, held, 2)
    trees = [[[(n.feature, n.threshold, n.default_left) for n in s.tree.nodes if not n.leaf] for s in m.stumps] for m in (want, got)]
    assert trees[0] == trees[1]
    assert np.allclose(margins(want, dense), margins(got, held), atol=1e-9)


def test_cuts_at_hand_and_in_a_table(spark, rows, monkeypatch):
    """Cuts of a table are those of all at hand, also of categories, of many values and of features that no row holds."""
    x, y, w = rows
    x = np.hstack([x[:, :2], np.abs(np.round(x[:, 2:3] * 3)), np.full((len(x), 1), np.nan), x[:, 3:4]])
    _, held = both(spark, x, y, w, kinds=("q", "q", "c", "q", "q"))
    rows_ = sparse.packed(held.df).persist()
    for max_bin in (30, 256):
        want = [feature_cuts_of(x[:, f], w, max_bin, f == 2, len(x)) for f in range(5)]
        for most in (0, 25, 1 << 20):
            monkeypatch.setattr(sparse, "MOST_CUTS", most)
            monkeypatch.setattr(sparse, "TOGETHER", 3)
            monkeypatch.setattr(sparse, "FEW", 30)
            cuts = sparse.sparse_cuts(rows_, 5, max_bin, [2], n=len(x))
            assert cuts.whole == (most == 1 << 20) and [len(c) for c in want] == cuts.sizes.tolist()
            assert all(np.array_equal(cuts[f], want[f]) for f in range(5))
            cells = {r["row_id"]: sorted(np.frombuffer(r["bins"], "<i4").tolist()) for r in sparse.row_cells(rows_, sparse.Layout(cuts, [2]), cuts).collect()}
            edges = np.cumsum([0, *map(len, want)])
            expected = {i: sorted(int(edges[f] + bin_array(x[i, f : f + 1], want[f], f == 2)[0]) for f in np.flatnonzero(~np.isnan(x[i]))) for i in range(len(x))}
            assert cells == {i: c for i, c in expected.items() if c}
            cuts.unpersist()
    rows_.unpersist()


def feature_cuts_of(v, w, max_bin, category, n):
    ok = ~np.isnan(v)
    return np.arange(v[ok].max() + 1) if category else Summary.exact(v[ok], w[ok]).prune(summary_budget(max_bin, n)).cuts(max_bin)
