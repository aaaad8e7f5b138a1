"""Linear models in blocks of features: the weights of the whole square, and any number of features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.operators import linear
from copse.plans.train import train
from copse.sources.frame import from_long

from .test_engine import frame_of, margins
from .test_sparse import both


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 7))
    x[rng.random(x.shape) < 0.5] = np.nan
    return x, np.stack([np.nan_to_num(x) @ np.arange(7.0) + 1, np.nan_to_num(x[:, 0])], axis=1), rng.uniform(0.5, 2, 80).round(2)


@pytest.mark.parametrize("selector", ["cyclic", "shuffle", "random", "thrifty"])
def test_blocks_like_the_whole(spark, monkeypatch, rows, selector):
    x, y, w = rows
    dense, sparse = both(spark, x, y, w)
    params = {"booster": "gblinear", "linear_updater": "coord_descent", "feature_selector": selector, "lambda": 0.05, "alpha": 0.01, "top_k": 4 if selector == "thrifty" else 0}
    whole = train(params, dense, 2)
    held = train(params, sparse, 2)
    assert np.allclose(held.linear, whole.linear)
    if selector in ("cyclic", "shuffle"):
        monkeypatch.setattr(linear, "MOST", 3)
        assert np.allclose(train(params, dense, 2).linear, whole.linear)
    assert np.allclose(margins(held, sparse), margins(whole, dense))


def test_many_features(spark):
    """20,000 features, 10 blocks: as by loops over rows."""
    rng = np.random.default_rng(9)
    n, width = 600, 20_000
    f = np.array([rng.choice(width, 5, replace=False) for _ in range(n)])
    v = rng.normal(size=f.shape).round(2)
    y = (v * (f % 3)).sum(axis=1)
    rows = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "row_id long, y double")
    entries = spark.createDataFrame([(i, int(a), float(b)) for i in range(n) for a, b in zip(f[i], v[i], strict=True)], "row_id long, f int, v double")
    frame = from_long(entries, width, rows).with_labels(F.col("y"))
    model = train({"booster": "gblinear", "lambda": 0.001, "disable_default_eval_metric": True}, frame, 1)
    x, w, g = np.zeros((n, width), np.float32), np.zeros(width + 1), y.mean() - y
    x[np.arange(n)[:, None], f] = v
    w[-1] = -0.5 * g.mean()
    g = g + w[-1]
    for k in range(width):
        own = x[:, k].astype(float)
        d = 0.5 * linear.step(own @ g, own @ own, 0.0, 0.0, 0.001 * n)
        w[k] = d
        g = g + own * d
    assert np.allclose(model.linear[:, 0], w, atol=1e-5)
    with pytest.raises(ValueError, match="greedy"):
        train({"booster": "gblinear", "linear_updater": "coord_descent", "feature_selector": "greedy"}, frame, 1)
    with pytest.raises(ValueError, match="max_row_perbatch"):
        train({"booster": "gblinear", "max_row_perbatch": 5}, frame, 1)


@pytest.mark.parametrize("selector", ["cyclic", "shuffle", "random", "thrifty"])
def test_listed_products_like_the_whole(spark, monkeypatch, rows, selector):
    """Blocks of listed products, blocks with a square, and both side by side."""
    x, y, w = rows
    dense, sparse = both(spark, x, y, w)
    params = {"booster": "gblinear", "linear_updater": "coord_descent", "feature_selector": selector, "lambda": 0.05, "alpha": 0.01, "top_k": 5 if selector == "thrifty" else 0}
    whole = train(params, dense, 2).linear
    monkeypatch.setattr(linear, "MOST", 4)
    monkeypatch.setattr(linear, "TOGETHER", 2)
    monkeypatch.setattr(linear, "MOST_PAIRS", {"cyclic": 200, "shuffle": 0}.get(selector, 1 << 21))
    monkeypatch.setattr(linear, "MOST_LISTED", 4 if selector == "thrifty" else 1 << 21)
    assert np.allclose(train(params, sparse, 2).linear, whole)


def test_blocks_by_pairs(spark):
    """Many features of which a row holds one are one block and one job; where rows hold many, blocks are small again."""
    width = 9 * linear.MOST
    frame = from_long(spark.range(width).select(F.col("id").alias("row_id"), F.col("id").alias("f"), (F.lit(1.0) + F.col("id") % 7).alias("v")), width).with_labels(F.col("row_id") % 5)
    grads = frame.df.select("entries", F.array((F.col("row_id") % 5 - 2).cast("double")).alias("g"), F.array(F.lit(1.0)).alias("h"))
    assert linear.cut_into_blocks(grads, [np.arange(width)], width, linear.MOST) == [(0, width, True)]
    ids, n = np.arange(width), spark.sparkContext.statusTracker()
    before = len(n.getJobIdsForGroup(None))
    weights = np.zeros((width + 1, 1))
    linear.descend_blocks(grads, weights, eta=0.5, lam=0.0, alpha=0.0, total=float(width))
    assert len(n.getJobIdsForGroup(None)) - before < 9
    g, v = ids % 5 - 2.0, 1.0 + ids % 7
    assert np.allclose(weights[:-1, 0], -0.5 * (g - 0.5 * g.mean()) / v)
    crowded = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4 * linear.MOST - 1)), lambda i: F.struct(i.cast("int").alias("f"), F.lit(1.0).alias("v"))).alias("entries"), F.array(F.lit(1.0)).alias("g"), F.array(F.lit(1.0)).alias("h"))
    got = linear.cut_into_blocks(crowded, [np.arange(4 * linear.MOST)], 4 * linear.MOST, linear.MOST)
    assert got == [(lo, lo + linear.MOST, True) for lo in range(0, 4 * linear.MOST, linear.MOST)]
