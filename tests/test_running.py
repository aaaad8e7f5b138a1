"""Sums over all rows in two steps, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.functions import metrics, running
from copse.operators import linear
from copse.plans import train as T
from copse.sources.frame import from_dense

from .test_engine import frame_of


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 5, 200])
def test_running_sums(spark, descending, ranges):
    rng = np.random.default_rng(ranges)
    keys = rng.permutation(np.unique(np.round(rng.normal(size=300), 2)))
    v = rng.integers(0, 9, len(keys)).astype(float)
    df = spark.createDataFrame([(float(k), float(x)) for k, x in zip(keys, v, strict=True)], "k double, v double").repartition(4)
    got = {r["k"]: (r["s"], r["s0"]) for r in running.running(df, "k", {"s": F.col("v")}, descending, ranges).collect()}
    order = np.argsort(-keys if descending else keys)
    upto = np.cumsum(v[order])
    assert [got[k] for k in keys[order]] == [(a, a - x) for a, x in zip(upto, v[order], strict=True)]
    assert running.running(df.limit(0), "k", {"s": F.col("v")}).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(int(k),) for k in (5, 3, 3, 9, -1, 7)], "k long").repartition(3)
    got = sorted((r["n"], r["k"]) for r in running.numbered(df, "k", ranges=3).collect())
    assert got == [(0, -1), (1, 3), (2, 3), (3, 5), (4, 7), (5, 9)]


def plain_threshold(s, share):
    s, want = np.sort(s), int(share * len(s))
    for i in range(len(s)):
        left = want - (len(s) - i - 1)
        if left > 0 and s[: i + 1].sum() / left > s[i] and (i + 1 == len(s) or s[: i + 1].sum() / left <= s[i + 1]):
            return s[: i + 1].sum() / left
    return s.sum() / want


@pytest.mark.parametrize("most", [3, 100_000])
@pytest.mark.parametrize("share", [0.05, 0.3, 0.9])
def test_sampling_threshold(spark, monkeypatch, most, share):
    """The expected number of rows is the share, also if windows hold three values at a time and one value is a third of the rows."""
    monkeypatch.setattr(T, "MOST_VALUES", most)
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.exponential(size=200), np.full(100, 0.7)])
    got = T.sampling_threshold(spark.createDataFrame([(float(x),) for x in s], "s double"), share)
    assert got == pytest.approx(plain_threshold(s, share), rel=1e-9)
    assert np.minimum(1, s / got).sum() == pytest.approx(int(share * len(s)))
    assert T.sampling_threshold(spark.createDataFrame([(1.0,)], "s double"), share) == float("inf")


@pytest.mark.parametrize("ratio", [0.1, 0.35, 1.0])
def test_ams_with_ties(spark, ratio):
    rng = np.random.default_rng(5)
    p, y, w = np.round(rng.random(120), 1), rng.integers(0, 2, 120).astype(float), rng.uniform(0.5, 2, 120)
    df = spark.createDataFrame([(i, float(p[i]), float(y[i]), float(w[i])) for i in range(120)], "i long, p double, y double, w double").repartition(3)
    order = np.lexsort((np.arange(120), -p))
    tp, fp = np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order]) + 10
    value = np.sqrt(2 * ((tp + fp) * np.log(1 + tp / fp) - tp))
    top = int(ratio * 120)
    want = value[min(top, 119) - 1] if top < 120 else max(v for v, a, b in zip(value, p[order], p[order][1:], strict=False) if a != b)
    assert metrics.ams(df, F.col("p"), F.col("y"), F.col("w"), ratio, "i").first()["value"] == pytest.approx(want)


def test_batches_of_rows(spark):
    """Shotgun in batches against loops over rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    y = np.nan_to_num(x) @ [1.0, -2.0, 0.5] + 3
    frame = frame_of(spark, x, y)
    model = T.train({"booster": "gblinear", "max_row_perbatch": 20, "lambda": 0.1, "alpha": 0.01}, frame, 3)
    z, w, b0 = np.nan_to_num(x), np.zeros(4), y.mean()
    for _ in range(3):
        g = b0 + z @ w[:3] + w[3] - y
        d = -0.5 * g.sum() / 50
        w[3] += d
        g = g + d
        for page in (slice(0, 20), slice(20, 40), slice(40, 50)):
            own = g[page].copy()
            for f in range(3):
                d = 0.5 * linear.step(own @ z[page, f], z[page, f] @ z[page, f], w[f], 0.01 * 50, 0.1 * 50)
                w[f] += d
                own += d * z[page, f]
    assert np.allclose(model.linear[:, 0], w)
    whole = T.train({"booster": "gblinear", "lambda": 0.1, "alpha": 0.01}, frame, 3)
    assert not np.allclose(whole.linear, model.linear)
    assert np.allclose(T.train({"booster": "gblinear", "max_row_perbatch": 50, "lambda": 0.1, "alpha": 0.01}, frame, 3).linear, whole.linear)
    with pytest.raises(ValueError, match="max_row_perbatch"):
        T.train({"booster": "gblinear", "max_row_perbatch": 0}, frame, 1)


def test_column_pages(spark):
    df = spark.createDataFrame([(i * 10, float(-i), None if i % 3 else float(i % 2)) for i in range(25)], "id long, a double, b double").repartition(3)
    got = sorted(tuple(r) for r in from_dense(df, ["a", "b"], "id").column_pages(10).collect())
    want = []
    for batch in range(3):
        rows = range(batch * 10, min(25, batch * 10 + 10))
        for f, cells in enumerate(([(-float(i), i * 10) for i in rows], [(float(i % 2), i * 10) for i in rows if i % 3 == 0])):
            want += [(batch, f, k, i, v) for k, (v, i) in enumerate(sorted(cells))]
    assert got == sorted(want)
