"""Ranking: drawn pairs, and pairs weighed by how likely their positions were examined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.functions import objectives
from copse.plans.train import train

from .test_engine import frame_of


def queries(spark, n=20, docs=6, seed=1, parts=3, sizes=None):
    rng = np.random.default_rng(seed)
    sizes = sizes or [docs] * n
    y = np.concatenate([np.arange(k)[::-1] for k in sizes]).astype(float)
    x = np.stack([y / 8 + rng.random(len(y)) * 0.1, rng.random(len(y))], axis=1)
    q = np.repeat(np.arange(len(sizes)), sizes)
    frame = frame_of(spark, x, y, parts=parts)
    at = F.array(*[F.lit(int(v)) for v in q])
    return frame.with_qid(F.get(at, F.col("row_id").cast("int"))), y, q


def scores(model, frame):
    return np.array([r.prediction[0] for r in model.predict(frame, "margin").orderBy("row_id").collect()])


def plain_unbiased(s, y, q, top, plus, minus, norm):
    """Gradients of rank:ndcg by loops, and the next propensities."""
    g, h = np.zeros(len(s)), np.zeros(len(s))
    li, lj = np.zeros(len(plus)), np.zeros(len(plus))
    for k in np.unique(q):
        own = np.flatnonzero(q == k)
        rank = own[np.lexsort((own, -s[own]))]
        ideal = sum((2.0**v - 1) / np.log2(i + 2) for i, v in enumerate(sorted(y[own], reverse=True)[:top]))
        sg, sh, total = np.zeros(len(s)), np.zeros(len(s)), 0.0
        for i in range(min(top, len(rank))):
            for j in range(i + 1, len(rank)):
                a, b, ra, rb = rank[i], rank[j], i, j
                if y[a] == y[b]:
                    continue
                if y[a] < y[b]:
                    a, b, ra, rb = b, a, rb, ra
                delta = abs((2.0 ** y[a] - 2.0 ** y[b]) * (1 / np.log2(ra + 2) - 1 / np.log2(rb + 2))) / ideal
                if s[rank[0]] != s[rank[-1]]:
                    delta /= abs(s[a] - s[b]) + 0.01
                sig = 1 / (1 + np.exp(s[b] - s[a]))
                lam, hess, cost = (sig - 1) * delta, max(sig * (1 - sig), 1e-16) * delta * 2, np.log(1 / (1 - sig)) * delta
                pa, pb = a - own[0], b - own[0]
                if pa < len(plus) and pb < len(plus):
                    tp, tm = plus[pa], minus[pb]
                    if tp >= 1e-16 and tm >= 1e-16:
                        lam, hess = lam / (tp * tm), hess / (tp * tm)
                    li[pa] += cost / tm if tm >= 1e-16 else 0
                    lj[pb] += cost / tp if tp >= 1e-16 else 0
                sg[a] += lam
                sg[b] -= lam
                sh[[a, b]] += hess
                total -= 2 * lam
        z = np.log2(1 + total) / total if total > 0 else 1
        g, h = g + sg * z, h + sh * z
    again = lambda old, c: (c / c[0]) ** (1 / (1 + norm)) if c[0] >= 1e-16 else old
    return g, h, again(plus, li), again(minus, lj)


@pytest.mark.parametrize("norm", [0.0, 1.0])
def test_unbiased_gradients_over_rounds(spark, norm):
    rng = np.random.default_rng(3)
    sizes = [5, 1, 7, 4]
    frame, y, q = queries(spark, sizes=sizes)
    y = rng.integers(0, 4, len(y)).astype(float)
    bias, plus, minus = objectives.PositionBias.start(4, norm), np.ones(4), np.ones(4)
    for _ in range(3):
        s = rng.normal(size=len(y))
        rows = spark.createDataFrame([(i, int(q[i]), float(s[i]), float(y[i])) for i in range(len(y))], "i long, q int, s double, y double").repartition(3)
        got = objectives.rank_gradients(rows, "ndcg", "s", "y", "q", "i", 4, bias=bias).persist()
        g, h, plus, minus = plain_unbiased(s, y, q, 4, plus, minus, norm)
        found = got.orderBy("i").collect()
        assert np.allclose([r["g"] for r in found], g) and np.allclose([r["h"] for r in found], h)
        bias = bias.updated(got)
        assert np.allclose(bias.plus, plus) and np.allclose(bias.minus, minus)


def test_unbiased_fits(spark):
    """It reaches the fit, so does its norm, and it still ranks; a second run is the same."""
    frame, _, q = queries(spark, 12, 6)
    fit = lambda **p: train({"objective": "rank:ndcg", "max_depth": 2, "disable_default_eval_metric": True, **p}, frame, 2)
    biased, unbiased = fit(), fit(lambdarank_unbiased=True)
    assert biased.to_json() != unbiased.to_json()
    assert unbiased.to_json() == fit(lambdarank_unbiased=True).to_json()
    assert fit(lambdarank_unbiased=True, lambdarank_bias_norm=0.0).to_json() != fit(lambdarank_unbiased=True, lambdarank_bias_norm=8.0).to_json()
    s = scores(unbiased, frame)
    assert sum(s[q == k].argmax() == 0 for k in range(12)) > 8


@pytest.mark.parametrize("kind", ["pairwise", "ndcg", "map"])
def test_drawn_pairs(spark, kind):
    """Each document meets so many of other labels, none of its own, whatever the partitioning; the sums are those of its pairs."""
    rng = np.random.default_rng(4)
    sizes = [6, 3, 1, 9]
    q = np.repeat(np.arange(4), sizes)
    y = rng.integers(0, 2 if kind == "map" else 3, len(q)).astype(float)
    s = rng.normal(size=len(q))
    y[q == 1] = 1.0  # one label: nothing to draw
    rows = spark.createDataFrame([(i, int(q[i]), float(s[i]), float(y[i])) for i in range(len(y))], "i long, q int, s double, y double")
    of = lambda df: sorted(tuple(r) for r in objectives.rank_pairs(df, kind, "s", "y", "q", "i", draws=2, seed=5).collect())
    pairs = of(rows.repartition(3))
    assert pairs == of(rows.repartition(7))
    assert pairs != sorted(tuple(r) for r in objectives.rank_pairs(rows, kind, "s", "y", "q", "i", draws=2, seed=6).collect())
    drawn = sum(2 for i in range(len(q)) if len(set(y[q == q[i]])) > 1)
    assert len(pairs) == drawn and all(q[a] == q[b] == k and y[a] > y[b] for k, a, b, *_ in pairs)
    every = {(k, a, b): (lam, h) for k, a, b, lam, h in (tuple(r) for r in objectives.rank_pairs(rows, kind, "s", "y", "q", "i", 100).collect())}
    assert all(np.allclose(every[k, a, b], (lam, h)) for k, a, b, lam, h in pairs)
    g = np.zeros(len(q))
    for _, a, b, lam, _ in pairs:
        g[a] += lam / 2
        g[b] -= lam / 2
    got = objectives.rank_gradients(rows, kind, "s", "y", "q", "i", draws=2, seed=5).orderBy("i").collect()
    assert np.allclose([r["g"] for r in got], g)


def test_mean_fits(spark):
    frame, _, q = queries(spark, 12, 6)
    fit = lambda **p: train({"objective": "rank:ndcg", "max_depth": 2, **p}, frame, 2, [("train", frame)])
    topk, mean = fit(), fit(lambdarank_pair_method="mean", lambdarank_num_pair_per_sample=2)
    assert topk.to_json() != mean.to_json() == fit(lambdarank_pair_method="mean", lambdarank_num_pair_per_sample=2).to_json()
    assert fit(lambdarank_pair_method="mean", lambdarank_num_pair_per_sample=2, seed=9).to_json() != mean.to_json()
    s = scores(mean, frame)
    assert sum(s[q == k].argmax() == 0 for k in range(12)) > 8
    assert mean.history[0][2] == "ndcg" and topk.history[0][2] == "ndcg@32"
    both = fit(lambdarank_pair_method="mean", lambdarank_unbiased=True)
    assert both.to_json() != mean.to_json()


def test_default_metric_names_the_level(spark):
    frame, _, _ = queries(spark, 5, 4)
    model = train({"objective": "rank:map", "max_depth": 1, "lambdarank_num_pair_per_sample": 3}, frame.with_labels((F.get("label", F.lit(0)) > 1).cast("int")), 1, [("train", frame)])
    assert model.history[0][2] == "map@3"
    with pytest.raises(ValueError, match="num_pair"):
        train({"lambdarank_num_pair_per_sample": 0}, frame, 1)
