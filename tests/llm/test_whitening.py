import math

import numpy as np
import pytest

from copse.llm import whitening as W


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, x int, n int")


def brute(rows, components=4):
    kept = [(i, np.array([math.floor(256 * float(np.float32(c))) for c in v])) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return {i: (int(((n * x - s) ** 2).sum()), (x - s / n) @ v / np.sqrt(e), e / np.trace(cov)) for i, x in kept}, n


def check(spark, rows):
    got = W.whiten(table(spark, rows).repartition(3)).collect()
    want, n = brute(rows)
    signs = {}
    assert len(got) == 4 * sum(1 for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v))
    for r in got:
        deviation, white, share = want[r["vec_id"]]
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(share[c], rel=1e-9)
        sign = signs.setdefault(c, np.sign(r["whitened"] * white[c]))
        assert r["whitened"] == pytest.approx(sign * white[c], abs=1e-7)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0.1, 1, 7) * (np.arange(7) + 1)]) for i in range(200)]
    check(spark, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 3, 5)]) for i in range(30)]
    rows += [(i, rows[0][1]) for i in range(100, 160)]  # a vector that repeats counts once
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, float("nan"), 2.0, 3.0, 4.0]), (204, [float("inf")] * 5), (205, [-0.0] * 5)]
    check(spark, rows)
    other = [*rows, (300, [1.0, 2.0])]
    assert {r["vec_id"] for r in W.whiten(table(spark, other)).collect()} == {r["vec_id"] for r in W.whiten(table(spark, rows)).collect()}


def test_without_spread(spark):
    got = W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, 0.0)] * 4
    assert {r["component"] for r in got} == {1, 2}
    flat = W.whiten(table(spark, [(i, [float(i), 5.0, 1.0]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in flat)


def test_empty_and_huge(spark):
    assert W.whiten(table(spark, [(1, None)])).count() == 0
    got = W.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e10, 3.0])])).collect()
    assert len(got) == 6 and all(r["n"] == 3 and r["deviation"] is None or r["vec_id"] == 3 for r in got)


def test_sums_are_exact():
    x = np.array([[1 << 61, -(1 << 61)], [1 << 61, 5]])
    y = W.from_centre(x, 3, [1 << 62, -7])
    assert y.tolist() == [[3 * (1 << 61) - (1 << 62), -3 * (1 << 61) + 7], [3 * (1 << 61) - (1 << 62), 22]]
