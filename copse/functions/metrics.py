"""Evaluation metrics as aggregations and windows over (prediction, label, weight)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .objectives import RT_EPS, _aft_density
from .running import numbered, running
from .scalar import dcg_gain, discount, log_gamma, num

#: Metrics by prefix for which more is better.
MAXIMISED = ("auc", "aucpr", "pre", "map", "ndcg", "ams", "interval-regression-accuracy")
RANK_METRICS = ("pre", "ndcg", "map")


#: Metrics of users by name: what gives their value, and whether more is better.
_REGISTERED: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {}


def register(name: str, value: Callable[[DataFrame], DataFrame], more_is_better: bool = False) -> None:
    """Let `eval_metric: name` stand for value: rows with prediction, margin, label (arrays) and weight in, one row with `value` out."""
    _REGISTERED[name] = value, more_is_better


def registered(name: str) -> Callable[[DataFrame], DataFrame] | None:
    return _REGISTERED[name][0] if name in _REGISTERED else None


def maximised(name: str) -> bool:
    if name in _REGISTERED:
        return _REGISTERED[name][1]
    return name.split("@")[0].rstrip("-") in MAXIMISED


def parse(name: str) -> tuple[str, float | None, bool]:
    """(kind, argument, trailing minus) of a metric's spelling; ValueError for unknown ones."""
    m = re.fullmatch(r"([a-z-]+?)(?:@([0-9.]+))?(-)?", name)
    kinds = {*ROWWISE, "auc", "aucpr", "pre", "ndcg", "map", "ams", "merror", "mlogloss", "cox-nloglik", "aft-nloglik", "interval-regression-accuracy", "quantile", "expectile", "tweedie-nloglik"}
    if not m or m[1] not in kinds:
        raise ValueError(f"unknown metric: {name}")
    if m[3] and m[1] not in RANK_METRICS:
        raise ValueError(f"only ranking metrics take a minus: {name}")
    if m[1] in ("ams", "tweedie-nloglik") and m[2] is None:
        raise ValueError(f"{m[1]} needs an argument")
    return m[1], float(m[2]) if m[2] else None, bool(m[3])


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, num(0)).otherwise(x * F.log(F.greatest(y, num(1e-16))))


ROWWISE = {
    "rmse": lambda p, y, a: (y - p) * (y - p),
    "rmsle": lambda p, y, a: F.pow(F.log1p(y) - F.log1p(p), 2),
    "mae": lambda p, y, a: F.abs(y - p),
    "mape": lambda p, y, a: F.abs((y - p) / F.nullif(y, num(0))),
    "mphe": lambda p, y, a: F.sqrt(1 + (y - p) * (y - p)) - 1,
    "logloss": lambda p, y, a: _xlogy(-y, p) + _xlogy(y - 1, 1 - p),
    "error": lambda p, y, a: F.when(p > (0.5 if a is None else a), 1 - y).otherwise(y),
    "poisson-nloglik": lambda p, y, a: log_gamma(y + 1) + F.greatest(p, num(1e-16)) - F.log(F.greatest(p, num(1e-16))) * y,
    "gamma-nloglik": lambda p, y, a: y / F.greatest(p, num(1e-6)) + F.log(F.greatest(p, num(1e-6))),
    "gamma-deviance": lambda p, y, a: F.log((p + RT_EPS) / (y + RT_EPS)) + (y + RT_EPS) / (p + RT_EPS) - 1,
    "tweedie-nloglik": lambda p, y, a: F.exp((2 - a) * F.log(p)) / (2 - a) - y * F.exp((1 - a) * F.log(p)) / (1 - a),
}


def _mean(total: Column, w: Column) -> Column:
    return F.when(w == 0, total).otherwise(total / F.nullif(w, num(0)))


def rowwise(df: DataFrame, kind: str, p: Column, y: Column, w: Column, arg=None) -> DataFrame:
    """One row with the metric's value."""
    total, weight = F.sum(ROWWISE[kind](p, y, arg) * w), F.sum(w)
    if kind in ("rmse", "rmsle"):
        return df.agg(F.sqrt(_mean(total, weight)).alias("value"))
    if kind == "gamma-deviance":
        return df.agg((2 * total / F.when(weight <= 0, num(RT_EPS)).otherwise(weight)).alias("value"))
    return df.agg(_mean(total, weight).alias("value"))


def pinball(df: DataFrame, kind: str, preds: Column, y: Column, w: Column, alpha: list[float]) -> DataFrame:
    """quantile or expectile: the mean over outputs. preds: an array."""
    total = num(0)
    for j, a in enumerate(alpha):
        d = y - F.get(preds, F.lit(j))
        total = total + (F.when(d >= 0, a * d).otherwise((a - 1) * d) if kind == "quantile" else F.when(d > 0, a * d * d).otherwise((1 - a) * d * d))
    return df.agg((F.sum(total * w) / F.nullif(F.sum(w) * len(alpha), num(0))).alias("value"))


def multiclass(df: DataFrame, kind: str, probs: Column, y: Column, w: Column) -> DataFrame:
    if kind == "merror":
        best = F.array_position(probs, F.array_max(probs)) - 1
        row = F.when(best == y, 0.0).otherwise(1.0)
    else:
        row = -F.log(F.greatest(F.get(probs, y.cast("int")), num(1e-16)))
    return df.agg(_mean(F.sum(row * w), F.sum(w)).alias("value"))


def _curve(df: DataFrame, by: list[str], pr: bool) -> DataFrame:
    """df: keys, s (score), y, w. The area under the curve by key, null where it has none.

    Rows are first summed by score, so windows run over distinct scores: those of one key, or else of one range of scores.
    """
    points = df.groupBy(*by, "s").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("n"))
    if by:
        upto = W.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
        points = points.withColumns({"tp": F.sum("p").over(upto), "fp": F.sum("n").over(upto)})
        points = points.withColumns({"tp0": F.col("tp") - F.col("p"), "fp0": F.col("fp") - F.col("n")})
    else:
        points = running(points, "s", {"tp": F.col("p"), "fp": F.col("n")}, descending=True)
    if not pr:
        area = F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) * 0.5)
        ends = points.groupBy(*by).agg(area.alias("area"), F.max("tp").alias("tp"), F.max("fp").alias("fp"))
        return ends.withColumn("value", F.when((F.col("tp") > 0) & (F.col("fp") > 0), F.col("area") / F.nullif(F.col("tp") * F.col("fp"), num(0)))).drop("area", "tp", "fp")
    if by:
        whole = W.partitionBy(*by)
        points = points.withColumns({"all": F.sum("p").over(whole), "none": F.sum("n").over(whole)})
    else:
        points = points.crossJoin(F.broadcast(points.agg(F.sum("p").alias("all"), F.sum("n").alias("none"))))  # one row
    all_, tp, tp0, fp, fp0 = (F.col(c) for c in ("all", "tp", "tp0", "fp", "fp0"))
    flat = F.col("p") == 0
    slope = (fp - fp0) / F.nullif(tp - tp0, num(0))
    a = F.when(flat, num(1)).otherwise(slope + 1)
    b = F.when(flat, num(0)).otherwise((fp0 - slope * tp0) / F.nullif(all_, num(0)))
    q, q0 = tp / F.nullif(all_, num(0)), tp0 / F.nullif(all_, num(0))
    bent = (q - q0 - b / a * (F.log(F.nullif(a * q + b, num(0))) - F.log(F.nullif(a * q0 + b, num(0))))) / a
    piece = F.when(b != 0, bent).otherwise((q - q0) / a)
    ends = points.groupBy(*by).agg(F.sum(piece).alias("area"), F.max("all").alias("all"), F.max("none").alias("none"))
    return ends.withColumn("value", F.when((F.col("all") > 0) & (F.col("none") > 0), F.col("area"))).drop("area", "all", "none")


def auc(df: DataFrame, p: Column, y: Column, w: Column, pr: bool = False, qid: str | None = None) -> DataFrame:
    """Area under the ROC or precision-recall curve; by query its mean over queries that have one."""
    slim = df.select(p.alias("s"), y.cast("double").alias("y"), (w if qid is None else num(1)).alias("w"), *([F.col(qid).alias("q")] if qid else []))
    got = _curve(slim, ["q"] if qid else [], pr)
    return got.agg(F.when(F.count("value") == 0, num(float("nan"))).otherwise(F.least(F.avg("value"), num(1))).alias("value"))


def ranking(df: DataFrame, kind: str, p: str, y: str, qid: str, order: str, top: int | None = None, minus: bool = False) -> DataFrame:
    """pre, ndcg or map at `top`, the mean over queries; a query without relevant documents counts 1, or 0 with minus."""
    d = df.select(F.col(qid).alias("q"), F.col(p).cast("double").alias("s"), F.col(y).cast("double").alias("y"), F.col(order).alias("i"))
    by_score, by_label = W.partitionBy("q").orderBy(F.desc("s"), "i"), W.partitionBy("q").orderBy(F.desc("y"), "i")
    d = d.withColumns({"r": F.row_number().over(by_score) - 1, "lr": F.row_number().over(by_label) - 1})
    inside = F.col("r") < top if top else F.lit(True)
    empty = num(0.0 if minus else 1.0)
    if kind == "pre":
        n = F.least(F.count("*"), F.lit(top)) if top else F.count("*")
        got = d.groupBy("q").agg((F.sum(F.when(inside, F.col("y")).otherwise(0)) / n).alias("v"))
    elif kind == "ndcg":
        ideal = F.sum(F.when(F.col("lr") < top if top else F.lit(True), dcg_gain(F.col("y")) * discount(F.col("lr"))).otherwise(0))
        made = F.sum(F.when(inside, dcg_gain(F.col("y")) * discount(F.col("r"))).otherwise(0))
        got = d.groupBy("q").agg(F.when(ideal > 0, made / F.nullif(ideal, num(0))).otherwise(empty).alias("v"))
    else:
        d = d.withColumn("hits", F.sum("y").over(by_score.rowsBetween(W.unboundedPreceding, 0)))
        acc = F.sum(F.when(inside, F.col("hits") / (F.col("r") + 1) * F.col("y")).otherwise(0))
        total = F.least(F.sum("y"), num(top)) if top else F.sum("y")
        got = d.groupBy("q").agg(F.when(F.sum("y") > 0, acc / F.nullif(total, num(0))).otherwise(empty).alias("v"))
    return got.agg(F.least(F.avg("v"), num(1)).alias("value"))


def ams(df: DataFrame, p: Column, y: Column, w: Column, ratio: float, order: str) -> DataFrame:
    """Approximate median significance at the best cut, or at the cut that `ratio` names."""
    n = df.count()
    top = int(ratio * n) or n
    hit = F.when(F.col("y") > 0.5, F.col("w")).otherwise(0)
    d = df.select(p.alias("s"), y.alias("y"), w.alias("w"), F.col(order).alias("i"))
    points = d.groupBy("s").agg(F.sum(hit).alias("p"), F.sum(F.col("w") - hit).alias("n"), F.count("*").alias("c"))
    points = running(points, "s", {"tp": F.col("p"), "fp": F.col("n"), "r": F.col("c")}, descending=True)
    b = F.col("fp") + 10
    value = F.sqrt(2 * ((F.col("tp") + b) * F.log(1 + F.col("tp") / b) - F.col("tp")))
    if top == n:  # between any two scores
        return points.where(F.col("r") < n).agg(F.coalesce(F.max(value), num(0)).alias("value"))
    last = min(top, n - 1)
    cut = points.where((F.col("r0") < last) & (F.col("r") >= last)).first()
    if cut is None:
        return d.limit(1).agg(F.lit(None).cast("double").alias("value"))
    inside = numbered(d.where(F.col("s").eqNullSafe(F.lit(cut["s"]))), "i").where(F.col("n") < last - int(cut["r0"]))
    return inside.agg((F.sum(hit) + float(cut["tp0"])).alias("tp"), (F.sum(F.col("w") - hit) + float(cut["fp0"])).alias("fp")).select(value.alias("value"))


def cox(df: DataFrame, p: Column, y: Column, w: Column) -> DataFrame:
    """Negative log partial likelihood over events; p is the hazard ratio. Rows of one time share a risk set."""
    d = df.select(F.greatest(p, num(1e-16)).alias("p"), y.alias("y"), F.abs(y).alias("t"), w.alias("w"))
    times = running(d.groupBy("t").agg(F.sum("p").alias("e")), "t", {"risk": F.col("e")}, descending=True).select("t", "risk")
    got = d.where("y > 0").join(times, "t")
    return got.agg((F.sum(F.col("w") * (F.log("risk") - F.log("p"))) / F.sum("w")).alias("value"))


def aft(df: DataFrame, margin: Column, lower: Column, upper: Column, w: Column, dist: str = "normal", sigma: float = 1.0) -> DataFrame:
    safe = lambda v: F.when((v > 0) & (v < float("inf")), F.log(v)).otherwise(num(0))
    zu, zl = (safe(upper) - margin) / sigma, (safe(lower) - margin) / sigma
    pdf, cdf_l = _aft_density(dist, zl)[:2]
    cdf_u = F.when(upper == float("inf"), num(1)).otherwise(_aft_density(dist, zu)[1])
    cdf_l = F.when(lower <= 0, num(0)).otherwise(cdf_l)
    like = F.when(lower == upper, pdf / (sigma * F.greatest(lower, num(1e-300)))).otherwise(cdf_u - cdf_l)
    return df.agg((F.sum(-F.log(F.greatest(like, num(1e-12))) * w) / F.sum(w)).alias("value"))


def interval_accuracy(df: DataFrame, margin: Column, lower: Column, upper: Column, w: Column) -> DataFrame:
    p = F.exp(margin)
    return df.agg((F.sum(F.when((p >= lower) & (p <= upper), w).otherwise(0)) / F.sum(w)).alias("value"))
