"""Objectives as Column expressions.

A row-wise objective maps (margin, label) to gradient and hessian; weights multiply both afterwards.
Objectives over several outputs take and give arrays. Those that need more than their row (absolute
error, quantile, Cox, ranking) say so by `frame`, which takes and returns a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .running import running
from .scalar import dcg_gain, discount, erf, num, sigmoid, softmax, softplus, softplus_inverse

TINY = 1.1754943508222875e-38  # the least normal 32-bit float
EPS = 1e-16
RT_EPS = 1e-6
QUANTILE_WIDTH = 0.04


class InvalidLabel(ValueError):
    pass


@dataclass
class Objective:
    name: str
    pair: Callable[[Column, Column], tuple[Column, Column]] | None = None
    transform: Callable[[Column], Column] = lambda m: m
    to_margin: Callable[[float], float] = lambda p: p
    init: str = "mean"  # mean, newton, or fixed:<value>
    metric: str = "rmse"
    label_ok: Callable[[Column], Column] | None = None
    outputs: int = 1
    constant_hessian: bool = False
    params: dict = field(default_factory=dict)
    #: For losses that need more than their row: margin, label and weight in, g and h (arrays by output, without weights) beside them.
    table: Callable[[DataFrame], DataFrame] | None = None


_REGISTERED: dict[str, Callable[..., Objective]] = {}


def register(name: str, make: Callable[..., Objective]) -> None:
    """Let `objective: name` stand for make(**parameters), in training and wherever a model of it is read."""
    _REGISTERED[name] = make


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _log(p: float) -> float:
    if p <= 0:
        raise ValueError("base_score must be greater than 0 for a log link")
    return math.log(p)


def squared(m, y):
    return m - y, num(1)


def squared_log(m, y):
    p = F.greatest(m, num(-1 + 1e-6))
    step = F.log1p(p) - F.log1p(y)
    return step / (p + 1), F.greatest((1 - step) / ((p + 1) * (p + 1)), num(1e-6))


def logistic(m, y):
    p = sigmoid(m)
    return p - y, F.greatest(p * (1 - p), num(EPS))


def hinge(m, y):
    z = 2 * y - 1
    wrong = m * z < 1
    return F.when(wrong, -z).otherwise(num(0)), F.when(wrong, num(1)).otherwise(num(TINY))


def pseudo_huber(slope):
    def pair(m, y):
        z, s2 = m - y, slope * slope
        root = F.sqrt(1 + z * z / s2)
        return z / root, s2 / ((s2 + z * z) * root)

    return pair


def gamma(m, y):
    r = y / F.exp(m)
    return 1 - r, r


def poisson(max_delta):
    return lambda m, y: (F.exp(m) - y, F.exp(m + max_delta))


def tweedie(rho):
    def pair(m, y):
        a, b = y * F.exp((1 - rho) * m), F.exp((2 - rho) * m)
        return b - a, (2 - rho) * b - (1 - rho) * a

    return pair


def create(name: str, **p) -> Objective:
    """An objective by its name; raises ValueError for unknown ones."""
    in_unit = lambda y: (y >= 0) & (y <= 1)
    exp = F.exp
    log_link = {"transform": exp, "to_margin": _log}
    table: dict[str, Callable[[], Objective]] = {
        "reg:squarederror": lambda: Objective(name, squared, constant_hessian=True),
        "reg:linear": lambda: Objective("reg:squarederror", squared, constant_hessian=True),
        "reg:squaredlogerror": lambda: Objective(name, squared_log, init="newton", metric="rmsle", label_ok=lambda y: y > -1),
        "reg:logistic": lambda: Objective(name, logistic, sigmoid, _logit, label_ok=in_unit),
        "binary:logistic": lambda: Objective(name, logistic, sigmoid, _logit, metric="logloss", label_ok=in_unit),
        "binary:logitraw": lambda: Objective(name, logistic, to_margin=_logit, metric="logloss", label_ok=in_unit),
        "binary:hinge": lambda: Objective(name, hinge, lambda m: F.when(m > 0, num(1)).otherwise(num(0)), init="newton", metric="error", label_ok=in_unit),
        "reg:pseudohubererror": lambda: Objective(name, pseudo_huber(p.get("huber_slope", 1.0)), init="newton", metric="mphe"),
        "reg:absoluteerror": lambda: Objective(name, init="newton", metric="mae"),
        "reg:quantileerror": lambda: Objective(name, init="quantile", metric="quantile", outputs=len(_alphas(p, "quantile_alpha")), params={"alpha": _alphas(p, "quantile_alpha")}),
        "reg:expectileerror": lambda: Objective(name, init="expectile", metric="expectile", outputs=len(_alphas(p, "expectile_alpha")), params={"alpha": _alphas(p, "expectile_alpha")}),
        "reg:gamma": lambda: Objective(name, gamma, metric="gamma-deviance", label_ok=lambda y: y > 0, **log_link),
        "count:poisson": lambda: Objective(name, poisson(p.get("max_delta_step") or 0.7), metric="poisson-nloglik", label_ok=lambda y: y >= 0, **log_link),
        "reg:tweedie": lambda: Objective(name, tweedie(p.get("tweedie_variance_power", 1.5)), metric=f"tweedie-nloglik@{p.get('tweedie_variance_power', 1.5)}", label_ok=lambda y: y >= 0, **log_link),
        "survival:cox": lambda: Objective(name, init="fixed:1.0", metric="cox-nloglik", **log_link),
        "survival:aft": lambda: Objective(name, init="fixed:0.5", metric="aft-nloglik", params={"dist": p.get("aft_loss_distribution", "normal"), "sigma": p.get("aft_loss_distribution_scale", 1.0)}, **log_link),
        "multi:softmax": lambda: Objective(name, init="classes", metric="mlogloss", outputs=_classes(p)),
        "multi:softprob": lambda: Objective(name, init="classes", metric="mlogloss", outputs=_classes(p)),
        "rank:pairwise": lambda: Objective(name, init="newton", metric=f"ndcg{_level(p)}", params=p, label_ok=lambda y: y >= 0),
        "rank:ndcg": lambda: Objective(name, init="newton", metric=f"ndcg{_level(p)}", params=p),
        "rank:map": lambda: Objective(name, init="newton", metric=f"map{_level(p)}", params=p, label_ok=lambda y: y >= 0),
    }
    if name in _REGISTERED:
        return _REGISTERED[name](**p)
    if name not in table:
        raise ValueError(f"unknown objective: {name}")
    return table[name]()


#: Ranks from which pairs are made, pairs drawn for a document, and positions that a bias is kept for where ranks are not cut.
TOP_RANKS, DRAWS, POSITIONS = 32, 1, 32


def pairs_per_sample(p: dict) -> int:
    return int(p.get("lambdarank_num_pair_per_sample") or (DRAWS if p.get("lambdarank_pair_method") == "mean" else TOP_RANKS))


def _level(p) -> str:
    return "" if p.get("lambdarank_pair_method") == "mean" else f"@{pairs_per_sample(p)}"


def _alphas(p, key):
    a = p.get(key)
    a = [a] if isinstance(a, int | float) else list(a or [])
    if not a or any(not 0 < x < 1 for x in a):
        raise ValueError(f"{key} needs values between 0 and 1")
    return a


def _classes(p):
    k = int(p.get("num_class") or 0)
    if k < 2:
        raise ValueError("num_class must be at least 2")
    return k


# ---- objectives over arrays of outputs ------------------------------------------------------------


#: Classes up to which probabilities are written out one by one, which stays in generated code.
FEW_CLASSES = 32


def softmax_pair(margins: Column, y: Column, k: int) -> tuple[Column, Column]:
    if k <= FEW_CLASSES:
        m = [F.get(margins, F.lit(j)) for j in range(k)]
        top = F.greatest(*m)
        e = [F.exp(x - top) for x in m]
        total = sum(e[1:], e[0])
        p = [x / total for x in e]
        return F.array(*[x - F.when(y == j, 1.0).otherwise(0.0) for j, x in enumerate(p)]), F.array(*[F.greatest(2 * x * (1 - x), num(EPS)) for x in p])
    p = softmax(margins)
    hit = lambda i: F.when(y == i, 1.0).otherwise(0.0)
    return F.transform(p, lambda x, i: x - hit(i)), F.transform(p, lambda x, i: F.greatest(2 * x * (1 - x), num(EPS)))


def expectile_pair(margins: Column, y: Column, alpha: list[float]) -> tuple[Column, Column]:
    preds, p = [], None
    for k in range(len(alpha)):
        m = F.get(margins, F.lit(k))
        p = m if p is None else p + RT_EPS + softplus(m)
        preds.append(p)
    g, h = [], []
    for j in range(len(alpha)):
        scale = num(1) if j == 0 else sigmoid(F.get(margins, F.lit(j)))
        side = [F.when(preds[k] >= y, 1 - alpha[k]).otherwise(alpha[k]) for k in range(j, len(alpha))]
        g.append(scale * sum((s * (preds[j + i] - y) for i, s in enumerate(side)), num(0)))
        h.append(scale * scale * sum(side, num(0)))
    return F.array(*g), F.array(*h)


def expectile_transform(margins: Column, n: int) -> Column:
    out, p = [], None
    for k in range(n):
        m = F.get(margins, F.lit(k))
        p = m if p is None else p + RT_EPS + softplus(m)
        out.append(p)
    return F.array(*out)


def expectile_margins(values: list[float]) -> list[float]:
    return [values[0], *(softplus_inverse(b - a - RT_EPS) for a, b in zip(values, values[1:], strict=False))]


# ---- objectives that need more than their row -----------------------------------------------------


def smoothing_scale(df: DataFrame, residual: Column, w: Column) -> float:
    """The squared weighted mean of root absolute residuals."""
    s = df.agg((F.sum(w * F.sqrt(F.abs(residual))) / F.sum(w)).alias("s")).first()["s"]
    return (s or 0.0) ** 2


def absolute_pair(r: Column, delta: float) -> tuple[Column, Column]:
    c = num(1) if delta <= 0 else delta / F.hypot(num(delta), r)
    return r * c, c


def quantile_pair(r: Column, alpha: float, scale: float) -> tuple[Column, Column]:
    if scale <= 0:
        return num(0), num(0)
    x = r / (QUANTILE_WIDTH * scale)
    slope = F.when(F.abs(x) < 1e-6, num(1)).otherwise(F.tanh(x) / x)
    return 0.5 * scale * (F.tanh(x) + 1 - 2 * alpha), 0.5 / QUANTILE_WIDTH * F.greatest(slope, num(3e-4))


def cox_pair(df: DataFrame, margin: str, y: str) -> DataFrame:
    """df with g and h of the partial likelihood; rows of one time share a risk set.

    The running sums go over distinct times, in two steps each (ranges of time, then times).
    """
    t, e = F.abs(F.col(y)), F.exp(F.col(margin))
    times = df.groupBy(t.alias("__t")).agg(F.sum(e).alias("__e"), F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("__d"))
    times = running(times, "__t", {"risk": F.col("__e")}, descending=True).select("__t", "__d", "risk")
    times = running(times, "__t", {"rk": F.col("__d") / F.col("risk"), "sk": F.col("__d") / (F.col("risk") * F.col("risk"))})
    got = df.join(times.select("__t", F.col("rk").alias("__rk"), F.col("sk").alias("__sk")), F.abs(F.col(y)) == F.col("__t"))
    event = F.when(F.col(y) > 0, 1.0).otherwise(0.0)
    return got.withColumns({"g": e * F.col("__rk") - event, "h": e * F.col("__rk") - e * e * F.col("__sk")}).drop("__t", "__rk", "__sk")


def _aft_density(dist: str, z: Column) -> tuple[Column, Column, Column, Column]:
    """Density, distribution function and the density's first two derivatives."""
    if dist == "normal":
        pdf = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return pdf, 0.5 * (1 + erf(z / math.sqrt(2))), -z * pdf, (z * z - 1) * pdf
    w = F.exp(F.least(z, num(300)))
    if dist == "logistic":
        pdf = w / ((1 + w) * (1 + w))
        return pdf, w / (1 + w), pdf * (1 - w) / (1 + w), pdf * (w * w - 4 * w + 1) / ((1 + w) * (1 + w))
    if dist == "extreme":
        pdf = w * F.exp(-w)
        return pdf, 1 - F.exp(-w), (1 - w) * pdf, (w * w - 3 * w + 1) * pdf
    raise ValueError(f"unknown distribution: {dist}")


def aft_pair(m: Column, lower: Column, upper: Column, dist: str = "normal", sigma: float = 1.0) -> tuple[Column, Column]:
    """Gradient in [-15, 15] and hessian in [1e-16, 15]; limits where the likelihood underflows."""
    exact, right, left = lower == upper, upper == float("inf"), lower <= 0
    safe = lambda v: F.when((v > 0) & (v < float("inf")), F.log(v)).otherwise(num(0))
    zu, zl = (safe(upper) - m) / sigma, (safe(lower) - m) / sigma
    pu, cu, gu, _ = _aft_density(dist, zu)
    pl, cl, gl, hl = _aft_density(dist, zl)
    pu, cu, gu = F.when(right, num(0)).otherwise(pu), F.when(right, num(1)).otherwise(cu), F.when(right, num(0)).otherwise(gu)
    pl0, cl0, gl0 = F.when(left, num(0)).otherwise(pl), F.when(left, num(0)).otherwise(cl), F.when(left, num(0)).otherwise(gl)
    dc, dp, dg = cu - cl0, pu - pl0, gu - gl0
    gn, gd = F.when(exact, gl).otherwise(dp), F.when(exact, sigma * pl).otherwise(sigma * dc)
    hn = F.when(exact, -(pl * hl - gl * gl)).otherwise(-(dc * dg - dp * dp))
    hd = F.when(exact, sigma * sigma * pl * pl).otherwise((sigma * dc) * (sigma * dc))
    late = F.when(exact, zl > 0).otherwise((~right & (zu > 0)) | (~left & (zl > 0)))
    censor_right, censor_left = ~exact & right & ~left, ~exact & left
    low = -15.0 if dist != "logistic" else -1 / sigma
    high = 15.0 if dist == "normal" else 1 / sigma
    glim = F.when(late, F.when(censor_left, num(0)).otherwise(num(low))).otherwise(F.when(censor_right, num(0)).otherwise(num(high)))
    if dist == "normal":
        one = num(1 / (sigma * sigma))
        hlim = F.when(censor_right, F.when(late, one).otherwise(num(EPS))).when(censor_left, F.when(late, num(EPS)).otherwise(one)).otherwise(one)
    elif dist == "logistic":
        hlim = num(EPS)
    else:
        hlim = F.when(~censor_left & late, num(15)).otherwise(num(EPS))
    g, h = F.when(gd == 0, glim).otherwise(gn / F.nullif(gd, num(0))), F.when(hd == 0, hlim).otherwise(hn / F.nullif(hd, num(0)))
    clip = lambda x, a, b: F.greatest(num(a), F.least(num(b), x))
    return clip(g, -15, 15), clip(h, EPS, 15)


@dataclass(frozen=True)
class PositionBias:
    """How likely documents at a position of the given list were examined: as the better one of a pair (plus), as the worse one (minus)."""

    plus: tuple[float, ...]
    minus: tuple[float, ...]
    exponent: float = 0.5

    @classmethod
    def start(cls, size: int, norm: float = 1.0) -> PositionBias:
        return cls((1.0,) * size, (1.0,) * size, 1 / (1 + norm))

    @property
    def size(self) -> int:
        return len(self.plus)

    def updated(self, rows: DataFrame) -> PositionBias:
        """The next round's, of rank_gradients' rows (pos, li, lj): one aggregation, a row a position."""
        sums = {r["pos"]: r for r in rows.where(F.col("pos") < self.size).groupBy("pos").agg(F.sum("li").alias("li"), F.sum("lj").alias("lj")).collect()}
        of = lambda c: [float(sums[k][c]) if k in sums else 0.0 for k in range(self.size)]
        again = lambda old, cost: tuple((c / cost[0]) ** self.exponent for c in cost) if cost and cost[0] >= EPS else old
        return PositionBias(again(self.plus, of("li")), again(self.minus, of("lj")), self.exponent)


def ranked_documents(df: DataFrame, margin: str, y: str, qid: str, order: str, top: int | None, exp_gain: bool, positions: bool) -> DataFrame:
    """q, i, s, y of each document with its ranks by score (r) and label (lr), its query's best, worst and ideal values, and its place in the given list (pos)."""
    value = dcg_gain if exp_gain else (lambda c: c)
    d = df.select(F.col(qid).alias("q"), F.col(order).alias("i"), F.col(margin).cast("double").alias("s"), F.col(y).cast("double").alias("y"))
    wq, lq = W.partitionBy("q").orderBy(F.desc("s"), "i"), W.partitionBy("q").orderBy(F.desc("y"), "i")
    d = d.withColumns({"r": F.row_number().over(wq) - 1, "lr": F.row_number().over(lq) - 1})
    everything = W.partitionBy("q")
    d = d.withColumns({"best": F.max("s").over(everything), "worst": F.min("s").over(everything)})
    inside = F.col("lr") < top if top else F.lit(True)
    d = d.withColumn("idcg", F.sum(F.when(inside, value(F.col("y")) * discount(F.col("lr"))).otherwise(0)).over(everything))
    run = wq.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("rel", F.sum("y").over(run))
    d = d.withColumn("acc", F.sum(F.col("y") / (F.col("r") + 1)).over(run))
    d = d.withColumn("all_rel", F.sum("y").over(everything))
    return d.withColumn("pos", F.row_number().over(W.partitionBy("q").orderBy("i")) - 1) if positions else d


def top_pairs(d: DataFrame, top: int) -> DataFrame:
    """Columns a and b (documents of one query and other labels, a ranked first and above `top`)."""
    a, b = d.where(F.col("r") < top).alias("a"), d.alias("b")
    return a.join(b, (F.col("a.q") == F.col("b.q")) & (F.col("a.r") < F.col("b.r")) & (F.col("a.y") != F.col("b.y")))


def drawn_pairs(d: DataFrame, times: int, seed: int) -> DataFrame:
    """Columns a and b: each document with `times` others of its query, drawn from those of other labels.

    Documents in the order of labels have those of their own label in one run, so a draw names a place
    outside the run, and one equi-join on (query, place) finds who stands there. Draws are digests of the seed,
    the query, the document and the number of the draw, the same however rows are dealt.
    """
    by_label, same = W.partitionBy("q").orderBy(F.desc("y"), "r"), W.partitionBy("q", "y")
    d = d.withColumn("k", F.row_number().over(by_label) - 1)
    d = d.withColumns({"from": F.min("k").over(same), "to": F.max("k").over(same) + 1, "n": F.count("*").over(W.partitionBy("q"))})
    others = F.col("from") + F.col("n") - F.col("to")
    draws = d.where(others > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("q", "i", "draw")]))
    at = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % others
    draws = draws.withColumn("at", F.when(at < F.col("from"), at).otherwise(at + F.col("to") - F.col("from")))
    whole = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in d.columns])
    met = draws.alias("x").join(d.alias("z"), (F.col("x.q") == F.col("z.q")) & (F.col("x.at") == F.col("z.k")))
    first = F.col("x.r") < F.col("z.r")
    return met.select(F.when(first, whole("x")).otherwise(whole("z")).alias("a"), F.when(first, whole("z")).otherwise(whole("x")).alias("b"))


def rank_pairs(
    df: DataFrame, kind: str, margin: str, y: str, qid: str, order: str, top: int | None = 32, normalise_scores: bool = True, exp_gain: bool = True, bias: PositionBias | None = None, draws: int = 0, seed: int = 0
) -> DataFrame:
    """A row for each pair of documents of a query whose labels differ, one of them ranked above `top`.

    Columns: qid, hi, lo (by `order`), lambda, hess. Only pairs with one of the first `top` ranks are
    made, so a query of n documents gives at most top * n; with `draws`, that many for each document. exp_gain: of
    ndcg, 2^y - 1 and not y. bias: both are divided by how likely the two were examined, and each side's cost,
    net of the other's likelihood, comes along (cost_hi, cost_lo).
    """
    value = dcg_gain if exp_gain else (lambda c: c)
    d = ranked_documents(df, margin, y, qid, order, None if draws else top, exp_gain, bias is not None)
    p = drawn_pairs(d, draws, seed) if draws else top_pairs(d, top)
    up = F.col("a.y") > F.col("b.y")
    hi = lambda c: F.when(up, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    lo = lambda c: F.when(up, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    if kind == "pairwise":
        delta = num(1)
    elif kind == "ndcg":
        change = (value(hi("y")) - value(lo("y"))) * (discount(hi("r")) - discount(lo("r")))
        delta = F.when(F.col("a.idcg") > 0, F.abs(change / F.nullif(F.col("a.idcg"), num(0)))).otherwise(num(0))
    else:
        delta = F.abs(map_change("a", "b"))
    if normalise_scores:
        delta = F.when(F.col("a.best") != F.col("a.worst"), delta / (F.abs(hi("s") - lo("s")) + 0.01)).otherwise(delta)
    sig = sigmoid(hi("s") - lo("s"))
    out = {"lambda": (sig - 1) * delta, "hess": F.greatest(sig * (1 - sig), num(EPS)) * delta * 2}
    if bias is not None:
        at = lambda values, pos: F.get(F.array(*map(num, values)), pos)
        known = (hi("pos") < bias.size) & (lo("pos") < bias.size)
        plus, minus = at(bias.plus, hi("pos")), at(bias.minus, lo("pos"))
        ok = known & (plus >= EPS) & (minus >= EPS)
        out = {c: F.when(ok, v / (plus * minus)).otherwise(v) for c, v in out.items()}
        cost = -F.log(1 - sig) * delta
        net = lambda by: F.when(known & (by >= EPS), cost / by).otherwise(num(0))
        out |= {"cost_hi": net(minus), "cost_lo": net(plus)}
    return p.select(F.col("a.q").alias("qid"), hi("i").alias("hi"), lo("i").alias("lo"), *[v.alias(c) for c, v in out.items()])


def map_change(a: str, b: str) -> Column:
    """How average precision changes when the documents of two ranks, a's above b's, change places.

    rel: relevant documents down to a rank; acc: the running sum of label by rank. Both sides' own
    precision terms change, and each rank between gains or loses one hit.
    """
    of = lambda t, n: F.col(f"{t}.{n}")
    ra, rb = of(a, "r") + 1, of(b, "r") + 1
    between = of(b, "acc") - of(a, "acc") - of(b, "y") / rb
    falls = of(a, "rel") / ra - of(b, "rel") / rb + between
    rises = (of(a, "rel") + 1) / ra - of(b, "rel") / rb + between
    change = F.when(of(a, "y") > of(b, "y"), falls).otherwise(-rises)
    return F.when(of(a, "all_rel") > 0, change / F.nullif(of(a, "all_rel"), num(0))).otherwise(num(0))


def rank_gradients(
    df: DataFrame, kind: str, margin: str, y: str, qid: str, order: str, top: int | None = 32, normalise: bool = True, normalise_scores: bool = True, exp_gain: bool = True,
    bias: PositionBias | None = None, draws: int = 0, seed: int = 0,
) -> DataFrame:
    """df with g and h: the sums of its pairs, scaled per query. With a bias also pos, li and lj, from which the next one is made."""
    pairs = rank_pairs(df, kind, margin, y, qid, order, top, normalise_scores, exp_gain, bias, draws, seed)
    costs = ("cost_hi", "cost_lo") if bias is not None else ()
    side = lambda who, sign, s, mine: pairs.select("qid", F.col(who).alias("i"), (sign * F.col("lambda")).alias("g"), F.col("hess").alias("h"), s.alias("s"), *[(F.col(c) if c == mine else num(0)).alias(c) for c in costs])
    sides = side("hi", 1, -2 * F.col("lambda"), "cost_hi").unionByName(side("lo", -1, num(0), "cost_lo"))
    rows = sides.groupBy("qid", "i").agg(*[F.sum(c).alias(c) for c in ("g", "h", "s", *costs)])
    rows = rows.withColumn("s", F.sum("s").over(W.partitionBy("qid")))
    if not normalise:
        scale = num(1)
    elif draws:
        scale = num(1 / draws)
    else:
        scale = F.when(F.col("s") > 0, F.log2(1 + F.col("s")) / F.nullif(F.col("s"), num(0))).otherwise(num(1))
    rows = rows.select(F.col("qid").alias("__q"), F.col("i").alias("__i"), (F.col("g") * scale).alias("g"), (F.col("h") * scale).alias("h"), *[F.col(c).alias(n) for c, n in zip(costs, ("li", "lj"), strict=False)])
    got = df.join(rows, (F.col(qid) == F.col("__q")) & (F.col(order) == F.col("__i")), "left").drop("__q", "__i")
    if bias is not None:
        got = got.withColumn("pos", F.row_number().over(W.partitionBy(qid).orderBy(order)) - 1)
    return got.withColumns({c: F.coalesce(c, num(0)) for c in ("g", "h", *(("li", "lj") if bias is not None else ()))})
