"""Scalar building blocks as Column expressions in doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the error function's polynomial (Abramowitz and Stegun 7.1.26); fixed values.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
#: Lanczos coefficients for g = 7; fixed values.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, num(0)) + F.log1p(F.exp(-F.abs(x)))


def softplus_inverse(x: float) -> float:
    return x if x > 20 else math.log(math.expm1(max(x, 1e-12)))


def softmax(margins: Column) -> Column:
    most = F.array_max(margins)
    e = F.transform(margins, lambda x: F.exp(x - most))
    total = F.aggregate(e, num(0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = num(0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def log_gamma(x: Column) -> Column:
    """For x >= 0.5, which label + 1 always is."""
    z = x - 1
    total = num(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def soft_threshold(g: Column, alpha) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - alpha, num(0))


def weight(g: Column, h: Column, lam=1.0, alpha=0.0, max_delta=0.0) -> Column:
    """The leaf weight that minimises the regularised second-order loss."""
    w = -soft_threshold(g, alpha) / (h + lam)
    if max_delta:
        w = F.greatest(num(-max_delta), F.least(num(max_delta), w))
    return F.when(h <= 0, num(0)).otherwise(w)


def gain_at(g: Column, h: Column, w: Column, lam=1.0, alpha=0.0) -> Column:
    return -(2 * g * w + (h + lam) * w * w + 2 * alpha * F.abs(w))


def gain(g: Column, h: Column, lam=1.0, alpha=0.0, max_delta=0.0) -> Column:
    if max_delta:
        return F.when(h <= 0, num(0)).otherwise(gain_at(g, h, weight(g, h, lam, alpha, max_delta), lam, alpha))
    t = soft_threshold(g, alpha)
    return F.when(h <= 0, num(0)).otherwise(t * t / (h + lam))


def dcg_gain(y: Column) -> Column:
    return F.pow(num(2), F.least(num(31), F.greatest(num(0), F.floor(y).cast("double")))) - 1


def discount(rank: Column) -> Column:
    """rank counts from 0."""
    return 1 / F.log2(rank.cast("double") + 2)


def coordinate_delta(g: Column, h: Column, w: Column, alpha=0.0, lam=0.0) -> Column:
    """An elastic-net Newton step of one coordinate that stops where the weight would cross zero."""
    gl2, hl2 = g + lam * w, h + lam
    past = w - gl2 / hl2
    down, up = F.greatest(-(gl2 + alpha) / hl2, -w), F.least(-(gl2 - alpha) / hl2, -w)
    return F.when(h < 1e-5, num(0)).when(past >= 0, down).otherwise(up)
