"""Split search over a node's histogram of a feature, in numpy; each task searches the pairs dealt to it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Penalty:
    """What regularises leaves and splits."""

    lam: float = 1.0
    alpha: float = 0.0
    max_delta: float = 0.0
    min_child_weight: float = 1.0
    monotone: tuple[int, ...] = ()
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 64
    direction: str = "learn"

    def weight(self, g, h, lo=-np.inf, hi=np.inf):
        t = np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = -t / (h + self.lam)
        if self.max_delta:
            w = np.clip(w, -self.max_delta, self.max_delta)
        return np.clip(np.where(h <= 0, 0.0, w), lo, hi)

    def gain(self, g, h, lo=-np.inf, hi=np.inf):
        if self.max_delta or self.monotone:
            w = self.weight(g, h, lo, hi)
            return np.where(h <= 0, 0.0, -(2 * g * w + (h + self.lam) * w * w + 2 * self.alpha * np.abs(w)))
        t = np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h <= 0, 0.0, t * t / (h + self.lam))


@dataclass
class Split:
    gain: float = -np.inf
    feature: int = -1
    bin: int = -1
    threshold: float = 0.0
    default_left: bool = False
    categories: frozenset[int] | None = None
    left: tuple = field(default_factory=lambda: (0.0, 0.0))
    right: tuple = field(default_factory=lambda: (0.0, 0.0))


def scans(f: int, g: np.ndarray, h: np.ndarray, total: tuple, missing: bool, p: Penalty, categorical: bool = False, bounds=(-np.inf, np.inf)):
    """Every candidate of one feature of a node, scan by scan in the order in which ties are settled.

    g, h: (outputs, bins). Yields default_left, the candidates' gains (-inf: not valid), their left sums
    gl and hl (outputs, candidates), and what names candidate i: its bin (the last that goes left, -1
    where only missing values do), or the codes that go right.
    """
    G, H = (np.asarray(t, float).reshape(-1, 1) for t in total)
    lo, hi = bounds
    parent = p.gain(G, H, lo, hi).sum()
    c = p.monotone[f] if p.monotone and f < len(p.monotone) else 0
    k = g.shape[1]

    def scan(default_left, gl, hl, named):
        gr, hr = G - gl, H - hl
        ml, mr = hl.mean(axis=0), hr.mean(axis=0)
        gains = (p.gain(gl, hl, lo, hi) + p.gain(gr, hr, lo, hi)).sum(axis=0) - parent
        bad = (ml <= 0) | (mr <= 0) | (ml < p.min_child_weight) | (mr < p.min_child_weight)
        if c:
            wl, wr = p.weight(gl, hl, lo, hi)[0], p.weight(gr, hr, lo, hi)[0]
            bad |= wl > wr if c > 0 else wl < wr
        return default_left, np.where(bad, -np.inf, gains), gl, hl, named

    if categorical and k < p.max_cat_to_onehot:
        gs, hs = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        one = lambda i: frozenset([i])
        yield scan(False, gs - g, hs - h, one)  # missing goes right, with the code
        if missing:
            yield scan(True, G - g, H - h, one)
    elif categorical:
        gs, hs = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        order = np.argsort(p.weight(g.sum(axis=0), h.sum(axis=0)), kind="stable")
        back, steps = order[::-1], min(p.max_cat_threshold, k) - 1
        upto = lambda x, o: np.cumsum(x[:, o], axis=1)[:, :steps]
        yield scan(True, G - upto(g, order), H - upto(h, order), lambda i: frozenset(order[: i + 1].tolist()))
        yield scan(False, gs - upto(g, back), hs - upto(h, back), lambda i: frozenset(back[: i + 1].tolist()))
    else:
        if p.direction != "left":
            yield scan(False, np.cumsum(g, axis=1), np.cumsum(h, axis=1), lambda i: i)
        if p.direction == "left" or missing and p.direction == "learn":
            # From the highest bin down; the right side holds bins i.., missing goes left.
            yield scan(True, G - np.cumsum(g[:, ::-1], axis=1), H - np.cumsum(h[:, ::-1], axis=1), lambda i: k - 2 - i)


def feature_split(f: int, g, h, n, total, count: int, p: Penalty, categorical=False, bounds=(-np.inf, np.inf)) -> Split:
    """The best split of one feature; equal gains go to the scan that comes first, then to its earlier candidate."""
    best = Split()
    G, H = (np.asarray(t, float).reshape(-1, 1) for t in total)
    for default_left, gains, gl, hl, named in scans(f, g, h, total, int(n.sum()) < count, p, categorical, bounds):
        if not gains.size:
            continue
        i = int(np.argmax(gains))
        if gains[i] > best.gain and np.isfinite(gains[i]):
            name = named(i)
            cats = name if isinstance(name, frozenset) else None
            best = Split(float(gains[i]), f, -1 if cats is not None else name, 0.0, default_left, cats, (gl[:, i].copy(), hl[:, i].copy()), ((G[:, 0] - gl[:, i]), (H[:, 0] - hl[:, i])))
    return best


def threshold_of(s: Split, cuts: np.ndarray) -> float:
    return 0.0 if s.categories is not None else float(cuts[s.bin]) if s.bin >= 0 else -np.inf


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, total: tuple, count: int, cuts: list[np.ndarray], p: Penalty, features, categorical=(), bounds=(-np.inf, np.inf)) -> Split:
    """The best split of a node whose histograms are at hand; equal gains go to the smaller feature.

    g, h: (outputs, features, bins); n: (features, bins) rows; total: (G, H) arrays by output.
    """
    best = Split()
    for f in features:
        k = len(cuts[f])
        s = feature_split(f, g[:, f, :k], h[:, f, :k], n[f, :k], total, count, p, f in categorical, bounds)
        if s.gain > best.gain:
            s.threshold = threshold_of(s, cuts[f])
            best = s
    return best


class Constraints:
    """Which features a node may split on: those of any group that holds all features of its path."""

    def __init__(self, groups, width: int):
        self.groups = [frozenset(g) for g in groups or ()]
        self.all = range(width)

    def allowed(self, path: frozenset[int]):
        if not self.groups or not path:
            return self.all
        held = set(path)
        for g in self.groups:
            if path <= g:
                held |= g
        return sorted(held)
