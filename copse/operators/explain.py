"""Attributions of a tree's output to features, vectorised over rows."""

from __future__ import annotations

from math import factorial

import numpy as np

from .tree import Tree


def shap(tree: Tree, x: np.ndarray, output: int = 0, hidden: int | None = None) -> np.ndarray:
    """Exact path-dependent SHAP values (rows, features + 1); the last column is the mean output.

    Per leaf, the features of its path are players: with a player in, the row must take the path's
    branches; without, the path is followed by the children's shares of cover. Weights of coalitions by
    size come from a polynomial per leaf, with each player divided out by leaving it out of the product.
    hidden: a feature to treat as missing everywhere.
    """
    rows, out = len(x), np.zeros((len(x), tree.width + 1))
    if hidden is not None:
        x = x.copy()
        x[:, hidden] = np.nan
    left = {}

    def walk(i: int, players: dict):
        n = tree.nodes[i]
        if n.leaf:
            v = float(np.atleast_1d(n.value)[min(output, len(np.atleast_1d(n.value)) - 1)])
            finish(v, players)
            return
        if i not in left:
            left[i] = tree.goes_left(n, x[:, n.feature]).astype(bool)
        total = tree.nodes[n.left].cover + tree.nodes[n.right].cover
        for child, goes in ((n.left, left[i]), (n.right, ~left[i])):
            share = tree.nodes[child].cover / total if total > 0 else 0.0
            z, o = players.get(n.feature, (1.0, np.ones(rows, bool)))
            walk(child, {**players, n.feature: (z * share, o & goes)})

    def finish(v: float, players: dict):
        d = len(players)
        everything = v
        for z, _ in players.values():
            everything *= z
        out[:, -1] += everything
        for f, (z, o) in players.items():
            # Coalitions of the others by size: coefficients of the product of (z + o t).
            poly = np.zeros((rows, d))
            poly[:, 0] = 1.0
            k = 0
            for other, (z2, o2) in players.items():
                if other == f:
                    continue
                poly[:, 1 : k + 2] = poly[:, 1 : k + 2] * z2 + poly[:, : k + 1] * o2[:, None]
                poly[:, 0] *= z2
                k += 1
            w = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
            out[:, f] += poly @ w * (o - z) * v

    walk(0, {})
    return out


def saabas(tree: Tree, x: np.ndarray, output: int = 0, hidden: int | None = None) -> np.ndarray:
    """Attribution along the row's own path: each step's change of the mean output."""
    out = np.zeros((len(x), tree.width + 1))
    if hidden is not None:
        x = x.copy()
        x[:, hidden] = np.nan
    means = tree.means(output)
    out[:, -1] = means[0]
    todo = [(0, np.arange(len(x)))]
    while todo:
        i, rows = todo.pop()
        n = tree.nodes[i]
        if n.leaf:
            continue
        goes = tree.goes_left(n, x[rows, n.feature]).astype(bool)
        for child, own in ((n.left, rows[goes]), (n.right, rows[~goes])):
            out[own, n.feature] += means[child] - means[i]
            todo.append((child, own))
    return out


def interactions(one, width: int) -> np.ndarray:
    """(rows, features + 1, features + 1), symmetric, rows summing to the attributions.

    one(hidden) gives attributions with a feature held out as missing.
    """
    whole = one(None)
    out = np.zeros((len(whole), width + 1, width + 1))
    for i in range(width):
        change = (whole - one(i)) / 2
        out[:, i, :] = change
    out = (out + out.transpose(0, 2, 1)) / 2
    for i in range(width + 1):
        out[:, i, i] = 0
        out[:, i, i] = whole[:, i] - out[:, i, :].sum(axis=1)
    return out
