"""Regression trees on the driver: nodes, walks over numpy columns, pruning, and JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROOT_PARENT = 2147483647


@dataclass
class Node:
    parent: int = -1
    left: int = -1
    right: int = -1
    feature: int = 0
    threshold: float = 0.0
    bin: int = -1
    default_left: bool = False
    categories: frozenset[int] | None = None  # codes that go right
    value: np.ndarray | float = 0.0
    weight: np.ndarray | float = 0.0
    gain: float = 0.0
    cover: float = 0.0
    depth: int = 0
    deleted: bool = False

    @property
    def leaf(self) -> bool:
        return self.left < 0


@dataclass
class Tree:
    width: int
    nodes: list[Node] = field(default_factory=lambda: [Node()])

    def split(self, i: int, **split) -> tuple[int, int]:
        """Turn leaf i into a split; the numbers of its children."""
        n = self.nodes[i]
        n.left, n.right = len(self.nodes), len(self.nodes) + 1
        for k, v in split.items():
            setattr(n, k, v)
        self.nodes += [Node(parent=i, depth=n.depth + 1), Node(parent=i, depth=n.depth + 1)]
        return n.left, n.right

    def live(self):
        return [(i, n) for i, n in enumerate(self.nodes) if not n.deleted]

    def goes_left(self, n: Node, v: np.ndarray) -> np.ndarray:
        """Where values go; NaN is missing. Codes of no known category go left."""
        missing = np.isnan(v)
        if n.categories is not None:
            ok = ~missing & (v >= 0) & (v == np.floor(v))
            left = ~(ok & np.isin(np.where(ok, v, -1), list(n.categories)))
        else:
            left = v < n.threshold
        return np.where(missing, n.default_left, left)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x (rows, features)."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            n = self.nodes[i]
            if n.leaf:
                at[rows] = i
                continue
            left = self.goes_left(n, x[rows, n.feature]).astype(bool)
            todo += [(n.left, rows[left]), (n.right, rows[~left])]
        return at

    def leaves_by_bin(self, bins: np.ndarray) -> np.ndarray:
        """The same on binned rows (-1: missing), by the bins that splits were found at."""
        at = np.zeros(len(bins), np.int64)
        todo = [(0, np.arange(len(bins)))]
        while todo:
            i, rows = todo.pop()
            n = self.nodes[i]
            if n.leaf or not len(rows):
                at[rows] = i
                continue
            b = bins[rows, n.feature]
            left = ~np.isin(b, list(n.categories)) if n.categories is not None else b <= n.bin
            left = np.where(b < 0, n.default_left, left).astype(bool)
            todo += [(n.left, rows[left]), (n.right, rows[~left])]
        return at

    def values(self) -> np.ndarray:
        """(nodes, outputs); zero for splits."""
        rows = [np.atleast_1d(n.value if n.leaf else np.zeros_like(np.atleast_1d(n.weight), float)) for n in self.nodes]
        width = max(len(r) for r in rows)
        return np.array([r if len(r) == width else np.zeros(width) for r in rows], float)

    def means(self, output: int = 0) -> np.ndarray:
        """Cover-weighted mean value of an output below each node."""
        out = np.zeros(len(self.nodes))
        for i in range(len(self.nodes) - 1, -1, -1):
            n = self.nodes[i]
            if n.deleted:
                continue
            if n.leaf:
                v = np.atleast_1d(n.value)
                out[i] = float(v[min(output, len(v) - 1)])
            else:
                a, b = self.nodes[n.left].cover, self.nodes[n.right].cover
                out[i] = (out[n.left] * a + out[n.right] * b) / (a + b) if a + b > 0 else 0.0
        return out

    def prune(self, gamma: float, eta: float, max_depth: int = 0) -> int:
        """Collapse splits of too little gain (or too deep) from below; how many went."""
        gone = 0
        for i in range(len(self.nodes) - 1, -1, -1):
            n = self.nodes[i]
            if n.deleted or n.leaf or not (self.nodes[n.left].leaf and self.nodes[n.right].leaf):
                continue
            if n.gain < gamma or (max_depth and n.depth >= max_depth):
                self.nodes[n.left].deleted = self.nodes[n.right].deleted = True
                n.left = n.right = -1
                n.categories, n.gain = None, 0.0
                n.value = eta * np.asarray(n.weight) if np.ndim(n.weight) else eta * n.weight
                gone += 1
        return gone

    def to_json(self, number: int = 0) -> dict:
        out = {k: [] for k in ("base_weights", "default_left", "left_children", "loss_changes", "parents", "right_children", "split_conditions", "split_indices", "split_type", "sum_hessian")}
        cats = {"categories": [], "categories_nodes": [], "categories_segments": [], "categories_sizes": []}
        leaf_vectors = []
        for i, n in enumerate(self.nodes):
            w = np.atleast_1d(n.weight)
            out["base_weights"].append(float(w[0]) if len(w) == 1 else [float(x) for x in w])
            out["default_left"].append(int(n.default_left))
            out["left_children"].append(n.left)
            out["right_children"].append(n.right)
            out["parents"].append(ROOT_PARENT if n.parent < 0 else n.parent)
            out["loss_changes"].append(float(n.gain))
            out["sum_hessian"].append(float(n.cover))
            v = np.atleast_1d(n.value)
            out["split_conditions"].append(float(v[0]) if n.leaf else float(n.threshold))
            out["split_indices"].append(n.feature)
            out["split_type"].append(int(n.categories is not None))
            if n.leaf and len(v) > 1:
                leaf_vectors.append([i, [float(x) for x in v]])
            if n.categories is not None:
                cats["categories_nodes"].append(i)
                cats["categories_segments"].append(len(cats["categories"]))
                cats["categories_sizes"].append(len(n.categories))
                cats["categories"] += sorted(n.categories)
        deleted = [i for i, n in enumerate(self.nodes) if n.deleted]
        sizes = {"num_nodes": str(len(self.nodes)), "num_feature": str(self.width), "num_deleted": str(len(deleted)), "size_leaf_vector": str(max(len(np.atleast_1d(n.value)) for n in self.nodes))}
        return {**out, **cats, "id": number, "deleted_nodes": deleted, "leaf_vectors": leaf_vectors, "tree_param": sizes}

    @classmethod
    def from_json(cls, d: dict) -> Tree:
        t = cls(int(d["tree_param"]["num_feature"]), [])
        cats = {i: frozenset(d["categories"][a : a + n]) for i, a, n in zip(d.get("categories_nodes", []), d.get("categories_segments", []), d.get("categories_sizes", []), strict=True)}
        vectors = {i: np.array(v) for i, v in d.get("leaf_vectors", [])}
        deleted = set(d.get("deleted_nodes", []))
        for i, left in enumerate(d["left_children"]):
            w = d["base_weights"][i]
            p = d["parents"][i]
            t.nodes.append(Node(
                -1 if p == ROOT_PARENT else p, left, d["right_children"][i], d["split_indices"][i], d["split_conditions"][i], -1, bool(d["default_left"][i]), cats.get(i),
                vectors.get(i, d["split_conditions"][i] if left < 0 else 0.0), np.array(w) if isinstance(w, list) else w, d["loss_changes"][i], d["sum_hessian"][i], 0, i in deleted,
            ))
        for n in t.nodes:  # parents come before children
            n.depth = t.nodes[n.parent].depth + 1 if n.parent >= 0 else 0
        return t
