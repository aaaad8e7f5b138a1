"""Models as documents of the public JSON shape, and as tables of nodes.

Fixed names of the public format: learner, gradient_booster, learner_model_param and the arrays of a tree.
Whole numbers among the parameters are strings there; vector leaves are rows of `leaf_weights`, found by
the slot that a leaf does not need for a right child; the base score is a prediction, not a margin.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions import objectives
from ..operators.tree import Node, Tree
from .model import Model, Stump

VERSION = [3, 0, 5]
NO_PARENT = 2147483647
#: What a split condition of a vector leaf reads: the least 32-bit number.
UNUSED = 1.401298464324817e-45


def to_prediction(name: str, params: dict, margin: float) -> float:
    """The inverse of an objective's to_margin."""
    link = objectives.create(name, **params).to_margin
    if link is objectives._logit:
        return 1 / (1 + math.exp(-margin))
    return math.exp(margin) if link is objectives._log else margin


def tree_document(tree: Tree, number: int) -> dict:
    vector = any(n.leaf and np.size(n.value) > 1 for n in tree.nodes)
    size = max(np.size(n.value) for n in tree.nodes) if vector else 1
    leaves, rows = {}, []
    for i, n in enumerate(tree.nodes):
        if vector and n.leaf:
            leaves[i] = len(rows)
            rows.append(np.broadcast_to(np.atleast_1d(n.value), size).tolist())
    split = [(i, sorted(n.categories)) for i, n in enumerate(tree.nodes) if n.categories is not None and not n.leaf]
    starts = np.cumsum([0, *(len(c) for _, c in split)]).tolist()
    number_of = lambda v: float(np.mean(v)) if np.ndim(v) == 0 or np.size(v) == 1 else [float(x) for x in v]
    out = {
        "base_weights": [number_of(n.weight) for n in tree.nodes], "categories": [c for _, own in split for c in own], "categories_nodes": [i for i, _ in split],
        "categories_segments": starts[:-1], "categories_sizes": [len(c) for _, c in split], "default_left": [int(n.default_left) for n in tree.nodes], "id": number,
        "left_children": [n.left for n in tree.nodes], "loss_changes": [float(n.gain) for n in tree.nodes], "parents": [(-1 if vector else NO_PARENT) if n.parent < 0 else n.parent for n in tree.nodes],
        "right_children": [leaves.get(i, n.right) for i, n in enumerate(tree.nodes)],
        "split_conditions": [(UNUSED if vector else float(np.atleast_1d(n.value)[0])) if n.leaf else float(n.threshold) for n in tree.nodes],
        "split_indices": [n.feature for n in tree.nodes], "split_type": [int(n.categories is not None and not n.leaf) for n in tree.nodes], "sum_hessian": [float(n.cover) for n in tree.nodes],
        "tree_param": {"num_deleted": str(sum(n.deleted for n in tree.nodes)), "num_feature": str(tree.width), "num_nodes": str(len(tree.nodes)), "size_leaf_vector": str(size)},
    }
    return out | ({"leaf_weights": [v for row in rows for v in row]} if vector else {})


def tree_of(d: dict, width: int) -> Tree:
    names = ("left_children", "right_children", "parents", "split_indices", "split_conditions", "default_left", "base_weights", "loss_changes", "sum_hessian")
    missing = [k for k in (*names, "tree_param") if k not in d]
    if missing:
        raise ValueError(f"a tree lacks {', '.join(missing)}")
    n = len(d["left_children"])
    if any(len(d[k]) != n for k in names):
        raise ValueError("the arrays of a tree differ in length")
    size = int(d["tree_param"]["size_leaf_vector"])
    values = np.array(d["leaf_weights"], float).reshape(-1, size) if "leaf_weights" in d else None
    cats = {i: frozenset(d["categories"][a : a + k]) for i, a, k in zip(d.get("categories_nodes", []), d.get("categories_segments", []), d.get("categories_sizes", []), strict=True)}
    tree = Tree(width, [])
    for i, (left, right, parent, f, cut, default, weight, gain, cover) in enumerate(zip(*(d[k] for k in names), strict=True)):
        if left >= n or (left >= 0 and right >= n) or not 0 <= f < max(width, 1):
            raise ValueError(f"node {i} names a child or a feature that is not there")
        leaf = left < 0
        value = (values[right] if values is not None else cut) if leaf else 0.0
        tree.nodes.append(Node(-1 if parent in (-1, NO_PARENT) else parent, left, -1 if leaf else right, f, 0.0 if leaf else cut, -1, bool(default), cats.get(i), value, np.array(weight) if isinstance(weight, list) else weight, gain, cover))
    return settled(tree)


def settled(tree: Tree) -> Tree:
    """A tree's depths, from the root down, and which of its nodes no path reaches."""
    seen, todo = set(), [(0, 0)]
    while todo:
        i, depth = todo.pop()
        if i in seen:
            raise ValueError("the nodes of a tree form a circle")
        seen.add(i)
        n = tree.nodes[i]
        n.depth = depth
        if not n.leaf:
            todo += [(n.left, depth + 1), (n.right, depth + 1)]
    for i, n in enumerate(tree.nodes):
        n.deleted = i not in seen
    return tree


def to_document(model: Model) -> str:
    groups = max(model.outputs, 1)
    classes = groups if model.objective.startswith("multi:") else 0
    score = [repr(to_prediction(model.objective, model.objective_params, float(b))) for b in model.base_score]
    attributes = {"objective_params": json.dumps({k: v for k, v in model.objective_params.items() if v is not None})}
    attributes |= {k: str(v) for k, v in (("best_iteration", model.best_iteration), ("best_score", model.best_score)) if v is not None}
    if model.linear is not None:
        booster = {"model": {"weights": model.linear.ravel().tolist(), "boosted_rounds": model.rounds}, "name": "gblinear"}
    else:
        ends = [sum(s.round < r for s in model.stumps) for r in range(model.rounds + 1)]
        vector = any(np.size(n.value) > 1 for s in model.stumps for n in s.tree.nodes)
        parallel = max(1, ends[1] // (1 if vector else groups)) if len(ends) > 1 else 1
        body = {
            "gbtree_model_param": {"num_parallel_tree": str(parallel), "num_trees": str(len(model.stumps))}, "iteration_indptr": ends,
            "tree_info": [s.group for s in model.stumps], "trees": [tree_document(s.tree, i) for i, s in enumerate(model.stumps)],
        }
        booster = {"model": body, "name": model.booster, "weight_drop": [float(s.weight) for s in model.stumps] if model.booster == "dart" else []}
    param = {"base_score": score[0] if len(score) == 1 else f"({','.join(score)})", "boost_from_average": "1", "num_class": str(classes), "num_feature": str(model.width), "num_target": str(1 if classes else groups)}
    learner = {"attributes": attributes, "feature_names": list(model.names), "feature_types": list(model.kinds), "gradient_booster": booster, "learner_model_param": param, "objective": {"name": model.objective, "reg_loss_param": {"scale_pos_weight": "1"}}}
    return json.dumps({"learner": learner, "version": VERSION})


def from_document(text: str) -> Model:
    """A model of a document of this shape, whoever wrote it; ValueError for what is not one."""
    try:
        learner = json.loads(text)["learner"]
        booster, param, name = learner["gradient_booster"], learner["learner_model_param"], learner["objective"]["name"]
        kind, body, width = booster["name"], booster["model"], int(param["num_feature"])
        groups = int(param.get("num_class", 0)) or max(1, int(param.get("num_target", 1)))
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"not a model document: {e}") from e
    if kind not in ("gbtree", "dart", "gblinear"):
        raise ValueError(f"unsupported booster: {kind}")
    attributes = learner.get("attributes", {})
    params = json.loads(attributes.get("objective_params", "{}"))
    if name.startswith("multi:"):
        params.setdefault("num_class", groups)
    to_margin = objectives.create(name, **params).to_margin
    base = [to_margin(float(v)) for v in param["base_score"].strip("()[] ").split(",")]
    names, kinds = tuple(learner.get("feature_names", ())), tuple(learner.get("feature_types", ()))
    if any(own and len(own) != width for own in (names, kinds)):
        raise ValueError(f"feature names or types are not {width}")
    best, score = attributes.get("best_iteration"), attributes.get("best_score")
    model = Model(kind, name, params, width, groups, base * (groups if len(base) == 1 else 1), names=names, kinds=kinds, best_iteration=None if best is None else int(best), best_score=None if score is None else float(score))
    if kind == "gblinear":
        if len(body["weights"]) != (width + 1) * groups:
            raise ValueError(f"{len(body['weights'])} weights for {width} features and {groups} outputs")
        model.linear = np.array(body["weights"], float).reshape(width + 1, groups)
        return model
    trees, info = body["trees"], body.get("tree_info") or [0] * len(body["trees"])
    drop = booster.get("weight_drop") or [1.0] * len(trees)
    if not len(info) == len(trees) == len(drop):
        raise ValueError(f"tree_info or weight_drop are not {len(trees)}")
    each = max(1, int(body["gbtree_model_param"].get("num_parallel_tree", 1))) * (1 if any("leaf_weights" in t for t in trees) else groups)
    ends = body.get("iteration_indptr") or list(range(0, len(trees) + 1, each))
    model.stumps = [Stump(tree_of(t, width), g, w, int(np.searchsorted(ends, i, "right")) - 1) for i, (t, g, w) in enumerate(zip(trees, info, drop, strict=True))]
    return model


def with_trees(model: Model, table: DataFrame) -> Model:
    """model with the trees of a table of nodes (Model.trees_table); the driver holds a model's nodes, as everywhere."""
    held: dict[int, list] = {}
    for r in table.collect():
        held.setdefault(r["tree_id"], []).append(r)
    stumps = []
    for _, rows in sorted(held.items()):
        rows.sort(key=lambda r: r["node"])
        if [r["node"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"tree {rows[0]['tree_id']} lacks nodes")
        one = lambda v: v[0] if len(v) == 1 else np.array(v)
        nodes = [
            Node(r["parent"], r["lft"], r["rgt"], r["split_index"], r["threshold"], -1, r["default_left"], frozenset(r["cats"]) if r["cats"] is not None else None, one(r["leaf_value"]), one(r["base_weight"]), r["gain"], r["cover"])
            for r in rows
        ]
        stumps.append(Stump(settled(Tree(model.width, nodes)), rows[0]["grp"], rows[0]["tree_weight"], rows[0]["round"]))
    return Model(**{**model.__dict__, "stumps": stumps})
