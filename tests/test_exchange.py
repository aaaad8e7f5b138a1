"""Models as public documents and tables; users' losses and metrics; refreshing after growth."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.functions import metrics, objectives
from copse.plans.exchange import from_document, to_document, with_trees
from copse.plans.train import train, update

from .test_engine import frame_of, margins


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[:, 2] = rng.integers(0, 9, 150)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, np.nan_to_num(x[:, 0]) + np.isin(x[:, 2], [1, 4, 7]) * 2.0 + rng.normal(size=150) * 0.1


CASES = [
    ({}, lambda y: y), ({"booster": "dart", "rate_drop": 0.5, "one_drop": True}, lambda y: y), ({"objective": "binary:logistic"}, lambda y: (y > 1).astype(float)), ({"objective": "count:poisson"}, lambda y: np.floor(np.abs(y))),
    ({"objective": "multi:softprob", "num_class": 3, "num_parallel_tree": 2, "subsample": 0.7}, lambda y: (np.abs(y) * 3 % 3).astype(int)), ({"multi_strategy": "multi_output_tree"}, lambda y: np.stack([y, -y], axis=1)),
    ({"booster": "gblinear", "kinds": ()}, lambda y: np.stack([y, 2 * y], axis=1)), ({"gamma": 1.0, "updater": "grow_quantile_histmaker,prune"}, lambda y: y),
]


@pytest.mark.parametrize("params,label", CASES)
def test_round_trip(spark, rows, params, label):
    x, y = rows
    params = dict(params)
    frame = frame_of(spark, x, label(y), kinds=params.pop("kinds", ("q", "q", "c")), names=("a", "b", "c"))
    own = {} if params.get("booster") == "gblinear" else {"max_depth": 3, "max_cat_to_onehot": 2}
    model = train({**own, "disable_default_eval_metric": True, **params}, frame, 2)
    text = to_document(model)
    again = from_document(text)
    assert json.loads(to_document(again)) == json.loads(text)
    assert np.allclose(margins(again, frame), margins(model, frame), atol=1e-12)
    assert (again.rounds, again.outputs, again.names, again.kinds) == (model.rounds, model.outputs, model.names, model.kinds)
    if model.linear is None:
        table = with_trees(replace(model, stumps=[]), model.trees_table(spark))
        assert (margins(table, frame) == margins(model, frame)).all()
        learner = json.loads(text)["learner"]
        tree = learner["gradient_booster"]["model"]["trees"][0]
        assert isinstance(tree["tree_param"]["num_nodes"], str) and len(tree["parents"]) == int(tree["tree_param"]["num_nodes"])
        assert ("leaf_weights" in tree) == ("multi_strategy" in params)


def test_documents_of_others():
    """A document without what only we write, and documents that are none."""
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "parents": [2147483647, 0, 0], "split_indices": [1, 0, 0], "split_conditions": [0.5, -1.0, 2.0], "default_left": [1, 0, 0], "base_weights": [0.1, -1, 2], "loss_changes": [3.0, 0, 0], "sum_hessian": [4.0, 2, 2], "split_type": [0, 0, 0], "categories": [], "categories_nodes": [], "categories_segments": [], "categories_sizes": [], "tree_param": {"num_feature": "2", "num_nodes": "3", "size_leaf_vector": "1", "num_deleted": "0"}}
    doc = {"learner": {"feature_names": [], "feature_types": [], "gradient_booster": {"name": "gbtree", "model": {"gbtree_model_param": {"num_parallel_tree": "1", "num_trees": "1"}, "tree_info": [0], "trees": [tree]}}, "learner_model_param": {"base_score": "2.5E-1", "num_class": "0", "num_feature": "2", "num_target": "1"}, "objective": {"name": "binary:logistic"}}}
    model = from_document(json.dumps(doc))
    assert model.base_score == [pytest.approx(np.log(1 / 3))] and model.rounds == 1
    assert model.stumps[0].tree.leaves(np.array([[0, 0.4], [0, 0.5], [0, np.nan]])).tolist() == [1, 2, 1]
    for broken in ("[]", "{}", json.dumps({**doc, "learner": {**doc["learner"], "gradient_booster": {"name": "other", "model": {}}}}), json.dumps(doc).replace('"left_children": [1, -1, -1]', '"left_children": [1, -1]'), json.dumps(doc).replace('"left_children": [1,', '"left_children": [7,'), json.dumps(doc).replace('"right_children": [2', '"right_children": [0')):
        with pytest.raises(ValueError):
            from_document(broken)


def test_own_loss_and_metric(spark, rows):
    """A user's loss by rows and by table trains like the built-in one it copies, and a user's metric steers early stopping."""
    x, y = rows
    frame = frame_of(spark, x, y)
    objectives.register("user:squares", lambda **_: objectives.Objective("user:squares", lambda m, t: (m - t, F.lit(1.0))))
    table = lambda df: df.withColumns({"g": F.array(F.get("margin", F.lit(0)) - F.get("label", F.lit(0))), "h": F.array(F.lit(1.0))})
    objectives.register("user:table", lambda **_: objectives.Objective("user:table", table=table))
    want = margins(train({"max_depth": 2}, frame, 2), frame)
    for name in ("user:squares", "user:table"):
        assert np.allclose(margins(train({"max_depth": 2, "objective": name, "disable_default_eval_metric": True}, frame, 2), frame), want)
    metrics.register("user-rounds", lambda df: df.agg(F.avg(F.get("prediction", F.lit(0)) * 0 - 1).alias("value")), more_is_better=True)
    model = train({"max_depth": 1, "eval_metric": "user-rounds"}, frame, 5, [("train", frame)], early_stopping_rounds=2)
    assert len(model.history) == 3 and model.best_iteration == 0 and model.history[0][3] == -1.0
    with pytest.raises(ValueError, match="unknown"):
        train({"eval_metric": "user-none"}, frame, 1, [("train", frame)])


def test_update_and_refresh(spark, rows):
    x, y = rows
    frame = frame_of(spark, x, y)
    two = train({"max_depth": 2}, frame, 2)
    assert np.allclose(margins(update(train({"max_depth": 2}, frame, 1), {"max_depth": 2}, frame), frame), margins(two, frame))
    grown = {"max_depth": 3, "subsample": 0.5, "disable_default_eval_metric": True}
    plain, fresh = train(grown, frame, 1), train({**grown, "updater": "grow_quantile_histmaker,refresh"}, frame, 1)
    a, b = plain.stumps[0].tree, fresh.stumps[0].tree
    assert [(n.feature, n.threshold) for n in a.nodes] == [(n.feature, n.threshold) for n in b.nodes]
    assert b.nodes[0].cover == 150 and a.nodes[0].cover < 150
    g = np.full(150, y.mean()) - y
    leaf = b.leaves(x)
    for i, n in enumerate(b.nodes):
        if n.leaf:
            assert n.value == pytest.approx(-0.3 * g[leaf == i].sum() / ((leaf == i).sum() + 1))
