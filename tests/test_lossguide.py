"""Best-first growth that looks ahead gives the trees of one job a split, in fewer jobs."""

import numpy as np
import pytest

from copse.operators import grow
from copse.plans import train as T

from .test_engine import frame_of


@pytest.mark.parametrize("more", [{}, {"max_depth": 4, "min_child_weight": 20.0, "gamma": 0.05}])
def test_same_trees_in_fewer_jobs(spark, monkeypatch, more):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(900, 4)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.sin(2 * np.nan_to_num(x[:, 0])) + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2]) + rng.normal(size=900) * 0.1
    frame = frame_of(spark, x, y, parts=2)
    jobs, models = [], []
    whole = grow.Grower.grow

    def counted(self, df, scale):
        tree = whole(self, df, scale)
        jobs.append(self.jobs)
        return tree

    monkeypatch.setattr(grow.Grower, "grow", counted)
    for ahead in (1, 16):
        monkeypatch.setattr(T, "AHEAD", ahead)
        models.append(T.train({"grow_policy": "lossguide", "max_leaves": 64, "max_depth": 0, "disable_default_eval_metric": True, **more}, frame, 1))
    trees = [m.stumps[0].tree.to_json() for m in models]
    assert trees[0] == trees[1]
    leaves = sum(n.leaf for n in models[0].stumps[0].tree.nodes)
    if not more:
        assert leaves == 64 and 2 * jobs[1] <= jobs[0]
    assert jobs[1] <= jobs[0]
