"""Training parameters: names, defaults, ranges, cross checks and warnings."""

from __future__ import annotations

import json
import math

UPDATERS = ("grow_colmaker", "grow_quantile_histmaker", "grow_histmaker", "refresh", "prune", "sync", "grow_gpu_hist", "grow_gpu_approx")
MODIFIERS = ("refresh", "prune", "sync")

_CHOICES = {
    "booster": ("gbtree", "dart", "gblinear"), "tree_method": ("auto", "exact", "approx", "hist"), "grow_policy": ("depthwise", "lossguide"), "sampling_method": ("uniform", "gradient_based"),
    "process_type": ("default", "update"), "multi_strategy": ("one_output_per_tree", "multi_output_tree"), "sample_type": ("uniform", "weighted"), "normalize_type": ("tree", "forest"),
    "feature_selector": ("cyclic", "shuffle", "random", "greedy", "thrifty"), "linear_updater": ("shotgun", "coord_descent"), "verbosity": (0, 1, 2, 3), "default_direction": ("learn", "left", "right"),
    "aft_loss_distribution": ("normal", "logistic", "extreme"), "lambdarank_pair_method": ("topk", "mean"),
}

DEFAULTS: dict = {
    "booster": "gbtree", "device": "cpu", "verbosity": 1, "nthread": 0, "validate_parameters": False, "disable_default_eval_metric": False, "fail_on_invalid_gpu_id": False, "use_rmm": False,
    "eta": 0.3, "gamma": 0.0, "max_depth": 6, "min_child_weight": 1.0, "max_delta_step": 0.0, "lambda": 1.0, "alpha": 0.0,
    "subsample": 1.0, "sampling_method": "uniform", "colsample_bytree": 1.0, "colsample_bylevel": 1.0, "colsample_bynode": 1.0,
    "tree_method": "auto", "updater": (), "grow_policy": "depthwise", "max_leaves": 0, "max_bin": 256, "num_parallel_tree": 1, "process_type": "default", "refresh_leaf": True,
    "multi_strategy": "one_output_per_tree", "monotone_constraints": (), "interaction_constraints": (), "max_cat_to_onehot": 4, "max_cat_threshold": 64,
    "max_cached_hist_node": 65536, "sparse_threshold": 0.2, "debug_synchronize": False, "opt_dense_col": 1.0, "default_direction": "learn",
    "sample_type": "uniform", "normalize_type": "tree", "rate_drop": 0.0, "one_drop": False, "skip_drop": 0.0,
    "linear_updater": "shotgun", "feature_selector": "cyclic", "top_k": 0, "tolerance": 0.0, "max_row_perbatch": None,
    "objective": "reg:squarederror", "base_score": None, "eval_metric": (), "seed": 0, "seed_per_iteration": False, "num_target": 1, "boost_from_average": True, "scale_pos_weight": 1.0,
    "huber_slope": 1.0, "quantile_alpha": (), "expectile_alpha": (), "tweedie_variance_power": 1.5, "aft_loss_distribution": "normal", "aft_loss_distribution_scale": 1.0, "num_class": 0,
    "lambdarank_pair_method": "topk", "lambdarank_num_pair_per_sample": None, "lambdarank_normalization": True, "lambdarank_score_normalization": True, "lambdarank_unbiased": False, "lambdarank_bias_norm": 1.0, "ndcg_exp_gain": True,
}

#: Accepted and without effect: Spark does what they tune.
INERT = ("nthread", "max_cached_hist_node", "sparse_threshold", "debug_synchronize", "use_rmm", "fail_on_invalid_gpu_id")
ALIASES = {"learning_rate": "eta", "min_split_loss": "gamma", "reg_lambda": "lambda", "reg_alpha": "alpha", "random_state": "seed"}

_RANGES = {
    "eta": (0, math.inf), "gamma": (0, math.inf), "max_depth": (0, 30), "min_child_weight": (0, math.inf), "max_delta_step": (0, math.inf), "lambda": (0, math.inf), "alpha": (0, math.inf),
    "subsample": (1e-12, 1), "colsample_bytree": (1e-12, 1), "colsample_bylevel": (1e-12, 1), "colsample_bynode": (1e-12, 1), "max_leaves": (0, math.inf), "max_bin": (2, 65535), "num_parallel_tree": (1, math.inf),
    "max_cat_to_onehot": (1, math.inf), "max_cat_threshold": (1, math.inf), "rate_drop": (0, 1), "skip_drop": (0, 1), "tweedie_variance_power": (1, 1.999999), "top_k": (0, math.inf), "tolerance": (0, math.inf),
    "sparse_threshold": (0, 1), "opt_dense_col": (0, 1), "huber_slope": (1e-12, math.inf), "aft_loss_distribution_scale": (1e-12, math.inf), "scale_pos_weight": (0, math.inf), "num_target": (1, math.inf), "max_cached_hist_node": (1, math.inf), "lambdarank_bias_norm": (0, math.inf),
}


class Params(dict):
    """Checked parameters; unknown names and values out of range raise ValueError."""

    def __init__(self, given: dict | None = None, **more):
        given = {**(given or {}), **more}
        super().__init__(DEFAULTS)
        for k, v in given.items():
            k = ALIASES.get(k, k)
            if k not in DEFAULTS:
                raise ValueError(f"unknown parameter: {k}")
            self[k] = v
        if self["booster"] == "gblinear":
            for k, v in (("eta", 0.5), ("lambda", 0.0)):
                if k not in {ALIASES.get(x, x) for x in given}:
                    self[k] = v
        self.given = {ALIASES.get(k, k) for k in given}
        self.check()

    def check(self) -> None:
        for k, choices in _CHOICES.items():
            if self[k] not in choices:
                raise ValueError(f"{k} must be one of {choices}, got {self[k]!r}")
        for k, (lo, hi) in _RANGES.items():
            v = self[k]
            if isinstance(v, bool) or not isinstance(v, int | float) or not lo <= v <= hi or not math.isfinite(v):
                raise ValueError(f"{k} must be between {lo} and {hi}, got {v!r}")
        device = str(self["device"])
        if device != "cpu":
            raise ValueError(f"device {device!r} is not available; only cpu")
        for u in self.updaters():
            if u not in UPDATERS:
                raise ValueError(f"unknown updater: {u}")
            if "gpu" in u:
                raise ValueError(f"updater {u} needs a device that is not available")
        if self["booster"] != "gblinear" and self["max_depth"] == 0 and self["max_leaves"] == 0:
            raise ValueError("max_depth and max_leaves must not both be 0")
        if self["process_type"] == "update" and not set(self.updaters()) & {"refresh", "prune"}:
            raise ValueError("process_type=update needs the updater refresh or prune")
        if self.method() == "exact" and (self["colsample_bynode"] < 1 or self["sampling_method"] == "gradient_based" or self["grow_policy"] == "lossguide"):
            raise ValueError("exact takes neither colsample_bynode nor gradient_based sampling nor lossguide")
        if self["multi_strategy"] == "multi_output_tree" and self["tree_method"] not in ("auto", "hist"):
            raise ValueError("multi_output_tree needs tree_method hist")
        if self["linear_updater"] == "shotgun" and self["feature_selector"] not in ("cyclic", "shuffle"):
            raise ValueError("shotgun takes only the selectors cyclic and shuffle")
        batch = self["max_row_perbatch"]
        if batch is not None and (isinstance(batch, bool) or not isinstance(batch, int) or batch < 1):
            raise ValueError(f"max_row_perbatch must be a whole number from 1 on, got {batch!r}")
        pairs = self["lambdarank_num_pair_per_sample"]
        if pairs is not None and (isinstance(pairs, bool) or not isinstance(pairs, int) or pairs < 1):
            raise ValueError(f"lambdarank_num_pair_per_sample must be a whole number from 1 on, got {pairs!r}")
        if any(c not in (-1, 0, 1) for c in self["monotone_constraints"]):
            raise ValueError("monotone_constraints are -1, 0 or 1")

    def updaters(self) -> tuple[str, ...]:
        u = self["updater"]
        return tuple(x.strip() for x in u.split(",") if x.strip()) if isinstance(u, str) else tuple(u)

    def method(self) -> str:
        for u, m in (("grow_colmaker", "exact"), ("grow_histmaker", "approx"), ("grow_quantile_histmaker", "hist")):
            if u in self.updaters():
                return m
        return "hist" if self["tree_method"] == "auto" else self["tree_method"]

    def modifiers(self) -> list[str]:
        own = [u for u in self.updaters() if u in ("refresh", "prune")]
        return own if own or self["process_type"] == "update" else (["prune"] if self.method() == "exact" else [])

    def warnings(self) -> list[str]:
        out = []
        if self["updater"]:
            out.append("updater is set explicitly; tree_method is the plainer way")
        if self["objective"] == "reg:linear":
            out.append("reg:linear is now reg:squarederror")
        if self["sampling_method"] == "gradient_based" and self["subsample"] == 1:
            out.append("sampling_method has no effect without subsample")
        return out

    def unused(self) -> list[str]:
        """Given parameters that this training does not look at."""
        linear = {"linear_updater", "feature_selector", "top_k", "tolerance", "max_row_perbatch"}
        dart = {"sample_type", "normalize_type", "rate_drop", "one_drop", "skip_drop"}
        tree = {"gamma", "max_depth", "min_child_weight", "subsample", "tree_method", "grow_policy", "max_leaves", "max_bin", "num_parallel_tree", "monotone_constraints", "interaction_constraints"}
        off = set(INERT)
        off |= tree | dart if self["booster"] == "gblinear" else linear | (dart if self["booster"] == "gbtree" else set())
        off |= {"max_row_perbatch"} if self["linear_updater"] != "shotgun" else set()
        off |= set() if self.method() == "exact" else {"default_direction", "opt_dense_col"}
        return sorted(self.given & off)

    def to_map(self) -> dict[str, str]:
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in self.items() if v is not None}

    def to_json(self) -> str:
        return json.dumps(self.to_map())
