"""The training loop."""

from __future__ import annotations

import logging
import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import metrics, objectives
from ..functions.objectives import InvalidLabel, Objective
from ..functions.running import numbered, ranged, running
from ..functions.scalar import num
from ..operators import linear
from ..operators.cuts import bin_array, feature_cuts
from ..operators.exact import ExactGrower, column_facts, ranges_for, value_blocks
from ..operators.grow import AHEAD, Grower, blocks, cell_type, fixed_scale, pack_bins
from ..operators.sparse import Layout, SparseGrower, add_cells, packed, row_cells, sparse_blocks, sparse_cuts
from ..operators.split import Penalty
from ..operators.tree import Tree
from ..sources.frame import Frame
from .model import Model, Stump, add_margin, choose_dropped, leaf_finder, wide
from .params import Params

log = logging.getLogger("copse")
#: Rounds after which the state's lineage is cut by a checkpoint.
CUT_EVERY = 8


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) by hash, the same however rows are dealt."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def add_bins(df: DataFrame, cuts: list[np.ndarray], categorical) -> DataFrame:
    """df with `bins`: cells of each row's features."""
    width, cats, kind = len(cuts), frozenset(categorical), cell_type(max(map(len, cuts), default=0))

    @F.arrow_udf("binary")
    def binned(features: pa.Array) -> pa.Array:
        x = wide(features, width)
        bins = np.stack([bin_array(x[:, f], cuts[f], f in cats) for f in range(width)], axis=1) if width else np.zeros((len(x), 0))
        return pack_bins(bins, kind)

    return df.withColumn("bins", binned("features"))


#: What training reads of its rows.
COLUMNS = ("row_id", "features", "entries", "label", "weight", "base_margin", "label_lower", "label_upper", "qid")


def slim(frame: Frame) -> Frame:
    return replace(frame, df=frame.df.select(*[c for c in COLUMNS if c in frame.df.columns]))


#: Values that one window of the search for the sampling threshold may hold.
MOST_VALUES = 100_000


def sampling_threshold(sizes: DataFrame, share: float) -> float:
    """The u at which the sum of min(1, s / u) over all s is share of the rows, exactly. sizes: s.

    Sums by range of values tell which range holds u; ranges are cut again while that one holds too many
    distinct values, and then one window over its values finds u. Equal values are one row from the start.
    """
    values = sizes.groupBy("s").agg(F.count("*").alias("c"), F.sum("s").alias("t"))
    n, total = values.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), num(0))).first()
    want, below, above = int(share * n), 0.0, 0  # the sum of values under the range, the number of rows over it
    if want == 0:
        return math.inf
    expected = lambda s, under, over: under / s + over if s > 0 else math.inf
    while values.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        parts = ranged(values, "s").groupBy("__range").agg(F.max("s").alias("top"), F.min("s").alias("low"), F.sum("c").alias("c"), F.sum("t").alias("t")).orderBy("__range").collect()
        under, over, found = below, above + sum(r["c"] for r in parts), None
        for r in parts:
            start, under, over = under, under + r["t"], over - r["c"]
            if expected(r["top"], under, over) <= want:
                found = (r, start, over)
                break
        if found is None:  # over the highest value
            return (below + sum(r["t"] for r in parts)) / (want - above)
        r, below, above = found
        values = values.where(F.col("s").between(r["low"], r["top"]))
        if len(parts) == 1:
            break
    low, rows = values.agg(F.min("s"), F.sum("c")).first()
    if want > above + rows and below / (want - above - rows) <= low:  # between the range before and this one
        return below / (want - above - rows)
    run = W.orderBy("s")  # at most MOST_VALUES, or one value
    inside = values.select("s", "c", F.sum("t").over(run).alias("under"), (F.lit(rows) - F.sum("c").over(run)).alias("over"), F.lead("s").over(run).alias("next"))
    left = F.lit(want) - F.col("over") - above
    u = F.when(left > 0, (F.col("under") + below) / F.nullif(left, F.lit(0)))
    got = inside.withColumn("u", u).where((F.col("u") > F.col("s")) & (F.col("next").isNull() | (F.col("u") <= F.col("next")))).orderBy("s").first()
    if got:
        return float(got["u"])
    return float(total / want)


#: Rows of a task above which training deals rows anew, if other tasks have much fewer.
MOST_ROWS = 50_000


def balanced(frame: Frame, rows: int, most: int) -> Frame:
    """frame, its rows dealt anew (once, by their ids) if one task has over twice its share of them: each round reads all rows several times."""
    tasks = frame.df.sparkSession.sparkContext.defaultParallelism
    if most <= max(MOST_ROWS, 2 * rows / tasks):
        return frame
    return replace(frame, df=frame.df.repartition(max(tasks, -(-rows // (1 << 20))), "row_id"))


class Trainer:
    def __init__(self, params: Params, frame: Frame, base: Model | None = None):
        self.params, self.frame, self.base = params, frame, base
        self.bias, self.pair_draws = None, 0  # what ranking keeps between rounds
        self.rng = random.Random(params["seed"])
        if "label" not in frame.df.columns:
            raise InvalidLabel("labels are missing")
        self.obj = objectives.create(params["objective"], **{k: v for k, v in params.items() if k not in ("objective",)})
        tasks = frame.df.groupBy(F.spark_partition_id().alias("task")).agg(F.max(self.bad_label()).alias("bad"), F.sum("weight").alias("w"), F.count("*").alias("n"), F.max(F.size("label")).alias("k"))
        bad, total, self.rows, self.targets, most = tasks.agg(F.max("bad"), F.sum("w"), F.sum("n"), F.max("k"), F.max("n")).first()
        self.targets, self.weight, self.rows = self.targets or 1, total or 0.0, self.rows or 0
        self.frame = frame = balanced(frame, self.rows, most or 0)
        self.outputs = self.obj.outputs if self.obj.outputs > 1 else self.targets
        if bad:
            raise InvalidLabel(f"labels are not valid for {self.obj.name}")
        self.categorical = [f for f in range(frame.width) if frame.is_categorical(f)]
        if self.categorical and params.method() == "exact" and params["booster"] != "gblinear" and params["process_type"] == "default":
            raise ValueError("exact search orders values, which categories have no order for; use tree_method hist or approx")
        for f in {f for group in params["interaction_constraints"] for f in group}:
            if not 0 <= f < frame.width:
                raise ValueError(f"interaction_constraints name feature {f} of {frame.width}")
        if params["monotone_constraints"] and len(params["monotone_constraints"]) > frame.width:
            raise ValueError(f"monotone_constraints are more than the {frame.width} features")
        self.alphas = self.obj.params.get("alpha", [])
        if base:
            if params["booster"] == "dart" or base.booster == "dart":
                raise ValueError("dart cannot continue a model")
            if base.width != frame.width:
                raise ValueError("the base model has other features")
        self.model = Model(
            params["booster"], self.obj.name, self.objective_params(), frame.width, self.outputs, base.base_score if base else self.base_score(),
            list(base.stumps) if base and params["process_type"] == "default" else [], names=base.names if base else frame.names, kinds=base.kinds if base else frame.kinds,
        )
        if params["booster"] == "gblinear":
            self.model.linear = base.linear.copy() if base and base.linear is not None else np.zeros((frame.width + 1, self.outputs))
        if params["booster"] == "gblinear":
            rows = frame.df
            if params["max_row_perbatch"] and params["linear_updater"] == "shotgun":
                rows = numbered(rows, "row_id", "batch").withColumn("batch", F.floor(F.col("batch") / int(params["max_row_perbatch"])).cast("int"))
            self.start = self.model.start(rows).persist()  # margins are made anew of it each round
            self.state = self.model.add_linear(self.start)
        else:
            self.state = self.model.margins(frame, stumps=self.model.stumps)
        self.cuts = self.layout = self.row_cells = None
        self.stale: list[DataFrame] = []
        self.kept: list = []  # tables that sparse rows' cuts and bins are read from
        if frame.sparse and params["booster"] != "gblinear" and (params.method() == "exact" or params["process_type"] == "update"):
            raise ValueError("sparse frames are trained by gblinear and by tree_method hist or approx; make the frame dense (from_sparse) for others")
        if params["booster"] == "gblinear" and params["max_row_perbatch"] and (frame.sparse or frame.width > linear.MOST):
            raise ValueError(f"max_row_perbatch takes dense frames of at most {linear.MOST} features")
        if params["booster"] != "gblinear" and params["process_type"] == "default" and params.method() != "approx":
            exact = params.method() == "exact"
            self.state = self.binned(self.state, frame.df, ranges_for(self.rows) if exact else params["max_bin"])
            if exact:
                self.facts = column_facts(frame.df, frame.width, self.rows)
            else:
                self.state = self.state if self.walks_values() else self.state.drop("features", "entries")  # from here on rows are walked by their bins
        if params["booster"] != "gblinear":  # a linear model's first margins are those of the start, which is kept
            self.state = self.state.persist()

    def binned(self, state: DataFrame, rows: DataFrame, max_bin: int, weight: str = "weight") -> DataFrame:
        """state with bins by new cuts of rows."""
        if not self.frame.sparse:
            self.cuts = feature_cuts(rows, self.frame.width, max_bin, self.categorical, weight, n=self.rows)
            return self.cells(state)
        held, old = packed(rows, weight).persist(), self.kept
        cuts = sparse_cuts(held, self.frame.width, max_bin, self.categorical, n=self.rows)
        for table in old:
            table.unpersist()
        self.cuts, self.layout, self.row_cells, self.kept = cuts, Layout(cuts, self.categorical), None, [cuts]
        if cuts.whole:
            held.unpersist()
            return self.cells(state)
        self.row_cells = row_cells(held, self.layout, cuts)
        if self.params.method() == "approx":  # read for the state and for the gradients
            self.row_cells = self.row_cells.persist()
            self.kept += [held, self.row_cells]
        else:
            self.stale.append(held)
        return self.cells(state)

    def cells(self, df: DataFrame) -> DataFrame:
        df = df.drop("bins")
        if self.layout is None:
            return add_bins(df, self.cuts, self.categorical)
        if self.row_cells is None:
            return add_cells(df, self.layout, self.cuts)
        return df.join(self.row_cells, "row_id", "left").withColumn("bins", F.coalesce("bins", F.lit(b"")))

    def objective_params(self) -> dict:
        keys = ("huber_slope", "quantile_alpha", "expectile_alpha", "tweedie_variance_power", "aft_loss_distribution", "aft_loss_distribution_scale", "num_class", "rate_drop", "skip_drop", "one_drop", "sample_type")
        return {k: list(self.params[k]) if isinstance(self.params[k], tuple) else self.params[k] for k in keys if self.params[k] not in ((), None)}

    def bad_label(self) -> Column:
        df, o = self.frame.df, self.obj
        if o.name.startswith("rank:") and "qid" not in df.columns:
            raise InvalidLabel("ranking needs query ids")
        if o.name == "survival:aft":
            if "label_lower" not in df.columns:
                raise InvalidLabel("survival:aft needs label bounds")
            return F.col("label_lower") < 0
        if o.name.startswith("multi:"):
            return F.exists("label", lambda y: y.isNull() | F.isnan(y) | (y != F.floor(y)) | (y < 0) | (y >= o.outputs))
        return F.exists("label", lambda y: y.isNull() | F.isnan(y) | (~o.label_ok(y) if o.label_ok else F.lit(False)))

    # ---- intercepts

    def base_score(self) -> list[float]:
        p, o, df, k = self.params, self.obj, self.frame.df, self.outputs
        if p["base_score"] is not None:
            given = p["base_score"] if isinstance(p["base_score"], list | tuple) else [p["base_score"]] * k
            return [o.to_margin(float(b)) for b in given]
        if o.init.startswith("fixed:"):
            return [o.to_margin(float(o.init[6:]))] * k
        if not p["boost_from_average"]:
            return [o.to_margin(0.5)] * k
        w = F.col("weight")
        if o.init == "classes":
            counts = dict(df.groupBy(F.get("label", F.lit(0)).cast("int")).agg(F.sum(w)).collect())
            logs = [math.log(max(counts.get(c, 0.0) / max(sum(counts.values()), 1e-16), 1e-6)) for c in range(k)]
            mean = sum(logs) / k
            return [x - mean for x in logs]
        y0 = F.get("label", F.lit(0))
        if o.init == "quantile":
            return [self.weighted_quantile(a) for a in self.alphas]
        means = df.agg(*[(F.sum(w * F.get("label", F.lit(j))) / F.nullif(F.sum(w), num(0))).alias(f"m{j}") for j in range(k)]).first()
        mean = means[0] or 0.0
        if o.init == "expectile":
            out = []
            for a in self.alphas:
                side = F.when(num(mean) >= y0, 1 - a).otherwise(a)
                g, h = df.agg(F.sum(side * (mean - y0) * w), F.sum(side * w)).first()
                out.append(mean - g / h if h else mean)
            out = list(np.maximum.accumulate(out))
            return objectives.expectile_margins([float(x) for x in out])
        if o.init == "newton" or p["scale_pos_weight"] != 1:
            start = [mean] * k if o.name == "reg:absoluteerror" else [0.0] * k
            g = self.gradients(df.withColumn("margin", F.array(*map(num, start))))
            g = g.persist() if self.bias else g
            sums = g.agg(*[F.sum(F.get(c, F.lit(j))).alias(f"{c}{j}") for j in range(k) for c in ("g", "h")]).first()
            self.learn_positions(g)
            g.unpersist()
            return [start[j] - sums[f"g{j}"] / sums[f"h{j}"] if sums[f"h{j}"] else start[j] for j in range(k)]
        return [o.to_margin(float(m or 0.0)) for m in means]

    def weighted_quantile(self, alpha: float) -> float:
        y = F.get("label", F.lit(0))
        if self.frame.df.agg(F.min("weight") == F.max("weight")).first()[0]:
            return float(self.frame.df.agg(F.percentile(y, alpha)).first()[0])
        steps = running(self.frame.df.groupBy(y.alias("y")).agg(F.sum("weight").alias("w")), "y", {"c": F.col("w")})
        got = steps.where(F.col("c") >= alpha * self.weight).orderBy("y").limit(2).collect()
        if not got:  # the last sum falls short by rounding
            return float(steps.agg(F.max("y")).first()[0])
        if len(got) > 1 and got[0]["c"] == alpha * self.weight:
            return (got[0]["y"] + got[1]["y"]) / 2
        return float(got[0]["y"])

    # ---- gradients

    def gradients(self, df: DataFrame) -> DataFrame:
        """df with arrays g and h, weights applied."""
        o, p, k = self.obj, self.params, self.outputs
        y0 = F.get("label", F.lit(0))
        m = lambda j: F.get("margin", F.lit(j))
        w = F.col("weight")
        times = lambda pair: (F.array(*[pair[0] * w]), F.array(*[pair[1] * w]))
        if o.table:
            return o.table(df).withColumns({c: F.transform(c, lambda x: x * w) for c in ("g", "h")})
        if o.pair:
            pairs = []
            for j in range(k):
                y = F.get("label", F.lit(j if self.targets > 1 else 0))
                wj = F.when(y == 1, w * p["scale_pos_weight"]).otherwise(w) if p["scale_pos_weight"] != 1 else w
                g, h = o.pair(m(j), y)
                pairs.append((g * wj, h * wj))
            return df.withColumns({"g": F.array(*[a for a, _ in pairs]), "h": F.array(*[b for _, b in pairs])})
        if o.name.startswith("multi:"):
            g, h = objectives.softmax_pair(F.col("margin"), y0, k)
            return df.withColumns({"g": F.transform(g, lambda x: x * w), "h": F.transform(h, lambda x: x * w)})
        if o.name == "reg:expectileerror":
            g, h = objectives.expectile_pair(F.col("margin"), y0, self.alphas)
            return df.withColumns({"g": F.transform(g, lambda x: x * w), "h": F.transform(h, lambda x: x * w)})
        if o.name == "reg:absoluteerror":
            pairs = []
            for j in range(k):
                r = m(j) - F.get("label", F.lit(j if self.targets > 1 else 0))
                pairs.append(objectives.absolute_pair(r, objectives.smoothing_scale(df, r, w)))
            return df.withColumns({"g": F.array(*[a * w for a, _ in pairs]), "h": F.array(*[b * w for _, b in pairs])})
        if o.name == "reg:quantileerror":
            pairs = []
            for j, a in enumerate(self.alphas):
                r = m(j) - y0
                pairs.append(objectives.quantile_pair(r, a, objectives.smoothing_scale(df, r, w)))
            return df.withColumns({"g": F.array(*[a * w for a, _ in pairs]), "h": F.array(*[b * w for _, b in pairs])})
        if o.name == "survival:aft":
            g, h = objectives.aft_pair(m(0), F.col("label_lower"), F.col("label_upper"), o.params["dist"], o.params["sigma"])
            g, h = times((g, h))
            return df.withColumns({"g": g, "h": h})
        plain = df.withColumns({"__m": m(0), "__y": y0})
        if o.name == "survival:cox":
            got = objectives.cox_pair(plain, "__m", "__y")
        else:
            n, mean = objectives.pairs_per_sample(p), p["lambdarank_pair_method"] == "mean"
            if p["lambdarank_unbiased"] and self.bias is None:
                size = min(objectives.POSITIONS, df.groupBy("qid").count().agg(F.max("count")).first()[0] or 0) if mean else n
                self.bias = objectives.PositionBias.start(size, p["lambdarank_bias_norm"])
            self.pair_draws += mean
            got = objectives.rank_gradients(
                plain, o.name[5:], "__m", "__y", "qid", "row_id", n, p["lambdarank_normalization"], p["lambdarank_score_normalization"], p["ndcg_exp_gain"],
                self.bias, n if mean else 0, p["seed"] * 1_000_003 + self.pair_draws,
            )
        return got.withColumns({"g": F.array(F.col("g") * w), "h": F.array(F.col("h") * w)}).drop("__m", "__y")

    def learn_positions(self, grads: DataFrame) -> None:
        """After a round's gradients, the position bias that the next one divides by."""
        if self.bias:
            self.bias = self.bias.updated(grads)

    def sampled(self, df: DataFrame, number: int) -> DataFrame:
        """df with the gradients of rows that are not drawn set to zero."""
        p, share = self.params, self.params["subsample"]
        if int(share * self.rows) >= self.rows:  # a share that is all rows draws nothing
            return df
        u = uniform(p["seed"] * 1_000_003 + number, F.col("row_id"))
        zero = lambda c: F.transform(c, lambda x: x * 0)
        if p["sampling_method"] == "uniform":
            return df.withColumns({c: F.when(u < share, F.col(c)).otherwise(zero(c)) for c in ("g", "h")})
        size = F.sqrt(F.aggregate(F.zip_with("g", "h", lambda a, b: a * a + 0.1 * b * b), num(0), lambda a, x: a + x))
        threshold = sampling_threshold(df.select(size.alias("s")), share)
        # An infinite threshold is an empty budget; one of 0 keeps what has a gradient.
        prob = F.least(num(1), size / max(threshold, objectives.RT_EPS))
        return df.withColumns({c: F.when(u < prob, F.transform(c, lambda x: x / prob)).otherwise(zero(c)) for c in ("g", "h")})

    def quantised(self, df: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
        flat = lambda c: F.aggregate(c, num(0), lambda a, x: a + F.abs(x))
        sums = df.agg(F.sum(flat("g")), F.sum(flat("h"))).first()
        for old in self.stale:  # the rows' new state has been read by now
            old.unpersist()
        self.stale = []
        scales = tuple(fixed_scale(s or 0.0) for s in sums)
        if self.layout:
            return sparse_blocks(df, scales).persist(), scales
        held = value_blocks if self.params.method() == "exact" else blocks
        return held(df, self.frame.width, scales).persist(), scales

    # ---- rounds

    def grower(self, cuts, outputs: int) -> Grower:
        p = self.params
        delta = p["max_delta_step"] or (0.7 if self.obj.name == "count:poisson" else 0.0)
        penalty = Penalty(p["lambda"], p["alpha"], delta, p["min_child_weight"], tuple(p["monotone_constraints"]), p["max_cat_to_onehot"], p["max_cat_threshold"], p["default_direction"] if p.method() == "exact" else "learn")
        width = self.frame.width
        draw = lambda pool, share: sorted(self.weighted_draw(pool, max(1, int(share * len(pool))))) if share < 1 else pool
        tree_pool = draw(range(width), p["colsample_bytree"])
        levels: dict[int, list[int]] = {}

        def columns(depth: int):
            if depth not in levels:
                levels[depth] = draw(tree_pool, p["colsample_bylevel"])
            return draw(levels[depth], p["colsample_bynode"])

        settings = {
            "penalty": penalty, "eta": p["eta"], "gamma": p["gamma"], "max_depth": p["max_depth"], "max_leaves": p["max_leaves"], "lossguide": p["grow_policy"] == "lossguide",
            "interactions": p["interaction_constraints"], "columns": columns,
            "ahead": 1 if p["colsample_bylevel"] < 1 or p["colsample_bynode"] < 1 else AHEAD,  # draws come in the order of the queue
        }
        if p.method() == "exact":
            return ExactGrower(cuts, dense=self.facts[0], constant=self.facts[1], opt_dense=p["opt_dense_col"], **settings)
        if self.layout:
            return SparseGrower(self.layout, self.cuts, outputs, categorical=self.categorical, **settings)
        return Grower(cuts, outputs, categorical=self.categorical, **settings)

    def weighted_draw(self, pool: list[int], n: int) -> list[int]:
        weights = self.frame.feature_weights
        if not weights:
            return self.rng.sample(pool, n)
        keyed = sorted(pool, key=lambda f: -math.log(max(self.rng.random(), 1e-300)) / max(weights[f], 1e-6))
        return keyed[:n]

    def round(self, number: int) -> None:
        p = self.params
        if p["seed_per_iteration"]:
            self.rng = random.Random(p["seed"] * 1_000_003 + number)
        if p["booster"] == "gblinear":
            return self.linear_round()
        if p["process_type"] == "update":
            return self.update_round(number)
        dropped = choose_dropped(self.model.stumps, p, self.rng) if p["booster"] == "dart" else []
        state = add_margin(self.state, [replace(s, weight=-s.weight) for s in dropped], self.frame.width, self.outputs, self.by_bins(dropped), layout=self.walked(dropped)) if dropped else self.state
        grads = self.gradients(state)
        if p.method() == "approx":
            if self.cuts is None or not self.obj.constant_hessian:
                hess = F.aggregate("h", num(0), lambda a, x: a + x) * F.col("weight")
                drawn = self.sampled(grads, number * 1009).withColumn("__w", hess)  # rows that are not drawn weigh nothing
                self.stale.append(self.state)
                self.state = self.binned(self.state, drawn, p["max_bin"], "__w")
                grads = self.cells(grads)
        vector = p["multi_strategy"] == "multi_output_tree" and self.outputs > 1
        grads = grads.select(*[c for c in ("row_id", "features", "entries", "bins", "g", "h", "pos", "li", "lj") if c in grads.columns and (c not in ("features", "entries") or self.walks_values())])
        # Gradients of a row alone are cheaper to compute again than to keep, if only one tree reads them.
        kept = not self.obj.pair or (self.outputs > 1 and not vector) or p["num_parallel_tree"] > 1 or p["subsample"] < 1
        grads = grads.persist() if kept else grads
        self.learn_positions(grads)
        made: list[Stump] = []
        for k in range(1 if vector else self.outputs):
            own = grads if vector or self.outputs == 1 else grads.withColumns({c: F.array(F.get(c, F.lit(k))) for c in ("g", "h")})
            for j in range(p["num_parallel_tree"]):
                q, scales = self.quantised(self.sampled(own, number * 1009 + k * 101 + j))
                tree = self.grower(self.cuts, self.outputs if vector else 1).grow(q, scales)
                q.unpersist()
                if p["num_parallel_tree"] > 1:
                    for n in tree.nodes:
                        n.value = n.value / p["num_parallel_tree"]
                made.append(Stump(tree, k, 1.0, self.model.rounds if not made else made[0].round))
                for modifier in p.modifiers():
                    if modifier == "prune":
                        tree.prune(p["gamma"], p["eta"], p["max_depth"])
                    else:
                        self.refresh(made[-1], own, None if vector else 0)
        if kept:
            grads.unpersist()
        if p["booster"] == "dart":
            changed = self.rescale(dropped, made)
        else:
            changed = made
        self.model.stumps += made
        self.advance(changed, number)

    def walks_values(self) -> bool:
        return self.params.method() == "exact" or "refresh" in self.params.modifiers()

    def by_bins(self, trees: list[Stump]) -> bool:
        """Whether the rows' bins are those that the trees split at: exact splits between them, approx cuts anew, and then values count."""
        return self.params.method() != "exact" and (self.params.method() != "approx" or self.obj.constant_hessian)

    def walked(self, trees: list[Stump]) -> Layout | None:
        """The layout of sparse rows' bins, if they are walked by them."""
        return self.layout if self.by_bins(trees) else None

    def advance(self, changed: list[Stump], number: int) -> None:
        """Add trees to the margins of the training rows; the old state is let go once the new one has been read."""
        new = add_margin(self.state, changed, self.frame.width, self.outputs, self.by_bins(changed), layout=self.walked(changed))
        if number % CUT_EVERY == CUT_EVERY - 1 and new.sparkSession.sparkContext.getCheckpointDir():
            new = new.checkpoint()
        self.stale.append(self.state)
        self.state = new.persist()

    def rescale(self, dropped: list[Stump], made: list[Stump]) -> list[Stump]:
        """New weights after dropout; what the training margins change by."""
        lr, k = self.params["eta"] / len(made), len(dropped)
        if not k:
            return made
        if self.params["normalize_type"] == "tree":
            new, keep = 1 / (k + lr), k / (k + lr)
        else:
            new = keep = 1 / (1 + lr)
        changed = []
        for s in dropped:
            changed.append(replace(s, weight=s.weight * keep - s.weight))
            s.weight *= keep
        for s in made:
            s.weight = new
        return [*changed, *made]

    def linear_round(self) -> None:
        p = self.params
        grads = self.gradients(self.state)
        settings = {"eta": p["eta"], "lam": p["lambda"], "alpha": p["alpha"], "total": self.weight, "selector": p["feature_selector"], "top_k": p["top_k"], "rng": self.rng}
        if p["max_row_perbatch"] and p["linear_updater"] == "shotgun":
            bias = linear.bias_sums(grads, self.outputs)
            largest = linear.descend_batches(self.model.linear, bias, linear.batch_moments(grads.select("batch", "features", "g", "h"), self.frame.width, self.outputs), **settings)
        elif self.frame.sparse or self.frame.width > linear.MOST:
            held = grads.select("entries" if self.frame.sparse else "features", "g", "h").persist()  # read once a block
            largest = linear.descend_blocks(held, self.model.linear, **settings)
            held.unpersist()
        else:
            a, b = linear.moments(grads.select("features", "g", "h"), self.frame.width, self.outputs)
            largest = linear.descend(self.model.linear, a, b, **settings)
        self.converged = p["tolerance"] > 0 and largest <= p["tolerance"]
        self.state.unpersist()
        self.state = self.model.add_linear(self.start).persist()

    def update_round(self, number: int) -> None:
        """Take one round's trees of the base model, refresh or prune them, and put them back."""
        p = self.params
        if not self.base:
            raise ValueError("process_type=update needs a base model")
        took = [Stump(Tree.from_json(s.tree.to_json()), s.group, s.weight, s.round) for s in self.base.stumps if s.round == number]
        if not took:
            raise ValueError("the base model has no more rounds to update")
        for modifier in p.modifiers():
            if modifier == "prune":
                for s in took:
                    s.tree.prune(p["gamma"], p["eta"], p["max_depth"])
            else:
                grads = self.gradients(self.state)
                for s in took:
                    self.refresh(s, grads, None if np.size(s.tree.nodes[0].weight) > 1 else s.group)
        self.model.stumps += took
        self.stale.append(self.state)
        self.state = add_margin(self.state, took, self.frame.width, self.outputs).persist()

    def refresh(self, s: Stump, grads: DataFrame, k: int | None) -> None:
        """A tree's statistics (and leaf values) from the current gradients of output k (None: of all, for vector leaves)."""
        p = self.params
        own = grads if k is None else grads.withColumns({c: F.array(F.get(c, F.lit(k))) for c in ("g", "h")})
        refreshed(s.tree, leaf_sums(own, s.tree, self.frame.width, self.outputs if k is None else 1), Penalty(p["lambda"], p["alpha"], p["max_delta_step"], p["min_child_weight"]), p["eta"] if p["refresh_leaf"] else None)


def leaf_sums(df: DataFrame, tree: Tree, width: int, outputs: int) -> DataFrame:
    """node, n, g, h (arrays by output): the rows and sums of each leaf. df: features or entries, g, h. A row a leaf and task moves."""
    held = "features" if "features" in df.columns else "entries"

    def run(batches):
        total = np.zeros((len(tree.nodes), 2 * outputs + 1))
        for batch in batches:
            if batch.num_rows:
                at = leaf_finder(batch.column(0), width, False)(tree)
                g, h = (np.array(batch.column(c).flatten(), float).reshape(-1, outputs) for c in ("g", "h"))
                np.add.at(total, at, np.hstack([g, h, np.ones((len(at), 1))]))
        rows = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(total[rows].tolist(), pa.list_(pa.float64()))], names=["node", "s"])

    parts = df.select(held, "g", "h").mapInArrow(run, "node bigint, s array<double>")
    sums = [F.sum(F.get("s", F.lit(i))) for i in range(2 * outputs + 1)]
    return parts.groupBy("node").agg(sums[-1].cast("bigint").alias("n"), F.array(*sums[:outputs]).alias("g"), F.array(*sums[outputs:-1]).alias("h"))


def refreshed(tree: Tree, sums: DataFrame, pen: Penalty, eta: float | None) -> None:
    """Set covers, weights and gains of a tree, and leaf values if eta is given, from leaf_sums; nodes add up towards the root."""
    rows = sums.collect()  # a row a leaf
    outputs = len(rows[0]["g"]) if rows else 1
    G, H = np.zeros((len(tree.nodes), outputs)), np.zeros((len(tree.nodes), outputs))
    for r in rows:
        G[r["node"]], H[r["node"]] = r["g"], r["h"]
    for i in range(len(tree.nodes) - 1, 0, -1):
        G[tree.nodes[i].parent] += G[i]
        H[tree.nodes[i].parent] += H[i]
    gain = lambda i: float(np.sum(pen.gain(G[i], H[i])))
    for i, n in tree.live():
        w = pen.weight(G[i], H[i])
        n.cover, n.weight = float(H[i].mean()), w if outputs > 1 else float(w[0])
        if n.leaf:
            if eta is not None:
                n.value = eta * n.weight
        else:
            n.gain = gain(n.left) + gain(n.right) - gain(i)


def evaluate(model: Model, df: DataFrame, name: str) -> float:
    """A metric on rows that have their margins."""
    own = metrics.registered(name)
    if own:
        value = own(df.withColumn("prediction", model.eval_transform(F.col("margin")))).first()["value"]
        return float("nan") if value is None else float(value)
    kind, arg, minus = metrics.parse(name)
    y, w = F.get("label", F.lit(0)), F.col("weight")
    preds = model.eval_transform(F.col("margin"))
    df = df.withColumn("__p", preds)
    p = F.get("__p", F.lit(0))
    alphas = model.objective_params.get("quantile_alpha") or model.objective_params.get("expectile_alpha") or [0.5]
    alphas = [alphas] if isinstance(alphas, float) else alphas
    if kind in metrics.ROWWISE:
        if model.outputs > 1 and not model.objective.startswith("multi:"):
            df = df.select("weight", F.explode(F.arrays_zip(F.col("__p").alias("p"), F.col("label").alias("y"))).alias("z"))
            p, y = F.col("z.p"), F.col("z.y")
        got = metrics.rowwise(df, kind, p, y, w, arg)
    elif kind in ("quantile", "expectile"):
        got = metrics.pinball(df, kind, F.col("__p"), y, w, alphas)
    elif kind in ("merror", "mlogloss"):
        got = metrics.multiclass(df, kind, F.col("__p"), y, w)
    elif kind in ("auc", "aucpr"):
        got = metrics.auc(df, p, y, w, kind == "aucpr", "qid" if "qid" in df.columns else None)
    elif kind in metrics.RANK_METRICS:
        flat = df.withColumns({"__s": p, "__y": y, "__q": F.col("qid") if "qid" in df.columns else F.lit(0)})
        got = metrics.ranking(flat, kind, "__s", "__y", "__q", "row_id", int(arg) if arg else None, minus)
    elif kind == "ams":
        got = metrics.ams(df, p, y, w, arg, "row_id")
    elif kind == "cox-nloglik":
        got = metrics.cox(df, p, y, w)
    else:
        m = F.get("margin", F.lit(0))
        lo, hi = F.col("label_lower"), F.col("label_upper")
        sigma, dist = model.objective_params.get("aft_loss_distribution_scale", 1.0), model.objective_params.get("aft_loss_distribution", "normal")
        got = metrics.aft(df, m, lo, hi, w, dist, sigma) if kind == "aft-nloglik" else metrics.interval_accuracy(df, m, lo, hi, w)
    value = got.first()["value"]
    return float("nan") if value is None else float(value)


def update(model: Model, params: dict | Params, frame: Frame, number: int | None = None) -> Model:
    """model with one more round on a frame. number: the round's, which seeds its draws; one after the model's if not given."""
    return train(params, frame, 1, base=model, first=model.rounds if number is None else number)


def train(params: dict | Params, frame: Frame, num_boost_round: int = 10, evals=(), base: Model | None = None, early_stopping_rounds: int | None = None, maximize: bool | None = None, verbose_eval: int = 0, first: int = 0) -> Model:
    """Boost for so many rounds; evals are (name, Frame) pairs whose metrics go into the model's history. first: the number of the first round, for draws."""
    params = params if isinstance(params, Params) else Params(params)
    for text in params.warnings():
        log.warning(text)
    for name in params.unused():
        log.warning("parameter %s has no effect here", name)
    if params["process_type"] == "update" and base is None:
        raise ValueError("process_type=update needs a base model")
    own = slim(frame)
    frame, evals = own, [(n, own if f is frame else slim(f)) for n, f in evals]
    trainer = Trainer(params, frame, base)
    if first:
        trainer.rng = random.Random(params["seed"] * 1_000_003 + first)
    model = trainer.model
    names = params["eval_metric"]
    names = [names] if isinstance(names, str) else list(names)
    if not names and not params["disable_default_eval_metric"]:
        names = [trainer.obj.metric]
    sets = [(n, None if f is frame else model.margins(f, stumps=model.stumps).persist(), f) for n, f in evals]
    best, stale = None, 0
    for number in range(num_boost_round):
        before = len(model.stumps)
        trainer.round(first + number)
        for i, (label, held, f) in enumerate(sets):
            if f is frame:
                held = trainer.state
            elif params["booster"] == "gbtree":
                held = add_margin(held, model.stumps[before:], frame.width, model.outputs).persist()
                sets[i] = (label, held, f)
            else:  # weights of earlier trees change, or there are none
                held = model.margins(f)
            for metric in names:
                model.history.append((number, label, metric, evaluate(model, held, metric)))
        if verbose_eval and model.history and number % verbose_eval == 0:
            log.info("[%d] %s", number, ", ".join(f"{s}-{m}:{v:.5f}" for n, s, m, v in model.history if n == number))
        if early_stopping_rounds and sets and names:
            value = model.history[-1][3]
            up = metrics.maximised(names[-1]) if maximize is None else maximize
            if best is None or (value > best if up else value < best):
                best, stale = value, 0
                model.best_iteration, model.best_score = number, value
            else:
                stale += 1
                if stale >= early_stopping_rounds:
                    break
        if getattr(trainer, "converged", False):
            break
    for state in (trainer.state, *trainer.stale, *trainer.kept, *([trainer.start] if params["booster"] == "gblinear" else []), *(held for _, held, f in sets if held is not None)):
        state.unpersist()
    return model
