"""Every query of the engine by name, with the SQL that must return the same rows.

Row-wise queries run over whole tables. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import metrics, objectives
from ..functions import scalar as S
from ..operators import cuts as C
from ..operators import grow as G
from ..operators import splits_sql as X
from ..operators.split import Penalty, scans
from ..operators.tree import Node, Tree
from ..sources.frame import from_dense, from_libsvm_lines, from_long, from_sparse, parse_libsvm, present
from .model import Model, Stump, importance
from .predict import InplaceRequest, Request
from .train import add_bins, balanced, slim

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- rows with margins and labels of every kind, from line items

BASE_SQL = """
base AS (SELECT l_orderkey AS q, l_linenumber + 10 * l_partkey::BIGINT + 10000000 * l_suppkey::BIGINT AS i, (l_quantity - 25) / 20 AS m, l_extendedprice / 32768 AS y, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS yb,
  l_discount * 10 AS yu, l_linenumber::DOUBLE AS yc, 1 + l_tax * 10 AS w, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END * (1 + l_linenumber + floor(l_quantity / 5)) AS yt,
  CASE WHEN l_linenumber % 4 = 0 THEN 0.0::DOUBLE ELSE 1 + l_quantity / 10 END AS lo,
  CASE WHEN l_linenumber % 4 = 1 THEN 1 + l_quantity / 10 WHEN l_linenumber % 4 = 2 THEN 'infinity'::DOUBLE ELSE 2 + l_quantity / 5 END AS up,
  floor(l_tax * 50)::DOUBLE AS grade FROM lineitem)"""


def base(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c, mod = F.col, F.col("l_linenumber") % 4
    return li.select(
        c("l_orderkey").alias("q"), (c("l_linenumber") + 10 * c("l_partkey").cast("bigint") + 10_000_000 * c("l_suppkey").cast("bigint")).alias("i"), ((c("l_quantity") - 25) / 20).alias("m"), (c("l_extendedprice") / 32768).alias("y"),
        F.when(c("l_returnflag") == "R", 1.0).otherwise(0.0).alias("yb"), (c("l_discount") * 10).alias("yu"), c("l_linenumber").cast("double").alias("yc"), (1 + c("l_tax") * 10).alias("w"),
        (F.when(c("l_linestatus") == "F", 1).otherwise(-1) * (1 + c("l_linenumber") + F.floor(c("l_quantity") / 5))).cast("double").alias("yt"),
        F.when(mod == 0, S.num(0)).otherwise(1 + c("l_quantity") / 10).alias("lo"),
        F.when(mod == 1, 1 + c("l_quantity") / 10).when(mod == 2, S.num(float("inf"))).otherwise(2 + c("l_quantity") / 5).alias("up"),
        F.floor(c("l_tax") * 50).cast("double").alias("grade"),
    )


def r(c, n=6):
    return F.round(c, n)


def gradient_query(name, pair, sql):
    """A row-wise objective's weighted gradient and hessian for every row."""
    g, h = sql

    def run(spark, sf_dir):
        a, b = pair()
        return base(spark, sf_dir).select("q", "i", r(a * F.col("w")).alias("g"), r(b * F.col("w")).alias("h"))

    query(f"WITH {BASE_SQL} SELECT q, i, round(({g}) * w, 6) AS g, round(({h}) * w, 6) AS h FROM base", name)(run)


def of(name, y, **p):
    return lambda: objectives.create(name, **p).pair(F.col("m"), F.col(y))


SIG = "(1 / (1 + exp(-m)))"
ERF_SQL = "(sign({z}) * (1 - (((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t) * exp(-({z}) * ({z}))))"

for _name, _pair, _sql in (
    ("grad_squarederror", of("reg:squarederror", "y"), ("m - y", "1")),
    ("grad_squaredlogerror", lambda: objectives.squared_log(F.col("m") / 2, F.col("y")), ("(ln(1 + m / 2) - ln(1 + y)) / (m / 2 + 1)", "greatest((1 - ln(1 + m / 2) + ln(1 + y)) / pow(m / 2 + 1, 2), 1e-6)")),
    ("grad_reg_logistic", of("reg:logistic", "yu"), (f"{SIG} - yu", f"greatest({SIG} * (1 - {SIG}), 1e-16)")),
    ("grad_binary_logistic", of("binary:logistic", "yb"), (f"{SIG} - yb", f"greatest({SIG} * (1 - {SIG}), 1e-16)")),
    ("grad_logitraw", of("binary:logitraw", "yb"), (f"{SIG} - yb", f"greatest({SIG} * (1 - {SIG}), 1e-16)")),
    ("grad_hinge", of("binary:hinge", "yb"), ("CASE WHEN m * (2 * yb - 1) < 1 THEN 1 - 2 * yb ELSE 0.0::DOUBLE END", "CASE WHEN m * (2 * yb - 1) < 1 THEN 1.0::DOUBLE ELSE 1.1754943508222875e-38 END")),
    ("grad_pseudohuber", of("reg:pseudohubererror", "y", huber_slope=0.5), ("(m - y) / sqrt(1 + (m - y) * (m - y) / 0.25)", "0.25 / ((0.25 + (m - y) * (m - y)) * sqrt(1 + (m - y) * (m - y) / 0.25))")),
    ("grad_gamma", of("reg:gamma", "y"), ("1 - y / exp(m)", "y / exp(m)")),
    ("grad_poisson", of("count:poisson", "yc"), ("exp(m) - yc", "exp(m + 0.7)")),
    ("grad_tweedie", of("reg:tweedie", "y", tweedie_variance_power=1.3), ("exp(0.7 * m) - y * exp(-0.3 * m)", "0.7 * exp(0.7 * m) + 0.3 * y * exp(-0.3 * m)")),
):
    gradient_query(_name, _pair, _sql)


@query(f"WITH {BASE_SQL}, d AS (SELECT pow(sum(w * sqrt(abs(m - y))) / sum(w), 2) AS s FROM base) SELECT q, i, round((m - y) * s / sqrt(s * s + (m - y) * (m - y)) * w, 6) AS g, round(s / sqrt(s * s + (m - y) * (m - y)) * w, 6) AS h FROM base, d")
def grad_absoluteerror(spark, sf_dir):
    df = base(spark, sf_dir)
    res = F.col("m") - F.col("y")
    g, h = objectives.absolute_pair(res, objectives.smoothing_scale(df, res, F.col("w")))
    return df.select("q", "i", r(g * F.col("w")).alias("g"), r(h * F.col("w")).alias("h"))


@query(f"WITH {BASE_SQL}, d AS (SELECT pow(sum(w * sqrt(abs(m - y))) / sum(w), 2) AS s FROM base), e AS (SELECT *, (m - y) / (0.04 * s) AS x FROM base, d) SELECT q, i, round(0.5 * s * (tanh(x) + 1 - 1.4) * w, 6) AS g, round(0.5 / 0.04 * greatest(CASE WHEN abs(x) < 1e-6 THEN 1 ELSE tanh(x) / x END, 3e-4) * w, 5) AS h FROM e")
def grad_quantile(spark, sf_dir):
    df = base(spark, sf_dir)
    res = F.col("m") - F.col("y")
    g, h = objectives.quantile_pair(res, 0.7, objectives.smoothing_scale(df, res, F.col("w")))
    return df.select("q", "i", r(g * F.col("w")).alias("g"), r(h * F.col("w"), 5).alias("h"))


@query(f"""WITH {BASE_SQL}, p AS (SELECT *, m AS p0, m + 1e-6 + greatest(m / 2, 0) + ln(1 + exp(-abs(m / 2))) AS p1 FROM base),
s AS (SELECT *, CASE WHEN p0 >= y THEN 0.75 ELSE 0.25 END AS s0, CASE WHEN p1 >= y THEN 0.25 ELSE 0.75 END AS s1, 1 / (1 + exp(-m / 2)) AS z FROM p)
SELECT q, i, round(s0 * (p0 - y) + s1 * (p1 - y), 6) AS g0, round(z * s1 * (p1 - y), 6) AS g1, round(s0 + s1, 6) AS h0, round(z * z * s1, 6) AS h1 FROM s""")
def grad_expectile(spark, sf_dir):
    g, h = objectives.expectile_pair(F.array(F.col("m"), F.col("m") / 2), F.col("y"), [0.25, 0.75])
    return base(spark, sf_dir).select("q", "i", *[r(F.get(x, F.lit(j))).alias(f"{n}{j}") for n, x in (("g", g), ("h", h)) for j in (0, 1)])


@query(f"""WITH {BASE_SQL}, e AS (SELECT *, exp(m) + exp(0) + exp(-m) AS t FROM base), p AS (SELECT *, exp(m) / t AS p0, 1 / t AS p1, exp(-m) / t AS p2 FROM e)
SELECT q, i, round(p0 - CASE WHEN yb = 0 THEN 1 ELSE 0 END, 6) AS g0, round(p1 - CASE WHEN yb = 1 THEN 1 ELSE 0 END, 6) AS g1, round(p2, 6) AS g2, round(greatest(2 * p1 * (1 - p1), 1e-16), 6) AS h1 FROM p""")
def grad_softmax(spark, sf_dir):
    g, h = objectives.softmax_pair(F.array(F.col("m"), S.num(0), -F.col("m")), F.col("yb"), 3)
    return base(spark, sf_dir).select("q", "i", *[r(F.get(g, F.lit(j))).alias(f"g{j}") for j in range(3)], r(F.get(h, F.lit(1))).alias("h1"))


@query(f"""WITH {BASE_SQL}, t AS (SELECT abs(yt) AS t, sum(exp(m)) AS e, sum(CASE WHEN yt > 0 THEN 1 ELSE 0 END) AS d FROM base GROUP BY 1),
k AS (SELECT t, d, sum(e) OVER (ORDER BY t DESC) AS risk FROM t), s AS (SELECT t, sum(d / risk) OVER (ORDER BY t) AS rk, sum(d / (risk * risk)) OVER (ORDER BY t) AS sk FROM k)
SELECT q, i, round(exp(m) * rk - CASE WHEN yt > 0 THEN 1 ELSE 0 END, 6) AS g, round(exp(m) * rk - exp(m) * exp(m) * sk, 6) AS h FROM base JOIN s ON abs(yt) = t""")
def grad_cox(spark, sf_dir):
    return objectives.cox_pair(base(spark, sf_dir), "m", "yt").select("q", "i", r(F.col("g")).alias("g"), r(F.col("h")).alias("h"))


AFT_LOGISTIC = """WITH {base}, z AS (SELECT *, CASE WHEN up < 'infinity'::DOUBLE THEN (ln(up) - m) / 0.8 ELSE 0 END AS zu, CASE WHEN lo > 0 THEN (ln(lo) - m) / 0.8 ELSE 0 END AS zl FROM base),
d AS (SELECT *, exp(zu) / pow(1 + exp(zu), 2) AS pu, exp(zu) / (1 + exp(zu)) AS cu, exp(zl) / pow(1 + exp(zl), 2) AS pl, exp(zl) / (1 + exp(zl)) AS cl FROM z),
e AS (SELECT *, pu * (1 - exp(zu)) / (1 + exp(zu)) AS gu, pl * (1 - exp(zl)) / (1 + exp(zl)) AS gl, pl * (exp(2 * zl) - 4 * exp(zl) + 1) / pow(1 + exp(zl), 2) AS hl FROM d),
f AS (SELECT *, CASE WHEN up = 'infinity'::DOUBLE THEN 0 ELSE pu END AS p1, CASE WHEN up = 'infinity'::DOUBLE THEN 1 ELSE cu END AS c1, CASE WHEN up = 'infinity'::DOUBLE THEN 0 ELSE gu END AS g1,
  CASE WHEN lo <= 0 THEN 0 ELSE pl END AS p0, CASE WHEN lo <= 0 THEN 0 ELSE cl END AS c0, CASE WHEN lo <= 0 THEN 0 ELSE gl END AS g0 FROM e)
SELECT q, i, round(greatest(-15, least(15, CASE WHEN lo = up THEN gl / (0.8 * pl) ELSE (p1 - p0) / (0.8 * (c1 - c0)) END)), 6) AS g,
  round(greatest(1e-16, least(15, CASE WHEN lo = up THEN -(pl * hl - gl * gl) / (0.64 * pl * pl) ELSE -((c1 - c0) * (g1 - g0) - pow(p1 - p0, 2)) / pow(0.8 * (c1 - c0), 2) END)), 6) AS h FROM f"""


@query(AFT_LOGISTIC.format(base=BASE_SQL))
def grad_aft(spark, sf_dir):
    g, h = objectives.aft_pair(F.col("m"), F.col("lo"), F.col("up"), "logistic", 0.8)
    return base(spark, sf_dir).select("q", "i", r(g).alias("g"), r(h).alias("h"))


RANKED = f"""WITH {BASE_SQL}, d AS (SELECT q, i, m AS s, grade AS y, row_number() OVER (PARTITION BY q ORDER BY m DESC, i) - 1 AS r, row_number() OVER (PARTITION BY q ORDER BY grade DESC, i) - 1 AS lr FROM base),
e AS (SELECT *, max(s) OVER (PARTITION BY q) AS best, min(s) OVER (PARTITION BY q) AS worst, sum(CASE WHEN lr < 32 THEN (pow(2, y) - 1) / log2(lr + 2) ELSE 0 END) OVER (PARTITION BY q) AS idcg FROM d),
p AS (SELECT a.q, a.best, a.worst, a.idcg, CASE WHEN a.y > b.y THEN a.i ELSE b.i END AS hi, CASE WHEN a.y > b.y THEN b.i ELSE a.i END AS lo, CASE WHEN a.y > b.y THEN a.s - b.s ELSE b.s - a.s END AS d,
  (pow(2, greatest(a.y, b.y)) - pow(2, least(a.y, b.y))) * abs(1 / log2(a.r + 2) - 1 / log2(b.r + 2)) AS change FROM e a JOIN e b ON a.q = b.q AND a.r < b.r AND a.y <> b.y WHERE a.r < 32),
k AS (SELECT q, hi, lo, 1 / (1 + exp(-d)) AS sig, {{delta}} / CASE WHEN best <> worst THEN abs(d) + 0.01 ELSE 1 END AS delta FROM p)
SELECT q AS qid, hi, lo, round((sig - 1) * delta, 6) + 0.0::DOUBLE AS lambda, round(greatest(sig * (1 - sig), 1e-16) * delta * 2, 6) AS hess FROM k"""


def rank_query(name, kind, delta):
    def run(spark, sf_dir):
        p = objectives.rank_pairs(base(spark, sf_dir), kind, "m", "grade", "q", "i")
        return p.select("qid", "hi", "lo", (r(F.col("lambda")) + S.num(0)).alias("lambda"), r(F.col("hess")).alias("hess"))

    query(RANKED.replace("{delta}", delta), name)(run)


rank_query("rank_pairs_pairwise", "pairwise", "1.0")
rank_query("rank_pairs_ndcg", "ndcg", "CASE WHEN idcg > 0 THEN change / idcg ELSE 0 END")

rank_query(
    "rank_pairs_map", "map", "CASE WHEN rel_all > 0 THEN abs(CASE WHEN ya > yb THEN rel_a / (ra + 1) - rel_b / (rb + 1) + between ELSE -((rel_a + 1) / (ra + 1) - rel_b / (rb + 1) + between) END) / rel_all ELSE 0 END",
)
ORACLE["rank_pairs_map"] = ORACLE["rank_pairs_map"].replace(
    "e AS (SELECT *,", "o AS (SELECT *, sum(y) OVER w AS rel, sum(y / (r + 1)) OVER w AS acc, sum(y) OVER (PARTITION BY q) AS rel_all FROM d WINDOW w AS (PARTITION BY q ORDER BY r)), e AS (SELECT *,"
).replace("FROM d),\np AS (SELECT", "FROM o),\np AS (SELECT a.rel AS rel_a, b.rel AS rel_b, a.rel_all, a.r AS ra, b.r AS rb, a.y AS ya, b.y AS yb, b.acc - a.acc - b.y / (b.r + 1) AS between,")


@query(ORACLE["rank_pairs_ndcg"].replace("SELECT q AS qid, hi, lo, round((sig - 1) * delta, 6) + 0.0::DOUBLE AS lambda, round(greatest(sig * (1 - sig), 1e-16) * delta * 2, 6) AS hess FROM k", """,
s AS (SELECT q, hi AS i, (sig - 1) * delta AS g, greatest(sig * (1 - sig), 1e-16) * delta * 2 AS h, -2 * (sig - 1) * delta AS t FROM k UNION ALL SELECT q, lo, (1 - sig) * delta, greatest(sig * (1 - sig), 1e-16) * delta * 2, 0 FROM k),
n AS (SELECT q, CASE WHEN sum(t) > 0 THEN log2(1 + sum(t)) / sum(t) ELSE 1 END AS z FROM s GROUP BY q), v AS (SELECT q, i, sum(g) AS g, sum(h) AS h FROM s GROUP BY q, i)
SELECT b.q, b.i, round(coalesce(v.g * n.z, 0), 6) + 0.0::DOUBLE AS g, round(coalesce(v.h * n.z, 0), 6) AS h FROM base b LEFT JOIN v ON v.q = b.q AND v.i = b.i LEFT JOIN n ON n.q = b.q"""))
def grad_rank_ndcg(spark, sf_dir):
    got = objectives.rank_gradients(base(spark, sf_dir), "ndcg", "m", "grade", "q", "i")
    return got.select("q", "i", (r(F.col("g")) + S.num(0)).alias("g"), r(F.col("h")).alias("h"))


def pairs_sql(n: int, score: str, top: int, given: str = "") -> str:
    """p{n}, the pairs of rank:ndcg at a score (sig, delta, places in the given list), and l{n}, with lam, hess and costs. given: joins of plus (hi) and minus (lo)."""
    ranks = f"row_number() OVER (PARTITION BY q ORDER BY {score} DESC, i) - 1 AS r, row_number() OVER (PARTITION BY q ORDER BY grade DESC, i) - 1 AS lr, row_number() OVER (PARTITION BY q ORDER BY i) - 1 AS pos"
    side = lambda c: f"CASE WHEN a.y > b.y THEN a.{c} ELSE b.{c} END AS hi_{c}, CASE WHEN a.y > b.y THEN b.{c} ELSE a.{c} END AS lo_{c}"
    known, ok = f"hi_pos < {top} AND lo_pos < {top}", "plus >= 1e-16 AND minus >= 1e-16"
    return f"""d{n} AS (SELECT q, i, {score} AS s, grade AS y, {ranks} FROM apart),
e{n} AS (SELECT *, max(s) OVER (PARTITION BY q) AS best, min(s) OVER (PARTITION BY q) AS worst, sum(CASE WHEN lr < {top} THEN (pow(2, y) - 1) / log2(lr + 2) ELSE 0 END) OVER (PARTITION BY q) AS idcg FROM d{n}),
j{n} AS (SELECT a.q, a.best, a.worst, a.idcg, {side('i')}, {side('s')}, {side('pos')}, abs((pow(2, a.y) - pow(2, b.y)) * (1 / log2(a.r + 2) - 1 / log2(b.r + 2))) AS change
  FROM e{n} a JOIN e{n} b ON a.q = b.q AND a.r < b.r AND a.y <> b.y WHERE a.r < {top}),
p{n} AS (SELECT *, 1 / (1 + exp(lo_s - hi_s)) AS sig, change / idcg / CASE WHEN best <> worst THEN abs(hi_s - lo_s) + 0.01 ELSE 1 END AS delta FROM j{n}),
l{n} AS (SELECT *, (sig - 1) * delta / CASE WHEN {known} AND {ok} THEN plus * minus ELSE 1 END AS lam, greatest(sig * (1 - sig), 1e-16) * delta * 2 / CASE WHEN {known} AND {ok} THEN plus * minus ELSE 1 END AS hess,
  CASE WHEN {known} AND minus >= 1e-16 THEN -ln(1 - sig) * delta / minus ELSE 0 END AS cost_hi, CASE WHEN {known} AND plus >= 1e-16 THEN -ln(1 - sig) * delta / plus ELSE 0 END AS cost_lo FROM p{n} {given})"""


# Line items repeat; these are told apart by their quantity and tax.
BIAS_SQL = f"""WITH {BASE_SQL}, apart AS (SELECT * REPLACE (i * 100000 + round(m * 20000 + 25000)::BIGINT + round(w * 10 - 10)::BIGINT AS i) FROM base), {pairs_sql(1, 'm', 3, ', (SELECT 1.0::DOUBLE AS plus, 1.0::DOUBLE AS minus)')},
c AS (SELECT pos, coalesce(sum(h), 0) AS li, coalesce(sum(l), 0) AS lj FROM (SELECT unnest(range(3)) AS pos) LEFT JOIN (SELECT hi_pos AS pos, cost_hi AS h, 0 AS l FROM l1 UNION ALL SELECT lo_pos, 0, cost_lo FROM l1) USING (pos) GROUP BY pos),
b AS (SELECT pos, CASE WHEN (SELECT li FROM c WHERE pos = 0) >= 1e-16 THEN sqrt(li / (SELECT li FROM c WHERE pos = 0)) ELSE 1.0::DOUBLE END AS plus, CASE WHEN (SELECT lj FROM c WHERE pos = 0) >= 1e-16 THEN sqrt(lj / (SELECT lj FROM c WHERE pos = 0)) ELSE 1.0::DOUBLE END AS minus FROM c)"""


def apart(spark, sf_dir):
    return base(spark, sf_dir).withColumn("i", F.col("i") * 100_000 + F.round(F.col("m") * 20_000 + 25_000).cast("bigint") + F.round(F.col("w") * 10 - 10).cast("bigint"))


@query(BIAS_SQL + " SELECT pos, round(plus, 6) AS plus, round(minus, 6) AS minus FROM b")
def rank_position_bias(spark, sf_dir):
    """How likely each place was examined, after one round."""
    bias = objectives.PositionBias.start(3)
    bias = bias.updated(objectives.rank_gradients(apart(spark, sf_dir), "ndcg", "m", "grade", "q", "i", 3, bias=bias))
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(bias.plus, bias.minus, strict=True))], "pos bigint, plus double, minus double").select("pos", r(F.col("plus")).alias("plus"), r(F.col("minus")).alias("minus"))


@query(BIAS_SQL + f""", {pairs_sql(2, '(w - m)', 3, 'LEFT JOIN (SELECT pos AS hi_pos, plus FROM b) USING (hi_pos) LEFT JOIN (SELECT pos AS lo_pos, minus FROM b) USING (lo_pos)')},
s AS (SELECT q, hi_i AS i, lam AS g, hess AS h, -2 * lam AS t FROM l2 UNION ALL SELECT q, lo_i, -lam, hess, 0 FROM l2),
n AS (SELECT q, CASE WHEN sum(t) > 0 THEN log2(1 + sum(t)) / sum(t) ELSE 1 END AS z FROM s GROUP BY q), v AS (SELECT q, i, sum(g) AS g, sum(h) AS h FROM s GROUP BY q, i)
SELECT b.q, b.i, round(coalesce(v.g * n.z, 0), 6) + 0.0::DOUBLE AS g, round(coalesce(v.h * n.z, 0), 6) AS h FROM apart b LEFT JOIN v ON v.q = b.q AND v.i = b.i LEFT JOIN n ON n.q = b.q""")
def grad_rank_unbiased(spark, sf_dir):
    """Gradients of a second round, divided by the position bias of the first."""
    df = apart(spark, sf_dir).withColumn("m2", F.col("w") - F.col("m"))
    bias = objectives.PositionBias.start(3)
    bias = bias.updated(objectives.rank_gradients(df, "ndcg", "m", "grade", "q", "i", 3, bias=bias))
    got = objectives.rank_gradients(df, "ndcg", "m2", "grade", "q", "i", 3, bias=bias)
    return got.select("q", "i", (r(F.col("g")) + S.num(0)).alias("g"), r(F.col("h")).alias("h"))


@query(f"""WITH {BASE_SQL}, apart AS (SELECT * REPLACE (i * 100000 + round(m * 20000 + 25000)::BIGINT + round(w * 10 - 10)::BIGINT AS i) FROM base), d AS (SELECT q, i, m AS s, grade AS y, row_number() OVER (PARTITION BY q ORDER BY m DESC, i) - 1 AS r, row_number() OVER (PARTITION BY q ORDER BY grade DESC, i) - 1 AS lr FROM apart),
e AS (SELECT *, max(s) OVER (PARTITION BY q) AS best, min(s) OVER (PARTITION BY q) AS worst, sum((pow(2, y) - 1) / log2(lr + 2)) OVER (PARTITION BY q) AS idcg, row_number() OVER (PARTITION BY q ORDER BY y DESC, r) - 1 AS k, count(*) OVER (PARTITION BY q) AS n FROM d),
f AS (SELECT *, min(k) OVER (PARTITION BY q, y) AS a0, max(k) OVER (PARTITION BY q, y) + 1 AS a1 FROM e),
g AS (SELECT *, unnest([1, 2]) AS draw FROM f WHERE a0 + n - a1 > 0),
h AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '7', q::VARCHAR, i::VARCHAR, draw::VARCHAR)), 1, 15))::BIGINT % (a0 + n - a1) AS at0 FROM g),
x AS (SELECT *, CASE WHEN at0 < a0 THEN at0 ELSE at0 + a1 - a0 END AS at FROM h),
p AS (SELECT x.q, x.best, x.worst, x.idcg, CASE WHEN x.y > z.y THEN x.i ELSE z.i END AS hi, CASE WHEN x.y > z.y THEN z.i ELSE x.i END AS lo, CASE WHEN x.y > z.y THEN x.s - z.s ELSE z.s - x.s END AS d,
  abs((pow(2, x.y) - pow(2, z.y)) * (1 / log2(x.r + 2) - 1 / log2(z.r + 2))) AS change FROM x JOIN f z ON z.q = x.q AND z.k = x.at),
k AS (SELECT q, hi, lo, 1 / (1 + exp(-d)) AS sig, change / idcg / CASE WHEN best <> worst THEN abs(d) + 0.01 ELSE 1 END AS delta FROM p)
SELECT q AS qid, hi, lo, round((sig - 1) * delta, 6) + 0.0::DOUBLE AS lambda, round(greatest(sig * (1 - sig), 1e-16) * delta * 2, 6) AS hess FROM k""")
def rank_pairs_mean(spark, sf_dir):
    """Two pairs a document, drawn from documents of other labels."""
    p = objectives.rank_pairs(apart(spark, sf_dir), "ndcg", "m", "grade", "q", "i", draws=2, seed=7)
    return p.select("qid", "hi", "lo", (r(F.col("lambda")) + S.num(0)).alias("lambda"), r(F.col("hess")).alias("hess"))


@query(f"WITH {BASE_SQL} SELECT q, i, round(exp(m) / (exp(m) + 1 + exp(-m)), 6) AS p0, round(1 / (exp(m) + 1 + exp(-m)), 6) AS p1 FROM base")
def transform_softmax(spark, sf_dir):
    p = S.softmax(F.array(F.col("m"), S.num(0), -F.col("m")))
    return base(spark, sf_dir).select("q", "i", r(F.get(p, F.lit(0))).alias("p0"), r(F.get(p, F.lit(1))).alias("p1"))


# ---- metrics

PRED = {"p": f"{SIG}"}


def metric_query(name, run, sql):
    query(f"WITH {BASE_SQL} {sql}", name)(lambda spark, sf_dir: run(base(spark, sf_dir)).select(r(F.col("value")).alias("value")))


for _kind, _p, _y, _arg, _sql in (
    ("rmse", lambda: F.col("m"), "y", None, "sqrt(sum((y - m) * (y - m) * w) / sum(w))"),
    ("rmsle", lambda: F.exp("m"), "y", None, "sqrt(sum(pow(ln(1 + y) - ln(1 + exp(m)), 2) * w) / sum(w))"),
    ("mae", lambda: F.col("m"), "y", None, "sum(abs(y - m) * w) / sum(w)"),
    ("mape", lambda: F.col("m"), "y", None, "sum(abs((y - m) / y) * w) / sum(w)"),
    ("mphe", lambda: F.col("m"), "y", None, "sum((sqrt(1 + (y - m) * (y - m)) - 1) * w) / sum(w)"),
    ("logloss", lambda: S.sigmoid(F.col("m")), "yb", None, f"sum(-(yb * ln({SIG}) + (1 - yb) * ln(1 - {SIG})) * w) / sum(w)"),
    ("error", lambda: S.sigmoid(F.col("m")), "yb", 0.6, f"sum(CASE WHEN {SIG} > 0.6 THEN 1 - yb ELSE yb END * w) / sum(w)"),
    ("poisson-nloglik", lambda: F.exp("m"), "yc", None, "sum((lgamma(yc + 1) + exp(m) - m * yc) * w) / sum(w)"),
    ("gamma-nloglik", lambda: F.exp("m"), "y", None, "sum((y / exp(m) + m) * w) / sum(w)"),
    ("gamma-deviance", lambda: F.exp("m"), "y", None, "2 * sum((ln((exp(m) + 1e-6) / (y + 1e-6)) + (y + 1e-6) / (exp(m) + 1e-6) - 1) * w) / sum(w)"),
    ("tweedie-nloglik", lambda: F.exp("m"), "y", 1.3, "sum((exp(0.7 * m) / 0.7 + y * exp(-0.3 * m) / 0.3) * w) / sum(w)"),
):
    metric_query("metric_" + _kind.replace("-", "_"), lambda df, k=_kind, p=_p, y=_y, a=_arg: metrics.rowwise(df, k, p(), F.col(y), F.col("w"), a), f"SELECT round({_sql}, 6) AS value FROM base")

metric_query("metric_quantile", lambda df: metrics.pinball(df, "quantile", F.array(F.col("m"), F.col("m") + 1), F.col("y"), F.col("w"), [0.2, 0.8]),
             "SELECT round(sum(((CASE WHEN y >= m THEN 0.2 * (y - m) ELSE -0.8 * (y - m) END) + (CASE WHEN y >= m + 1 THEN 0.8 * (y - m - 1) ELSE -0.2 * (y - m - 1) END)) * w) / (2 * sum(w)), 6) AS value FROM base")
metric_query("metric_expectile", lambda df: metrics.pinball(df, "expectile", F.array(F.col("m")), F.col("y"), F.col("w"), [0.3]),
             "SELECT round(sum(CASE WHEN m >= y THEN 0.7 ELSE 0.3 END * (m - y) * (m - y) * w) / sum(w), 6) AS value FROM base")
PROBS = "SELECT *, exp(m) / (exp(m) + 1 + exp(-m)) AS p0, 1 / (exp(m) + 1 + exp(-m)) AS p1, exp(-m) / (exp(m) + 1 + exp(-m)) AS p2, CASE WHEN yb = 1 THEN 0 WHEN yt > 0 THEN 1 ELSE 2 END AS c FROM base"
_probs = lambda: S.softmax(F.array(F.col("m"), S.num(0), -F.col("m")))
_class = lambda: F.when(F.col("yb") == 1, 0).when(F.col("yt") > 0, 1).otherwise(2)
metric_query("metric_merror", lambda df: metrics.multiclass(df, "merror", _probs(), _class(), F.col("w")),
             f", p AS ({PROBS}) SELECT round(sum(CASE WHEN c = CASE WHEN m >= 0 THEN CASE WHEN m = 0 THEN 0 ELSE 0 END ELSE 2 END THEN 0 ELSE w END) / sum(w), 6) AS value FROM p")
metric_query("metric_mlogloss", lambda df: metrics.multiclass(df, "mlogloss", _probs(), _class(), F.col("w")),
             f", p AS ({PROBS}) SELECT round(sum(-ln(CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) * w) / sum(w), 6) AS value FROM p")
CURVE = ", c AS (SELECT m, sum(w * yb) AS p, sum(w * (1 - yb)) AS n FROM base GROUP BY m), k AS (SELECT m, sum(p) OVER o AS tp, sum(n) OVER o AS fp, p, n FROM c WINDOW o AS (ORDER BY m DESC))"
metric_query("metric_auc", lambda df: metrics.auc(df, F.col("m"), F.col("yb"), F.col("w")), f"{CURVE} SELECT round(sum(n * (2 * tp - p) * 0.5) / (max(tp) * max(fp)), 6) AS value FROM k")
metric_query("metric_aucpr", lambda df: metrics.auc(df, F.col("m"), F.col("yb"), F.col("w"), pr=True),
             f"""{CURVE}, s AS (SELECT *, tp - p AS tp0, fp - n AS fp0, (SELECT sum(p) FROM c) AS a FROM k), l AS (SELECT *, CASE WHEN p = 0 THEN 1 ELSE n / p + 1 END AS x, CASE WHEN p = 0 THEN 0 ELSE (fp0 - n / p * tp0) / a END AS z FROM s)
SELECT round(sum(CASE WHEN z <> 0 THEN (tp / a - tp0 / a - z / x * (ln(x * tp / a + z) - ln(x * tp0 / a + z))) / x ELSE (tp / a - tp0 / a) / x END), 6) AS value FROM l""")  # fmt: skip
RANKS = ", d AS (SELECT q, grade AS y, CASE WHEN grade > 2 THEN 1.0 ELSE 0.0 END AS b, row_number() OVER (PARTITION BY q ORDER BY m DESC, i) AS r, row_number() OVER (PARTITION BY q ORDER BY grade DESC, i) AS lr FROM base)"
_graded = lambda df: df.withColumn("b", F.when(F.col("grade") > 2, 1.0).otherwise(0.0))
metric_query("metric_ndcg", lambda df: metrics.ranking(df, "ndcg", "m", "grade", "q", "i", 3),
             f"{RANKS}, g AS (SELECT q, sum(CASE WHEN r <= 3 THEN (pow(2, y) - 1) / log2(r + 1) ELSE 0 END) AS a, sum(CASE WHEN lr <= 3 THEN (pow(2, y) - 1) / log2(lr + 1) ELSE 0 END) AS z FROM d GROUP BY q) SELECT round(avg(CASE WHEN z > 0 THEN a / z ELSE 1 END), 6) AS value FROM g")
metric_query("metric_pre", lambda df: metrics.ranking(_graded(df), "pre", "m", "b", "q", "i", 2),
             f"{RANKS}, g AS (SELECT q, sum(CASE WHEN r <= 2 THEN b ELSE 0 END) / least(2, count(*)) AS v FROM d GROUP BY q) SELECT round(avg(v)::DOUBLE, 6) AS value FROM g")
metric_query("metric_map", lambda df: metrics.ranking(_graded(df), "map", "m", "b", "q", "i", minus=True),
             f"{RANKS}, h AS (SELECT *, sum(b::DOUBLE) OVER (PARTITION BY q ORDER BY r) AS k FROM d), g AS (SELECT q, sum(k / r * b) AS a, sum(b::DOUBLE) AS z FROM h GROUP BY q) SELECT round(avg(CASE WHEN z > 0 THEN a / z ELSE 0 END), 6) AS value FROM g")
metric_query("metric_cox_nloglik", lambda df: metrics.cox(df, F.exp("m"), F.col("yt"), F.col("w")),
             ", t AS (SELECT abs(yt) AS t, sum(exp(m)) AS e FROM base GROUP BY 1), k AS (SELECT t, sum(e) OVER (ORDER BY t DESC) AS risk FROM t) SELECT round(sum(w * (ln(risk) - m)) / sum(w), 6) AS value FROM base JOIN k ON abs(yt) = t WHERE yt > 0")
metric_query("metric_interval_accuracy", lambda df: metrics.interval_accuracy(df, F.col("m"), F.col("lo"), F.col("up"), F.col("w")), "SELECT round(sum(CASE WHEN exp(m) BETWEEN lo AND up THEN w ELSE 0 END) / sum(w), 6) AS value FROM base")
metric_query("metric_aft_nloglik", lambda df: metrics.aft(df, F.col("m"), F.col("lo"), F.col("up"), F.col("w"), "extreme", 0.8),
             """, z AS (SELECT *, CASE WHEN up < 'infinity'::DOUBLE THEN exp((ln(up) - m) / 0.8) ELSE 0 END AS eu, CASE WHEN lo > 0 THEN exp((ln(lo) - m) / 0.8) ELSE 0 END AS el FROM base)
SELECT round(sum(-ln(greatest(1e-12, CASE WHEN lo = up THEN el * exp(-el) / (0.8 * lo) ELSE CASE WHEN up = 'infinity'::DOUBLE THEN 1 ELSE 1 - exp(-eu) END - CASE WHEN lo <= 0 THEN 0 ELSE 1 - exp(-el) END END)) * w) / sum(w), 6) AS value FROM z""")  # fmt: skip
metric_query("metric_ams", lambda df: metrics.ams(df.withColumn("o", F.col("q") * 100 + F.col("i")), F.col("m"), F.col("yb"), F.col("w"), 1.0, "o"),
             ", k AS (SELECT m, sum(w * yb) AS s, sum(w * (1 - yb)) AS b FROM base GROUP BY m), c AS (SELECT m, sum(s) OVER o AS s, sum(b) OVER o + 10 AS b, lead(m) OVER o AS x FROM k WINDOW o AS (ORDER BY m DESC)) SELECT round(max(sqrt(2 * ((s + b) * ln(1 + s / b) - s))), 6) AS value FROM c WHERE x IS NOT NULL")

# ---- intercepts, sources, cuts, histograms and splits

metric_query("intercept_mean", lambda df: df.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value")), "SELECT round(sum(w * y) / sum(w), 6) AS value FROM base")
metric_query("intercept_newton", lambda df: df.agg((-F.sum(objectives.squared_log(S.num(0), F.col("y"))[0]) / F.sum(objectives.squared_log(S.num(0), F.col("y"))[1])).alias("value")),
             "SELECT round(sum(ln(1 + y)) / sum(greatest(1 + ln(1 + y), 1e-6)), 6) AS value FROM base")
metric_query("intercept_quantile", lambda df: df.agg(F.percentile("y", 0.7).alias("value")), "SELECT round(quantile_cont(y, 0.7), 6) AS value FROM base")

FEATURES = ("l_quantity", "l_discount", "l_tax")
LONG_SQL = """rows AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS row_id, row_number() OVER () AS rid, l_quantity, l_discount, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax END AS l_tax, l_extendedprice / 1000 AS y FROM lineitem),
mean AS (SELECT avg(y) AS b FROM rows),
long AS (SELECT row_id, rid, f, CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS v, b - y AS g, 1.0::DOUBLE AS h, CASE WHEN l_quantity < 25 THEN 1 ELSE 2 END AS node FROM rows, mean, (VALUES (0), (1), (2)) fs(f)),
vals AS (SELECT DISTINCT f, v FROM long WHERE v IS NOT NULL), rk AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r, count(*) OVER (PARTITION BY f) AS n FROM vals),
cuts AS (SELECT f, r - 2 AS bin, v AS upper FROM rk WHERE r > 1 UNION ALL SELECT f, n - 1, v + (abs(v) + 1e-5) FROM rk WHERE r = n),
binned AS (SELECT l.row_id, l.rid, l.f, l.v, l.g, l.h, l.node, CASE WHEN l.v IS NULL THEN NULL ELSE least(k.r - 1, k.n - 1) END AS bin FROM long l LEFT JOIN rk k ON k.f = l.f AND k.v = l.v),
hist AS (SELECT f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM binned GROUP BY f, bin)"""


@query(f"WITH {LONG_SQL} SELECT f, bin, round(upper, 6) AS upper FROM cuts")
def cuts_exact(spark, sf_dir):
    cuts = C.feature_cuts(feature_frame(spark, sf_dir).df, 3, 256)
    return spark.createDataFrame([(f, i, float(v)) for f, own in enumerate(cuts) for i, v in enumerate(own)], "f int, bin int, upper double").select("f", "bin", r(F.col("upper")).alias("upper"))


@query(f"WITH {LONG_SQL} SELECT row_id, f, bin FROM binned")
def bin_assign(spark, sf_dir):
    df = feature_frame(spark, sf_dir).df
    cuts = C.feature_cuts(df, 3, 256)

    @F.arrow_udf("array<int>")
    def cells(bins: pa.Array) -> pa.Array:
        found = G.unpack_cells(G.cells_of(bins, 3)).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * 3), pa.array(found.astype(np.int32), mask=found < 0))

    return add_bins(df, cuts, ()).select("row_id", F.posexplode(cells("bins")).alias("f", "bin"))


def feature_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")))
    return from_dense(li, list(FEATURES), F.col("l_orderkey") * 10 + F.col("l_linenumber")).with_labels(F.col("l_extendedprice") / 1000)


def grown(spark, sf_dir, penalty: Penalty | None = None, level: int = 0, rest: bool = False) -> DataFrame:
    """node, f, sums and best split of the root (level 0) or its children, by the jobs that grow trees.

    The rows are those of feature_frame, with squared-error gradients at the mean; the children part at l_quantity 25. rest: the right child is taken
    as what the root has beyond the left one.
    """
    frame, y = feature_frame(spark, sf_dir), F.get("label", F.lit(0))
    mean, rows = frame.df.agg(F.avg(y), F.count("*")).first()
    frame = balanced(slim(frame), rows, rows if frame.df.rdd.getNumPartitions() < 8 else 0)
    cuts = C.feature_cuts(frame.df, 3, 256, n=rows)
    df = add_bins(frame.df.select("features", F.array(mean - y).alias("g"), F.array(S.num(1)).alias("h")), cuts, ())
    scale = G.fixed_scale(df.agg(F.sum(F.abs(F.get("g", F.lit(0))))).first()[0] or 0.0), G.fixed_scale(float(rows))
    held, tree, sizes = G.blocks(df, 3, scale), Tree(3), [len(c) for c in cuts]
    if level:
        at = int(np.searchsorted(cuts[0], 25.0, "left"))
        tree.split(0, feature=0, threshold=25.0, bin=at)
    nodes, other = {0: 0} if not level else {1: 0} if rest else {1: 0, 2: 0}, {}
    parts = G.partial_sums(held, tree, nodes, sizes, 1)
    if rest:
        whole = G.searched(G.partial_sums(held, Tree(3), {0: 0}, sizes, 1), sizes, 1, scale, Penalty(), (), {}, {0: ((-np.inf, np.inf), None)})
        parts, other = parts.unionByName(whole.select(F.col("node").alias("pair"), "f", F.lit(-1).alias("kind"), "sums")), {0: 2}
    settings = {n: ((-np.inf, np.inf), None) for n in (*nodes, *other.values())}
    found = G.searched(parts, sizes, 1, scale, penalty or Penalty(), (), other, settings)
    return found.withColumns({"gs": F.lit(scale[0]), "hs": F.lit(scale[1])})


def bins_of(found: DataFrame) -> DataFrame:
    """node, f, bin (null: missing), g, h, n of the sums that hold rows."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for node, f, data, gs, hs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, h, n = np.frombuffer(data, np.int64).reshape(3, -1)
                for i in np.flatnonzero(n).tolist():
                    for column, value in zip(out, (node, f, i if i < len(n) - 1 else None, g[i] / gs, h[i] / hs, n[i]), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["node", "f", "bin", "g", "h", "n"])

    return found.select("node", "f", "sums", "gs", "hs").mapInArrow(run, "node int, f int, bin int, g double, h double, n bigint")


def candidates_of(found: DataFrame, penalty: Penalty) -> DataFrame:
    """f, bin, default_left, gain of every valid split that the search weighs, but those of missing values against all others (bin -1)."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for f, data, gs, hs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, h, n = np.frombuffer(data, np.int64).reshape(3, -1)
                for left, gains, _, _, named in scans(f, g[None, :-1] / gs, h[None, :-1] / hs, ([g.sum() / gs], [h.sum() / hs]), bool(n[-1]), penalty):
                    for i in np.flatnonzero(np.isfinite(gains)).tolist():
                        if named(i) >= 0:
                            for column, value in zip(out, (f, named(i), left, gains[i]), strict=True):
                                column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["f", "bin", "default_left", "gain"])

    return found.select("f", "sums", "gs", "hs").mapInArrow(run, "f int, bin int, default_left boolean, gain double")


@query(f"WITH {LONG_SQL} SELECT f, bin, round(g, 4) AS g, round(h, 4) AS h, n FROM hist")
def hist_root(spark, sf_dir):
    return bins_of(grown(spark, sf_dir)).select("f", "bin", r(F.col("g"), 4).alias("g"), r(F.col("h"), 4).alias("h"), "n")


NODE_SQL = LONG_SQL + ", nhist AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM binned GROUP BY node, f, bin)"


@query(f"WITH {NODE_SQL} SELECT node, f, bin, round(g, 4) AS g, round(h, 4) AS h, n FROM nhist")
def hist_level1(spark, sf_dir):
    return bins_of(grown(spark, sf_dir, level=1)).select("node", "f", "bin", r(F.col("g"), 4).alias("g"), r(F.col("h"), 4).alias("h"), "n")


@query(f"WITH {NODE_SQL} SELECT f, bin, round(g, 3) AS g, round(h, 3) AS h, n FROM nhist WHERE node = 2")
def hist_subtraction(spark, sf_dir):
    """The right child's sums as its parent's less its sibling's."""
    return bins_of(grown(spark, sf_dir, level=1, rest=True).where("node = 2")).select("f", "bin", r(F.col("g"), 3).alias("g"), r(F.col("h"), 3).alias("h"), "n")


def split_query(name, sql_options, penalty, side=None):
    def run(spark, sf_dir):
        found = candidates_of(grown(spark, sf_dir), penalty)
        found = found if side is None else found.where(F.col("default_left") == side)
        return found.select("f", "bin", "default_left", r(F.col("gain"), 2).alias("gain"))

    query(f"WITH {LONG_SQL} {X.candidates_sql(**sql_options)}", name)(run)


split_query("split_forward", {"direction": "forward"}, Penalty(), False)
split_query("split_backward_missing", {"direction": "backward"}, Penalty(), True)
split_query("split_l1_l2", {"direction": "both", "lam": 3.0, "alpha": 50.0}, Penalty(lam=3.0, alpha=50.0))
split_query("split_max_delta_step", {"direction": "both", "max_delta": 2.0}, Penalty(max_delta=2.0))
split_query("split_min_child_weight", {"direction": "both", "min_child": 8000.0}, Penalty(min_child_weight=8000.0))
split_query("split_monotone", {"direction": "both", "monotone": {0: -1}}, Penalty(monotone=(-1, 0, 0)))


@query(f"WITH {LONG_SQL}, c AS ({X.candidates_sql('both')}) SELECT f, bin, default_left, gain FROM c ORDER BY gain DESC, f, default_left, bin LIMIT 1")
def split_best(spark, sf_dir):
    best = G.best_of_nodes(grown(spark, sf_dir)).select("s.*")
    return best.select("f", "bin", "default_left", r(F.col("gain"), 2).alias("gain"))


@query(f"""WITH {LONG_SQL}, c AS ({X.candidates_sql('both')}), best AS (SELECT * FROM c ORDER BY gain DESC, f, default_left, bin LIMIT 1),
sides AS (SELECT row_id, g, h, CASE WHEN b.bin IS NULL THEN s.default_left ELSE b.bin <= s.bin END AS goes FROM binned b JOIN best s ON s.f = b.f),
leaf AS (SELECT goes, -0.3 * sum(g) / (sum(h) + 1) AS v, count(*) AS n FROM sides GROUP BY goes) SELECT round(b + v, 4) AS margin, n FROM leaf, mean""")
def boost_round_1(spark, sf_dir):
    """A whole round of training of depth 1: how many rows get which margin."""
    from .train import train

    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")))
    frame = from_dense(li, list(FEATURES), F.monotonically_increasing_id()).with_labels(F.col("l_extendedprice") / 1000)
    model = train({"max_depth": 1, "disable_default_eval_metric": True}, frame, 1)
    return model.predict(frame, "margin").groupBy(r(F.get("prediction", F.lit(0)), 4).alias("margin")).agg(F.count("*").alias("n"))


CAT_SQL = f"WITH {BASE_SQL}, cats AS (SELECT (yc - 1)::INT AS code, sum(m - y) AS g, sum(1.0::DOUBLE) AS h FROM base GROUP BY 1), t AS (SELECT sum(g) AS tg, sum(h) AS th FROM cats)"


def category_sums(spark, sf_dir):
    return base(spark, sf_dir).groupBy((F.col("yc") - 1).cast("int").alias("code")).agg(F.sum(F.col("m") - F.col("y")).alias("g"), F.sum(S.num(1)).alias("h"))


def category_candidates(sums: DataFrame, penalty: Penalty, pick: int) -> DataFrame:
    """code, k, gain by the search's scan number `pick` of a categorical feature. sums: code, g, h, a row for each category of one node."""

    def run(key, pdf):
        pdf = pdf.sort_values("code")
        g, h = pdf["g"].to_numpy()[None], pdf["h"].to_numpy()[None]
        _, gains, _, _, named = list(scans(0, g, h, (g.sum(axis=1), h.sum(axis=1)), False, penalty, True))[pick]
        sets = [named(i) for i in range(len(gains))]
        codes = [next(iter(x - (sets[i - 1] if len(x) > 1 else frozenset()))) for i, x in enumerate(sets)]
        return pd.DataFrame({"code": codes, "k": range(1, len(codes) + 1), "gain": gains})

    return sums.groupBy(F.lit(0).alias("node")).applyInPandas(run, "code int, k bigint, gain double")


@query(CAT_SQL + " SELECT code, round(g * g / (h + 1) + (tg - g) * (tg - g) / (th - h + 1) - tg * tg / (th + 1), 3) AS gain FROM cats, t")
def split_onehot(spark, sf_dir):
    return category_candidates(category_sums(spark, sf_dir), Penalty(max_cat_to_onehot=100), 0).select("code", r(F.col("gain"), 3).alias("gain"))


@query(CAT_SQL + """, w AS (SELECT *, row_number() OVER (ORDER BY -g / (h + 1), code) AS k FROM cats), s AS (SELECT code, k, sum(g) OVER (ORDER BY k) AS sg, sum(h) OVER (ORDER BY k) AS sh, count(*) OVER () AS n FROM w)
SELECT code, k, round(sg * sg / (sh + 1) + (tg - sg) * (tg - sg) / (th - sh + 1) - tg * tg / (th + 1), 3) AS gain FROM s, t WHERE k < n""")
def split_partition(spark, sf_dir):
    return category_candidates(category_sums(spark, sf_dir), Penalty(), 0).select("code", "k", r(F.col("gain"), 3).alias("gain"))


@query(f"WITH {NODE_SQL} SELECT node, round(-0.3 * sum(g) / (sum(h) + 1), 6) AS value FROM nhist WHERE f = 0 GROUP BY node")
def leaf_values(spark, sf_dir):
    """What a leaf gets of its sums, by the trainer's weight."""
    penalty = Penalty()
    rows = grown(spark, sf_dir, level=1).where("f = 0").select("node", F.get("total", F.lit(0)) / F.col("gs"), F.get("total", F.lit(1)) / F.col("hs")).toDF("node", "g", "h")

    @F.pandas_udf("double")
    def value(g: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(0.3 * penalty.weight(g.to_numpy(), h.to_numpy()))

    return rows.select("node", r(value("g", "h")).alias("value"))


@query(f"WITH {BASE_SQL}, s AS (SELECT yc, sum((m - y) * m) + 0.05 AS g, sum(m * m) + 0.5 AS h FROM base GROUP BY yc) SELECT yc, round(CASE WHEN 0.1 - g / h >= 0 THEN greatest(-g / h, -0.1) ELSE least(-g / h, -0.1) END, 6) AS delta FROM s")
def coord_step(spark, sf_dir):
    got = base(spark, sf_dir).groupBy("yc").agg(F.sum((F.col("m") - F.col("y")) * F.col("m")).alias("g"), F.sum(F.col("m") * F.col("m")).alias("h"))
    return got.select("yc", r(S.coordinate_delta(F.col("g"), F.col("h"), S.num(0.1), 0.0, 0.5)).alias("delta"))


# ---- a fixed tree: routing, prediction, attribution, importances

TREE_SQL = """t AS (SELECT l_orderkey AS q, l_linenumber AS i, l_quantity AS x0, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount END AS x1, l_extendedprice / 1000 AS y FROM lineitem),
leafed AS (SELECT *, CASE WHEN x0 < 20 THEN CASE WHEN x1 IS NULL OR x1 < 0.05 THEN 3 ELSE 4 END ELSE CASE WHEN x1 < 0.03 THEN 5 ELSE 6 END END AS leaf FROM t)"""
LEAVES = {3: 1.5, 4: -0.5, 5: 2.0, 6: -1.0}


def fixed_tree() -> Tree:
    cover = {0: 100.0, 1: 40.0, 2: 60.0, 3: 30.0, 4: 10.0, 5: 20.0, 6: 40.0}
    gains = {0: 12.0, 1: 3.0, 2: 5.0}
    rows = {0: (1, 2, 0, 20.0, False), 1: (3, 4, 1, 0.05, True), 2: (5, 6, 1, 0.03, False)}
    tree = Tree(2, [])
    for k in range(7):
        a, b, f, t, d = rows.get(k, (-1, -1, 0, 0.0, False))
        tree.nodes.append(Node((k - 1) // 2 if k else -1, a, b, f, t, -1, d, None, LEAVES.get(k, 0.0), LEAVES.get(k, 0.25 * k), gains.get(k, 0.0), cover[k], (k + 1).bit_length() - 1))
    return tree


def fixed_model() -> Model:
    return Model("gbtree", "binary:logistic", {}, 2, 1, [0.1], [Stump(fixed_tree(), 0)])


def tree_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x0"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount")).alias("x1"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    return from_dense(li, ["x0", "x1"], F.col("q") * 10 + F.col("i"))


LEAF_CASE = "(CASE leaf WHEN 3 THEN 1.5 WHEN 4 THEN -0.5 WHEN 5 THEN 2.0 ELSE -1.0 END)::DOUBLE"


@query(f"WITH {TREE_SQL} SELECT q, i, leaf::BIGINT AS leaf FROM leafed")
def predict_leaf_fixed_tree(spark, sf_dir):
    return fixed_model().predict(tree_frame(spark, sf_dir), "leaf").select("q", "i", F.get("prediction", F.lit(0)).alias("leaf"))


@query(f"WITH {TREE_SQL} SELECT q, i, round(0.1 + {LEAF_CASE}, 6) AS margin FROM leafed")
def predict_margin_fixed_tree(spark, sf_dir):
    return fixed_model().predict(tree_frame(spark, sf_dir), "margin").select("q", "i", r(F.get("prediction", F.lit(0))).alias("margin"))


@query(f"WITH {TREE_SQL} SELECT q, i, round(1 / (1 + exp(-(0.1 + {LEAF_CASE}))), 6) AS p FROM leafed")
def predict_value_fixed_tree(spark, sf_dir):
    return fixed_model().predict(tree_frame(spark, sf_dir)).select("q", "i", r(F.get("prediction", F.lit(0))).alias("p"))


def cut_tree(threshold: float) -> Tree:
    """One split of x0; its leaves are the nodes 1 and 2."""
    tree = Tree(2, [])
    for k, (a, b) in enumerate([(1, 2), (-1, -1), (-1, -1)]):
        tree.nodes.append(Node(0 if k else -1, a, b, 0, threshold if k == 0 else 0.0, -1, False, None, float(k), float(k), 1.0 if k == 0 else 0.0, 10.0, min(k, 1)))
    return tree


def grid_model() -> Model:
    """Two rounds of two outputs of two parallel trees."""
    trees = [fixed_tree(), cut_tree(10), cut_tree(20), cut_tree(30), cut_tree(40), cut_tree(45), cut_tree(15), fixed_tree()]
    return Model("gbtree", "multi:softprob", {}, 2, 2, [0.1, 0.2], [Stump(t, k // 2 % 2, round=k // 4) for k, t in enumerate(trees)])


@query(f"""WITH {TREE_SQL}, cells AS (SELECT q, i, unnest([struct_pack(r := 0, o := 0, p := 0, leaf := leaf), struct_pack(r := 0, o := 0, p := 1, leaf := CASE WHEN x0 < 10 THEN 1 ELSE 2 END),
  struct_pack(r := 0, o := 1, p := 0, leaf := CASE WHEN x0 < 20 THEN 1 ELSE 2 END), struct_pack(r := 0, o := 1, p := 1, leaf := CASE WHEN x0 < 30 THEN 1 ELSE 2 END),
  struct_pack(r := 1, o := 0, p := 0, leaf := CASE WHEN x0 < 40 THEN 1 ELSE 2 END), struct_pack(r := 1, o := 0, p := 1, leaf := CASE WHEN x0 < 45 THEN 1 ELSE 2 END),
  struct_pack(r := 1, o := 1, p := 0, leaf := CASE WHEN x0 < 15 THEN 1 ELSE 2 END), struct_pack(r := 1, o := 1, p := 1, leaf := leaf)]) AS c FROM leafed)
SELECT q, i, c.r::INTEGER AS round, c.o::INTEGER AS output, c.p::INTEGER AS parallel, c.leaf::BIGINT AS leaf FROM cells""")
def predict_strict_leaf(spark, sf_dir):
    """Leaves by round, output and parallel tree."""
    got = Request("leaf", strict_shape=True).run(grid_model(), tree_frame(spark, sf_dir))
    got = got.select("q", "i", F.posexplode("prediction").alias("round", "x")).select("q", "i", "round", F.posexplode("x").alias("output", "x"))
    return got.select("q", "i", "round", "output", F.posexplode("x").alias("parallel", "leaf"))


@query(f"""WITH t AS (SELECT l_orderkey AS q, l_linenumber AS i, l_quantity AS x0, CASE WHEN l_discount = 0.02 THEN NULL ELSE l_discount END AS x1, l_extendedprice AS margin FROM lineitem),
{TREE_SQL[TREE_SQL.index("leafed AS"):]} SELECT q, i, margin::DOUBLE AS margin, round(1 / (1 + exp(-(0.1 + {LEAF_CASE}))), 6) AS p FROM leafed""")
def predict_inplace(spark, sf_dir):
    """Plain columns with a sentinel for missing; a column of the table's own is called margin."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x0"), F.col("l_discount").alias("x1"), F.col("l_extendedprice").cast("double").alias("margin"))
    return InplaceRequest(missing=0.02).run_columns(fixed_model(), li, ["x0", "x1"]).select("q", "i", "margin", r(F.col("prediction")).alias("p"))


@query(f"WITH {TREE_SQL} SELECT q, i, round(CASE WHEN x0 < 20 THEN 1.0 ELSE 0.0 END - 0.4, 6)::DOUBLE AS c0, round({LEAF_CASE} - CASE WHEN x0 < 20 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS c1, round(0.5, 6)::DOUBLE AS bias FROM leafed")
def saabas_fixed_tree(spark, sf_dir):
    got = fixed_model().predict(tree_frame(spark, sf_dir), "approx_contribution")
    part = lambda k: r(F.get(F.get("prediction", F.lit(0)), F.lit(k)))
    return got.select("q", "i", part(0).alias("c0"), part(1).alias("c1"), part(2).alias("bias"))


def vector_model() -> Model:
    """The fixed tree with two outputs, the second ten times the square of the first."""
    tree = fixed_tree()
    for n in tree.nodes:
        n.value = np.array([n.value, 10 * n.value**2]) if n.leaf else np.zeros(2)
        n.weight = np.zeros(2)
    return Model("gbtree", "reg:squarederror", {}, 2, 2, [0.1, -0.2], [Stump(tree, 0)])


VECTOR_LEAF = "(CASE leaf WHEN 3 THEN 22.5 WHEN 4 THEN 2.5 WHEN 5 THEN 40.0 ELSE 10.0 END)::DOUBLE"


@query(f"""WITH {TREE_SQL}, s AS (SELECT q, i, CASE WHEN x0 < 20 THEN 1.0 ELSE 0.0 END AS a, {LEAF_CASE} AS a1, CASE WHEN x0 < 20 THEN 17.5 ELSE 20.0 END AS b, {VECTOR_LEAF} AS b1 FROM leafed)
SELECT q, i, round(a - 0.4, 6)::DOUBLE AS a0, round(a1 - a, 6)::DOUBLE AS a1, round(b - 19.0, 6)::DOUBLE AS b0, round(b1 - b, 6)::DOUBLE AS b1, 18.8::DOUBLE AS bias FROM s""")
def saabas_vector_leaf(spark, sf_dir):
    """Each output of a vector leaf has attributions of its own."""
    got = vector_model().predict(tree_frame(spark, sf_dir), "approx_contribution")
    part = lambda o, k: r(F.get(F.get("prediction", F.lit(o)), F.lit(k)))
    return got.select("q", "i", part(0, 0).alias("a0"), part(0, 1).alias("a1"), part(1, 0).alias("b0"), part(1, 1).alias("b1"), part(1, 2).alias("bias"))


SHAP_SQL = f"""WITH {TREE_SQL}, v AS (SELECT q, i, {LEAF_CASE} AS whole, CASE WHEN x0 < 20 THEN 1.0 ELSE 0.0 END AS only0,
  0.4 * CASE WHEN x1 IS NULL OR x1 < 0.05 THEN 1.5 ELSE -0.5 END + 0.6 * CASE WHEN x1 < 0.03 THEN 2.0 ELSE -1.0 END AS only1, 0.4 AS none FROM leafed)
SELECT q, i, round((only0 - none + whole - only1) / 2, 6)::DOUBLE AS c0, round((only1 - none + whole - only0) / 2, 6)::DOUBLE AS c1, 0.5::DOUBLE AS bias FROM v"""


@query(SHAP_SQL)
def shap_fixed_tree(spark, sf_dir):
    got = fixed_model().predict(tree_frame(spark, sf_dir), "contribution")
    part = lambda k: r(F.get(F.get("prediction", F.lit(0)), F.lit(k)))
    return got.select("q", "i", part(0).alias("c0"), part(1).alias("c1"), part(2).alias("bias"))


@query(f"WITH {TREE_SQL} SELECT q, i, round(0.1 + x0 * 0.05 + coalesce(x1, 0) * 2 + 0.3, 6) AS margin, round(x0 * 0.05, 6) AS c0, round(coalesce(x1, 0) * 2, 6) AS c1 FROM t")
def predict_linear(spark, sf_dir):
    import numpy as np

    model = Model("gblinear", "reg:squarederror", {}, 2, 1, [0.1], linear=np.array([[0.05], [2.0], [0.3]]))
    frame = tree_frame(spark, sf_dir)
    part = lambda k: F.get(F.get("prediction", F.lit(0)), F.lit(k))
    return model.predict(frame, "contribution").select("q", "i", r(part(0) + part(1) + part(2)).alias("margin"), r(part(0)).alias("c0"), r(part(1)).alias("c1"))


@query(f"WITH {TREE_SQL} SELECT leaf, count(*) AS n, round(sum(0.1 + {LEAF_CASE} - y), 3) AS g, round(-0.3 * sum(0.1 + {LEAF_CASE} - y) / (count(*) + 1), 6) AS value FROM leafed GROUP BY leaf")
def refresh_fixed_tree(spark, sf_dir):
    """Leaf sums of squared-error gradients at the tree's own margins, and the refreshed leaf values."""
    from .train import leaf_sums, refreshed

    model, tree = fixed_model(), fixed_tree()
    got = model.predict(tree_frame(spark, sf_dir), "margin").withColumns({"g": F.array(F.get("prediction", F.lit(0)) - F.col("y")), "h": F.array(S.num(1))})
    sums = leaf_sums(got, tree, 2, 1).persist()
    refreshed(tree, sums, Penalty(), 0.3)
    values = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(tree.nodes) if n.leaf for v in (i, float(n.value))]), F.col("node").cast("int"))
    return sums.select(F.col("node").cast("int").alias("leaf"), "n", r(F.get("g", F.lit(0)), 3).alias("g"), r(values).alias("value"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS label, l_discount AS v1, CASE WHEN l_tax > 0.04 THEN l_tax END AS v3 FROM lineitem")
def source_libsvm(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("string"), F.lit(" 1:"), F.col("l_discount").cast("string"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit(" 3:"), F.col("l_tax").cast("string"))).otherwise(""))
    got = parse_libsvm(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), text.alias("value")))
    return got.where("bad IS NULL").select("row_id", "label", F.try_element_at("entries", F.lit(1)).alias("v1"), F.try_element_at("entries", F.lit(3)).alias("v3"))


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS label, l_discount AS x0, 1 AS width FROM lineitem")
def source_libsvm_one_column(spark, sf_dir):
    """Lines whose largest index is 0 have one column."""
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("string"), F.lit(" 0:"), F.col("l_discount").cast("string"))
    frame = from_libsvm_lines(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), text.alias("value")))
    return frame.df.select("row_id", F.get("label", F.lit(0)).alias("label"), F.get("features", F.lit(0)).alias("x0"), F.lit(frame.width).alias("width"))


@query("SELECT o_orderkey AS row_id, o_totalprice AS x0, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE END AS x1 FROM orders")
def source_sparse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    entries = orders.select("row_id", F.lit(0).alias("f"), F.col("o_totalprice").alias("v")).unionByName(orders.where("row_id % 2 = 0").select("row_id", F.lit(1).alias("f"), F.col("o_custkey").alias("v")))
    return from_sparse(entries, 2).df.select("row_id", F.get("features", F.lit(0)).alias("x0"), F.get("features", F.lit(1)).alias("x1"))


@query("SELECT f, n FROM (SELECT 0 AS f, count(l_quantity) AS n FROM lineitem UNION ALL SELECT 1, count(*) FROM lineitem WHERE l_linenumber % 4 <> 0)")
def source_column_sizes(spark, sf_dir):
    return tree_frame(spark, sf_dir).column_sizes()


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, 0 AS f, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 1, l_discount FROM lineitem WHERE l_linenumber % 4 <> 0")
def source_transposed(spark, sf_dir):
    return tree_frame(spark, sf_dir).transposed().select("row_id", "f", "v")


# ---- whole trainings; those that draw by seeds have no SQL form


def price_frame(spark, sf_dir, label="l_extendedprice", scale=10000.0):
    li = table(spark, sf_dir, "lineitem")
    return from_dense(li, ["l_quantity", "l_discount", "l_tax"], F.col("l_orderkey") * 10 + F.col("l_linenumber")).with_labels(F.col(label) / scale)


def history(spark, model):
    return spark.createDataFrame(model.history, "round int, data string, metric string, value double").withColumn("value", r(F.col("value")))


def forest_sql(rounds: int, classes: int = 0, depth: int = 0, leaves: int = 0) -> str:
    """Metrics by round of trees over three columns without missing values: squared error, or so many classes.

    With depth, every node of a level is split where that gains; with leaves, the node that gains most is, one after another.
    Nodes are numbered by their path; a node that no split improves keeps its number and is tried again in vain.
    """
    gain = "lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)"
    label = "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END" if classes else "l_extendedprice / 10000"
    out = [f"r AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_quantity AS x0, l_discount AS x1, l_tax AS x2, {label} AS y FROM lineitem)",
           "long AS MATERIALIZED (SELECT rid, f, CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS v FROM r, (VALUES (0), (1), (2)) c(f))"]
    if classes:
        out += ["c0 AS (SELECT y AS k, ln(count(*)::DOUBLE / (SELECT count(*) FROM r)) AS l FROM r GROUP BY y)", "m0 AS MATERIALIZED (SELECT rid, k, l - (SELECT avg(l) FROM c0) AS m FROM r, c0)"]
    else:
        out.append("m0 AS MATERIALIZED (SELECT rid, 0 AS k, (SELECT avg(y) FROM r) AS m FROM r)")
    for t in range(rounds):
        if classes:
            out += [f"p{t} AS (SELECT rid, k, exp(m) / sum(exp(m)) OVER (PARTITION BY rid) AS p FROM m{t})",
                    f"g{t} AS MATERIALIZED (SELECT rid, k, p - (y = k)::INT AS g, greatest(2 * p * (1 - p), 1e-16) AS h FROM p{t} JOIN r USING (rid))"]
        else:
            out.append(f"g{t} AS MATERIALIZED (SELECT rid, k, m - y AS g, 1.0::DOUBLE AS h FROM m{t} JOIN r USING (rid))")
        out.append(f"n{t}_0 AS (SELECT rid, k, 0 AS node FROM m{t})")
        for i in range(depth or leaves - 1):
            a = f"{t}_{i}"
            best = f"row_number() OVER (PARTITION BY k{'' if leaves else ', node'} ORDER BY round(gain, 7) DESC, node, f, v) AS o"
            out += [
                f"h{a} AS MATERIALIZED (SELECT k, node, f, v, sum(g) AS g, sum(h) AS h FROM n{a} JOIN g{t} USING (rid, k) JOIN long USING (rid) GROUP BY k, node, f, v)",
                f"s{a} AS (SELECT k, node, f, v, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER q AS tg, sum(h) OVER q AS th FROM h{a} WINDOW q AS (PARTITION BY k, node, f), w AS (PARTITION BY k, node, f ORDER BY v))",
                f"e{a} AS (SELECT *, {gain} AS gain FROM s{a} WHERE lh >= 1 AND th - lh >= 1)",
                f"b{a} AS MATERIALIZED (SELECT * FROM (SELECT *, {best} FROM e{a} WHERE gain > 1e-6) WHERE o = 1)",
                f"n{t}_{i + 1} AS MATERIALIZED (SELECT n.rid, n.k, CASE WHEN b.f IS NULL THEN n.node WHEN CASE b.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= b.v THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node FROM n{a} n JOIN r USING (rid) LEFT JOIN b{a} b ON b.k = n.k AND b.node = n.node)",
            ]
        last = f"n{t}_{depth or leaves - 1}"
        out += [f"l{t} AS (SELECT k, node, -0.3 * sum(g) / (sum(h) + 1) AS v FROM {last} JOIN g{t} USING (rid, k) GROUP BY k, node)", f"m{t + 1} AS MATERIALIZED (SELECT rid, k, m + v AS m FROM m{t} JOIN {last} USING (rid, k) JOIN l{t} USING (k, node))"]
    name, value = ("rmse", "sqrt(avg(pow(m - y, 2)))") if not classes else ("mlogloss", "avg(z - m)")
    scored = lambda t: f"m{t} JOIN r USING (rid)" if not classes else f"(SELECT rid, k, m, ln(sum(exp(m)) OVER (PARTITION BY rid)) AS z FROM m{t}) JOIN r USING (rid) WHERE y = k"
    picks = " UNION ALL ".join(f"SELECT {t}::INT AS round, 'train' AS data, '{name}' AS metric, round({value}, 6) AS value FROM {scored(t + 1)}" for t in range(rounds))
    return f"WITH {', '.join(out)} {picks}"


def linear_history_sql(rounds: int) -> str:
    """Metrics by round of coordinate descent: all that a step needs of the rows are their moments."""
    x = ("x0", "x1", "x2")
    sums = ", ".join([*(f"sum({a}) AS s_{a}" for a in x), *(f"sum({a} * {b}) AS s_{a}{b}" for a in x for b in x), *(f"sum((b - y) * {a}) AS g_{a}" for a in x), *(f"0.0::DOUBLE AS w_{a}" for a in x)])
    out = ["r AS MATERIALIZED (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice / 10000 AS y, (SELECT avg(l_extendedprice / 10000) FROM lineitem) AS b FROM lineitem)",
           f"t0 AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(b - y) AS g_, 0.0::DOUBLE AS w_, {sums} FROM r)"]
    steps, ends = 0, []
    for _ in range(rounds):
        for a in ("", *x):
            square = f"s_{a}{a}" if a else "n"
            cross = lambda b, a=a: f"s_{a}{b}" if a and b else f"s_{a}{b}" if a or b else "n"
            moved = ", ".join(f"g_{b} + d * {cross(b)} AS g_{b}" for b in ("", *x))
            out.append(f"t{steps + 1} AS MATERIALIZED (SELECT * EXCLUDE (d) REPLACE ({moved}, w_{a} + d AS w_{a}) FROM (SELECT *, -0.5 * g_{a} / {square} AS d FROM t{steps}))")
            steps += 1
        ends.append(steps)
    margin = "b + w_ + " + " + ".join(f"w_{a} * {a}" for a in x)
    picks = " UNION ALL ".join(f"SELECT {i}::INT AS round, 'train' AS data, 'rmse' AS metric, round(sqrt(avg(pow({margin} - y, 2))), 6) AS value FROM r, t{at}" for i, at in enumerate(ends))
    return f"WITH {', '.join(out)} {picks}"


def training(name, params, rounds=3, prepare=None, sql=None):
    from .train import train

    def run(spark, sf_dir):
        frame = (prepare or price_frame)(spark, sf_dir)
        return history(spark, train(params, frame, rounds, [("train", frame)]))

    query(sql, name)(run)


def flagged(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)
    return from_dense(li, ["l_quantity", "l_discount", "l_tax"], F.col("l_orderkey") * 10 + F.col("l_linenumber")).with_labels(flag)


training("train_hist", {"max_depth": 4}, sql=forest_sql(3, depth=4))
training("train_lossguide", {"grow_policy": "lossguide", "max_leaves": 6, "max_depth": 0}, 2, sql=forest_sql(2, leaves=6))
training("train_approx", {"tree_method": "approx", "max_depth": 3}, 2, sql=forest_sql(2, depth=3))
training("train_exact", {"tree_method": "exact", "max_depth": 3}, 2, sql=forest_sql(2, depth=3))
training("train_dart", {"booster": "dart", "rate_drop": 0.5, "max_depth": 3})
training("train_linear", {"booster": "gblinear"}, 5, sql=linear_history_sql(5))
training("train_softprob", {"objective": "multi:softprob", "num_class": 3, "max_depth": 3}, 2, flagged, forest_sql(2, classes=3, depth=3))
training("train_sampled", {"subsample": 0.5, "sampling_method": "gradient_based", "colsample_bynode": 0.7, "max_depth": 3}, 2)


# ---- whole trees of depth 2, which SQL can unroll

# Rows are told apart by rid: order and line number repeat.
DEPTH2_SQL = f"""WITH {LONG_SQL}, c AS ({X.candidates_sql('both')}), best AS (SELECT * FROM c ORDER BY gain DESC, f, default_left, bin LIMIT 1),
side AS (SELECT rid, CASE WHEN (CASE WHEN b.bin IS NULL THEN s.default_left ELSE b.bin <= s.bin END) THEN 1 ELSE 2 END AS part FROM binned b JOIN best s ON s.f = b.f),
h2 AS (SELECT part, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM binned JOIN side USING (rid) GROUP BY ALL),
t2 AS (SELECT part, sum(g) AS tg, sum(h) AS th FROM h2 WHERE f = 0 GROUP BY part),
p2 AS (SELECT part, f, bin, sum(g) OVER w AS lg, sum(h) OVER w AS lh, max(bin) OVER (PARTITION BY part, f) AS last FROM h2 WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY part, f ORDER BY bin)),
c2 AS (SELECT p.part, p.f, p.bin, d.dl, p.lg + CASE WHEN d.dl THEN m.g ELSE 0 END AS lg, p.lh + CASE WHEN d.dl THEN m.h ELSE 0 END AS lh, t.tg, t.th
  FROM p2 p JOIN t2 t USING (part) LEFT JOIN (SELECT * FROM h2 WHERE bin IS NULL) m ON m.part = p.part AND m.f = p.f, (VALUES (TRUE), (FALSE)) d(dl) WHERE NOT d.dl OR (m.n > 0 AND p.bin < p.last)),
g2 AS (SELECT *, round(lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1), 4) AS gain FROM c2 WHERE lh >= 1 AND th - lh >= 1),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY gain DESC, f, dl, bin) AS k FROM g2) WHERE k = 1),
ends AS (SELECT rid, s.part, CASE WHEN b.bin IS NULL THEN x.dl ELSE b.bin <= x.bin END AS goes, b.g, b.h FROM side s JOIN b2 x USING (part) JOIN binned b USING (rid) WHERE b.f = x.f),
leaf AS (SELECT part, goes, -0.3 * sum(g) / (sum(h) + 1) AS v, count(*) AS n FROM ends GROUP BY ALL) SELECT round(b + v, 4) AS margin, n FROM leaf, mean"""


def depth2_query(name, params):
    def run(spark, sf_dir):
        from .train import train

        li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")))
        frame = from_dense(li, list(FEATURES), F.monotonically_increasing_id()).with_labels(F.col("l_extendedprice") / 1000)
        model = train({"max_depth": 2, "disable_default_eval_metric": True, **params}, frame, 1)
        return model.predict(frame, "margin").groupBy(r(F.get("prediction", F.lit(0)), 4).alias("margin")).agg(F.count("*").alias("n"))

    query(DEPTH2_SQL, name)(run)


def depth2_model(spark, sf_dir, rounds=1, **params):
    from .train import train

    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")))
    frame = from_dense(li, list(FEATURES), F.monotonically_increasing_id()).with_labels(F.col("l_extendedprice") / 1000)
    return train({"max_depth": 2, "disable_default_eval_metric": True, **params}, frame, rounds), frame


def margin_counts(model, frame):
    return model.predict(frame, "margin").groupBy(r(F.get("prediction", F.lit(0)), 4).alias("margin")).agg(F.count("*").alias("n"))


depth2_query("tree_hist", {})
depth2_query("tree_exact", {"tree_method": "exact"})

# Of the two children only the one of the larger gain is split.
THREE_LEAVES_SQL = DEPTH2_SQL.replace("ends AS (SELECT rid, s.part, CASE WHEN b.bin IS NULL THEN x.dl ELSE b.bin <= x.bin END AS goes, b.g, b.h FROM side s JOIN b2 x USING (part) JOIN binned b USING (rid) WHERE b.f = x.f)", """b3 AS (SELECT * FROM b2 ORDER BY gain DESC LIMIT 1),
ends AS (SELECT rid, s.part, CASE WHEN x.f IS NULL THEN NULL WHEN b.bin IS NULL THEN x.dl ELSE b.bin <= x.bin END AS goes, b.g, b.h FROM side s LEFT JOIN b3 x USING (part) JOIN binned b USING (rid) WHERE b.f = coalesce(x.f, 0))""")


@query(THREE_LEAVES_SQL)
def tree_lossguide(spark, sf_dir):
    """Three leaves: the queue splits the child that gains more and leaves the other one."""
    return margin_counts(*depth2_model(spark, sf_dir, grow_policy="lossguide", max_leaves=3))


@query(THREE_LEAVES_SQL)
def prune_fixed_tree(spark, sf_dir):
    """A depthwise tree whose split of the smaller gain is pruned has the same three leaves."""
    model, frame = depth2_model(spark, sf_dir)
    tree = model.stumps[0].tree
    low, high = sorted(tree.nodes[c].gain for c in (tree.nodes[0].left, tree.nodes[0].right))
    tree.prune((low + high) / 2, 0.3)
    return margin_counts(model, frame)


@query(DEPTH2_SQL.replace("SELECT round(b + v, 4) AS margin", "SELECT round(b + v * 2 / 1.3, 4) AS margin"))
def tree_dart(spark, sf_dir):
    """Two rounds, the second without the first one's tree: it grows the same tree, and both weigh 1 / (1 + eta)."""
    return margin_counts(*depth2_model(spark, sf_dir, booster="dart", rate_drop=1.0, rounds=2))


IMPORTANCE_SQL = DEPTH2_SQL[: DEPTH2_SQL.index(",\nends AS")] + ", i AS (SELECT f AS split_index, gain, (SELECT count(*) FROM rows)::DOUBLE AS cover FROM best UNION ALL SELECT f, gain, th FROM b2) "
for _kind, _sql in (("weight", "1000 * count(*)::DOUBLE"), ("total_gain", "sum(gain)"), ("gain", "avg(gain)"), ("total_cover", "sum(cover)"), ("cover", "avg(cover)")):
    query(f"{IMPORTANCE_SQL} SELECT split_index, round({_sql} / 1000, 2) AS {_kind} FROM i GROUP BY split_index", f"importance_{_kind}")(
        lambda spark, sf_dir, k=_kind: importance(depth2_model(spark, sf_dir)[0].trees_table(spark), k).select("split_index", r(F.col(k) / (1 if k == "weight" else 1000), 2).alias(k))
    )


@query(DEPTH2_SQL)
def model_document(spark, sf_dir):
    """A trained model, written as a document of the public shape and read back."""
    from .exchange import from_document, to_document

    model, frame = depth2_model(spark, sf_dir)
    return margin_counts(from_document(to_document(model)), frame)


@query(DEPTH2_SQL)
def model_table(spark, sf_dir):
    """A trained model whose trees are read back from their table."""
    from dataclasses import replace

    from .exchange import with_trees

    model, frame = depth2_model(spark, sf_dir)
    return margin_counts(with_trees(replace(model, stumps=[]), model.trees_table(spark)), frame)


# ---- stumps of several outputs and rounds


def stump_sql(p: str, gh: str) -> str:
    """Tables of the best split of depth 1 by output k, of gradients gh (k, rid, g, h) over `binned`: {p}b the splits, {p}s the side of each row, {p}l leaf values."""
    return f"""{p}h AS (SELECT k, f, bin, sum(e.g) AS g, sum(e.h) AS h, count(*) AS n FROM binned JOIN {gh} e USING (rid) GROUP BY k, f, bin),
{p}t AS (SELECT k, sum(g) AS tg, sum(h) AS th FROM {p}h WHERE f = 0 GROUP BY k),
{p}p AS (SELECT k, f, bin, sum(g) OVER w AS lg, sum(h) OVER w AS lh, max(bin) OVER (PARTITION BY k, f) AS last FROM {p}h WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY k, f ORDER BY bin)),
{p}c AS (SELECT p.k, p.f, p.bin, d.dl, p.lg + CASE WHEN d.dl THEN m.g ELSE 0 END AS lg, p.lh + CASE WHEN d.dl THEN m.h ELSE 0 END AS lh, t.tg, t.th
  FROM {p}p p JOIN {p}t t USING (k) LEFT JOIN (SELECT * FROM {p}h WHERE bin IS NULL) m ON m.k = p.k AND m.f = p.f, (VALUES (TRUE), (FALSE)) d(dl) WHERE NOT d.dl OR (m.n > 0 AND p.bin < p.last)),
{p}g AS (SELECT *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) AS gain FROM {p}c WHERE lh >= 1 AND th - lh >= 1),
{p}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gain, 7) DESC, f, dl, bin) AS o FROM {p}g) WHERE o = 1),
{p}s AS (SELECT b.rid, x.k, CASE WHEN b.bin IS NULL THEN x.dl ELSE b.bin <= x.bin END AS goes FROM binned b JOIN {p}b x ON b.f = x.f),
{p}l AS (SELECT s.k, s.goes, -0.3 * sum(e.g) / (sum(e.h) + 1) AS v FROM {p}s s JOIN {gh} e USING (rid, k) GROUP BY s.k, s.goes)"""


FLAG_SQL = LONG_SQL.replace("l_extendedprice / 1000 AS y FROM", "l_extendedprice / 1000 AS y, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS cls, 1 + l_tax * 10 AS w FROM")


def flag_frame(spark, sf_dir, label, weight=None):
    li = table(spark, sf_dir, "lineitem").withColumn("x_tax", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")))
    frame = from_dense(li, ["l_quantity", "l_discount", "x_tax"], F.monotonically_increasing_id()).with_labels(label)
    return frame if weight is None else frame.with_weights(weight)


@query(f"""WITH {FLAG_SQL}, z AS (SELECT ln(a / (1 - a)) AS b0 FROM (SELECT sum(w * (cls = 2)::INT) / sum(w) AS a FROM rows)),
g1 AS (SELECT 0 AS k, rid, (1 / (1 + exp(-b0)) - (cls = 2)::INT) * w AS g, 1 / (1 + exp(-b0)) * (1 - 1 / (1 + exp(-b0))) * w AS h FROM rows, z), {stump_sql('u', 'g1')},
m1 AS (SELECT rid, b0 + v AS m FROM z, us JOIN ul USING (k, goes)),
g2 AS (SELECT 0 AS k, rid, (1 / (1 + exp(-m)) - (cls = 2)::INT) * w AS g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) * w AS h FROM rows JOIN m1 USING (rid)), {stump_sql('c', 'g2')}
SELECT round(m + v, 4) AS margin, count(*) AS n FROM m1 JOIN cs USING (rid) JOIN cl USING (k, goes) GROUP BY 1""")
def tree_approx(spark, sf_dir):
    """Two rounds of weighted logistic stumps: the second one's cuts and sums are of other hessians."""
    from .train import train

    frame = flag_frame(spark, sf_dir, (F.col("l_returnflag") == "R").cast("int"), 1 + F.col("l_tax") * 10)
    return margin_counts(train({"max_depth": 1, "objective": "binary:logistic", "tree_method": "approx", "disable_default_eval_metric": True}, frame, 2), frame)


@query(f"""WITH {FLAG_SQL}, c0 AS (SELECT k, ln(count(*)::DOUBLE / (SELECT count(*) FROM rows)) AS l FROM rows, (VALUES (0), (1), (2)) v(k) WHERE cls = k GROUP BY k), c1 AS (SELECT k, l - avg(l) OVER () AS m FROM c0),
c2 AS (SELECT k, m, exp(m) / sum(exp(m)) OVER () AS p FROM c1),
gk AS (SELECT k, rid, p - (cls = k)::INT AS g, greatest(2 * p * (1 - p), 1e-16) AS h FROM rows, c2), {stump_sql('t', 'gk')},
o AS (SELECT rid, k, m + v AS m FROM ts JOIN tl USING (k, goes) JOIN c2 USING (k)),
w3 AS (SELECT rid, max(CASE WHEN k = 0 THEN m END) AS m0, max(CASE WHEN k = 1 THEN m END) AS m1, max(CASE WHEN k = 2 THEN m END) AS m2 FROM o GROUP BY rid)
SELECT round(m0, 4) AS m0, round(m1, 4) AS m1, round(m2, 4) AS m2, count(*) AS n FROM w3 GROUP BY ALL""")
def softprob_round_1(spark, sf_dir):
    """A stump a class after the first round of three classes."""
    from .train import train

    frame = flag_frame(spark, sf_dir, F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0))
    model = train({"max_depth": 1, "objective": "multi:softprob", "num_class": 3, "disable_default_eval_metric": True}, frame, 1)
    return model.predict(frame, "margin").groupBy(*[r(F.get("prediction", F.lit(k)), 4).alias(f"m{k}") for k in range(3)]).agg(F.count("*").alias("n"))


@query(f"""WITH {FLAG_SQL}, g0 AS (SELECT 0 AS k, rid, tanh(b - y) AS g, greatest(1 - pow(tanh(b - y), 2), 1e-6) AS h FROM rows, mean), {stump_sql('q', 'g0')},
m0 AS (SELECT b + v AS m, y FROM qs JOIN ql USING (k, goes) JOIN rows USING (rid), mean) SELECT round(m, 4) AS margin, count(*) AS n, round((SELECT avg(ln(cosh(m - y))) FROM m0), 6) AS loss FROM m0 GROUP BY 1""")
def custom_loss_round_1(spark, sf_dir):
    """A user's loss (log cosh) and metric, by name in training and evaluation."""
    from .train import train

    slope = lambda m, y: F.tanh(m - y)
    objectives.register("user:logcosh", lambda **_: objectives.Objective("user:logcosh", lambda m, y: (slope(m, y), F.greatest(1 - F.pow(slope(m, y), 2), S.num(1e-6))), metric="user-logcosh"))
    metrics.register("user-logcosh", lambda df: df.agg(F.avg(F.log(F.cosh(F.get("prediction", F.lit(0)) - F.get("label", F.lit(0))))).alias("value")))
    frame = flag_frame(spark, sf_dir, F.col("l_extendedprice") / 1000)
    model = train({"max_depth": 1, "objective": "user:logcosh"}, frame, 1, [("train", frame)])
    return margin_counts(model, frame).withColumn("loss", r(F.lit(model.history[0][3])))


def linear_sql() -> str:
    """One round of coordinate descent: the bias, then each feature on the gradient that is left."""
    x = ("x0", "x1", "x2")
    out = ["r AS (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice / 10000 AS y FROM lineitem)", "s AS (SELECT avg(y) AS b, count(*)::DOUBLE AS n, " + ", ".join(f"sum({a}) AS s_{a}" for a in x) + ", " + ", ".join(f"sum({a} * {b}) AS s_{a}{b}" for a in x for b in x) + ", sum(y) AS sy, " + ", ".join(f"sum({a} * y) AS sy_{a}" for a in x) + " FROM r)"]
    out.append("t0 AS (SELECT *, -0.5 * (b * n - sy) / n AS db, " + ", ".join(f"b * s_{a} - sy_{a} + s_{a} * (-0.5 * (b * n - sy) / n) AS g_{a}" for a in x) + " FROM s)")
    for i, a in enumerate(x):
        out.append(f"t{i + 1} AS (SELECT * EXCLUDE ({', '.join('g_' + b for b in x)}), -0.5 * g_{a} / s_{a}{a} AS d_{a}, " + ", ".join(f"g_{b} + s_{a}{b} * (-0.5 * g_{a} / s_{a}{a}) AS g_{b}" for b in x) + f" FROM t{i})")
    picks = " UNION ALL ".join(f"SELECT {i} AS f, round({c}, 6) AS weight FROM t3" for i, c in enumerate(("d_x0", "d_x1", "d_x2", "db")))
    return f"WITH {', '.join(out)} {picks}"


@query(linear_sql())
def linear_round_1(spark, sf_dir):
    """Weights after one round of a linear model; the last is the bias."""
    from .train import train

    model = train({"booster": "gblinear", "disable_default_eval_metric": True}, price_frame(spark, sf_dir), 1)
    return spark.createDataFrame([(f, float(w)) for f, w in enumerate(model.linear[:, 0])], "f int, weight double").select("f", r(F.col("weight")).alias("weight"))


def batches_sql() -> str:
    """One round of shotgun in two batches of rows: the bias on all, then both features on each batch's own residuals."""
    out = ["o AS (SELECT o_orderkey AS id, max(o_custkey)::DOUBLE / 100 AS x0, min(o_totalprice) / 100000 AS x1, max(o_totalprice) / 50000 AS y FROM orders GROUP BY o_orderkey)",
           "r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY id) <= (SELECT (count(*) + 1) // 2 FROM o) THEN 0 ELSE 1 END AS p, (SELECT avg(y) FROM o) AS b FROM o)",
           "z AS (SELECT -0.5 * sum(b - y) / count(*) AS db FROM r)",
           "s AS (SELECT p, db, " + ", ".join(f"sum((b - y + db) * {a}) AS g_{a}" for a in ("x0", "x1")) + ", sum(x0 * x0) AS s00, sum(x0 * x1) AS s01, sum(x1 * x1) AS s11 FROM r, z GROUP BY p, db)",
           "a AS (SELECT -0.5 * g_x0 / s00 AS w0, -0.5 * (g_x1 + s01 * (-0.5 * g_x0 / s00)) / s11 AS w1, db FROM s WHERE p = 0)",
           "c AS (SELECT w0 + -0.5 * g_x0 / s00 AS w0, w1 + -0.5 * (g_x1 + s01 * (-0.5 * g_x0 / s00)) / s11 AS w1, s.db FROM s, a WHERE p = 1)"]
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT {i} AS f, round({c}, 6) AS weight FROM c" for i, c in enumerate(("w0", "w1", "db")))


@query(batches_sql())
def linear_batches_round_1(spark, sf_dir):
    """Weights after a round of shotgun over two batches of rows; the last is the bias."""
    from .train import train

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg((F.max("o_custkey").cast("double") / 100).alias("x0"), (F.min("o_totalprice") / 100000).alias("x1"), (F.max("o_totalprice") / 50000).alias("y"))
    frame = from_dense(orders, ["x0", "x1"], F.col("id")).with_labels(F.col("y"))
    model = train({"booster": "gblinear", "max_row_perbatch": (orders.count() + 1) // 2, "disable_default_eval_metric": True}, frame, 1)
    return spark.createDataFrame([(f, float(w)) for f, w in enumerate(model.linear[:, 0])], "f int, weight double").select("f", r(F.col("weight")).alias("weight"))


@query("""WITH o AS (SELECT o_orderkey AS id, max(o_custkey) AS f, min(o_totalprice) / 100000 AS v, max(o_totalprice) / 50000 AS y FROM orders GROUP BY o_orderkey), b AS (SELECT avg(y) AS b FROM o),
z AS (SELECT b, -0.5 * sum(b - y) / count(*) AS db FROM o, b GROUP BY b) SELECT f::BIGINT AS f, round(-0.5 * sum((b - y + db) * v) / sum(v * v), 6) AS weight FROM o, z GROUP BY f""")
def linear_sparse_round_1(spark, sf_dir):
    """A round of a linear model over orders whose one feature is the customer: weights of customers that have orders."""
    from .train import train

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("row_id")).agg(F.max("o_custkey").alias("f"), (F.min("o_totalprice") / 100000).alias("v"), (F.max("o_totalprice") / 50000).alias("y"))
    frame = from_long(orders.select("row_id", "f", "v"), orders.agg(F.max("f")).first()[0] + 1, orders.select("row_id", "y")).with_labels(F.col("y"))
    w = train({"booster": "gblinear", "disable_default_eval_metric": True}, frame, 1).linear[:-1, 0]
    held = np.flatnonzero(w)
    return spark.createDataFrame(pa.table({"f": held, "weight": w[held]}), "f bigint, weight double").select("f", r(F.col("weight")).alias("weight"))


@query("""WITH o AS (SELECT o_orderkey AS row_id, max(o_totalprice) AS x0, CASE WHEN o_orderkey % 2 = 0 THEN max(o_custkey)::DOUBLE END AS x1 FROM orders GROUP BY o_orderkey),
n AS (SELECT *, ((row_number() OVER (ORDER BY row_id) - 1) // 1000)::INT AS batch FROM o), c AS (SELECT batch, 0 AS f, row_id, x0 AS v FROM n UNION ALL SELECT batch, 1, row_id, x1 FROM n WHERE x1 IS NOT NULL)
SELECT batch, f, (row_number() OVER (PARTITION BY batch, f ORDER BY v, row_id) - 1)::INT AS rank, row_id, v FROM c""")
def source_column_pages(spark, sf_dir):
    """Columns of batches of 1000 rows, each by value."""
    orders = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.max("o_totalprice").alias("x0"), F.when(F.col("o_orderkey") % 2 == 0, F.max("o_custkey").cast("double")).alias("x1"))
    return from_dense(orders, ["x0", "x1"], F.col("o_orderkey")).column_pages(1000)


@query(f"""WITH {BASE_SQL}, v AS (SELECT sqrt(pow(({SIG} - yb) * w, 2) + 0.1 * pow({SIG} * (1 - {SIG}) * w, 2)) AS s FROM base), c AS (SELECT s, count(*) AS c, sum(s) AS t FROM v GROUP BY s),
k AS (SELECT s, sum(t) OVER w AS under, coalesce(sum(c) OVER (ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS over_, lead(s) OVER w AS nxt FROM c WINDOW w AS (ORDER BY s)),
u AS (SELECT s, nxt, CASE WHEN floor(0.3 * (SELECT count(*) FROM base)) > over_ THEN under / (floor(0.3 * (SELECT count(*) FROM base)) - over_) END AS u FROM k) SELECT round(min(u), 6) AS value FROM u WHERE u > s AND (nxt IS NULL OR u <= nxt)""")
def sample_threshold(spark, sf_dir):
    """The gradient size from which rows are always drawn, for a share of 0.3."""
    from .train import sampling_threshold

    g, h = of("binary:logistic", "yb")()
    w = F.col("w")
    sizes = base(spark, sf_dir).select(F.sqrt(F.pow(g * w, 2) + 0.1 * F.pow(h * w, 2)).alias("s"))
    return spark.createDataFrame([(sampling_threshold(sizes, 0.3),)], "value double").select(r(F.col("value")).alias("value"))


# ---- search over all values, and over many sparse features


def values_sql(rows: str, entries: str, threshold: str, gap: str) -> str:
    """The best split over all distinct values. rows: row, y; entries: f, row, v of what is present."""
    gain = "lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)"
    return f"""WITH r AS MATERIALIZED ({rows}), n AS MATERIALIZED ({entries}), b AS (SELECT avg(y) AS b FROM r), t AS (SELECT sum(b - y) AS tg, count(*)::DOUBLE AS th FROM r, b),
v AS (SELECT f, v, sum(b - y) AS g, count(*)::DOUBLE AS h FROM n JOIN r USING (row), b GROUP BY f, v), m AS (SELECT f, tg - sum(g) AS mg, th - sum(h) AS mh FROM v, t GROUP BY f, tg, th),
c AS (SELECT f, v, lead(v) OVER w AS nxt, sum(g) OVER w AS lg, sum(h) OVER w AS lh FROM v WINDOW w AS (PARTITION BY f ORDER BY v)),
k AS (SELECT c.f, {threshold} AS threshold, d.dl, lg + CASE WHEN dl THEN mg ELSE 0 END AS lg, lh + CASE WHEN dl THEN mh ELSE 0 END AS lh FROM c JOIN m USING (f), (VALUES (TRUE), (FALSE)) d(dl) WHERE nxt IS NOT NULL AND (mh > 0 OR NOT dl)
  UNION ALL SELECT c.f, v + (abs(v) + {gap}), FALSE, lg, lh FROM c WHERE nxt IS NULL),
x AS (SELECT *, {gain} AS gain FROM k, t WHERE lh >= 1 AND th - lh >= 1), best AS (SELECT * FROM x ORDER BY gain DESC, f, dl, threshold LIMIT 1)
SELECT f, round(threshold, 6) AS threshold, round(gain, 2) AS gain, lh::BIGINT AS n_left, round(b - 0.3 * lg / (lh + 1), 6) AS left_margin, round(b - 0.3 * (tg - lg) / (th - lh + 1), 6) AS right_margin FROM best, b"""


def root_split(spark, model, frame):
    """What values_sql gives, of a trained stump: its split, and how many of the frame's rows go left."""
    tree = model.stumps[0].tree
    root, base = tree.nodes[0], model.base_score[0]
    left = model.predict(frame, "leaf").where(F.get("prediction", F.lit(0)) == root.left).agg(F.count("*").alias("n_left"))
    value = lambda i: r(F.lit(base + float(tree.nodes[i].value)))
    return left.select(F.lit(root.feature).alias("f"), r(F.lit(float(root.threshold))).alias("threshold"), r(F.lit(root.gain), 2).alias("gain"), "n_left", value(root.left).alias("left_margin"), value(root.right).alias("right_margin"))


EXACT_ROWS = "SELECT row_number() OVER () AS row, l_extendedprice AS x0, CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice * (1 - l_discount) END AS x1, l_quantity + 20 * sin(l_extendedprice / 5000) AS y FROM lineitem"


@query(values_sql(EXACT_ROWS, "SELECT row, 0 AS f, x0 AS v FROM r UNION ALL SELECT row, 1, x1 FROM r WHERE x1 IS NOT NULL", "(v + nxt) / 2", "1e-6"))
def tree_exact_continuous(spark, sf_dir):
    """Exact search over prices, of which nearly all differ."""
    from .train import train

    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    frame = from_dense(li, [price, F.when(F.col("l_linenumber") % 4 != 0, price * (1 - F.col("l_discount")))], F.monotonically_increasing_id()).with_labels(F.col("l_quantity") + 20 * F.sin(price / 5000))
    return root_split(spark, train({"max_depth": 1, "tree_method": "exact", "disable_default_eval_metric": True}, frame, 1), frame)


@query(values_sql("SELECT o_orderkey AS row, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY o_orderkey", "SELECT l_orderkey AS row, l_partkey AS f, max(l_quantity) AS v FROM lineitem JOIN r ON l_orderkey = r.row GROUP BY ALL", "nxt", "1e-5"))
def tree_sparse(spark, sf_dir):
    """A stump over orders whose features are the parts ordered, as many as there are parts."""
    from .train import train

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("row_id")).agg((F.sum("o_totalprice") / 1000).alias("y"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("f"), F.col("l_quantity").alias("v"))
    width = parts.agg(F.max("f")).first()[0] + 1
    frame = from_long(parts, width, orders).with_labels(F.col("y"))
    return root_split(spark, train({"max_depth": 1, "disable_default_eval_metric": True}, frame, 1), frame)


def flagship(spark, sf_dir):
    from .train import train

    frame = price_frame(spark, sf_dir)
    model = train({"max_depth": 3}, frame, 3)
    return model.predict(frame).select("row_id", F.get("prediction", F.lit(0)).alias("prediction"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
