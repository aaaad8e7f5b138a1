"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on character and word statistics gives each document's own evidence. It is
fitted on the driver from a hash sample of labelled documents that is bounded by SAMPLE; everything
else covers all rows. Hosts, and paths within hosts, then get posteriors: a site's mean probability
over all of its documents is shrunk towards the global prior, a path's towards its host's, with
strengths fitted from the spread between sites (method of moments of a beta prior). A document's
final log-odds are its own evidence with the global prior replaced by its path's posterior.

Sums by site are pre-aggregated before they are shuffled. The posteriors return to the documents in a
broadcast join while the table is small (checked), else in a join salted by document, so that a site
with a third of all rows is no single task's work.

Defined results: a null text is empty and is judged by its (empty) statistics; null host or path is a
site of its own; documents without labels only lack a label; with no usable labels of both kinds the
evidence is 0 for all and every document is kept; an empty table gives no rows; repeated rows are
judged alike; very long texts are read whole; own columns of any name stay as they are.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: At most about so many labelled documents are used for fitting (expected size of a hash sample).
SAMPLE = 20_000
#: Sites up to which posteriors are broadcast: rows of some 60 bytes, so 12 MB.
BROADCAST_SITES = 200_000
SALTS = 32
#: A document is rejected below this posterior probability of good quality.
KEEP = 0.5
#: The range of a site's shrinkage strength, in documents.
STRENGTH = (10.0, 10_000.0)

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
SYMBOL = b"*#$%&!|<>{}[]=~^_@\\/+"
STOP = b".,;:?"
WIDE = bytes(range(128, 256))
FEATURES = 12


def statistics(text: bytes) -> list[float]:
    """Numbers of about unit size that describe a text."""
    n, words = len(text), text.split()
    k = len(words)
    count = lambda table: n - len(text.translate(None, table))
    upper, lower, wide = count(UPPER), count(LOWER), count(WIDE)
    letters = upper + lower + wide + 1
    distinct = len(set(words))
    twice = sum(map(operator.eq, words, words[1:]))
    symbol = count(SYMBOL)
    return [
        min(1.0, 3 * upper / letters),
        min(2.0, 10 * symbol / (n + 1)),
        min(1.0, 10 * count(DIGIT) / (n + 1)),
        2 * twice / (k + 1),
        math.log1p(k) / 5,
        min(2.0, n / (5 * k + 5)),
        1 - distinct / (k + 1),
        (1 - distinct / (k + 1)) * math.log1p(k) / 5,
        min(1.0, 10 * text.count(b"\n") / (k + 1)),
        min(1.0, 4 * count(STOP) / (k + 1)),
        float(symbol > 0.02 * n),
        1.0 / (1 + k),
    ]


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights (intercept last) by Newton's method, and the prior log-odds of the sample."""
    if not len(y) or y.min() == y.max():
        return np.zeros(FEATURES + 1), 0.0
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], decay * len(y))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    m = y.mean()
    return w, float(np.log(m / (1 - m)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality"):
    """Fit on labelled documents. Only the sample's ids (bounded) are broadcast, only its statistics collected."""
    known = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).where(f"__k IS NOT NULL AND __y IN (0, 1)").groupBy("__k").agg(F.max("__y").alias("__y"))
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    known = known.where(F.pmod(F.xxhash64("__k"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(known), "__k")
    schema = common.arrow_schema("k bigint, y int, x array<double>")

    def make():
        def step(batch):
            x = [statistics(t) for part in common.parts(batch) for t in common.utf8(part, "__t")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(x, schema.field(2).type)], schema=schema)

        return step

    # Rows that repeat an id count once, so no more than the sample reaches the driver.
    got = common.map_batches(rows.select("__k", "__y", "__t"), make, "k bigint, y int, x array<double>").groupBy("k", "y").agg(F.max("x").alias("x")).toPandas().sort_values(["k", "y"], kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), FEATURES)
    return fit(x, got["y"].to_numpy(float))


def evidence(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with __logit, each document's own log-odds. Column names of docs may be any."""
    at = [c.lower() for c in docs.columns].index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("__logit", T.DoubleType())])
    w = weights.copy()

    def run(batches):
        for batch in batches:
            for part in common.parts(batch):
                texts = [b or b"" for b in part.column(at).cast(pa.binary()).to_pylist()]
                x = np.array([statistics(t) for t in texts]).reshape(len(texts), FEATURES)
                logit = np.round(np.clip(x @ w[:-1] + w[-1], -12, 12), 6)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logit)], names=[*part.schema.names, "__logit"])

    return docs.mapInArrow(run, schema)


def strength(groups: DataFrame, n: str, s: str, q: str) -> float:
    """The beta prior's size from how far means of groups spread beyond their own sampling error."""
    mean = F.col(s) / F.col(n)
    within = (F.col(q) - F.col(s) * mean) / F.greatest(F.col(n) - 1, F.lit(1)) / F.col(n)
    sums = groups.where(F.col(n) > 1).agg(
        F.count("*").alias("groups"), F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col(n) * mean * mean).alias("m2"), F.sum(F.col(n) * within).alias("within")
    ).first()
    if not sums or not sums["groups"] or sums["groups"] < 2:
        return STRENGTH[1]
    prior = sums["s"] / sums["n"]
    between = sums["m2"] / sums["n"] - prior * prior - sums["within"] / sums["n"]
    if between <= 0:
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], prior * (1 - prior) / between - 1))


def site_posteriors(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """__host, __path, host_posterior, path_posterior; and the global prior. scored: __host, __path, __logit."""
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = scored.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    paths = common.materialise(paths, "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    prior = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    by_host, by_path = strength(hosts, "hn", "hs", "hq"), strength(paths, "n", "s", "q")
    own = (F.col("hs") + by_host * prior) / (F.col("hn") + by_host)
    joined = paths.join(hosts.withColumn("host_posterior", F.round(own, 9)).withColumnRenamed(host, "__h"), common.same(F.col(host), F.col("__h"))).drop("__h")
    below = (F.col("s") + by_path * F.col("host_posterior")) / (F.col("n") + by_path)
    return joined.select(host, path, "host_posterior", F.round(below, 9).alias("path_posterior")), prior


def with_posteriors(scored: DataFrame, sites: DataFrame, host: str, path: str, salt_by: str, most: int = BROADCAST_SITES) -> DataFrame:
    """scored joined with its sites' posteriors."""
    right = sites.withColumnsRenamed({host: "__h", path: "__p"})
    on = common.same(F.col(host), F.col("__h")) & common.same(F.col(path), F.col("__p"))
    if right.count() <= most:
        return scored.join(F.broadcast(right), on).drop("__h", "__p")
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = scored.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return left.join(right, on & (F.col("__salt") == F.col("__s"))).drop("__h", "__p", "__s", "__salt")


def log_odds(p):
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host and path posteriors, evidence, posterior and keep for every row."""
    slim = docs.select(F.col("doc_id"), F.col(host).alias("__host"), F.col(path).alias("__path"), F.col("text"))
    return judged(slim, docs, labels).select(
        "doc_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.round(1 / (1 + F.exp(-F.col("__logit"))), 6).alias("evidence"),
        "host_posterior", "path_posterior", F.round("__posterior", 6).alias("posterior"), "keep",
    )


def judged(slim: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, sampled = train(docs, labels)
    scored = common.materialise(evidence(slim, weights).drop("text"), "evidence")
    sites, _ = site_posteriors(scored, "__host", "__path")
    joined = with_posteriors(scored, sites, "__host", "__path", "doc_id")
    return posterior(joined, sampled)


def posterior(joined: DataFrame, sampled: float) -> DataFrame:
    p = 1 / (1 + F.exp(-(F.col("__logit") + log_odds(F.col("path_posterior")) - sampled)))
    return joined.withColumn("__posterior", p).withColumn("keep", F.col("__posterior") >= KEEP)


def kept_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs without the rows that the classifier rejects."""
    inner, at = common.numbered(docs)
    weights, sampled = train(docs, labels)
    # The texts are read twice and never shuffled: once for the sites' sums, once for the decision.
    scored = evidence(inner, weights, at["text"])
    sums = evidence(inner.select(at[host], at[path], at["text"]), weights, at["text"]).drop(at["text"])
    sites, _ = site_posteriors(sums, at[host], at[path])
    joined = with_posteriors(scored, sites, at[host], at[path], at["doc_id"])
    return common.renumbered(posterior(joined, sampled).where("keep"), docs)
