import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import fingerprint, lines, quality

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def odd_rows(spark, more=()):
    rows = [
        (1, "Copyright 2019 by A\nsome text here", "en", "s1", 34, 1.0), (2, None, None, None, None, None), (3, "", "en", "s1", 0, 0.0), (None, "Copyright 2020 by A", "de", None, 19, 0.0),
        (5, "Copyright 2021 by A\n\n \nCopyright 2022 by A", "en", "s2", 43, 0.0), (6, "Copyright 7 by A", "en", "s2", 16, 0.0), (6, "Copyright 7 by A", "en", "s2", 16, 0.0), (8, "w " * 30000, "en", "s3", 60000, 0.0), *more,
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key double")


def plain_keys(line):
    """The templates of a line as plain text."""
    tokens = ["<*>" if any(c in "0123456789@" for c in t) or "://" in t else t for t in line.split()]
    if len(tokens) < 8:
        return [("whole", *tokens)] if tokens else []
    rest = len(tokens) - 3
    edges = [3 + rest * j // 4 for j in range(5)]
    return [(j, len(tokens), *tokens[: edges[j]], "|", *tokens[edges[j + 1] :]) for j in range(4)]


def brute_drops(rows, min_docs):
    """rows: (doc_id, text). The set of (row, line) that go."""
    holders, hashed, places = defaultdict(set), {}, {}
    for i, (_, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            for k, h in zip(plain_keys(line), lines.template_keys(line.encode()), strict=True):
                assert hashed.setdefault(k, h) == h
                holders[k].add(i)
                places.setdefault((i, n), []).append(k)
    assert len(set(hashed.values())) == len(hashed)
    first, gone = set(), set()
    for at, keys in sorted(places.items()):
        docs, _, k = max((len(holders[k]), hashed[k], k) for k in keys)
        if docs >= min_docs:
            (gone if k in first else first).add(at if k in first else k)
    return gone


def test_lines_against_brute_force(spark, corpus):
    more = [(10_000 + i, f"Unique {chr(97 + i)} line\nThe server at port {i} sent the same long answer again to user number {chr(97 + i)}") for i in range(9)]
    docs = corpus[0].select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    gone = brute_drops(rows, 5)
    assert len(gone) >= 8
    got = {r.doc_id: r for r in lines.line_digests(docs, 5).collect()}
    for i, (doc, text) in enumerate(rows):
        left = "\n".join(line for n, line in enumerate((text or "").split("\n")) if (i, n) not in gone)
        assert got[doc].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()
        assert got[doc].n_dropped == sum(k == i for k, _ in gone)
    assert [got[10_000 + i].n_dropped for i in range(9)] == [0] + [1] * 8
    assert sorted(map(tuple, lines.line_digests(docs.repartition(7), 5).collect())) == sorted(map(tuple, got.values()))


def test_lines_odd_rows(spark):
    docs = odd_rows(spark)
    got = lines.deduped_documents(docs, 3)
    assert got.columns == docs.columns
    texts = sorted((r.doc_id or 0, r.text) for r in got.collect() if r.doc_id != 2)
    # The first holder by doc_id (null last) keeps its line.
    assert texts == [(0, ""), (1, "Copyright 2019 by A\nsome text here"), (3, ""), (5, "\n "), (6, ""), (6, ""), (8, "w " * 30000)]
    assert [r.text for r in got.where("doc_id = 2").collect()] == [None]
    assert got.where("doc_id = 5").first().n_chars == 2
    assert lines.deduped_documents(docs.limit(0)).count() == 0
    digest = {r.doc_id: r for r in lines.line_digests(docs, 3).collect()}
    assert digest[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and digest[5].n_lines == 2 and digest[5].n_dropped == 2


def test_quality(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    known = labels.collect()
    assert np.mean([got[r.doc_id].keep == bool(r.quality) for r in known]) > 0.97
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.keep}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    got = quality.classify(docs, labels.where(half == 0)).join(labels.where(half == 1).select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in got]) > 0.98
    assert np.mean([r.keep for r in got if r.quality]) > 0.99


def brute_posteriors(rows, weights, sampled):
    """rows: (doc_id, host, path, text). Posterior by doc_id, by plain sums."""
    own = {d: min(12, max(-12, float(np.dot(quality.statistics((t or "").encode()), weights[:-1]) + weights[-1]))) for d, _, _, t in rows}
    p = {d: 1 / (1 + np.exp(-round(x, 6))) for d, x in own.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for d, h, q, _ in rows:
        hosts[h].append(p[d])
        paths[h, q].append(p[d])

    def strength(groups):
        groups = [np.array(g) for g in groups if len(g) > 1]
        if len(groups) < 2:
            return 10_000.0
        n = sum(map(len, groups))
        prior = sum(g.sum() for g in groups) / n
        between = sum(len(g) * g.mean() ** 2 for g in groups) / n - prior**2 - sum(len(g) * g.var(ddof=1) / len(g) for g in groups) / n
        return 10_000.0 if between <= 0 else min(10_000.0, max(10.0, prior * (1 - prior) / between - 1))

    prior = (sum(p.values()) + 1) / (len(p) + 2)
    by_host, by_path = strength(hosts.values()), strength(paths.values())
    host = {h: (sum(g) + by_host * prior) / (len(g) + by_host) for h, g in hosts.items()}
    path = {k: (sum(g) + by_path * host[k[0]]) / (len(g) + by_path) for k, g in paths.items()}
    return {d: 1 / (1 + np.exp(-(own[d] + np.log(path[h, q] / (1 - path[h, q])) - sampled))) for d, h, q, _ in rows}


def test_quality_against_plain_sums(spark, corpus):
    docs, labels = corpus
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "junk site").otherwise(F.col("source"))).withColumn("text", F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 12 > 0), F.lit("$$ # 11 WIN win win")).otherwise(F.col("text")))
    weights, sampled = quality.train(docs, labels)
    want = brute_posteriors([(r.doc_id, r.source, r.lang, r.text) for r in docs.collect()], weights, sampled)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d].posterior - p) < 2e-6 and got[d].keep == (p >= 0.5) for d, p in want.items() if abs(p - 0.5) > 1e-5)
    # The site counts: the same text is worth less on the bad one.
    alike = docs.where("doc_id % 12 = 1").limit(1).select("doc_id", "lang", "text", F.col("n_chars"), F.lit("junk site").alias("source"))
    moved = quality.classify(docs.unionByName(alike.withColumn("doc_id", F.lit(-1).cast("bigint"))), labels).where("doc_id = -1").first()
    assert moved.posterior < got[alike.first().doc_id].posterior


def test_clashing_columns(spark):
    docs = odd_rows(spark).withColumn("__host", F.lit("h")).withColumn("__path", F.lit(1)).withColumn("__logit", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 8
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and all(r["__logit"] == "x" for r in kept.collect())


def test_quality_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (6, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 8  # labels of one kind only: nothing is rejected
    assert quality.kept_documents(docs, labels).count() == 8
    assert quality.kept_documents(docs.limit(0), labels.limit(0)).count() == 0
    both = labels.union(spark.createDataFrame([(8, 0, 0)], labels.schema))
    assert quality.classify(docs, both).count() == 8


def test_site_posteriors_shrink(spark):
    rows = [("big", "p", 3.0)] * 50 + [("bad", "p", -3.0)] * 50 + [("one", "p", -3.0), (None, None, 3.0)]
    scored = spark.createDataFrame(rows, "h string, p string, __logit double")
    sites, prior = quality.site_posteriors(scored, "h", "p")
    got = {r.h: r for r in sites.collect()}
    assert got["bad"].host_posterior < got["one"].host_posterior < prior + 0.2 < got["big"].host_posterior + 0.2
    small = quality.with_posteriors(scored.withColumn("k", F.lit(1)), sites, "h", "p", "k")
    salted = quality.with_posteriors(scored.withColumn("k", F.monotonically_increasing_id()), sites, "h", "p", "k", most=0)
    assert sorted(map(str, salted.drop("k").collect())) == sorted(map(str, small.drop("k").collect()))


def test_fingerprints_odd_rows(spark):
    more = [(20 + i, f"alpha beta{i % 3} gamma{i % 5} delta{i % 7}", "en", "s", 1, 0.0) for i in range(40)]
    docs = odd_rows(spark, more)
    got = fingerprint.fingerprints(docs, ranges=5).collect()
    assert len(got) == docs.count()
    one = {r.doc_id: r for r in got}
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        if r.doc_id in (6,):
            continue
        text, k = r.text or "", len(r.text or "") // 4
        edited = text[: len(text) - k] + (after.text or "")[:k]
        assert one[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert one[r.doc_id].n_chars == len(text)
        assert 0 <= one[r.doc_id].near_edited <= 1 and 0 <= one[r.doc_id].near_next <= 1
    prints = defaultdict(set)
    for r in got:
        prints[next(x.text or "" for x in rows if x.doc_id == r.doc_id)].add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert one[2].near_edited == 1.0 and one[2].fingerprint == one[3].fingerprint
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(docs.limit(1)).count() == 1


def test_range_of(spark):
    df = spark.range(100).select("id", fingerprint.range_of(F.col("id"), [10, 20, 21, 50, 51, 80]).alias("r"))
    assert all(r.r == sum(b <= r.id for b in [10, 20, 21, 50, 51, 80]) for r in df.collect())
