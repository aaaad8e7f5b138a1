import math
import re
from collections import Counter

import numpy as np
import pytest

from copse.llm import ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall(ranked.WORD, text or "")]


def brute(docs, items, top=10):
    """docs, items: (id, text). A list of (item_id, rank, doc_id, score)."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * len(held) // total
            score = 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, item string, score double").repartition(parts)
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, df int")


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    weights = 1 / np.arange(1, 301)
    return [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum()))) for i in range(n)]


@pytest.mark.parametrize("postings,docs_held,block", [(2_000_000, 65_536, 128), (700, 65_536, 4), (10**9, 50, 7)])
def test_against_all_scores(spark, postings, docs_held, block):
    """Shards and blocks of several sizes give the scores of all documents."""
    docs = corpus(400, 5)
    items = [(i, t) for i, t in corpus(12, 8)]
    d, q = frames(spark, docs, items)
    index = ranked.build_index(d, block, postings, docs_held)
    assert (index.rows.where("term IS NULL").count() > 3) == (postings == 700 or docs_held == 50)
    got = [tuple(r) for r in ranked.search(index, q).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, "One two, THREE"), (2, None), (3, ""), (4, " .,- "), (None, "one two three"), (5, "one two three"), (5, "one two three"), (7, "Émile é É one"), (8, "one " * 50000 + "zwölf"), (9, "émile")]
    items = [(1, "one three"), (2, None), (3, ""), (1, "one three"), (None, "zwölf Émile"), (4, "absent"), (5, "two two two one")]
    d, q = frames(spark, docs, items)
    got = sorted((tuple(r) for r in ranked.ranked(d, q).collect()), key=str)
    assert got == brute(docs, items)
    assert ranked.ranked(d.limit(0), q).count() == ranked.ranked(d, q.limit(0)).count() == 0


def test_terms_are_counted_as_they_are_indexed(spark, monkeypatch):
    """N and L come from the index's own splitting, without a pattern over all texts, which took most of the query's time."""
    docs = [(1, "One two, THREE"), (2, None), (3, ""), (4, " .,- "), (None, "one two"), (5, "Émile\u2003é 1a_b\x00c\x7fd"), (6, "x " * 70000)]
    d, _ = frames(spark, docs, [(1, "one")], 2)
    monkeypatch.setattr(ranked.F, "regexp_count", None)
    index = ranked.build_index(d)
    held = [terms(t) for _, t in docs if terms(t)]
    assert (index.docs, index.total) == (len(held), sum(map(len, held)))
    empty = ranked.build_index(d.limit(0))
    assert (empty.docs, empty.total, empty.rows.count()) == (0, 0, 0)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "MOST_TERMS", 40)
    docs, items = corpus(100, 1), corpus(9, 2)
    d, q = frames(spark, docs, items)
    assert sorted((tuple(r) for r in ranked.ranked(d, q).collect()), key=str) == brute(docs, items)


def test_blocks_come_back():
    """Gaps and counts of one, two and four bytes survive; so do block bounds."""
    docs = np.array([0, 1, 300, 70_300, 70_301, 5, 6])
    ids = np.array([0, 0, 0, 0, 0, 1, 1])
    tf = np.array([1, 255, 256, 1, 70_000, 2, 3])
    df, first, firsts, lasts, maxima, place, out = ranked.encode(ids, docs, tf, tf * 10, 2, 3)
    assert df.tolist() == [5, 2] and first.tolist() == [0, 2, 3]
    assert firsts.tolist() == [0, 70_300, 5] and lasts.tolist() == [300, 70_301, 6] and maxima.tolist() == [2560, 700_000, 30]
    got = [ranked.decode(out[place[i] : place[i + 1]], int(firsts[i])) for i in range(3)]
    assert np.concatenate([g[0] for g in got]).tolist() == docs.tolist()
    assert np.concatenate([g[1] for g in got]).tolist() == tf.tolist()


def test_blocks_are_skipped():
    """One document of high scores at the front leaves most blocks compressed."""
    shard = ranked.Shard()
    shard.add(0, b"rare rare rare common")
    for i in range(1, 3000):
        shard.add(i, b"common " + b"other " * (i % 7))
    n, total = len(shard.n), sum(shard.n)
    lists = ranked.Lists()
    for name, term, _, *rest in zip(*(c.to_pylist() for c in shard.rows("0", n, total).columns), strict=True):
        if term is None:
            lists.documents(rest[1], rest[2], rest[3], n, total)
        else:
            lists.add(term, *rest)
    held = ranked.best_documents(lists, [(b"common", 1), (b"rare", 7000)], 1, [])
    assert held[0][1] == (True, 0)
    assert lists.blocks_read < 12
