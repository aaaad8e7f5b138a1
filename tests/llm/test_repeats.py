import hashlib
import random
from collections import Counter

import pytest

from copse.llm import repeats


def brute(rows, length=400):
    """Per row: (n_bytes, n_removed, n_spans, sha) by listing all windows."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = [prose(60), prose(75), prose(80), prose(120), prose(400)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(common)
            if rng.random() < 0.5:  # a near copy of the passage
                words = p.split()
                words[rng.randrange(len(words))] = "edit"
                p = " ".join(words)
            parts += [p, prose(rng.randrange(0, 60))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 500), (101, "abc " * 300), (102, rows[5][1]), (103, rows[6][1]), (104, rows[6][1] + "x"), (105, None), (106, ""), (107, "x" * 399), (108, "y" * 400), (109, "z" * 401), (110, "é" * 350)]
    rows += [(111, "q" * 400), (112, "q" * 400), (None, common[0] + common[1]), (None, common[0] + common[1]), (113, common[3][:-1]), (114, common[3][1:])]
    return rows


@pytest.mark.parametrize(("seed", "big"), [(1, repeats.BIG), (2, 3)])
def test_removed_against_brute_force(spark, seed, big):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, lo int, k string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(docs, big).collect())
    assert got == Counter((d, *b) for (d, _), b in zip(rows, brute(rows), strict=True))


def brute_shared(rows, words=51):
    """Whether a row's text has a window of so many words that another row's text has."""
    lists = [(t or "").split() for _, t in rows]
    holders = {}
    for i, w in enumerate(lists):
        for j in range(len(w) - words + 1):
            holders.setdefault(tuple(w[j : j + words]), set()).add(i)
    shared = {i for s in holders.values() if len(s) > 1 for i in s}
    return [i in shared for i in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 4])
def test_shared_passages_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    prose = lambda n: [rng.choice("the of and cat dog sun") + str(rng.randrange(300)) for _ in range(n)]
    for size in range(47, 60):  # passages just below and above the limit, twice in different surroundings
        p = prose(size)
        rows += [(1000 + 2 * size + i, "\n ".join([*prose(rng.randrange(40)), *p, *prose(rng.randrange(40))])) for i in range(2)]
    p = prose(60)
    rows.append((2000, " ".join([*p, "x", *p, *prose(30)])))  # repeats itself only
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, lo int, k string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_shared > 0) for r in repeats.removed(docs).collect())
    want = brute_shared(rows)
    assert got == Counter((d, len((t or "").encode()), s) for (d, t), s in zip(rows, want, strict=True))
    assert 20 < sum(want) < len(rows)


def test_segments_join(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcd") for _ in range(9000))
    whole = repeats.Anchors().places(data)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert repeats.Anchors().places(data) == whole
    assert all(any(i <= p <= i + repeats.REACH for p in whole) for i in range(0, 8600, 50))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removed(docs).count() == 0
    assert repeats.removed(spark.createDataFrame([(1, "short")], "doc_id long, text string")).first().n_removed == 0
