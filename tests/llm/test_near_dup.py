import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copse.llm import near_dup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def near(a, b):
    x, y = a.split(), b.split()
    if x == y:
        return bool(x)
    return min(len(x), len(y)) >= 5 and lcs(x, y) >= 0.8 * max(len(x), len(y)) - 1e-9


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from(["", "x", "a b", "c"])), max_size=9), st.sampled_from([4, 1 << 13]))
def test_alignment(words, edits, span):
    other = list(words)
    for at, new in edits:
        if at < len(other):
            other[at] = new
    a, b = (near_dup.Text(" ".join(x).encode()) for x in (words, other))
    a.SPAN = span
    assert a.near_to(b) == near(" ".join(words), " ".join(other))


def test_shared_items_are_those_of_sets(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-900, 900, rng.integers(0, 300))) for _ in range(23)]
    want = [[len(np.intersect1d(x, y)) for y in sets[9:]] for x in sets[:9]]
    assert (near_dup.shared(sets[:9], sets[9:]) == want).all()
    monkeypatch.setattr(near_dup, "ITEMS", 500)
    monkeypatch.setattr(near_dup, "COLUMNS", 7)
    assert (near_dup.shared(sets[:9], sets[9:]) == want).all()
    assert (near_dup.shared(sets[:2], [np.zeros(0, np.int64)]) == 0).all()


def test_labels_are_the_labelled_words():
    a, b = near_dup.Text(b"a b a c\ta\x0bd"), near_dup.Text(b"a a x b\r\na a d")
    assert len(set(a.labels.tolist())) == len(a.labelled) == 6
    assert near_dup.shared([a.labels], [b.labels])[0, 0] == len(a.labelled & b.labelled) == 5


def test_hashes_follow_words():
    h = near_dup.Hasher()
    one = h.words(b"the cat\n sat  on\tthe mat")[1]
    assert one[0] == one[4] and len(set(one.tolist())) == 5
    assert (h.words(b"  cat sat")[1] == one[1:3]).all()
    long = b" ".join(b"w%d" % (i % 977) for i in range(400_000))
    parts = np.concatenate([h.words(c)[1] for c in near_dup.chunks(long)])
    assert len(parts) == 400_000 and (parts[:977] == parts[977:1954]).all()
    assert [len(h.words(c)[1]) for c in near_dup.chunks(b"x" * 3_000_000 + b" y")] == [1, 1]


def edited(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 12])):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.4]) if len(base) > 8 else 0, vocabulary)))
    texts += ["", None, "  ", "one two", "one two", "one  two", "again " * 400, "again " * 390, "x"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "en", i) for i, t in enumerate(texts)]


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    texts = [(r[1] or "").encode() for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or near(texts[i].decode(), texts[j].decode()):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {r[0]: rows[root(i)][0] for i, r in enumerate(rows)}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, class_id int")
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == want
    if seed == 1:
        kept = near_dup.deduped_documents(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def shared_passage(seed):
    """Unrelated documents, pairs of edited copies among them, that all hold one long passage, so that they fill common buckets."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(25):
        own = [rng.choice(vocabulary) for _ in range(100)]
        texts += [" ".join(passage + edited(rng, own, 0.05 * i, vocabulary)) for i in range(rng.choice([1, 2]))]
    return [(i, t, "en", i) for i, t in enumerate(texts)]


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    rows = shared_passage(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, class_id int")
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows) and 25 <= len(set(got.values())) < len(rows)


def test_large_buckets_cost_no_more_than_their_blocks(spark, monkeypatch):
    """Unrelated texts of one passage: dealt by rare words or in blocks, whichever makes fewer rows, with the same classes; few texts are sent."""
    rng = random.Random(4)
    passage, vocabulary = [f"p{i}" for i in range(200)], [f"w{i}" for i in range(1000)]
    rows = []
    for i in range(40):
        own = [rng.choice(vocabulary) for _ in range(100)]
        rows += [(2 * i + j, " ".join(passage + edited(rng, own, 0.3 * j, vocabulary)), "en", i) for j in range(1 + (i < 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, class_id int")
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    blockwise, written, made, want = near_dup.blockwise, near_dup.common.materialise, [], brute_classes(rows)

    def counted(groups, *rest):
        made.append(groups.count())
        return blockwise(groups, *rest)

    def sent(df, name):
        out = written(df, name)
        if name == "meeting":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "blockwise", counted)
    monkeypatch.setattr(near_dup.common, "materialise", sent)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == want
    dealt, texts_sent = made[2:]
    assert dealt <= near_dup.block_rows(len(rows), 1) and texts_sent <= dealt // 4
    made.clear()
    monkeypatch.setattr(near_dup, "block_rows", lambda n, main: 1 << 40)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == want
    assert made[2] > 3 * dealt and made[3] <= made[2] // 4


@pytest.mark.parametrize("seed", range(6))
def test_no_near_pair_is_dropped_by_keys(spark, seed):
    """Pairs at the edge of nearness, of equal and different sizes, with words that repeat, meet exactly once if dealt by words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([12, 60, 900]))]
    texts = []
    for n in [1, 2, 5, 6, 19, 20, 21, 40, 61, 100, 150]:
        base = [rng.choice(vocabulary) for _ in range(n)]
        texts += [base, base[: math.ceil(0.8 * n - 1e-9)], base[n - math.ceil(0.8 * n - 1e-9) :], base + [rng.choice(vocabulary) for _ in range(n // 4)]]
        texts += [edited(rng, base, share, vocabulary) for share in (0.05, 0.15, 0.2, 0.25)]
    texts = sorted({" ".join(t).encode() for t in texts})
    rows = spark.createDataFrame([(t, t, t) for t in texts], "th binary, label binary, text binary").withColumn("text", F.col("text").cast("string"))
    held = near_dup.rare_words(rows.select("th", "label"), rows.select("th", "text")).collect()
    listed = [(bytes(r.th), np.array(r["keys"]), r.size, r.deal) for r in held]
    want = {(a, b) for a in texts for b in texts if a < b and near(a.decode(), b.decode())}
    whole = [(near_dup.ALL, 0, 0, 0, th, th, keys, 0, size) for th, keys, size, _ in listed]
    met = [tuple(sorted((g[i][5], g[j][5]))) for g, _, meet in [near_dup.sides(whole)] for i, j in np.argwhere(meet)]
    assert want and want <= set(met) and len(set(met)) == len(met)
    by_word = Counter()
    for key in {k for _, keys, _, deal in listed for k in keys[:deal].tolist()}:
        group = [(key, 0, 0, 0, th, th, keys, keys.tolist().index(key), size) for th, keys, size, deal in listed if key in keys[:deal]]
        left, _, meet = near_dup.sides(group)
        by_word.update(tuple(sorted((left[i][5], left[j][5]))) for i, j in np.argwhere(meet))
    assert want <= set(by_word) and set(by_word[x] for x in want) == {1}


def test_blocks_meet_all_pairs_of_different_labels_once(spark, monkeypatch):
    """Each pair of different labels lies in one group of two blocks, and a bucket of one large component does not cost its square."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    sizes = {1: {0: 400, 1: 3, 2: 1}, 2: {0: 20, 1: 19, 2: 18}, 3: {0: 4, 1: 2}, 4: {0: 8, 1: 1}}
    rows = [(key, f"{key}-{label}-{i}".encode(), bytes([label]), sum(own.values())) for key, own in sizes.items() for label, n in own.items() for i in range(n)]
    got = near_dup.paired_blocks(spark.createDataFrame(rows, "key long, th binary, label binary, n int")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.key, r.p, r.q), []).append(r)
    met = Counter()
    for (key, p, q), own in groups.items():
        left, right = [r for r in own if r.blk == p], [r for r in own if r.blk == q]
        assert p == q or len(left) + len(right) == len(own)
        met.update((key, *sorted((bytes(a.th), bytes(b.th)))) for i, a in enumerate(left) for b in (left[:i] if p == q else right) if a.label != b.label)
    want = {(r[0], *sorted((r[1], s[1]))) for i, r in enumerate(rows) for s in rows[:i] if r[0] == s[0] and r[2] != s[2]}
    assert set(met) == want and set(met.values()) == {1}
    assert sum(r.key == 1 for r in got) <= 400 + 4 * 51
    assert near_dup.paired_blocks(spark.createDataFrame([], "key long, th binary, label binary, n int")).count() == 0


def test_edited_copies_are_found(spark):
    """Copies that share about half of their shingles: nearly all are found, and nothing else is joined."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(100):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        rows += [(2 * g, " ".join(base), g), (2 * g + 1, " ".join(edited(rng, base, rng.uniform(0.02, 0.1), vocabulary)), g)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, g int")).collect()}
    assert all(c in (d, d - 1) for d, c in got.items()) and all(got[d] == d for d in range(0, 200, 2))
    assert sum(got[d] == d - 1 for d in range(1, 200, 2)) >= 90


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (1, None, 4), (2, "", 5), (None, "lone text of its own here", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    assert Counter(map(tuple, near_dup.near_duplicates(docs).collect())) == Counter([(None, 1), (1, 1), (1, 1), (1, 1), (2, 1), (None, None)])
    assert Counter((r.doc_id, r.text) for r in near_dup.deduped_documents(docs).collect()) == Counter([(1, "a b c d e f"), (1, None), (None, "lone text of its own here")])
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dup.deduped_documents(docs.limit(0)).count() == 0
    assert near_dup.near_duplicates(docs.limit(1)).count() == 1
