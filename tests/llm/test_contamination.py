import hashlib
import re

import pytest

from copse.llm import contamination as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"q{i}" for i in range(30))
DOCS = [
    (1, None), (2, ""), (3, "  \n,"), (4, f"Before. {LONG.upper()}! After"), (4, f"Before. {LONG.upper()}! After"), (5, "short ITEM here"), (None, "short-item"), (6, "shorts item"),
    (7, "Ähnlich ähnlich é É " + " ".join(f"q{i}" for i in range(5, 14))), (8, " ".join(f"q{i}" for i in range(5, 15)) + " x " + " ".join(f"q{i}" for i in range(12, 22))), (9, "w " * 60000 + "short item"),
    (10, " ".join(["a"] * 25)),
]
ITEMS = [(1, LONG), (2, None), (3, "!"), (10, "Short item."), (9, "short item"), (10, LONG), (None, " ".join(["a"] * 12)), (11, "É"), (12, "é q5")]


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, row int, items string")
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")


def test_against_all_windows(spark):
    d, q = frames(spark)
    assert sorted((tuple(r) for r in C.contamination(d, q).collect()), key=str) == brute(DOCS, ITEMS)
    assert C.contamination(d.limit(0), q).count() == 0
    assert {r["contaminated"] for r in C.contamination(d, q.limit(0)).collect()} == {False}


def test_several_automata(spark, monkeypatch):
    """Long items in pieces, pieces in many automata: the same rows, and the same places in the text."""
    d, q = frames(spark)
    whole = sorted(map(str, C.find_items(d, q).collect()))
    monkeypatch.setattr(C, "PIECE", 4)
    monkeypatch.setattr(C, "MOST_WORDS", 60)
    assert len(list(C.automata(q, C.SPAN))) > 2
    assert sorted((tuple(r) for r in C.contamination(d, q).collect()), key=str) == brute(DOCS, ITEMS)
    assert sorted(map(str, C.find_items(d, q).collect())) == whole


def test_places_in_the_original(spark):
    text = "Ärger, ÉÉ: One--TWO\tthree! é"
    d, q = frames(spark, [(1, text)], [(1, "one two three")])
    row = C.find_items(d, q).first()
    assert [text[a:b] for a, b in zip(row["starts"], row["ends"], strict=True)] == ["One--TWO\tthree"]


def test_clean_documents(spark):
    rows = [(1, "keep short, item keep", 21), (2, None, None), (3, "nothing", 7), (4, "Short item", 10), (5, "é short item é short item", 25)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    q = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in C.clean_documents(d, q).collect()}
    assert got == {1: ("keep   keep", 11), 2: (None, None), 3: ("nothing", 7), 4: (" ", 1), 5: ("é   é  ", 7)}


@pytest.mark.parametrize("bounds,want", [([(0, 3), (2, 5), (5, 6), (8, 9)], [(0, 6), (8, 9)]), ([(4, 9), (1, 2), (5, 6)], [(1, 2), (4, 9)]), ([], [])])
def test_merged(bounds, want):
    import numpy as np

    assert list(map(tuple, C.merged(np.array(bounds, np.int64).reshape(-1, 2)).tolist())) == want
