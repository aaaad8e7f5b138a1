import hashlib

from copse.llm import lines, queries

PASSAGE = "Nothing in this passage of more than eight words was written twice by chance"
OTHER = "A second passage of many words stands in three documents that share nothing else"


def planted(spark):
    """Unrelated documents; 1 and 2 share PASSAGE, 3 to 5 share OTHER, 6 to 9 a short line, 10 and 11 a long line up to its numbers."""
    texts = [f"{PASSAGE}\nalpha", f"beta\n{PASSAGE}", f"gamma\n{OTHER}", f"{OTHER}\ndelta", f"{OTHER}\n\nepsilon", *(f"{w}\nRead more here" for w in ("zeta", "eta", "theta", "iota"))]
    texts += [f"The {n} rows of table {n} were read in {n} parts" for n in (7, 8)]
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_passages_of_two_and_three_documents(spark, tmp_path):
    docs = planted(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op7_lines(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.n_dropped} == {2, 4, 5}
    assert got[2].kept_sha256 == hashlib.sha256(b"beta").hexdigest() and got[5].kept_sha256 == hashlib.sha256(b"\nepsilon").hexdigest()
    left = {r.doc_id: r.text for r in lines.deduped_documents(docs, long_docs=2).collect()}
    assert left[1] == f"{PASSAGE}\nalpha" and left[3] == f"gamma\n{OTHER}" and left[2] == "beta" and left[4] == "delta"
    # A higher number for long lines holds for them alone.
    assert {r.doc_id for r in lines.line_digests(docs, long_docs=3).collect() if r.n_dropped} == {4, 5}


NAMES = ["Ana", "Bea", "Cem", "Dov", "Eli", "Fay", "Gus", "Hal", "Ida", "Jon", "Kim", "Leo", "Max", "Ned", "Oda", "Pia", "Quy", "Ros", "Sam", "Tim"]


def test_two_fields_head_fields_and_bylines(spark):
    two = [f"This long note was kindly sent to us by the user {n} from his own house in {m} today" for n, m in zip(NAMES[:6], NAMES[6:12], strict=True)]
    head = [f"Written by {n} for the readers of our weekly paper" for n in NAMES[:5]]
    byline = [f"Posted by {n}" for n in NAMES]
    few = [f"Painted by {n}" for n in NAMES[:19]]
    one = ["I like it"] * 25 + ["I like tea"]
    texts = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}\n{line}" for i, line in enumerate([*two, *head, *byline, *few, *one])]
    got = lines.line_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {r.doc_id for r in got if r.n_dropped}
    # The first of each stays; 19 short lines are too few, and what differs from one recurring line is no field.
    assert gone == {*range(1, 6), *range(7, 11), *range(12, 31), *range(51, 75)}


def test_wide_keys_against_plain_keys():
    texts = [f"{a} {b} c d e f {g} h i{' j' * k}".encode() for a in "xy" for b in "xy" for g in "xy" for k in range(3)] + [f"{a} {b} {c}".encode() for a in "xy" for b in "xy" for c in "xy"]
    seen = {}
    for text in texts:
        tokens = text.split()
        edges, sets, kind = lines.open_sets(len(tokens))
        keys = lines.wide_keys(tokens)
        for x, k in zip(sets, keys, strict=True):
            plain = (len(tokens), x, *[tuple(tokens[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if i not in x])
            assert seen.setdefault(plain, k) == k and k & lines.KINDS == kind
    assert len(set(seen.values())) == len(seen)
