"""The pipeline, stage by stage, against plain Python on a small corpus."""

import re
from collections import Counter

import corpus_pipeline
from copse.llm import mixing, near_dup, quality
from copse.llm.queries import tokenizer_path

from .test_filters import brute_drops
from .test_simple import brute_best_fit, brute_targets

SMALL = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_near(rows):
    """rows: (doc_id, text) in order of doc_id. The doc_ids that stay."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    texts = [near_dup.Text((t or "").encode()) for _, t in rows]
    for i, one in enumerate(texts):
        for j in range(i):
            if rows[i][1] == rows[j][1] or one.near_to(texts[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SMALL).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mix_to_weights", "best_fit_packing"]
    assert all(f.columns == docs.columns for f in frames[:-1])
    given, kept, lined, apart, mixed, packed = (f.collect() for f in frames)

    judged = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given if judged[r.doc_id]}

    rows = sorted((r.doc_id, r.text) for r in kept)
    gone = brute_drops(rows, 5)
    left = {doc: "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone) for i, (doc, text) in enumerate(rows)}
    assert {r.doc_id: r.text for r in lined} == left and all(r.n_chars == len(r.text) for r in lined)

    assert {r.doc_id for r in apart} == brute_near(sorted((r.doc_id, r.text) for r in lined))

    names = sorted({r.source for r in apart})
    sizes = [sum(words(r.text) for r in apart if r.source == s) for s in names]
    targets = brute_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for i, s in enumerate(names):
        assert abs(sum(words(r.text) for r in mixed if r.source == s) - targets[i]) < 1 + 1e-6

    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    assert len({r.sequence_id for r in packed}) == len(brute_best_fit([r.length for r in packed], 2048))
