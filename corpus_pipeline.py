"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns what goes on; all but the last keep the columns of
documents. Between stages the rows are written and read again.
"""

from __future__ import annotations

from copse.llm import common, lines, mixing, near_dup, packing, quality
from copse.llm.queries import tokenizer_path


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject (operator 2)."""
    return quality.kept_documents(docs, common.table(spark, sf_dir, "labels"))


def drop_lines(spark, docs, sf_dir):
    """Documents without lines of recurring templates (operator 7)."""
    return lines.deduped_documents(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate class (operator 5)."""
    return near_dup.deduped_documents(docs)


def mix_sources(spark, docs, sf_dir):
    """Sources mixed to their weights, in whole and part epochs (operator 1)."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Token pieces placed in sequences (operator 10)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_to_weights", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the alignment and the tokenizer have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
