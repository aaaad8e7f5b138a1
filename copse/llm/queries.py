"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import contamination, fingerprint, lines, media, mixing, near_dup, packing, pii, quality, ranked, repeats, url_filter, whitening
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media(spark, sf_dir):
    return media.text_features(table(spark, sf_dir, "documents"))


def op4_repeats(spark, sf_dir):
    return repeats.removed(table(spark, sf_dir, "documents"))


def op5_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_urls(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_lines(spark, sf_dir):
    return lines.line_digests(table(spark, sf_dir, "documents"), long_docs=lines.LONG_DOCS)


def op8_imatch(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whiten(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_contamination(spark, sf_dir):
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked(spark, sf_dir):
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    own = (op1_mix, op2_quality, op3_media, op4_repeats, op5_near_dup, op6_urls, op7_lines, op8_imatch, op9_pii, op10_pack, op11_whiten, op12_contamination, op13_ranked)
    return {f.__name__: f for f in own}


def oracle_sql():
    return {"op1_mix": mixing.MIX_SQL, "op6_urls": url_filter.judge_sql(), "op8_imatch": fingerprint.fingerprint_sql(), "op12_contamination": contamination.CONTAMINATION_SQL, "op13_ranked": ranked.RANKED_SQL}
