"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from veilframe.llm import bpe_tree, collision_ann, decontam, exact_dedup, html_extract, near_dedup, prefix_trie, quality, sharding, token_store, url_filter, warc, whitening
from veilframe.llm.common import table


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_bpe_tree(spark, sf_dir):
    return bpe_tree.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_token_store(spark, sf_dir):
    return token_store.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_decontamination(spark, sf_dir):
    return decontam.report(decontam.find_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_collision_ann(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return collision_ann.search(rows, collision_ann.every(rows, 50))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_near_dedup,
        op3_url_filter,
        op4_warc,
        op5_bpe_tree,
        op6_token_store,
        op7_decontamination,
        op8_sharding,
        op9_exact_dedup,
        op10_html_extract,
        op11_prefix_trie,
        op12_collision_ann,
        op13_whitening,
    )
}

ORACLES = {"op3_url_filter": url_filter.ORACLE, "op4_warc": warc.ORACLE, "op8_sharding": sharding.ORACLE, "op7_decontamination": decontam.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE}
