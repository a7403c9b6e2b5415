import hashlib
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from test_dedup import brute
from test_text import words
from veilframe.llm import bpe_tree, quality
from veilframe.llm.common import utf8
from veilframe.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    net = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.score(net, *utf8(pa.array([d["text"] for d in docs], pa.string())))
    left = {d["doc_id"]: d["text"] or "" for d, s in zip(docs, scores, strict=True) if s >= 0.7}
    seen = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in seen.values()}
    classes = brute(list(left.items()))
    left = {i: t for i, t in left.items() if classes[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(0, len(w) - 9) or min(1, len(w)))}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = words(t)
        return any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))

    tokenizer = bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary("word_bpe_49k.json")))
    want = {i: hashlib.sha256(" ".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in left.items() if not hit(t)}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns


def tables(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = ["the", "weather", "of", "a", "day", "people", "said", "water", "under", "bridge", "went", "along", "river", "evening", "house", "field", "garden", "again"]
    good = [(i, " ".join(rng.choice(words, 60)) + ".", "en", "s", 1, True, 2.0) for i in range(60)]
    bad = [(100 + i, f"BUY!!! NOW$$$ {i} %%% ### " * 9, "en", "s", 1, False, None) for i in range(60)]
    odd = [(200, good[0][1], None, None, None, None, None), (201, None, "x", "y", 0, None, None), (None, good[1][1] + " later", "en", "s", 1, True, 0.0)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)]
    benchmark = [(1, good[5][1]), (2, None)]
    rows = {r.doc_id for r in corpus_pipeline.run(spark, tables(spark, tmp_path / "a", good + bad + odd, labels, benchmark)).collect()}
    assert rows <= {None, 201, *range(60)} and 200 not in rows and 5 not in rows and len(rows) > 40
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", [], labels, benchmark)).count() == 0
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "c", good, [], benchmark)).count() == 0
    clean = corpus_pipeline.run(spark, tables(spark, tmp_path / "d", good + bad, labels, [])).collect()
    assert {r.doc_id for r in clean} <= set(range(60)) and 5 in {r.doc_id for r in clean}
