import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from veilframe.llm import common, exact_dedup, files, near_dedup, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 5, False) for i, t in rows], DOCS)


def test_exact_groups_nulls_ties_and_clashing_columns(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, None), (4, ""), (1, "a b"), (None, "a b"), (9, "x" * 200_000), (8, "z")]
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {(3, 1, 4), (1, 1, 4), (None, 1, 4), (2, 2, 2), (4, 2, 2), (9, 9, 1), (8, 8, 1)}
    kept = [r.doc_id for r in exact_dedup.exact_dedup(docs(spark, rows)).where("kept").collect()]
    assert sorted(kept) == [1, 2, 8, 9]
    left = exact_dedup.drop_copies(docs(spark, rows))
    assert left.columns == docs(spark, []).columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 8, 9]


def test_exact_hot_and_cold_agree(spark):
    rows = [(i, f"t {i % 7}" if i % 3 else "hot") for i in range(300)]
    runs = [sorted(map(tuple, exact_dedup.exact_dedup(docs(spark, rows), hot=k).collect())) for k in (1, 4096)]
    assert runs[0] == runs[1]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.classes(none).count() == 0
    assert sharding.assign(none).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_classes_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(8)]
    rows = []
    for k in range(160):
        words = list(base[k % 8])
        for p in rng.integers(0, 120, rng.integers(0, 5)):
            words[p] = str(rng.choice(vocabulary))
        rows.append((k + 1, " ".join(words)))
    rows += [(500, ""), (501, None), (502, "!!!"), (503, "!!!"), (504, "one two"), (505, "One, TWO")]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, rows)).collect()}
    assert got == brute(rows)
    monkeypatch.setattr(near_dedup.remainder, "__defaults__", (0, 16, 64))
    monkeypatch.setattr(near_dedup.tiled, "__defaults__", (16, 32))
    monkeypatch.setattr(common.few, "__defaults__", (0,))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, rows)).collect()} == got


def test_prefixes_of_similar_sets_meet(spark):
    """Texts of one long boilerplate, in one bucket of the star: links among them are found through rare shingles."""
    rng = np.random.default_rng(11)
    rows, boiler = [], [f"b{i}" for i in range(60)]
    for k in range(40):
        own = [f"o{k}x{i}" for i in range(20)]
        rows.append((3 * k, " ".join(boiler + own)))
        rows.append((3 * k + 1, " ".join(boiler + own[:19])))
        rows.append((3 * k + 2, " ".join([str(x) for x in rng.choice(boiler, 3)] + boiler + own)))
    sets = near_dedup.contents(docs(spark, rows), 5).selectExpr("id as node", "id as comp", "content").cache()
    content = sets.select(F.col("node").alias("id"), "content")
    for small in (64, 5):
        pairs, blocked = near_dedup.remainder(sets.select("node", "comp"), content, 0.8, small, 100, 1000)
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in near_dedup.verify(pairs, content, 0.8).unionByName(blocked).collect()}
        words = {i: t.split() for i, t in rows}
        shingled = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
        want = {(a, b) for a in shingled for b in shingled if a < b and len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])}
        if small == 64:
            assert got == want and pairs.count() < 10 * len(want)
        else:
            assert got <= want and {x for p in got for x in p} == {x for p in want for x in p}


def test_recall_by_similarity(spark):
    """All pairs of different texts of sf0.01, by brute force, against the classes."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    sets, lists = {}, {}
    for i, t in texts.items():
        w = WORD.findall(t.lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        for x in sets[i]:
            lists.setdefault(x, []).append(i)
    both = {}
    for ids in lists.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                both[a, b] = both.get((a, b), 0) + 1
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items()}
    close = [p for p, s in alike.items() if s >= 0.8]
    assert len(close) > 30 and all(got[a] == got[b] for a, b in close)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in close:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in texts}


def test_near_rows_of_one_id_and_very_long_texts(spark):
    base = [" ".join(f"t{k}w{i}" for i in range(50)) for k in range(4)]
    long_ = " ".join(f"z{i}" for i in range(150_000))
    rows = [(5, base[0]), (5, base[1]), (3, base[1]), (9, base[0]), (7, base[2]), (7, base[2]), (20, long_), (21, long_ + " end"), (None, base[3]), (8, base[3]), (30, None), (31, "")]
    got = sorted((r.doc_id or -1, r.class_id, r.kept) for r in near_dedup.classes(docs(spark, rows)).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (8, 8, True), (9, 3, False), (20, 20, True), (21, 20, False), (30, 30, True), (31, 31, True)]


def test_near_keeps_one_and_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text), (1, text + " more"), (7, "other words stand in this text"), (None, text)]
    left = near_dedup.keep_one(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 7]


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    marks = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    a, b = marks[:300], marks[100:]
    m = 2048
    row = np.repeat([0, 1], 300)
    s = near_dedup.prob_minhash(row, np.concatenate([a, b]), np.ones(600), 2, m)
    assert abs((s[0] == s[1]).mean() - 200 / 400) < 0.05
    heavy = np.ones(600)
    heavy[:100] = 8.0  # weight on what only the first holds
    t = near_dedup.prob_minhash(row, np.concatenate([a, b]), heavy, 2, m)
    assert (t[0] == t[1]).mean() < (s[0] == s[1]).mean() - 0.1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("limit", [1, 40, 500, 10**6])
def test_shards_fit_and_only_oversized_split(spark, limit):
    rows = [(i, "x" * (i % 23)) for i in range(200)] + [(5, "same text")] * 60 + [(None, None), (7, "y" * 600)]
    got = sharding.assign(docs(spark, rows), limit).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for bits, members in shards.items():
        size = sum(r.n_bytes for r in members)
        assert {(r.shard_bytes, r.shard_rows, r.depth) for r in members} == {(size, len(members), len(bits))}
        assert size <= limit or len(members) == 1
        assert not any(o != bits and o.startswith(bits) for o in shards)
        if bits:  # the parent was too large
            parent = sum(r.n_bytes for o, rs in shards.items() if o.startswith(bits[:-1]) for r in rs)
            assert parent > limit


@pytest.mark.parametrize("form", ["scan", "robin", "hash", "sorted", "filtered"])
def test_written_shards_hold_every_row(spark, tmp_path, form):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("shard", F.lit("own"))
    made = {"scan": source, "robin": source.repartition(6), "hash": source.repartition(5, "lang"), "sorted": source.orderBy("n_chars"), "filtered": source.repartition(3).where("length(text) > 500")}[form]
    listed = sharding.write_shards(made, str(tmp_path / "out"), 60_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(source.columns).collect())) == sorted(map(tuple, made.collect()))
    sizes = {r.s: r.b for r in back.groupBy(F.col("_shard").cast("string").alias("s")).agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    shards = {r.shard: r for r in listed.collect()}
    assert len(shards) > 4 and sum(sizes.values()) == sum(r.shard_bytes for r in shards.values()) and sorted(sizes.values()) == sorted(r.shard_bytes for r in shards.values())
    assert all(r.shard_bytes <= 60_000 or r.shard_rows == 1 for r in shards.values())


def test_a_directory_places_rows_again_and_new_ones(spark):
    rows = [(i, f"text {i} " + "x" * (i % 300)) for i in range(500)] + [(None, None)]
    d = docs(spark, rows)
    shards = sharding.directory(d, 3000)
    want = {(r.doc_id, r.shard) for r in sharding.assign(d, 3000).collect()}
    assert {(r.doc_id, r.shard) for r in sharding.lookup(d, shards).collect()} == want
    new = sharding.lookup(docs(spark, [(9999, "later")]), shards).collect()
    assert len(new) == 1 and new[0].shard in {s for _, s in want}
    assert sharding.directory(docs(spark, []), 10).count() == 0 and sharding.lookup(d, sharding.directory(docs(spark, []), 10)).where("shard is null").count() == len(rows)


def test_joins_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(300)] + [(900, None), (901, "none")], "i int, k string")
    facts = common.cut(rows.where("k is not null and k != 'none'").groupBy("k").count())
    for how in ("inner", "left"):
        runs = []
        for most in (500_000, 0):
            monkeypatch.setattr(common.few, "__defaults__", (most,))
            runs.append(sorted(map(str, common.looked_up(rows, facts, "k", how=how).select("i", "k", "count").collect())))
        assert runs[0] == runs[1] and len(runs[0]) == (300 if how == "inner" else 302)


def test_folders_have_a_file_system(spark):
    hadoop = spark._jsc.hadoopConfiguration()
    old = hadoop.get("fs.defaultFS")
    try:
        hadoop.set("fs.defaultFS", "hdfs://localhost:1")
        assert common.qualified(spark, "/user/checkpoints/") == "hdfs://localhost:1/user/checkpoints"
        assert common.qualified(spark, "file:/tmp/x") == "file:/tmp/x"
    finally:
        hadoop.set("fs.defaultFS", old)
    assert files.locate("file:/tmp/x")[1] == files.locate("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError):
        files.locate("/user/checkpoints")


def test_forgotten_checkpoints_are_gone(spark):
    kept, lost = common.cut(spark.range(5)), common.cut(spark.range(7))
    common.forget(lost)
    assert kept.count() == 5
    with pytest.raises(Exception):
        lost.count()


def test_near_copies_that_differ_by_a_repeated_line(spark):
    rows = []
    for k in range(12):
        text = " ".join(f"t{k}w{i}" for i in range(49))
        line = " ".join(f"l{k}w{i}" for i in range(4))
        rows += [(2 * k + 1, text), (2 * k + 2, f"{text} " + " ".join([line] * 470))]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, rows)).collect()}
    assert got == brute(rows) and all(got[2 * k + 2] == 2 * k + 1 for k in range(12))


def test_near_reads_and_keeps_only_what_is_open(spark, monkeypatch):
    """Texts that the star has settled aren't shuffled by the second verification, and the bands' and contents' files are gone."""
    boiler = [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(boiler + [f"o{k}x{i}" for i in range(20)])) for k in range(40)]
    rows += [(100 + 2 * k + j, " ".join([f"s{k}x{i}" for i in range(100 - j)])) for k in range(30) for j in (0, 1)]
    read, gone, verify, forget = [], [], near_dedup.verify, near_dedup.forget
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, content, threshold: read.append(content.count()) or verify(pairs, content, threshold))
    monkeypatch.setattr(near_dedup, "forget", lambda *frames: gone.extend(set(f.columns) for f in frames) or forget(*frames))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, rows)).collect()}
    assert got == brute(rows)
    assert len(read) == 2 and read[0] >= 60 + read[1] > 60
    assert any("bands" in x for x in gone) and {"id", "content"} in gone
