import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from veilframe.llm import bpe_tree, decontam, quality, token_store
from veilframe.llm.common import fresh_folder, utf8
from veilframe.llm.queries import vocabulary

DOCS = "doc_id long, text string, ids string, n_tokens long, score string"
ODD = [None, "", " ", "a  b", "a\n b", "x <|endoftext|> y", "é́ ́a", "don't it's", "ab " * 3000 + "q" * 4000, "日本語のテキスト" * 300, "\n" * 90, " lead", "trail "]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("leaf", [37, 400])
def test_tree_equals_the_library(name, leaf):
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary(name)))
    rng = np.random.default_rng(leaf)
    mixed = ["".join(rng.choice(["a", "B", " ", "\n", "é", "'", "s", "9", "!", "<|endoftext|>", "日"], 700)) for _ in range(40)]
    for text in [x or "" for x in ODD] + mixed:
        assert bpe_tree.encode_tree(t, text, leaf, 8, 4).tolist() == t.encode(text, add_special_tokens=False).ids


def test_documents_go_through_the_tree(monkeypatch):
    """With the query's parameters, every document of more than a few KiB is halved and joined."""
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary("word_bpe_49k.json")))
    joins, join = [], bpe_tree.joined
    monkeypatch.setattr(bpe_tree, "joined", lambda *a: (joins.append(r := join(*a)), r)[1])
    texts = [r or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    got = bpe_tree.encode(t, texts)
    assert all(ids.tolist() == e.ids for ids, e in zip(got, t.encode_batch(texts, add_special_tokens=False), strict=True))
    leaves = sum(len(bpe_tree.halves(0, len(x), 1 << 11)) for x in texts)
    assert sum(len(x) > 1 << 11 for x in texts) > 300 and sum(r is not None for r in joins) == leaves - len(texts) and len(joins) < 1.2 * (leaves - len(texts))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_without_white_space(name):
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary(name)))
    rng = np.random.default_rng(8)
    for text in ("日本語のテキスト" * 9000, "".join(rng.choice(list("abcdefgé"), 60_000)), "a" * 30_000, "Ab1-" * 20_000, "\u0301" * 5000 + "e\u0301" * 9000):
        assert bpe_tree.encode(t, [text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_places_of_remembered_words():
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary("word_bpe_49k.json")))
    texts = ["Don't  stop-me\tnow,é́t日本 x", "", "  ", "a", "日本 日本\u00a0語\x1cz", "İstanbul ΑΣ <|endoftext|> x"]
    for text, (ids, begin) in zip(texts, bpe_tree.memo(t, placed=True).encode_placed(texts), strict=True):
        e = t.encode(text, add_special_tokens=False)
        assert ids.tolist() == e.ids and begin.tolist() == [a for a, _ in e.offsets]


def test_bpe_round_trip_query(spark):
    path = vocabulary("word_bpe_49k.json")
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(path))
    for r in bpe_tree.round_trip(docs(spark, ODD), path, leaf=50).collect():
        ids = t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        want = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *want]
    assert bpe_tree.round_trip(docs(spark, []), path).count() == 0


def test_token_files(spark):
    path = vocabulary("byte_bpe_50k.json")
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(path))
    texts = ODD * 3
    got = sorted(token_store.round_trip(docs(spark, texts), path).collect())
    start = 0
    for i, r in enumerate(got):
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.round_trip(docs(spark, []), path).count() == 0


def test_token_files_hold_null_and_repeated_ids(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = spark.createDataFrame([(None, "a b"), (4, "x y z"), (4, "x y z"), (1, None)], "doc_id long, text string")
    got = token_store.round_trip(rows, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 4, 4] and [r.start for r in got][0] == 0


def test_token_files_with_a_bound_on_ranges(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = spark.createDataFrame([(i, f"text {i} " + "of some words " * (i % 9)) for i in range(200)], "doc_id long, text string").repartition(4)
    made = {}
    for most in (3, 50_000):
        folder = fresh_folder(spark, "tokens")
        catalogue = token_store.write(rows, folder, path, file_bytes=300, most_tokens=60, most_ranges=most)
        parts, files = catalogue.select("part").distinct().count(), catalogue.count()
        assert parts <= 3 < files if most == 3 else parts > 20
        made[most] = sorted(map(tuple, token_store.read(catalogue, folder).collect()))
    assert made[3] == made[50_000] and len(made[3]) == 200


class Counted:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, size, offset):
        self.read += size
        return self.data[offset : offset + size]


def test_words_are_not_learned_anew_before_many_others(monkeypatch):
    """160,000 words that come twice, in the same order, are encoded once, with the number of words that write() remembers."""
    memo, learned = bpe_tree.Memo(bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary("byte_bpe_50k.json"))), token_store.WORDS), []
    learn = memo.learn
    monkeypatch.setattr(memo, "learn", lambda new: learned.append(len(new)) or learn(new))
    texts = ["x " + " ".join(f"w{i:x}" for i in range(a, a + 20_000)) for a in range(0, 160_000, 20_000)]
    first = [memo.encode([t])[0].tolist() for t in texts]
    assert [memo.encode([t])[0].tolist() for t in texts] == first and sum(learned) == 160_000


def test_a_token_is_read_without_its_file():
    rng = np.random.default_rng(3)
    ids = np.where(rng.random(900_000) < 0.5, rng.integers(0, 200, 900_000), rng.integers(0, 50_000, 900_000)).astype(np.uint32)
    starts = np.arange(0, 900_001, 90)
    data = token_store.pack(token_store.Dac.build(ids), np.arange(10_000), starts, np.ones(10_000, bool))
    for at in (0, 511, 512, 77_777, 899_999):
        source = Counted(data)
        assert token_store.DacFile(source)[at] == ids[at] and source.read < 2000 < len(data) // 500
    source = Counted(data)
    file = token_store.DacFile(source)
    doc_ids, known, bounds = file.documents(5000, 5010)
    assert doc_ids.tolist() == list(range(5000, 5010)) and known.all()
    assert (file.slice(int(bounds[0]), int(bounds[-1])) == ids[bounds[0] : bounds[-1]]).all() and source.read < 10_000
    assert token_store.crcs(file, bounds, 77) == [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    with pytest.raises(IndexError):
        file[900_000]


def test_tokens_by_position_and_hot_ids(spark):
    path = vocabulary("byte_bpe_50k.json")
    t = bpe_tree.load(bpe_tree.tokenizer_bytes(path))
    rows = [(i if i % 3 else 7, f"text number {i} of some words" if i % 4 else "the same") for i in range(300)]
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = fresh_folder(spark, "tokens")
    catalogue = token_store.write(source, folder, path, file_bytes=700, most_tokens=50)
    found = sorted(token_store.read(catalogue, folder, docs=3, step=5).collect(), key=lambda r: r.start)
    assert catalogue.where("first_id = 7").select("part").distinct().count() > 2  # the hot id is in several ranges
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows) and all(a.start + a.n_tokens == b.start for a, b in zip(found[:-1], found[1:], strict=True))
    want = sorted((i, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x in rows)
    assert sorted((r.doc_id, r.ids_crc32) for r in found) == want
    total = found[-1].start + found[-1].n_tokens
    asked = spark.range(-3, total + 5, 7).withColumnRenamed("id", "position")
    ids = {r.position: r.id for r in token_store.lookup(catalogue, folder, asked, cell=64).collect()}
    assert sorted(ids) == [p for p in range(-3, total + 5, 7) if 0 <= p < total] and all((ids[r.start + r.n_tokens - 1] == 0) for r in found if (r.start + r.n_tokens - 1 + 3) % 7 == 0)


@pytest.mark.parametrize("width", [4, 8, 16])
def test_codes_give_any_token(width):
    rng = np.random.default_rng(width)
    ids = np.where(rng.random(5000) < 0.4, rng.integers(0, 9, 5000), rng.integers(0, 70000, 5000)).astype(np.uint32)
    dac = token_store.Dac.build(ids, width)
    assert [dac[i] for i in range(0, 5000, 7)] == ids[::7].tolist()
    for a in range(0, 4900, 313):
        assert (dac.slice(a, a + 97) == ids[a : a + 97]).all()
    with pytest.raises(IndexError):
        dac[5000]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_windows_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = ["aa", "B", "c1", "é", "日本"]
    items = [" ".join(rng.choice(v, k)) for k in (12, 10, 4, 1)] + ["", None, "ZZ top"]
    texts = [", ".join(rng.choice(v, k)) for k in (0, 3, 50, 400)] + [None, "zz TOP", "zz  top! zz", items[0] + " x " + items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    known = {}
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(0, len(w) - 9) or min(1, len(w))):
            known.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for block, per_pass in ((16 << 20, 4), (8, 100), (8, 2), (60, 1)):
        got = {r.doc_id: r for r in decontam.report(decontam.find_overlap(docs(spark, texts), bench, block_bytes=block, per_pass=per_pass)).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for size in {len(k) for k in known}:
                for a in range(len(w) - size + 1):
                    if tuple(w[a : a + size]) in known:
                        hit |= set(range(a, a + size))
                        found |= known[tuple(w[a : a + size])]
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_window_sets_are_small_and_exact(monkeypatch):
    texts = [r or "" for r in pq.read_table("/root/testdata/sf0.1/benchmark.parquet")["text"].to_pylist()]
    known = decontam.WindowSet([(str(i), t) for i, t in enumerate(texts)], 10)
    assert known.nbytes() <= 6 * sum(len(t.encode()) for t in texts)
    # with hashes of two values, all windows collide and the bytes decide
    rng = np.random.default_rng(6)
    items = [(str(i), " ".join(rng.choice(["a", "b", "c"], 14))) for i in range(20)] * 2
    document = " ".join([items[3][1], *rng.choice(["a", "b", "c"], 30), items[11][1]])
    data, offsets = utf8(pa.array([document]))
    want = decontam.scan([decontam.WindowSet(items, 10)], data, offsets)
    plain = decontam.windows
    monkeypatch.setattr(decontam, "windows", lambda words, n: plain(words, n) % np.uint64(2))
    got = decontam.scan([decontam.WindowSet(items, 10)], data, offsets)
    assert (got[1] == want[1]).all() and got[2] == want[2] and {"3", "11"} <= got[2][0]


def test_decontamination_of_odd_tables(spark):
    item = " ".join(f"k{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "k3 k4 k5 k6 k7 k8 k9 k10 k11 z1 z2"), (None, item)], "item_id long, text string")
    rows = [(None, item), (4, item), (4, item), (5, "w " * 200_000 + item), (6, None), (7, "")]
    columns = "doc_id long, text string, _items string, _spans long, spans int, n_hit string"
    source = spark.createDataFrame([(i, t, "a", 1, 2, "b") for i, t in rows], columns)
    for block, per_pass in ((1 << 20, 4), (8, 1)):
        found = decontam.report(decontam.find_overlap(source, bench, block_bytes=block, per_pass=per_pass)).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in found) == [(0, 12, 12, 2), (4, 12, 12, 2), (4, 12, 12, 2), (5, 200_012, 12, 2), (6, 0, 0, 0), (7, 0, 0, 0)]
        left = decontam.decontaminate(source, bench, block_bytes=block, per_pass=per_pass)
        assert left.columns == source.columns and sorted(r.doc_id for r in left.collect()) == [6, 7]
        cut = decontam.decontaminate(source, bench, action="spans", block_bytes=block, per_pass=per_pass)
        assert sorted(len(r.text or "") for r in cut.collect()) == [0, 0, 0, 0, 0, 400_000]
    assert decontam.decontaminate(source.limit(0), bench).count() == 0 and decontam.find_overlap(source, bench.limit(0)).where("n_hit > 0").count() == 0


def test_removal(spark):
    item = " ".join(f"k{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    source = docs(spark, [f"before {item.upper()} after", "clean", None])
    assert decontam.decontaminate(source, bench).columns == source.columns
    assert {r.text for r in decontam.decontaminate(source, bench).collect()} == {"clean", None}
    assert {r.text for r in decontam.decontaminate(source, bench, action="spans").collect()} == {"before  after", "clean", None}
    assert decontam.decontaminate(source, bench.limit(0)).count() == 3


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    rng = np.random.default_rng(0)
    v = ["the", "of", "thing", "under", "water"]
    rows, labels = [], []
    for i in range(240):
        w = list(rng.choice(v, 60))
        good = i % 2
        rows.append((i, " ".join(w) if good else (" ".join(x.upper() + "!!" for x in w) if i % 4 else " ".join(x for x in w[:8] for _ in range(8)))))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, (1 - good) if held else good, 0))
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    net = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.quality(d, net).collect()}
    assert sum((got[i].score > 0.5) == bool(i % 2) for i, _ in rows) >= 236
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    assert quality.keep_good(d, net).count() == sum(r.predicted for r in got.values())


def test_classifier_scores_do_not_depend_on_batches():
    net = quality.fit(["good words here", "BAD!! BAD!!"] * 9, [1, 0] * 9, epochs=2)
    texts = ["", "a" * 1000, "one two two", "x " * 5000]
    together = quality.score(net, *utf8(pa.array(texts)))
    alone = [quality.score(net, *utf8(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)
    assert (quality.score(quality.fit([], []), *utf8(pa.array(texts))) == 0.5).all()


def test_classifier_is_the_network_that_its_parameters_say():
    net = quality.fit(["good words here and there", "BAD!! BAD!! bad"] * 20, [1, 0] * 20, epochs=2)
    for text in ("", "x", "some words, ünd more", "a" * 63, "b" * 64, "c d" * 300):
        data = text.encode() + bytes(net.width)
        chunks = -(-len(data) // net.chunk)
        data = data.ljust(chunks * net.chunk, b"\0")
        pooled = []
        for c in range(chunks):
            own = range(c * net.chunk, (c + 1) * net.chunk - (net.width - 1 if c == chunks - 1 else 0))
            values = [sum(net.tables[j, data[p + j]] for j in range(net.width)) + net.bias for p in own]
            pooled.append(np.maximum(np.max(values, axis=0), 0))
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0), [1]]) @ net.out
        got = quality.score(net, *utf8(pa.array([text])))[0]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_classifier_on_empty_tables_and_long_training_texts(spark):
    d = spark.createDataFrame([(i, "fine words " * 20 if i % 2 else "BAD!! " * 20) for i in range(40)] + [(100, "z" * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(100, 0, 0), (100, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    texts, classes = quality.training_rows(d, labels, 800, 1 << 18)
    assert max(map(len, texts)) < 1000 and set(classes) == {0, 1}
    net = quality.train(d, labels)
    assert quality.quality(d.limit(0), net).count() == 0 and quality.keep_good(d.limit(0), net).count() == 0
    assert quality.quality(d, quality.train(d, labels.limit(0))).where("score = 0.5 and predicted = 0").count() == 41
    assert quality.quality(d, quality.train(d.limit(0), labels)).count() == 41
