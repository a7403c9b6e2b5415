"""Every registered query over the smallest table, against plain Python."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_dedup import brute
from test_text import words
from test_trie import COLUMNS
from test_trie import brute as whole_trie
from test_vectors import nearest

from veilframe.llm import bpe_tree
from veilframe.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def rows(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


DOCS = {d[0]: d[1] or "" for d in rows("documents")}
PAGES = {p[0]: (p[1], p[2] or "") for p in rows("pages")}


@pytest.fixture(scope="module")
def got(spark):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, SF).collect()
        return kept[name]

    return of


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_op1(got):
    found = {r.doc_id: r for r in got("op1_quality_classifier")}
    assert set(found) == set(DOCS)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in found.items())


def test_op1_held_out_accuracy(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    found = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, folder).collect()}
    judged = [(found[i].predicted, q) for i, q, _ in duckdb.sql(f"SELECT * FROM '{folder}/labels.parquet'").fetchall() if found[i].held_out]
    assert len(judged) > 50 and sum(a == b for a, b in judged) >= 0.97 * len(judged)


def test_op2(got):
    assert {r.doc_id: r.class_id for r in got("op2_near_dedup")} == brute(list(DOCS.items()))


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_op3(got):
    found = {r.page_id: r for r in got("op3_url_filter")}
    assert set(found) == set(PAGES)
    for i, (url, _) in PAGES.items():
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fit, key=len, default=None)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, best)
        assert found[i].verdict == RULES[best] if best else found[i].verdict in ("allow", "block")


def test_op4(got):
    first = {}
    for i in sorted(PAGES):
        first.setdefault(PAGES[i][1], i)
    for r in got("op4_warc"):
        html = PAGES[r.page_id][1]
        own = first[html] == r.page_id
        want = (len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), "response" if own else "revisit", None if own else first[html])
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    assert len(got("op4_warc")) == len(PAGES)


def test_op5_and_op6(got):
    word, byte = (bpe_tree.load(bpe_tree.tokenizer_bytes(vocabulary(n))) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for r in got("op5_bpe_tree"):
        ids = word.encode(DOCS[r.doc_id], add_special_tokens=False).ids
        text = word.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    start, found = 0, {r.doc_id: r for r in got("op6_token_store")}
    for i in sorted(DOCS):
        ids = [*byte.encode(DOCS[i], add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert len(got("op5_bpe_tree")) == len(found) == len(DOCS)


def test_op7(got):
    known = {}
    for i, t in rows("benchmark"):
        w = words(t)
        for k in range(max(0, len(w) - 9) or min(1, len(w))):
            known.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(k) for k in known}
    for r in got("op7_decontamination"):
        w, hit, items = words(DOCS[r.doc_id]), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in known:
                    hit |= set(range(a, a + n))
                    items |= known[tuple(w[a : a + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_op8(got, spark):
    found = got("op8_sharding")
    assert sum(r.n_bytes for r in found) == sum(len(t.encode()) for t in DOCS.values()) and len(found) == len(DOCS)
    documents = duckdb.sql(f"SELECT * FROM '{LARGER}/documents.parquet'")  # noqa: F841  the SQL's table
    want = duckdb.sql(ORACLES["op8_sharding"]).fetchall()
    assert sorted(map(tuple, QUERIES["op8_sharding"](spark, LARGER).collect())) == sorted(want) and len({r[2] for r in want}) > 2


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_warc"])
def test_sql(got, name):
    pages = duckdb.sql(f"SELECT * FROM '{SF}/pages.parquet'")  # noqa: F841  the SQL's table
    assert sorted(map(str, map(tuple, got(name)))) == sorted(map(str, duckdb.sql(ORACLES[name]).fetchall()))


def test_op9(got):
    documents = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'")  # noqa: F841  the SQL's table
    want = duckdb.sql(ORACLES["op9_exact_dedup"]).fetchall()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got("op9_exact_dedup")) == sorted(want)


def test_op10(got):
    import html

    for r in got("op10_html_extract"):
        url, page = PAGES[r.page_id]
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", "\n", re.sub(r"</?b>", "", article))).split())
        assert (r.url, r.text, r.n_chars) == (url, text, len(text))
    assert len(got("op10_html_extract")) == len(PAGES)


def test_op11(got):
    found = sorted((tuple(r[c] for c in COLUMNS) for r in got("op11_prefix_trie")), key=lambda r: (r[1], r[0]))
    assert found == whole_trie([r[:4] for r in rows("conversations")])


def embeddings():
    found = sorted((i, v) for i, v, *_ in rows("embeddings"))
    return [i for i, _ in found], np.array([v for _, v in found], float)


def test_op12(got):
    ids, x = embeddings()
    found = {}
    for r in got("op12_collision_ann"):
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, ranked in found.items():
        want = nearest(ids, x, q, len(ids))
        exact = dict(want)
        assert sorted(ranked) == [1, 2, 3, 4, 5] and all(abs(exact[i] - s) < 1e-12 for i, s in ranked.values())
        assert [ranked[k][1] for k in range(1, 6)] == sorted((s for _, s in ranked.values()), reverse=True)
        hits += len({i for i, _ in want[:5]} & {i for i, _ in ranked.values()})
    assert hits >= 0.9 * 5 * len(found)


def test_op13(got):
    ids, x = embeddings()
    a = np.floor(1024 * x).astype(np.int64) + 100_000
    n, d = len(a), a - a.sum(0) / len(a)
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want, made = d @ u / np.sqrt(e), np.zeros((n, 8))
    for r in got("op13_whitening"):
        i = ids.index(r.vec_id)
        made[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * a[i] - a.sum(0)) ** 2).sum()) and r.identity_error < 1e-9
        assert abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9
    assert np.abs(made * np.sign((made * want).sum(0)) - want).max() < 1e-9
