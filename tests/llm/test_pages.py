import base64
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import common, html_extract, url_filter, warc
from veilframe.llm.common import fresh_folder

PAGES = "page_id long, url string, html string, host string, path string, digest string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", 3) for i, u, h in rows], PAGES)


RULED = [
    ("http://A.example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org", "example.org", "", None, "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.org/q#f", "x.org", "/q", "org/", "allow"),
    ("http://notcom/fr/", "notcom", "/fr/", None, "allow"),
    ("http://b.com/de/?a://c", "b.com", "/de/", "com/de/", "block"),
    ("http://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://H.net\n/x", "h.net\n", "/x", None, "allow"),
]


def test_rules(spark):
    got = {r.page_id: r for r in url_filter.judge(pages(spark, [(i, x[0], None) for i, x in enumerate(RULED)])).collect()}
    for i, x in enumerate(RULED):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == x[1:]
    assert url_filter.judge(pages(spark, [])).count() == 0


def test_propagation_follows_and_reverses_links(spark):
    link = '<a href="http://{}/">x</a>'
    rows = [
        (1, "http://bad.com/de/a", ""),
        (2, "http://feeder.net/x", link.format("bad.com") * 3),
        (3, "http://good.com/fr/a", link.format("liked.net") + '<a href=//also.net/p>y</a>'),
        (4, "http://liked.net/x", ""),
        (5, "http://also.net/x", link.format("liked.net")),
        (6, "http://alone.net/x", link.format("alone.net")),
    ]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert got[2].distrust > 0 and got[4].trust > got[5].trust > 0


def test_no_host_is_distrusted_for_its_name_by_default(spark):
    rows = [(1, "http://free-bets.net/x", ""), (2, "http://alphabets.net/x", "")]
    assert {r.verdict for r in url_filter.judge(pages(spark, rows)).collect()} == {"allow"}
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows), seed_words=("bets",)).collect()}
    assert got == {1: "block", 2: "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    hosts = [f"h{i}.net" for i in range(17)]
    rows = [(0, "http://bad.com/de/a", "")] + [(i + 1, f"http://{h}/", f'<a href="http://{to}/">x</a>') for i, (h, to) in enumerate(zip(hosts, ["bad.com", *hosts], strict=False))]
    assert {r.verdict for r in url_filter.judge(pages(spark, rows)).collect()} == {"block"}


def test_small_seed_shares_are_not_taken_for_convergence(spark):
    edges = [(f"h{i + 1}", f"h{i}", 1) for i in range(7)]
    seeds = spark.createDataFrame([("h0", "d", 1e-7)], "host string, kind string, share double")
    got = {r.host: r.distrust for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds).collect()}
    assert [got[f"h{i}"] for i in range(8)] == pytest.approx([1e-7 * 0.15 * 0.85**i for i in range(8)], rel=1e-9)


def test_ranks_equal_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 5)]
    seeds = spark.createDataFrame([("a", "t", 1.0), ("c", "d", 1.0)], "host string, kind string, share double")
    got = {r.host: r for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds, rounds=12, tolerance=0).collect()}
    for kind, seed, ends in (("trust", "a", edges), ("distrust", "c", [(b, a, n) for a, b, n in edges])):
        rank = {h: 0.15 * (h == seed) for h in "abcd"}
        for _ in range(12):
            new = {h: 0.15 * (h == seed) for h in "abcd"}
            for a, b, n in ends:
                new[b] += 0.85 * rank[a] * n / sum(m for x, _, m in ends if x == a)
            rank = new
        for h, v in rank.items():
            assert (got[h][kind] if h in got else 0) == pytest.approx(v, abs=1e-9)


def test_a_host_without_links_is_judged_by_its_own_pages(spark):
    """However many other hosts are trusted: normalising each kind by itself would weigh one rejected page more."""
    rows = [(i, f"http://h{i}.org/", "") for i in range(60)]
    rows += [(100, "http://s.com/fr/1", ""), (101, "http://s.com/fr/2", ""), (102, "http://s.com/de/1", ""), (103, "http://s.com/x", "")]
    rows += [(110, "http://t.com/fr/1", ""), (112, "http://t.com/de/1", ""), (113, "http://t.com/x", "")]
    rows += [(120, "http://u.com/fr/1", ""), (121, "http://u.com/de/1", ""), (122, "http://u.com/de/2", ""), (123, "http://u.com/x", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows)).collect()}
    assert [got[i] for i in (103, 113, 123)] == ["allow", "allow", "block"]


def test_sql_follows_links(spark):
    """The query's SQL on pages whose links decide, which those of the tables don't."""
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(8)
    hosts = [f"g{i}.org" for i in range(5)] + [f"b{i}.com" for i in range(5)] + [f"x{i}.net" for i in range(30)]
    rows = []
    for i, h in enumerate(hosts):
        for p in range(3):
            own = i % 2 if i >= 10 else i // 5  # the side a host is on
            to = [hosts[int(rng.choice([k for k in range(40) if (k % 2 if k >= 10 else k // 5) == own]))] for _ in range(3)]
            rows.append((3 * i + p, f"http://{h}/{'de' if h.endswith('com') and p else 'x'}/{p}", "".join(f'<a href="http://{t}/">' for t in to)))
    table = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", table)
    want = dict(con.sql(f"SELECT page_id, verdict FROM ({url_filter.ORACLE})").fetchall())
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows)).collect()}
    assert got == want and {got[i] for i in range(30, 120)} == {"allow", "block"}


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_verdicts_where_propagation_decides_most(spark):
    """Good and bad hosts link mostly among their own; a few of each have pages that rules decide."""
    rng = np.random.default_rng(4)
    names = [f"n{i}.good.net" for i in range(40)] + [f"n{i}.bad.net" for i in range(40)]
    rows, links = [], {}
    for i, name in enumerate(names):
        for p in range(3):
            to = [names[int(rng.integers(0, 40)) + 40 * (i // 40 if rng.random() < 0.96 else 1 - i // 40)] for _ in range(5)]
            form = ['<a href="https://{}/x">', "<img src='//{}/i'>", "<base href=http://{}><a href=rel>", '<A HREF = "HTTP://{}:80/">']
            rows.append((10 * i + p, f"http://{name}/p{p}?go=http%3A%2F%2F{to[4]}%2F&x=1", "".join(f.format(t) for f, t in zip(form, to, strict=False))))
            for t in (*to[:3], to[3] + ":80", to[4]):
                if t != name:
                    links[name, t] = links.get((name, t), 0) + 1
    seeds = [(5000 + i, n) for i, n in enumerate(names) if i % 13 == 0]
    rows += [(k, f"http://{n}/{'ok' if 'good' in n else 'no'}/", "") for k, n in seeds]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows), rules=[("net/ok/", "allow"), ("net/no/", "block")]).collect()}
    every = sorted({x for k in links for x in k})
    ranks = []
    for kind, flow in (("good", links), ("bad", {(b, a): n for (a, b), n in links.items()})):
        m, base = np.zeros((len(every), len(every))), np.array([float(any(s == n and kind in s for _, s in seeds)) for n in every])
        for (a, b), n in flow.items():
            m[every.index(b), every.index(a)] = n / sum(x for (c, _), x in flow.items() if c == a)
        rank = base = base / len(seeds) * 0.15  # one total for both kinds
        for _ in range(300):
            rank = base + 0.85 * m @ rank
        ranks.append(dict(zip(every, rank, strict=True)))
    open_ = [(i, r.host, r.verdict) for i, r in got.items() if r.rule is None]
    assert len(open_) == 240 and all(v == ("block" if ranks[1][h] > ranks[0][h] else "allow") for _, h, v in open_)
    assert sum((v == "block") == (i >= 400) for i, _, v in open_) >= 0.85 * len(open_)


def test_warc_round_trip(spark):
    rows = [(5, "http://a/1", "same"), (2, "http://a/é ü\n", "same"), (9, None, None), (8, "", ""), (3, "u", "x" * 300_000 + "é"), (None, "n", "same"), (7, "u", "other\r\n\r\nWARC/1.1")]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        same = [k for k, _, x in rows if (x or "") == (h or "") and k is not None]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), b32(h))
        assert (r.record_type, r.refers_to) == (("response", None) if i == min(same) else ("revisit", min(same)))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_selected_records_and_payloads(spark):
    folder = fresh_folder(spark, "warc")
    index = warc.write(pages(spark, [(i, f"http://h/{i}", f"p{i // 2}") for i in range(40)]), folder)
    found = warc.read(index.where("page_id in (4, 5, 30)"), folder, block=600, gap=10, with_payload=True).collect()
    assert {(r.page_id, r.record_type, bytes(r.payload).decode()) for r in found} == {(4, "response", "p2"), (5, "revisit", ""), (30, "response", "p15")}
    small = warc.write(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), fresh_folder(spark, "warc"), min_bytes=3)
    assert {r.page_id: r.record_type for r in small.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_with_more_repeated_payloads_than_are_broadcast(spark, monkeypatch):
    rows = pages(spark, [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"p{i // 4}") for i in range(200)] + [(500, "u", None), (501, "u", "")])
    want = sorted(map(tuple, warc.round_trip(rows).collect()))
    monkeypatch.setattr(common.few, "__defaults__", (0,))
    assert sorted(map(tuple, warc.round_trip(rows).collect())) == want
    assert sorted(map(tuple, warc.round_trip(rows, 3).collect())) == sorted((i, n, d, "response", None) if n < 3 else (i, n, d, t, r) for i, n, d, t, r in want)


def test_bloom_filter_misses_nothing(spark):
    facts = spark.range(0, 3000, 3).selectExpr("sha1(cast(id as string)) as digest")
    probed = spark.range(3000).selectExpr("id", "case when id != 1 then sha1(cast(id as string)) end as k")
    got = {r.id for r in probed.where(warc.maybe_among(facts, F.col("k"), 4)).collect()}
    assert {i for i in range(0, 3000, 3)} <= got and len(got) < 1100 and 1 not in got


def test_ranges_merge():
    at = [{"offset": o, "length": 10} for o in (0, 10, 25, 100)]
    assert [len(x) for x in warc.merged(at, 5)] == [3, 1]


PAGE = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>T &amp; {0}</h1><p>one <b>b</b>old{0}<br>two<form><input>f</form></article><section id=comments>c</section><footer>f</footer>"
PLAIN = "<div><p>Menu line</p><p>Text {0} of this page</p><p>More {0}</p><p>Copyright</p></div>"


def test_extraction(spark):
    rows = [(1, "http://a/x/1", PAGE.format(1)), (2, "http://a/x/2", PAGE.format(2)), (3, "http://b/1", PLAIN.format(1)), (4, "http://b/2", PLAIN.format(2)), (5, "http://b/2", PLAIN.format(2)), (6, None, None), (7, "http://c/", PLAIN.format(7))]
    got = {r.page_id: r for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got[1].text == "T & 1 one bold1 two"
    assert got[3].text == "Text 1 of this page More 1" and got[4].text == "Text 2 of this page More 2"
    assert got[7].text == "Menu line Text 7 of this page More 7 Copyright"
    assert got[6].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(pages(spark, [])).count() == 0
    assert html_extract.extract(pages(spark, rows), group=1).count() == len(rows)


def test_lcs():
    a, b = list("abcbdab"), list("bdcaba")
    assert len(html_extract.common(a, b)) == 4
    assert html_extract.common([], b) == set() and html_extract.common(a, a) == set(range(7))


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_the_table():
    rng = np.random.default_rng(3)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        a, b = ([letters[i] for i in rng.integers(0, len(letters), rng.integers(0, 40))] for _ in range(2))
        got = [a[i] for i in sorted(html_extract.common(a, b))]
        rest = iter(b)
        assert all(x in rest for x in got) and len(got) == lcs(a, b)
        assert int(html_extract.growth(a, b).sum()) == lcs(a, b)
    a, b = (list(rng.choice(list("abc"), 700)) for _ in range(2))  # so many equal pairs that the lists are halved
    got = [a[i] for i in sorted(html_extract.common(a, b))]
    rest = iter(b)
    assert all(x in rest for x in got) and len(got) == lcs(a, b)


def test_many_equal_lines_and_nested_inline_tags_take_little_time():
    began = time.process_time()
    assert len(html_extract.common(["x", *["same"] * 100_000, "y"], ["u", *["same"] * 100_000, "v"])) == 100_000
    assert time.process_time() - began < 4
    began = time.process_time()
    html_extract.lines("<p><body>" + "<b>" * 130_000 + "<hr>" * 150_000)
    assert time.process_time() - began < 4


@pytest.mark.parametrize(
    "attributes, furniture",
    [
        ('class="ad"', True),
        ("id=cookie-banner", True),
        ("class='commentList'", True),
        ('class="article-comments"', True),
        ('class="content share-enabled"', False),
        ('class="entry-content"', False),
        ('class="no-sidebar-page wide"', False),
        ('role="navigation"', True),
        ('href="/ad/comments"', False),
        ('class="share-price"', False),
        ('class="related-work"', False),
        ('class="notice-board"', False),
        ('class="share-buttons"', True),
        ('class="ad-slot"', True),
    ],
)
def test_marks(attributes, furniture):
    assert html_extract.marked(attributes, False) == furniture


def test_comments_inside_articles_and_odd_markup():
    page = '<article class="has-sidebar"><header><h1>T</h1></header><p>a<p>b<ul><li>c</ul><div hidden>x</div><pre>d\n e</pre><article class="comment"><p>no</article>g</article><p>after'
    assert html_extract.main_text(html_extract.lines(page), None) == "T a b c d e g"
    assert html_extract.main_text(html_extract.lines("<p>1 < 2 &amp; 3 > 2<!-- x --><script>var a='<p>';</script> end"), None) == "1 < 2 & 3 > 2 end"


def test_open_lines_are_differenced_on_pages_with_an_article():
    page = "<article>Teaser</article><div id=x><p>Menu</p><p>The long text {0} of the page</p></div>"
    one, two = (html_extract.lines(page.format(i)) for i in (1, 2))
    assert html_extract.main_text(one, two) == "Teaser The long text 1 of the page"
    assert html_extract.main_text(one, None) == "Teaser Menu The long text 1 of the page"


@pytest.mark.parametrize(
    "attributes, unseen",
    [
        (' class="overflow-hidden"', False),
        (' style="overflow:hidden"', False),
        (" class='hidden-xs'", False),
        (' title="hidden"', False),
        (" hidden", True),
        (' class="a" HIDDEN=""', True),
        (" aria-hidden=true", True),
        (' style="color:red; display: none"', True),
        (' style="visibility:hidden"', True),
    ],
)
def test_hidden(attributes, unseen):
    assert html_extract.main_text(html_extract.lines(f"<main{attributes}><p>text</main>"), None) == ("" if unseen else "text")


@pytest.mark.parametrize("tag", ["<svg class=i/>", "<iframe src=x />", "<noscript>", "<select>", "<template>", "<canvas>"])
def test_elements_without_a_closing_tag_end_nothing(tag):
    assert html_extract.main_text(html_extract.lines(f"<p>a</p>{tag}<p>b</p>{tag}<p>c</p>"), None) == "a b c"
    assert html_extract.main_text(html_extract.lines("<p>a<svg/>b<svg><text>no</text></svg>c<script>d"), None) == "abc"


def test_partners_past_runs_of_copies_and_in_long_templates(spark):
    menu = "".join(f"<p>A menu line of the template, number {i}</p>" for i in range(20))
    texts = ["Tiny tale", "Other words", *["Third thing"] * 4]
    rows = [(i, f"http://h/{i}", f"{menu}<p>{t}</p>") for i, t in enumerate(texts)] + [(9, "http://b/1", PLAIN.format(1)), *((i, "http://b/2", PLAIN.format(2)) for i in (10, 11, 12))]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(6)] == texts
    assert all(got[i] == "Text 2 of this page More 2" for i in (10, 11, 12))


def test_differencing_decides_inside_main_and_whatever_has_no_mark(spark):
    menu = "".join(f"<li>Entry {i}" for i in range(9))
    page = "<body><div><ul>" + menu + "</ul></div><main class='overflow-hidden'><h2 class='page-header'>Title {0}</h2><p>Share this page<p>Story {0} told at length, in words of its own<div>Newest stories</div></main><div>Imprint</div>"
    rows = [(i, f"http://h/{i:03}", page.format(f"{i} {i * i}")) for i in range(30)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Title {i} {i * i} Story {i} {i * i} told at length, in words of its own" for i in range(30)}
    assert html_extract.main_text(html_extract.lines(rows[0][2]), None).endswith("words of its own Newest stories")  # but for its partner


def test_pages_without_a_host_have_no_partner(spark):
    rows = [(i, None if i % 2 else f"no scheme {i}", f"<p>Shared line<p>Own words {i} {i * i}") for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Shared line Own words {i} {i * i}" for i in range(6)}


def test_headings_marked_as_headers_and_passages_inside_articles_stay():
    page = "<article><h2 class='page-header'>Heading</h2><p class='is-hidden-xs'>A passage</p><p>Text {0}</p><div class='newsletter'>Join</div></article>"
    one, two = (html_extract.lines(page.format(i)) for i in (1, 2))
    assert html_extract.main_text(one, two) == "Heading A passage Text 1"


@pytest.mark.parametrize("part", ['<a "', "<a b='", "<!", "<", "<div>", "</x>", "<svg>", "<p><b>", "<!-- ", "<a b=\"\"\">"])
def test_broken_markup_is_read_once(part):
    began = time.process_time()
    html_extract.lines("<div>" * 1000 + part * (1_000_000 // len(part)) + "</b></x>" * 1000)
    assert time.process_time() - began < 5
    assert html_extract.main_text(html_extract.lines(f"<p>text</p>{'<p>' if part == '<a ' else ''}"), None) == "text"


def test_held_pages_beyond_memory():
    held = html_extract.Held(most=500)
    for i in range(9):
        held.add({"lines": [("x" * 100, 1)], "i": i}, [i])
    assert any(isinstance(page, bytes) for page, _ in held.rows) and [(page["i"], page["lines"][0][0], sides) for page, sides in held] == [(i, "x" * 100, [i]) for i in range(9)]


def test_ranges_keep_neighbours_together(spark):
    part = lambda i: f"<p>Menu of part {i // 6}, the same on all its pages</p>"
    rows = [(i, f"http://h/{i // 6:02}/{i:03}", part(i) + f"<p>{'one' if i in range(40, 70) else i} says its own words about {i * i if i not in range(40, 70) else 0} things</p>") for i in range(120)]
    whole, split = ({r.page_id: r.text for r in html_extract.extract(pages(spark, rows), group=g).collect()} for g in (1000, 7))
    assert split == whole and len(split) == 120
    assert not any("Menu" in whole[i] for i in (*range(36), *range(76, 120)))
