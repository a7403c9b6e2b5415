"""Column functions and reports against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checks, masks, scrub, text
from veilframe.functions.synthetic import synthetic
from veilframe.functions.types import NAMES, TYPES, dimension
from veilframe.operators import metrics, native
from veilframe.operators import spans as S
from veilframe.sources import corpus, sinks
from veilframe.sources.models import answers, chunks_to_text, client

SAMPLES = ["", "ascii", "Ёлка İ ß", "a b c", "日本 🙂 x", "Привет, Мир_1!"]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(s,) for s in SAMPLES], "t string").cache()


def test_types_are_thirty_and_ordered(spark):
    assert len(TYPES) == 30 == len(set(NAMES))
    assert [r.type for r in dimension(spark).orderBy("ord").collect()] == NAMES


def test_lower_and_spaces_keep_byte_lengths(samples):
    for r in samples.select("t", text.safe_lower("t").alias("a"), text.normalize_spaces("t").alias("b"), text.from_byte_view(text.byte_view("t")).alias("c")).collect():
        assert len(r.a.encode()) == len(r.b.encode()) == len(r.t.encode())
        assert r.c == r.t and not any(c in r.b for c in "  ")


def test_letters_of_other_widths_move_nothing(spark):
    """ẞ loses a byte in lower case, Ⱥ wins one: the text's length doesn't tell."""
    t = "ẞ AB Ⱥ CD"
    assert spark.range(1).select(text.safe_lower(F.lit(t))).first()[0] == "ẞ ab Ⱥ cd"


def test_tokens_and_matches_have_byte_offsets(samples):
    for r in samples.select("t", text.tokens("t").alias("k"), text.matches("t", r"\p{L}+").alias("m")).collect():
        data = r.t.encode()
        assert b"".join(data[x.start : x.end] for x in r.k) == data
        assert all(data[x.start : x.end].decode() == x.text for x in r.m)
    kinds = samples.where("t like 'Привет%'").select(text.tokens("t").alias("k")).first().k
    assert [x.kind for x in kinds] == ["word", "punct", "space", "alnum", "punct"]


def test_edges(spark):
    one = spark.range(1).select(F.lit("ab, cd!").alias("t"))
    got = one.select(text.is_boundary("t", F.lit(1)), text.is_boundary("t", F.lit(2)), text.expand_word("t", F.lit(1), F.lit(5)), text.trim_edges("t", F.lit(2), F.lit(7))).first()
    assert tuple(got) == (False, True, (0, 6), (4, 6))


def test_measures(spark):
    df = spark.createDataFrame([("",), ("абв",), ("abcdefgh",), ("a",)], "t string")
    assert [r[0] for r in df.select(text.estimate_tokens("t")).collect()] == [0, 1, 2, 1]
    assert df.select(text.store_key(F.lit("  Id-7 "))).first()[0] == "id-7"
    assert spark.range(1).select(text.case_blind(F.lit("abc")), text.is_upper_first(F.lit("Ёж")), text.is_cyrillic_word(F.lit("Ёж")), text.count_digits(F.lit("a1b22"))).first() == (True, True, True, 3)


MASKS = [
    ("stars_keep2", "4509 123456", "45** ****56"),
    ("stars_keep2", "1234", "****"),
    ("stars_keep2", "--", "--"),
    ("stars_all", "Ёж-12", "**-**"),
    ("initials", "Петров-Водкин Кузьма", "П.-В. К."),
    ("initials", "иванов и.и.", "И. И. И."),
    ("initials", "12345", "12*45"),
    ("initials_latin", "IVAN PETROV", "I. P."),
    ("label", "x", "[ФИО]"),
    ("keep_domain", "marina.k@post.ru", "ma****.*@post.ru"),
    ("keep_domain", "no-at-sign", "no-**-**gn"),
    ("none", "as it is", "as it is"),
    ("unknown", "4509 123456", "45** ****56"),
]


@pytest.mark.parametrize("strategy, value, want", MASKS)
def test_masks(spark, strategy, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(masks.masked(F.col("v"), F.lit("FIO"), F.lit(strategy))).first()[0] == want


def test_tokens_are_salted_digests(spark):
    got = spark.range(1).select(masks.token(F.lit("Пётр"), F.lit("FIO"), "s")).first()[0]
    assert got == "PD_FIO_" + hashlib.sha256("s\0Пётр".encode()).hexdigest()[:6]


def numbers(value, kind, salt="veilframe"):
    """The counter stream of a value in plain Python."""
    block = 0
    while True:
        h = hashlib.sha256("\0".join([salt, kind, value, str(block)]).encode()).hexdigest()
        yield from (int(h[i : i + 8], 16) for i in range(0, 64, 8))
        block += 1


def test_synthetic_values_keep_their_shape(spark):
    rows = [
        ("FIO", "Иванов Иван"), ("CARD_NUMBER", "4111 1111 1111 1111"), ("PHONE", "+7 916 123-45-67"), ("PHONE", "916 123 45 67"), ("EMAIL", "a@b.ru"), ("BIRTH_DATE", "12.05.1990"),
        ("BIRTH_DATE", "3 мая 1990"), ("INN", "500100732259"), ("CITY", "Тверь"), ("CARD_HOLDER", "IVAN PETROV"), ("STREET", "Новая-Лесная 2b"), ("OWN", ""), ("FIO", None), (None, "x1"),
    ]
    df = spark.createDataFrame(rows, "kind string, value string")
    got = df.select("kind", "value", synthetic(F.col("value"), F.col("kind")).alias("made"), synthetic(F.col("value"), F.col("kind")).alias("again")).collect()
    for r in got:
        assert r.made == r.again
        if r.value is None or not r.value:
            assert r.made == r.value
            continue
        assert r.made != r.value
        if r.kind in ("CARD_NUMBER", "PHONE", "INN", "STREET"):
            assert [c.isdigit() for c in r.made] == [c.isdigit() for c in r.value]
    made = {(r.kind, r.value): r.made for r in got}
    assert checks_luhn(made["CARD_NUMBER", "4111 1111 1111 1111"].replace(" ", "")) and made["CARD_NUMBER", "4111 1111 1111 1111"].startswith("4")
    assert made["PHONE", "+7 916 123-45-67"].startswith("+7 9") and made["PHONE", "916 123 45 67"].startswith("9")
    day, month, year = map(int, made["BIRTH_DATE", "12.05.1990"].split("."))
    assert 1 <= day <= 28 and 1 <= month <= 12 and 1960 <= year < 2000
    assert len(made["FIO", "Иванов Иван"].split()) == 2
    n = numbers("500100732259", "INN")
    assert made["INN", "500100732259"] == "".join(str(next(n) % 10) for _ in range(12))
    street = made["STREET", "Новая-Лесная 2b"]
    assert [c.isupper() for c in street] == [c.isupper() for c in "Новая-Лесная 2b"] and street[5] == "-"


def checks_luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 31, 32, 33, 200, 1100)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", text.running(F.col("x")).alias("s")).collect()
    assert all(r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] for r in got)


def test_matches_of_texts_with_control_characters(spark):
    got = spark.createDataFrame([("a\u000112\u0001 3",), ("",), (None,)], "t string").select(text.matches("t", "[0-9]+").alias("m")).collect()
    assert [[(m.start, m.end, m.text) for m in r.m] for r in got] == [[(2, 4, "12"), (6, 7, "3")], [], []]


def test_checks(spark):
    v = lambda f, x: spark.range(1).select(f(F.lit(x))).first()[0]
    assert v(checks.luhn, "4111111111111111") and not v(checks.luhn, "4111111111111112") and not v(checks.luhn, "")
    assert v(checks.inn_valid, "7707083893") and not v(checks.inn_valid, "7707083894")
    assert v(checks.snils_valid, "11223344595") and not v(checks.snils_valid, "11223344596")
    assert v(checks.iban_valid, "DE89 3704 0044 0532 0130 00") and not v(checks.iban_valid, "DE88370400440532013000")
    assert v(checks.card_scheme, "2200000000000000") == "mir"
    assert spark.range(1).select(checks.card_grouping(F.split(F.lit("3782-822463-10005"), "-"))).first()[0]


def test_scrub(spark):
    line = "Пётр Иванов a.b@c.ru +7 916 123-45-67 заказ 1234567 ok 42"
    assert spark.range(1).select(scrub.scrub(F.lit(line))).first()[0] == "[name redacted] [email redacted] [phone:11 redacted] заказ [digits:7 redacted] ok 42"
    assert spark.range(1).select(scrub.redact_value(F.lit("short"))).first()[0] == "short"
    assert spark.range(1).select(scrub.redact_value(F.lit("id 12345"))).first()[0].startswith("[redacted len=8 fp=")


def test_custom_anchors_need_a_word_edge_and_the_window(spark):
    rows = [("табель 1234",), ("табельный 1234",), ("табель " + "x" * 60 + " 1234",)]
    df = spark.createDataFrame(rows, "t string")
    assert [len(r[0]) for r in df.select(native.custom("t", "BADGE", "[0-9]{4}", ["табель"], 40)).collect()] == [1, 0, 0]


def test_label_expansion_stops_at_lines_and_spans(spark):
    t = "номер телефона: 123\nтел. 456"
    at = lambda x: len(t[: t.index(x)].encode())
    spans = [(at("123"), at("123") + 3, "PHONE", 0.9, "t", ""), (at("456"), at("456") + 3, "PHONE", 0.9, "t", "")]
    from veilframe.functions.types import SPANS

    df = spark.createDataFrame([(t, spans)], f"t string, s {SPANS}")
    got = df.select(S.expand_labels("t", F.col("s")).alias("e")).first().e
    assert t.encode()[got[1].start : got[1].end].decode() == "тел. 456"


def test_masked_looks(spark):
    yes, no = ["a ** b", "PD_FIO_12", "И. И. И."], ["ничего", "Ф. И. О.", "2 * 2"]
    df = spark.createDataFrame([(x,) for x in yes + no], "t string")
    assert [r[0] for r in df.select(S.looks_masked("t")).collect()] == [True] * 3 + [False] * 3
    assert spark.range(1).select(S.looks_label_masked(F.lit("[КОД] x"), F.lit(True)), S.looks_label_masked(F.lit("[КОД]"), F.lit(False))).first() == (True, False)


def test_histogram_and_quantile(spark):
    values = [0.5, 1.0, 1.5, 3.0, 7.0, 99999.0]
    r = spark.createDataFrame([(v,) for v in values], "v double")
    h = metrics.histogram(r, "v")
    got = {x.le: x.cumulative for x in h.collect()}
    assert got[1.0] == 2 and got[2.0] == 3 and got[5.0] == 4 and got[10.0] == 5 and got[None] == 6
    assert metrics.bucket_quantile(h, 0.5).first()[0] == 2.0


def test_corpus_and_dictionary(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"id":"A","text":"x","expect_types":["FIO"]}\n\n{"id":"b","text":"y"}\n')
    bad.write_text('{"id":"a","text":"x"}\n{"id":"A","text":"y"}\n')
    cases = corpus.checked(corpus.read_cases(spark, str(good)))
    assert {r.id: r.expect_types for r in cases.collect()} == {"A": ["FIO"], "b": []}
    with pytest.raises(ValueError):
        corpus.checked(corpus.read_cases(spark, str(bad)))
    words = tmp_path / "w.txt"
    words.write_text("# months\nЯнварь\t1\nмай\t5 # five\n\nслово\n")
    assert {(r.word, r.value) for r in corpus.dictionary(spark, str(words)).collect()} == {("январь", 1), ("май", 5), ("слово", None)}


def test_sinks(spark):
    counts = spark.createDataFrame([("mask", 'o"k', 3)], "op string, status string, n long")
    lines = [r.line for r in sinks.exposition(counts, "requests_total", ["op", "status"]).collect()]
    assert lines[-1] == 'requests_total{op="mask",status="o\\"k"} 3' and lines[1] == "# TYPE requests_total counter"
    assert sinks.stats(requests=counts).first().json == '{"requests":[{"op":"mask","status":"o\\"k","n":3}]}'


def test_model_connector(spark):
    def ask(messages):
        if messages[-1]["content"] == "down":
            raise OSError
        return "re: " + messages[-1]["content"]

    rows = [([{"role": "user", "masked": "hi"}],), ([{"role": "user", "masked": "down"}],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,masked:string>>")
    assert [r[0] for r in df.select(answers(ask)(F.col("m"))).collect()] == ["re: hi", None]
    assert chunks_to_text(['data: {"choices":[{"delta":{"content":"a"}}]}', "", 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]"]) == "ab"


def test_http_client():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Endpoint(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = asked["messages"][-1]["content"]
            if said == "down":
                self.send_error(503)
                return
            events = "".join(f'data: {json.dumps({"choices": [{"delta": {"content": c}}]})}\n\n' for c in said) + "data: [DONE]\n\n"
            whole = json.dumps({"choices": [{"message": {"content": said.upper()}}]})
            body = ("{broken" if said == "broken" else events if asked["stream"] else whole).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    say = lambda t: [{"role": "user", "content": t}]
    assert client(url, "m", "k")(say("hi")) == "HI" and client(url, "m", stream=True)(say("hey")) == "hey"
    for broken in (lambda: client(url, "m")(say("down")), lambda: client(url, "m")(say("broken")), lambda: client(url, "m", most_bytes=5)(say("long answer"))):
        with pytest.raises(OSError):
            broken()
    server.shutdown()


def test_metric_families(spark):
    requests = spark.createDataFrame([("s1", "mask", 200, 1.5), ("s1", "mask", 500, 30.0), ("s2", "odd", 200, None)], "system_id string, op string, status long, latency_ms double")
    masked = spark.createDataFrame([("s1", [("EMAIL",), ("BADGE",)]), ("s2", [])], "system_id string, replacements array<struct<type:string>>")
    leaks = spark.createDataFrame([([("PHONE",)],)], "leaks array<struct<type:string>>")
    lines = [[r.line for r in f.collect()] for f in sinks.families(requests, masked, leaks, spark.range(3))]
    flat = {x for family in lines for x in family}
    assert {'veilframe_requests_total{op="other",status="200"} 1', 'veilframe_errors_total{status="500"} 1', 'veilframe_latency_ms_bucket{le="+Inf"} 2', "veilframe_latency_ms_count 2", 'veilframe_found_total{type="custom"} 1', 'veilframe_payloads_total{changed="false"} 1', 'veilframe_leaks_total{type="PHONE"} 1', "veilframe_evicted_total 3"} <= flat
    assert len(lines) == 11 and all(x[1].startswith("# TYPE") for x in lines) and "veilframe_latency_ms_sum 31.5" in flat


def test_percentiles_from_a_summary(spark):
    values = spark.range(1, 1001).selectExpr("cast(id as double) as v")
    exact, rough = (metrics.percentiles(values, "v", a).first() for a in (None, 1000))
    assert all(abs(a - b) <= 2 for a, b in zip(exact, rough, strict=True))


def test_store_and_token_families(spark):
    decisions = spark.createDataFrame([("mask", True), ("mask", False), ("demask", False), ("echo", False), ("mask", True)], "operation string, stored boolean")
    flat = [r.line for f in sinks.store_families(decisions) for r in f.collect()]
    assert {"veilframe_store_puts_total 2", "veilframe_store_skipped_total 1", "veilframe_store_hits_total 1", "veilframe_store_misses_total 1", "veilframe_store_repeats_total 0"} <= set(flat)
    tokens = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 5L AS tokens_in, 7L AS tokens_out UNION ALL SELECT timestamp'2024-01-01 00:01:00', 10L, 20L")
    flat = [r.line for f in sinks.token_families(tokens) for r in f.collect()]
    assert {"veilframe_tokens_in_total 15", "veilframe_tokens_out_total 27", "veilframe_requests_per_second 0.1", "veilframe_tokens_per_second 3.0"} <= set(flat)


def test_sketches_stay_within_their_error_and_merge(spark):
    import random

    r = random.Random(2)
    rows = [(g, d, abs(r.lognormvariate(2, 2)) if g else float(r.randrange(1, 50))) for g in (0, 1) for d in range(3) for _ in range(400)]
    df = spark.createDataFrame([*rows, (1, 0, None), (1, 0, float("nan"))], "g int, d int, v double").repartition(5)
    whole, parts = metrics.sketch(df, "v", ["g"]), metrics.merged(metrics.sketch(df, "v", ["g", "d"]), ["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    quantiles = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = {(x.g, x.quantile): x.estimate for x in metrics.sketch_quantiles(parts, ["g"], quantiles).collect()}
    for g in (0, 1):
        ordered = sorted(v for h, _, v in rows if h == g)
        for q in quantiles:
            exact = ordered[int(q * (len(ordered) - 1))]
            assert abs(got[g, q] - exact) <= 0.01 * exact * (1 + 1e-9)
