"""Detectors on sentences of our own: what is found, and what must stay as it is."""

import random
import re

import pytest

from veilframe.functions.types import NAMES
from veilframe.operators.detect import chunks, spans_of
from veilframe.operators.scan import SCANNERS, Context, Span, scan
from veilframe.operators.scan.context import compiled, evidence, order, resolve, scanner
from veilframe.operators import digits, native
from veilframe.operators.detect import detect
from veilframe.operators.scan.phrases import phrases
from veilframe.plans import cases

ALL = frozenset(NAMES)


@pytest.fixture(scope="module")
def found(spark):
    """found(texts, types): the spans of each text, as a list of sets of (category, value)."""

    def run(texts, types=NAMES):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string").coalesce(4)
        rows = detect(df, types=list(types)).select("i", "payload", "spans").collect()
        out = {r.i: [(s.type, r.payload.encode()[s.start : s.end].decode()) for s in r.spans if s.conf >= 0.7] for r in rows}
        return [out[i] for i in range(len(texts))]

    return run


POSITIVE = [
    ("Пишите на Marina.K+bank@Post.example.ru сегодня", {("EMAIL", "Marina.K+bank@Post.example.ru")}),
    ("Мой телефон 8 (916) 555-44-33", {("PHONE", "8 (916) 555-44-33")}),
    ("Номер карты 5555 5555 5555 4444, держатель OLEG VOLKOV", {("CARD_NUMBER", "5555 5555 5555 4444"), ("CARD_HOLDER", "OLEG VOLKOV")}),
    ("карта 4111111111111112", {("CARD_NUMBER", "4111111111111112")}),
    ("ИНН 500100732259", {("INN", "500100732259")}),
    ("Расчётный счёт 40817810099910004312", {("BANK_ACCOUNT", "40817810099910004312")}),
    ("IBAN DE89 3704 0044 0532 0130 00", {("BANK_ACCOUNT", "DE89 3704 0044 0532 0130 00")}),
    ("Код безопасности карты: 321", {("CVV", "321")}),
    ("мой пин-код 4821", {("PIN", "4821")}),
    ("СНИЛС 112-233-445 95", {("SNILS", "112-233-445 95")}),
    ("Свидетельство о рождении II-МЮ 654321", {("BIRTH_CERTIFICATE", "II-МЮ 654321")}),
    ("Военный билет АК 7654321", {("MILITARY_ID", "АК 7654321")}),
    ("Загранпаспорт 72 7654321", {("FOREIGN_PASSPORT", "72 7654321")}),
    ("Вид на жительство 82 номер 7654321".replace("82 номер ", ""), {("RESIDENCE_PERMIT", "7654321")}),
    ("Полис ОМС 7700 1122 3344 5566", {("OMS_POLICY", "7700 1122 3344 5566")}),
    ("Права 99 12 765432", {("DRIVER_LICENSE", "99 12 765432")}),
    ("Дата рождения 3 марта 1985", {("BIRTH_DATE", "3 марта 1985")}),
    ("Паспорт выдан 14.07.2011", {("PASSPORT_ISSUE_DATE", "14.07.2011")}),
    ("родилась 21091978", {("BIRTH_DATE", "21091978")}),
    ("Заявитель Кузнецова Ольга Игоревна", {("FIO", "Кузнецова Ольга Игоревна")}),
    ("Подпись: Кузнецов А.В.", {("FIO", "Кузнецов А.В.")}),
    ("паспорт серия 45 10 номер 765432", {("PASSPORT", "45 10"), ("PASSPORT", "765432")}),
    ("Гражданство: Казахстан", {("CITIZENSHIP", "Казахстан")}),
    ("Адрес: 170100, г. Тверь, ул. Садовая, д. 7, кв. 12", {("POSTAL_CODE", "170100"), ("CITY", "Тверь"), ("STREET", "Садовая"), ("HOUSE", "7"), ("APARTMENT", "12")}),
]


def test_found(found):
    for (text, want), got in zip(POSITIVE, found([t for t, _ in POSITIVE]), strict=True):
        assert want <= set(got), text


NEGATIVE = [
    "",
    "Напишите на info@shop.example.ru или support@sberbank.ru",
    "Горячая линия 8 800 555-35-35, экстренный номер 112",
    "Счёт-фактура 1234567890123 от поставщика",
    "Версия 10.12.2020 сборки, договор 45 от 01.02.2024",
    "Перечислено по 1234567 рублей",
    "Для сим-карты pin 4821",
    "Отделение банка: г. Тверь, ул. Садовая, д. 7",
    "Паспорт сделки 1234 567890",
    "Стихи Анны Ахматовой читали в школе",
    "ООО Кузнецов поставило товар",
    "Сумма 450000 рублей, скидка 12.05",
    "IP 192.168.10.25, артикул 4111-1111",
]


def test_left_alone(found):
    assert {t: got for t, got in zip(NEGATIVE, found(NEGATIVE), strict=True) if got} == {}


MORE = [
    ("Номер 4509 123456, код подразделения 770-001", {("PASSPORT", "4509 123456"), ("SUBDIVISION_CODE", "770-001")}),
    ("Клиент смирнов обратился в банк", {("FIO", "смирнов")}),
    ("OLEG VOLKOV", {("CARD_HOLDER", "OLEG VOLKOV")}),
    ("CARDHOLDER OLEG VOLKOV VALID THRU", {("CARD_HOLDER", "OLEG VOLKOV")}),
    ("Клиент 12.05.1990г.р.", {("BIRTH_DATE", "12.05.1990")}),
    ("Паспорт выдан ОВД г. Нижнего Тагила", {("PASSPORT_ISSUER", "ОВД г. Нижнего Тагила")}),
    ("Родилась в городе Рязань", {("BIRTH_PLACE", "городе Рязань")}),
]


def test_found_by_rule(found):
    for (text, want), got in zip(MORE, found([t for t, _ in MORE]), strict=True):
        assert set(got) == want, text


QUIET = ["Николай Гоголь, место рождения: Сорочинцы", "Отдел полиции сообщил о проверке", "Владелец счетов получил справку", "VISA GOLD CARD"]


def test_left_alone_by_rule(found):
    assert found(QUIET) == [[]] * len(QUIET)


def test_phrases_are_declined():
    p = phrases("дат{а} рождени{е} | счет{} | кред~ | д.р.")
    assert all(p.search(x) for x in ("дата рождения", "датой  рождения", "счетами", "по счету", "кредиты", "д.р. 1"))
    assert not any(p.search(x) for x in ("датарождения", "счетовод", "пересчет", "дата рожденияя"))
    assert p.search("нет, счета").group() == "счета"


@pytest.mark.parametrize("name", cases.FAMILIES)
def test_families(found, name):
    types, sentences = cases.FAMILIES[name]
    marked = [x.replace("{k}", key) for x in sentences for key in ("000123", "999999", "482193")]
    for x, got in zip(marked, found([cases.plain(m) for m in marked], types), strict=True):
        assert got == [p for p in cases.pieces(x) if p[0]], x


CUES = {
    "CARD_NUMBER": digits.CARD, "BANK_ACCOUNT": digits.ACCOUNT, "INN": digits.INN, "CVV": digits.CVV, "PIN": digits.PIN, "PHONE": digits.PHONE, "SNILS": digits.SNILS,
    "DRIVER_LICENSE": digits.LICENCE, "FOREIGN_PASSPORT": digits.ABROAD, "BIRTH_CERTIFICATE": digits.BIRTH, "MILITARY_ID": digits.MILITARY, "RESIDENCE_PERMIT": digits.RESIDENCE, "OMS_POLICY": digits.POLICY,
}


@pytest.mark.parametrize("kind", CUES)
def test_each_cue_stands_by_a_marked_value(kind):
    marked = [x.lower() for _, s in cases.FAMILIES.values() for x in s if f"[{kind}|" in x] + [t.lower() for t, want in POSITIVE if kind in {k for k, _ in want}]
    for one in CUES[kind].split("|"):
        assert any(re.search(one, x) for x in marked), one


def test_no_python_in_the_plans_of_numbers(spark):
    df = spark.createDataFrame([("x",)], "payload string")
    plan = detect(df, types=sorted(native.TYPES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "ArrowEvalPython" in detect(df, types=["FIO", "PHONE"])._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_long_tables(spark, found):
    """A text with thousands of numbers, and the same value found wherever it stands."""
    text = ", ".join(str(i) for i in range(3000)) + "; карта 4111 1111 1111 1111, " + "ё" * 50 + " инн 500100732259."
    assert found([text], ["CARD_NUMBER", "INN"]) == [[("CARD_NUMBER", "4111 1111 1111 1111"), ("INN", "500100732259")]]
    assert found(["", "12", "карта", "+", "4111 1111 1111 1111", "0"], sorted(native.TYPES))[4] == [("CARD_NUMBER", "4111 1111 1111 1111")]


def test_texts_without_evidence_hold_nothing(spark):
    """What the JVM keeps from Python is nothing: scanners find no category in texts that lack its evidence."""
    rng = random.Random(5)
    texts = [t for t, _ in POSITIVE + MORE] + NEGATIVE + [cases.plain(x) for _, (_, s) in cases.FAMILIES.items() for x in s]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bare = []
    for t in texts:
        for drop in ("[0-9]", "[\u0400-\u04ff]", "[@]", "[A-Z]", "[0-9\u0400-\u04ff]"):
            bare.append(re.sub(drop, rng.choice(["", "x"]), t))
    for t in texts + bare:
        ctx = Context(t, ALL)
        for types, f in SCANNERS.values():
            for s in f(ctx):
                assert compiled(evidence(frozenset([s.type]))).search(t), (s, t)
    from pyspark.sql import functions as F

    from veilframe.operators.detect import scanned

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts + bare)], "i int, t string").select("i", scanned(F.col("t"), NAMES).alias("s")).collect()
    assert all([tuple(x) for x in r.s] == [tuple(x) for x in spans_of((texts + bare)[r.i], ALL, 2025, {}, 64 << 10, 256)] for r in got)


def test_dense_addresses_take_linear_time():
    import time

    def seconds(n):
        ctx = Context("Адрес: г. Тверь, ул. Садовая, д. 7, кв. 12; " * n, ALL)
        began = time.process_time()
        scan(ctx)
        return time.process_time() - began

    seconds(20)
    assert seconds(1600) < 40 * max(seconds(100), 0.004)


@pytest.mark.parametrize("kinds", [NAMES[i::5] for i in range(5)])
def test_disabled_types_are_not_reported(found, kinds):
    text = " ".join(t for t, _ in POSITIVE)
    assert not {t for t, _ in found([text], ALL - set(kinds))[0]} & set(kinds)


def test_checksums_are_sensitive_to_each_digit(spark):
    from pyspark.sql import functions as F

    from veilframe.functions.checks import iban_valid, inn_valid, luhn

    card = "4111111111111111"
    wrong = [card[:i] + str((int(card[i]) + 1) % 10) + card[i + 1 :] for i in range(16)]
    got = spark.createDataFrame([(x,) for x in [card, *wrong]], "x string").select(luhn("x")).collect()
    assert [r[0] for r in got] == [True] + [False] * 16
    row = spark.range(1).select(inn_valid(F.lit("500100732259")), inn_valid(F.lit("7707083893")), inn_valid(F.lit("1111111111")), iban_valid(F.lit("de89370400440532013000"))).first()
    assert list(row) == [True, True, False, True]


def brute(spans):
    kept = []
    for s in sorted(spans, key=order):
        if not any(s.start < k.end and k.start < s.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


@pytest.mark.parametrize("n", [0, 1, 5, 47, 48, 49, 400])
def test_resolution_is_brute_force(n):
    rng = random.Random(n)
    spans = []
    for _ in range(n):
        a = rng.randrange(200)
        spans.append(Span(a, a + rng.randrange(1, 12), rng.choice(NAMES + ["OWN"]), rng.choice([0.6, 0.8, 0.9]), "t"))
    kept = resolve(spans)
    assert kept == brute(spans)
    assert all(a.end <= b.start for a, b in zip(kept, kept[1:], strict=False))


def test_native_resolution_is_the_same(spark):
    from pyspark.sql import functions as F

    from veilframe.functions.types import SPANS
    from veilframe.operators import spans as S

    rng = random.Random(3)
    rows = []
    for _ in range(60):
        spans = []
        for _ in range(rng.randrange(30)):
            a = rng.randrange(60)
            spans.append(Span(a, a + rng.randrange(1, 12), rng.choice(NAMES + ["OWN"]), rng.choice([0.6, 0.8, 0.9]), "t"))
        rows.append((spans,))
    for n, reach in ((1000, 3000), (8000, 250_000), (8000, 16_000)):  # many spans in a row
        rows.append(([Span(a, a + rng.randrange(1, 60), rng.choice(NAMES), rng.choice([0.6, 0.8, 0.9]), "t") for a in (rng.randrange(reach) for _ in range(n))],))
    df = spark.createDataFrame([([tuple(s) for s in r[0]],) for r in rows], f"spans {SPANS}")
    got = [[Span(*s) for s in r.k] for r in df.select(S.resolve(F.col("spans")).alias("k")).collect()]
    assert got == [brute(r[0]) for r in rows]


def test_an_entity_on_a_chunk_boundary_is_found_once():
    text = "слово " * 900 + "Клиент Смирнов Иван Петрович. " + "слово " * 900
    whole = spans_of(text, ALL, 2025, {}, 1 << 20, 256)
    for size in (10_000, 10_860, 10_880, 11_200):
        assert spans_of(text, ALL, 2025, {}, size, 256) == whole


def test_chunks_cover_the_text_and_keep_characters_whole():
    text = "ё" * 1000 + "\n" + "日本" * 500
    parts = chunks(text, 300, 40)
    data = text.encode()
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1].encode()) == len(data)
    end = 0
    for at, part in parts:
        assert at <= end and data[at:].startswith(part.encode()) and len(part.encode()) <= 344
        end = at + len(part.encode())


def test_scanner_names_are_unique():
    with pytest.raises(ValueError):
        scanner(next(iter(SCANNERS)))(lambda ctx: [])


def test_long_payloads_take_linear_time():
    import time

    def seconds(n):
        text = ("Клиент Кузнецов Олег, тел. +7 916 555-44-33, 12.05.1990; " * n)[: n * 50]
        began = time.process_time()
        scan(Context(text, ALL))
        return time.process_time() - began

    seconds(50)
    assert seconds(1600) < 40 * max(seconds(100), 0.004)


NUMBERS_SIDE_BY_SIDE = [
    ("ie 70.154.107.238 und 80.121.189.156 an", []),
    ("de +1 (669) 555-8484 38.203.63.148 as", [("PHONE", "+1 (669) 555-8484")]),
    ("de 38.203.63.148 +1 (669) 555-8484", [("PHONE", "+1 (669) 555-8484")]),
    ("+1 (866) 555-4354 4749986894262300 er", [("PHONE", "+1 (866) 555-4354"), ("CARD_NUMBER", "4749986894262300")]),
    ("+1 (866) 555-4354erüß +1 (518) 555-0532", [("PHONE", "+1 (866) 555-4354"), ("PHONE", "+1 (518) 555-0532")]),
    ("10.0.0.1 916 555 44 33 10.0.0.2", [("PHONE", "916 555 44 33")]),
    ("Звоните 8.916.123.45.67 или +7.916.123.45.67", [("PHONE", "8.916.123.45.67"), ("PHONE", "+7.916.123.45.67")]),
]


def test_phones_beside_addresses_and_numbers(found):
    texts = [t for t, _ in NUMBERS_SIDE_BY_SIDE]
    assert found(texts, ["PHONE", "CARD_NUMBER"]) == [want for _, want in NUMBERS_SIDE_BY_SIDE]
