"""Queries that SQL can't say, and relational operators, against plain Python."""

import random
import re
from datetime import date

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from veilframe.functions import calendar, scrub
from veilframe.functions.types import NAMES
from veilframe.operators.detect import chunks, detect, detect_long, register_chunks, spans_of
from veilframe.operators.relational import nearest
from veilframe.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ALL = frozenset(NAMES)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"pii_all_types", "text_chunks", "text_chunks_udtf"}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def numbers(text):
    """E-mail addresses, solid or spaced cards and phones in brackets, in plain Python: what the given documents hold."""
    low = text.lower()
    found = [("EMAIL", m.span()) for m in re.finditer(r"(?<![\w.+-])[a-z0-9][a-z0-9._+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}(?!\w)", low)]
    found = [f for f in found if low[slice(*f[1])].split("@")[0] not in ("info", "admin", "support", "sales", "hr", "contact", "help", "office", "press", "noreply")]
    found += [("CARD_NUMBER", m.span()) for m in re.finditer(r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![\w-])", low) if luhn(re.sub("[ -]", "", m[0]))]
    return found + [("PHONE", m.span()) for m in re.finditer(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?!\d)", low)]


def test_all_types(spark, documents):
    want = {}
    for d in documents.values():
        kinds = [s.type for s in spans_of(d.text, ALL, 2025, {}, 64 << 10, 256) if s.conf >= 0.7] + [k for k, _ in numbers(d.text or "")]
        for kind in kinds:
            want[d.source, kind] = want.get((d.source, kind), 0) + 1
    assert {(r.source, r.type): r.n for r in QUERIES["pii_all_types"](spark, SF).collect()} == want and want


@pytest.mark.parametrize("name", ["text_chunks", "text_chunks_udtf"])
def test_text_chunks(spark, documents, name):
    got = {r.key: (r.n, r.longest) for r in QUERIES[name](spark, SF).collect()}
    want = {}
    for d in documents.values():
        data, at, out = (d.text or "").encode(), 0, []
        while len(data) - at > 4096:  # cut at the last newline, else the last space, of the window's last quarter
            window = data[at : at + 4096]
            cut = max(window.rfind(b"\n", 3072), -1)
            cut = cut if cut >= 0 else window.rfind(b" ", 3072)
            cut = at + cut + 1 if cut >= 0 else at + 4096
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append((at, cut))
            at = cut
        out.append((at, len(data)))
        sizes = []
        for a, b in out:
            back = max(0, a - 64)
            while back and data[back] & 0xC0 == 0x80:
                back -= 1
            sizes.append(b - back)
        want[d.doc_id] = (len(sizes), max(sizes))
    assert got == want


def test_scrub_lines(spark, documents):
    extra = ["Пётр Иванов a.b@c.ru, +7 916 123-45-67; 12 34 56", "x1234567y Anna-Maria Lee 999-99", "", "100 200 300 400 8 (495) 010-99-99", "карта 4276 3801 2345 6789", "+7 (916) 555 44 33 и 1234567"]
    rules = [
        (r"[\p{L}0-9._%+-]+@[\p{L}0-9.-]+\.\p{L}{2,}", "email"),
        (r"(?:\+7|\b8)[\s()-]*[0-9][0-9\s()-]{7,}[0-9]", "phone:"),
        (r"\b[0-9]{3,4}(?:[ -][0-9]{2,4})+\b", "digits:"),
        (r"[0-9]{6,}", "digits:"),
        (r"\p{Lu}\p{L}+(?:[ .\u00a0]+\p{Lu}\p{L}+)+", "name"),
    ]

    def brute(t):
        for pattern, mark in rules:
            t = regex.sub(pattern, lambda m: f"[{mark}{sum(c.isdigit() for c in m[0]) if mark[-1] == ':' else ''} redacted]", t, flags=regex.ASCII if "b" in pattern else 0)  # noqa: B023
        return t

    got = {r.doc_id: r.line for r in QUERIES["scrub_lines"](spark, SF).collect()}
    assert got == {i: brute(d.text) for i, d in documents.items()}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in extra], "t string").select(scrub.scrub("t")).collect()] == [brute(x) for x in extra]
    assert brute(extra[4]) == "карта [digits:16 redacted]" and brute(extra[5]) == "[phone:11 redacted] и [digits:7 redacted]"


def test_long_documents_are_scanned_as_rows(spark):
    text = "слово и дело, почта ivan.p@mail.ru, тел. +7 916 123-45-67. " * 400
    rows = [(1, text), (2, None), (3, "почта a.bcd@mail.ru"), (4, "")]
    df = spark.createDataFrame(rows, "id int, payload string")
    whole = {r.id: [tuple(s) for s in r.spans or []] for r in detect(df, types=NAMES, size=1 << 30).collect()}
    for size in (1000, 1333, 1 << 20):
        got = {r.key: [tuple(s) for s in r.spans] for r in detect_long(df, "id", types=NAMES, size=size).collect()}
        assert got == whole and len(whole[1]) == 800
    register_chunks(spark)
    parts = spark.sql("SELECT * FROM text_chunks('один два три четыре', 12, 4)").collect()
    assert [(r.offset, r.chunk) for r in parts] == chunks("один два три четыре", 12, 4)


@pytest.mark.parametrize("cell", [3, 50, 10**6])
@pytest.mark.parametrize("within", [None, 9])
def test_nearest(spark, cell, within):
    rng = random.Random(cell)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.randrange(-80, 200), None]) if rng.random() < 0.1 else rng.randrange(-80, 200), i) for i in range(300)]
    right = [(rng.choice([1, 2, None]), rng.randrange(-80, 200), f"r{i}") for i in range(60)]
    got = nearest(spark.createDataFrame(left, "key int, at int, id int"), spark.createDataFrame(right, "key int, at int, name string"), "key", "at", ["name"], cell, within).collect()
    assert len(got) == len(left)
    for r in got:
        near = sorted((abs(a - r.at), a) for k, a, _ in right if k == r.key) if r.key is not None and r.at is not None else []
        near = [x for x in near if within is None or x[0] <= within]
        assert (r.near.at if r.near else None) == (near[0][1] if near else None)
        assert r.near is None or any(k == r.key and a == r.near.at and n == r.near.name for k, a, n in right)


def test_calendar(spark):
    rows = ["31.12.1999", "29.02.2023", "29.02.2024", "1/2/30", "1/2/25", "1/2/26", "2020-02-30", "2020-2-3", "3-2-2020", "1.2/2020", "00.01.2000", "1.1.1", "", None, "12.13.2000"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(calendar.numeric_date("t", 2025)).collect()]
    assert got == [date(1999, 12, 31), None, date(2024, 2, 29), date(1930, 2, 1), date(2025, 2, 1), date(1926, 2, 1), None, date(2020, 2, 3), date(2020, 2, 3), None, None, None, None, None, None]
    assert spark.range(1).select(calendar.date_of(F.lit(5), F.lit(7), F.lit(1990))).first()[0] == date(1990, 7, 5)


#: Texts in which an address touches the next word, with no blank between them.
GLUED = ["ie hsr.29@mail5.example.comerüß x", "ie hsr.29@mail5.example.coméner x", "ie hsr.29@mail5.example.com7 x", "a.long@b-c.com_ b.long@b-c.com38.203.63.148", "hsr.29@mail5.example.com", "keine", ""]


def by_sql(spark, folder, name, texts):
    """A query's rows over documents of these texts, and its SQL's."""
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    documents = duckdb.sql(f"SELECT * FROM '{folder}/documents.parquet/*.parquet'")  # noqa: F841  the SQL's table
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect())), sorted(duckdb.sql(ORACLES[name]).fetchall())


def test_an_address_that_touches_a_word_is_labelled_whole(spark, tmp_path):
    got, want = by_sql(spark, tmp_path, "pii_label_emails", GLUED)
    assert got == want and len(got) == 5


def test_an_address_that_touches_a_word_is_masked_whole(spark, tmp_path):
    got, want = by_sql(spark, tmp_path, "pii_mask_emails", GLUED)
    assert got == want and len(got) == len(GLUED)


#: Role mailboxes, capitals, Cyrillic domains, addresses inside each other or glued to what stands before them, letters of
#: other widths in lower case, letters of two halves.
SPELT = ["info@example.com INFO@x.org", "a@sberbank.ru", "Hsr.29@mail5.example.com hsr.29@mail5.example.com", "HSR.29@MAIL5.EXAMPLE.COM"]
SPELT += ["ab.1@почта.рф", "ab.1@mail.exampleпочта.com", "éab.2@x.com, xab.2@x.com, _ab.2@x.com ab.2@x.com", "xab.2@x.com ab.2@x.com x"]
SPELT += ["ab.2@x.com ab.2@x.co", "ẞ ab@x.com Ⱥ ab.3@y.com ab@x.com", "\U0001d400ab@x.com", None, "x\u0001y a.1@x.com", "a@b.cc $1 \\1 a@b.cc"]


def test_addresses_are_masked_wherever_the_sql_does(spark, tmp_path):
    got, want = by_sql(spark, tmp_path, "pii_mask_emails", SPELT)
    assert got == want and len(got) == len(SPELT)
