"""Dates of birth and of passport issue: shapes of dates, classified by what stands around them."""

from __future__ import annotations

import re
from calendar import monthrange
from typing import NamedTuple

from veilframe.operators.scan.context import CYRILLIC, DIGIT, Context, Span, nearest, resolve, scanner
from veilframe.operators.scan.phrases import pattern, phrases

# fixed values: stems and endings of the month names
MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "ма": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}
ENGLISH = "january february march april may june july august september october november december".split()
MONTH = r"(январ[ьяеюём]+|феврал[ьяеюём]+|март[аеуом]*|апрел[ьяеюём]+|ма[йяеюём]+|июн[ьяеюём]+|июл[ьяеюём]+|август[аеуом]*|сентябр[ьяеюём]+|октябр[ьяеюём]+|ноябр[ьяеюём]+|декабр[ьяеюём]+|янв|фев|мар|апр|авг|сент?|окт|ноя|дек|" + "|".join(ENGLISH) + r"|ммм)"
MONTH_STEM = re.compile("|".join(MONTHS))
NUMERIC = re.compile(r"(?<![\w./-])([0-9]{1,4}) {0,3}([./-]) {0,3}([0-9]{1,2}) {0,3}\2 {0,3}([0-9]{1,4})(?![./-]?(?!г\.)[\w])")
SPACED = re.compile(r"(?<![\w./-])([0-9]{1,2}) ([0-9]{1,2}) ((?:19|20)[0-9]{2})(?![\w])")
TEXTUAL = re.compile(rf"(?<!\w)«?([0-9]{{1,2}})»?(?:-?(?:го|ое|е|st|nd|rd|th))?[ .]{{1,3}}{MONTH}\.?(?:[ ,]{{1,3}}([0-9]{{4}}|[0-9]{{2}}(?= ?г)))?(?!\w)")
WORDED = re.compile(rf"(?<!\w)([а-яё]+(?: [а-яё]+)?) {MONTH}(?: ((?:[а-яё]+ ){{0,5}}[а-яё]+))?(?!\w)")
COMPACT = re.compile(r"(?<![\w.])([0-9]{8})(?![\w.]*[0-9])")
DAY_MONTH = re.compile(r"(?<![\w./-])([0-9]{1,2})[./ ]([0-9]{1,2})(?![./-]?[\w])")
YEAR_ONLY = re.compile(r"(?<![\w./-])((?:19|20)[0-9]{2}) ?(?:г\. ?р\.?|г\.р|года рождения|год рождения|г\. рождения)")

# what tells a date of birth or of issue: field names, verbs and participles, abbreviations
FIELD_BIRTH = "дат{а} рождени{е} | год{} рождени{е} | дат{а} рожд"
FIELD_ISSUE = "дат{а} выдач{а}"
BORN = "рождени{е} | рожден | рожден{а} | рождён | рождён{а} | родил~ | д.р. | г.р."
ISSUED = "выдач{а} | выдан | выдан{а}"
ENGLISH_BIRTH, ENGLISH_ISSUE = "date of birth | birth date | birthday | dob | born", "date of issue | issue date | issued"
BIRTH, ISSUE = phrases(f"{FIELD_BIRTH} | {BORN} | {ENGLISH_BIRTH}"), phrases(f"{FIELD_ISSUE} | {ISSUED} | {ENGLISH_ISSUE}")
LABEL_BIRTH, LABEL_ISSUE, ISSUE_VERB = phrases(FIELD_BIRTH), phrases(FIELD_ISSUE), phrases(ISSUED.replace("выдач{а} | ", ""))
BIRTH_RIGHT = re.compile(r"[ ,(]{0,3}" + pattern(f"{FIELD_BIRTH} | рождени{{е}} | г.р~ | г. р~").removeprefix(r"(?<!\w)"))
# what has a date of its own in this package's own sentences
NEGATIVE = phrases("договор{} | заявк{а}")
NEGATIVE_RIGHT = re.compile(r" {0,2}(?:[%₽$]|руб|коп|usd|eur)")
# two numbers after these are a series, a house and its building and the like
IDENTIFIER = phrases("сери{я} | дом{} | кв")
NUMBER_RIGHT = re.compile(r"[ ,]{0,3}(?:№|номер|no)")
NAME = re.compile(r"[а-яё]+(?:ович|евич|ич|овна|евна|ична)[а-яё]{0,2}[\s,(]{1,3}$")
BREAK = re.compile(r"[.!?;\n](?=\s|$)")

UNITS = {"перв": 1, "втор": 2, "трет": 3, "четвёрт": 4, "четверт": 4, "пят": 5, "шест": 6, "седьм": 7, "восьм": 8, "девят": 9, "десят": 10, "одиннадцат": 11, "двенадцат": 12, "тринадцат": 13, "четырнадцат": 14, "пятнадцат": 15, "шестнадцат": 16, "семнадцат": 17, "восемнадцат": 18, "девятнадцат": 19, "двадцат": 20, "тридцат": 30}
CARDINALS = {"тысяча": 1000, "две": 0, "два": 0, "тысячи": 2000, "тысячного": 2000, "двухтысячного": 2000, "девятьсот": 900, "двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90}
TENS = {"сороков": 40, "пятидесят": 50, "шестидесят": 60, "семидесят": 70, "восьмидесят": 80, "девяност": 90}
ORDINAL_END = re.compile(r"(?:ого|его|ое|ье|ый|ий|ой|ьего)$")


class Found(NamedTuple):
    start: int
    end: int
    year: int | None
    kind: str  # full, compact, day_month, year


def ordinal(word: str) -> int | None:
    stem = ORDINAL_END.sub("", word)
    if stem == word:
        return None
    return UNITS.get(stem) or TENS.get(stem)


def word_day(words: str) -> int | None:
    parts = words.split()
    day = ordinal(parts[-1])
    if day and len(parts) > 1 and parts[-2] in ("двадцать", "тридцать") and day < 10:
        day += CARDINALS[parts[-2]]
    return day if day and day <= 31 else None


def word_year(words: str) -> tuple[int, int] | None:
    """A spelled year and how many words it takes."""
    total, used = 0, 0
    for w in words.split():
        if w in CARDINALS:
            total, used = total + CARDINALS[w], used + 1
            continue
        last = ordinal(w)
        if last:
            total, used = total + last, used + 1
        break
    return (total, used) if 1900 <= total <= 2100 else None


def month_of(word: str) -> int:
    if word in ENGLISH:
        return ENGLISH.index(word) + 1
    if word == "ммм":
        return 1
    for stem, number in MONTHS.items():
        if word.startswith(stem) and stem != "ма" or stem.startswith(word):
            return number
    return 5 if word.startswith("ма") else 0


def full_year(text: str, ref: int) -> int:
    year = int(text)
    if len(text) <= 2:
        return year + (ref // 100 * 100 if year <= ref % 100 else ref // 100 * 100 - 100)
    return year


def plausible(day: int, month: int, year: int, ref: int) -> bool:
    return 1900 <= year <= ref + 1 and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]


def calendar_year(a: str, b: str, c: str, ref: int) -> int | None:
    """The year of three numbers that are a date in some order."""
    x, y, z = int(a), int(b), int(c)
    if len(a) == 4:
        return x if plausible(z, y, x, ref) or plausible(y, z, x, ref) else None
    if len(a) > 2 or len(c) not in (2, 4):
        return None
    year = full_year(c, ref)
    return year if plausible(x, y, year, ref) or plausible(y, x, year, ref) else None


def shapes(ctx: Context):
    t, ref = ctx.lower, ctx.ref_year
    for m in NUMERIC.finditer(t):
        year = calendar_year(m[1], m[3], m[4], ref)
        if year:
            yield Found(m.start(), m.end(), year, "full")
    for m in SPACED.finditer(t):
        if plausible(int(m[1]), int(m[2]), int(m[3]), ref):
            yield Found(m.start(), m.end(), int(m[3]), "full")
    for m in TEXTUAL.finditer(t):
        month, year = month_of(m[2]), full_year(m[3], ref) if m[3] else None
        if month and plausible(int(m[1]), month, year or 2000, ref):
            yield Found(m.start(), m.end(3) if m[3] else m.end(2), year, "full" if m[3] else "day_month")
    for m in WORDED.finditer(t) if MONTH_STEM.search(t) else ():
        day, start = word_day(m[1]), m.start(1)
        if not day:
            continue
        parts = m[1].split()
        if len(parts) == 2 and parts[0] not in ("двадцать", "тридцать"):
            start += len(parts[0]) + 1
        year = word_year(m[3]) if m[3] else None
        end = m.start(3) + len(" ".join(m[3].split()[: year[1]])) if year else m.end(2)
        yield Found(start, end, year[0] if year else None, "compact")
    for m in COMPACT.finditer(t):
        d = m[1]
        if plausible(int(d[:2]), int(d[2:4]), int(d[4:]), ref) or plausible(int(d[6:]), int(d[4:6]), int(d[:4]), ref):
            yield Found(m.start(), m.end(), None, "compact")
    for m in DAY_MONTH.finditer(t):
        if plausible(int(m[1]), int(m[2]), 2000, ref) and not IDENTIFIER.search(ctx.left(m.start(), 16)) and not NUMBER_RIGHT.match(t, m.end()):
            yield Found(m.start(), m.end(), None, "day_month")
    for m in YEAR_ONLY.finditer(t):
        yield Found(m.start(1), m.end(1), int(m[1]), "year")


@scanner("dates", "BIRTH_DATE", "PASSPORT_ISSUE_DATE", needs=f"{DIGIT}|{CYRILLIC}")
def dates(ctx: Context):
    spans = []
    for f in shapes(ctx):
        kind, conf = classify(ctx, f)
        if kind:
            spans.append(Span(f.start, f.end, kind, conf, "dates", f.kind))
    spans = resolve(spans)
    yield from propagated(ctx, spans)


def classify(ctx: Context, f: Found) -> tuple[str | None, float]:
    """The category and confidence of a date, by its surroundings."""
    if f.kind == "year":
        return "BIRTH_DATE", 0.90
    left = ctx.left(f.start, 60)
    if NEGATIVE_RIGHT.match(ctx.lower, f.end):
        return None, 0
    birth, issue, negative = (nearest(p, left) for p in (BIRTH, ISSUE, NEGATIVE))
    places = {k: m.end() for k, m in (("BIRTH_DATE", birth), ("PASSPORT_ISSUE_DATE", issue)) if m}
    best = max(places, key=places.get) if places else None
    if best and not (negative and negative.end() > places[best]) and not BREAK.search(left[places[best] :].lstrip(".")[:-1] if f.kind == "day_month" else ""):
        return best, 0.95
    far = ctx.left(f.start, 160)
    if not best:
        for kind, pattern, size in (("BIRTH_DATE", LABEL_BIRTH, 96), ("PASSPORT_ISSUE_DATE", LABEL_ISSUE, 96), ("PASSPORT_ISSUE_DATE", ISSUE_VERB, 160)):
            m = nearest(pattern, ctx.left(f.start, size))
            if m and not re.search(r"[0-9;,.!?\n](?!\s*[а-яё])|[;,!?\n]", ctx.left(f.start, size)[m.end() :]) and f.kind != "compact":
                return kind, 0.95
    if BIRTH_RIGHT.match(ctx.lower, f.end):
        return "BIRTH_DATE", 0.90
    if f.kind in ("compact", "day_month") or negative:
        return None, 0
    if f.year and ctx.ref_year - f.year >= 14 and NAME.search(far):
        return "BIRTH_DATE", 0.78
    if f.year and ctx.ref_year - f.year < 14:
        return None, 0
    return "BIRTH_DATE", 0.60


def propagated(ctx: Context, spans: list[Span]):
    """A bare date whose nearest anchored date is one of birth, close by and in one sentence, is one as well."""
    sure = [s for s in spans if s.conf >= 0.85 and s.hint != "day_month"]
    for s in spans:
        if s.conf == 0.60 and sure and len(spans) <= 64:
            near = min(sure, key=lambda o: gap(s, o))
            a, b = min(s.end, near.end), max(s.start, near.start)
            text = ctx.lower[a:b]
            if near.type == "BIRTH_DATE" and len(text.encode()) <= 96 and not BREAK.search(text):
                s = s._replace(conf=0.80, hint="propagated")
        yield s


def gap(a: Span, b: Span) -> int:
    return max(a.start, b.start) - min(a.end, b.end)
