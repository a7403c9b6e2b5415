"""Addresses: streets, cities, houses, flats, postal codes, countries. Markers are never part of a span."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from veilframe.operators.scan.context import CYRILLIC, Context, Span, nearest, scanner
from veilframe.operators.scan.lexicon import STOP, Lexicon
from veilframe.operators.scan.phrases import pattern, phrases

# fixed values: address markers
STREET = "улица улице улицы улицу улицей улицам ул проспект проспекте проспекта проспекту проспектом просп пр-т пр-кт переулок переулке переулка переулку бульвар бульваре бульвара бульвару б-р шоссе набережная набережной набережную наб площадь площади проезд проезде проезду тупик аллея аллее тракт тракте микрорайон микрорайоне мкр мкрн территория снт".split()
STREET_DOT = "пер ш пл туп пр".split()
CITY = "г город городе городу пгт село селе деревня деревне посёлок поселок посёлке поселке ст-ца станица станице хутор рп".split()
CITY_DOT = "гор с дер пос х".split()
REGION = "область обл области областью край края крае краю республика республике республики респ район районе района р-н округ округе".split()
HOUSE = "д дом дома дому доме влад вл владение владении домовладение".split()
CORPUS = "корп корпус корпусе строение строении литера литер".split()
CORPUS_DOT = "к стр лит".split()
FLAT = "кв квартира квартире квартиру кв-ра офис офисе апартаменты помещение пом".split()
FLAT_DOT = "оф апарт".split()
CONNECTORS = frozenset(["имени", "маршала"])
REGION_ENDS = ("ская", "ский", "ской", "скую", "цкая", "цкий", "цкой", "ского", "ском")
GENERIC = phrases("городск{ый} | районн{ый}")

# what says that an address follows, or that a person lives or gets something there
LIVES = "живёт | живу | прожива~ | мест{о} жительства"
GETS = "доставк{а}"
REGISTERED = "зарегистрирован{а}"
ANCHOR = phrases(f"адрес~ | address | индекс~ | урожен~ | {LIVES} | {GETS} | {REGISTERED}")
RESIDENCE = phrases(LIVES)
PERSONAL = phrases(f"{LIVES} | {GETS} | {REGISTERED}")
# places of a bank, a shop or an office; an office with a number is a flat's counterpart, not an organisation
PLACES = "филиал{} | банкомат{} | магазин{} | склад{}"
OFFICE = r"(?:доп\.? ?|дополнительн\w+ |операционн\w+ |головн\w+ |центральн\w+ )офис\w*|офис\w{0,3} (?:банк\w*|в|на|по)"
BANK = re.compile(r"(?<!\w)(?:" + pattern("отделени{е} | банкомат{} | филиал{}") + rf"|(?:{OFFICE})(?!\w))")
# such a place as a sentence's subject, with adjectives and pronouns before it, unless it is a customer's
SUBJECT = re.compile(r"^\W*(?:(?:наш|ваш|этот|эта|это|\w+(?:ый|ий|ой|ая|яя|ое|ее|ые|ие|ша|ше|ши)) ){0,3}(?:" + pattern(f"{PLACES} | офис{{}}") + ")(?! (?:" + "|".join(["клиент", "заказчик", "покупател", "получател", "сотрудник", "работник", "пользовател", "арендатор", "владел"]) + "))")
OWNER = phrases("адрес~ банка")

NAME = r"(?:[0-9]{1,3}-?(?:й|я|ая|ой|го|е)? )?[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)*"
VALUE = r"[0-9]{1,4}(?:[а-яёА-ЯЁ](?![а-яёА-ЯЁ]))?(?:[0-9]{1,3})?(?:[/-][0-9]{1,4}[а-яё]?)?"


def marker(words: list[str], dotted: list[str]) -> str:
    plain = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    short = "|".join(sorted(map(re.escape, dotted), key=len, reverse=True))
    return rf"(?:(?:{plain})\.?" + (rf"|(?:{short})\." if dotted else "") + ")"


POSTAL = re.compile(r"(?<![\w-])([0-9]{6})(?![\w-]| ?(?:руб|₽|шт|\$|€|usd|eur|тенге))")
POSTAL_CUE = phrases("индекс~ | почтов{ый} | zip | postal~ | postcode~")
OPAQUE = re.compile(r"(?<!\w)адрес[а-яё]*(?: (?:проживания|регистрации|доставки|прописки))?[ \t]*[:—–-][ \t]*([^\n;]{10,220}?)(?=[.;\n]\s|[.;\n]?$)")

M_STREET, M_CITY, M_REGION = marker(STREET, STREET_DOT), marker(CITY, CITY_DOT), marker(REGION, [])
M_HOUSE, M_CORPUS, M_FLAT = marker(HOUSE, []), marker(CORPUS, CORPUS_DOT), marker(FLAT, FLAT_DOT)
WORD_NAME = r"(?:[0-9]{1,3}(?:-?[а-яё]{1,2})? )?[а-яё][а-яё-]+(?: [а-яё][а-яё-]+){0,2}"
STREET_AFTER = re.compile(rf"(?<!\w){M_STREET} ?(?!\w*\.)({WORD_NAME}|[0-9]{{1,3}}(?: [а-яё-]+){{1,2}})")
STREET_BEFORE = re.compile(rf"(?<!\w)([а-яё][а-яё-]+(?:ая|ий|ой|ый|ую|ому|ом|его|ого|яя|ей)) {M_STREET}(?!\w)")
CITY_AFTER = re.compile(rf"(?<!\w){M_CITY} ?({WORD_NAME})")
REGION_BEFORE = re.compile(rf"(?<!\w)([а-яё-]+(?:{'|'.join(REGION_ENDS)})) {M_REGION}(?!\w)")
REGION_AFTER = re.compile(r"(?<!\w)(?:республик[аеи]|респ\.?) ([а-яё-]+)")
HOUSE_AFTER = re.compile(rf"(?<!\w){M_HOUSE} ?(?:№ ?)?({VALUE})(?!\w)", re.I)
CORPUS_AFTER = re.compile(rf"(?<!\w){M_CORPUS} ?([0-9]{{1,3}}[а-яё]?|[а-яё])(?!\w)")
FLAT_AFTER = re.compile(rf"(?<!\w){M_FLAT} ?(?:№ ?)?([0-9]{{1,4}}[а-яё]?)(?!\w)")
BARE_HOUSE = re.compile(r", ?([0-9]{1,3}[а-яё]?)(?:-([0-9]{1,4}))?(?!\w|[./][0-9]| ?(?:год|руб|шт|%|лет|мин|км))")
CHAIN = re.compile(rf"(?<!\w)({NAME}), ({NAME}),? ([0-9]{{1,3}}[а-яё]?)(?:-([0-9]{{1,4}}))?(?!\w)")


class Part(NamedTuple):
    start: int
    end: int
    type: str
    alone: bool  # can stand without a second component
    lives: bool  # "lives in" is enough for it
    hint: str = ""


@scanner("address", "CITY", "STREET", "HOUSE", "APARTMENT", "POSTAL_CODE", "COUNTRY", "ADDRESS", needs=CYRILLIC)
def addresses(ctx: Context):
    lexicon = Lexicon.of(ctx.dictionaries.get("words", ()))
    parts = settle(sorted(components(ctx, lexicon), key=lambda p: (p.start, -p.end)))
    spans = []
    for p in parts:
        conf, hint = judged(ctx, p, parts)
        if conf:
            spans.append(Span(p.start, p.end, p.type, conf, "address", p.hint or hint))
    yield from spans
    if "ADDRESS" in ctx.enabled:
        for m in OPAQUE.finditer(ctx.lower):
            value = m[1].rstrip(" .,")
            a, b = m.start(1), m.start(1) + len(value)
            if any(c.isdigit() for c in value) and len(value.split()) >= 2 and not any(a < s.end and s.start < b for s in spans) and not bank(ctx, a) and "@" not in value:
                yield Span(a, b, "ADDRESS", 0.90, "address", "opaque")


def cased(ctx: Context, a: int, b: int) -> int:
    """The end of a name from a to b: its words are capitals, but for connecting words and endings."""
    if ctx.case_blind:
        first = re.match(r"(?:[0-9]+(?:-?[а-яё]{1,2})? )?[\w-]+", ctx.lower[a:b])
        return a + first.end() if first else a
    end = a
    for m in re.finditer(r"[\w-]+", ctx.text[a:b]):
        w = m[0]
        if not (w[0].isupper() or w[0].isdigit() or w.lower() in CONNECTORS) or w.lower() in STOP:
            break
        end = a + m.end()
    return end


def components(ctx: Context, lexicon: Lexicon):
    t = ctx.lower
    for pattern, kind in ((STREET_AFTER, "STREET"), (CITY_AFTER, "CITY")):
        for m in pattern.finditer(t):
            end = cased(ctx, m.start(1), m.end(1))
            if end > m.start(1) and not (kind == "CITY" and m[0].startswith("г ") and not ctx.text[m.start(1)].isupper()):
                yield Part(m.start(1), end, kind, True, kind == "CITY")
    for m in STREET_BEFORE.finditer(t):
        if ctx.case_blind or ctx.text[m.start(1)].isupper():
            yield Part(*m.span(1), "STREET", True, False)
    for pattern in (REGION_BEFORE, REGION_AFTER):
        for m in pattern.finditer(t):
            if not GENERIC.fullmatch(m[1]) and (ctx.case_blind or ctx.text[m.start(1)].isupper()):
                yield Part(*m.span(1), "CITY", False, False, "region")
    for m in HOUSE_AFTER.finditer(t):
        yield Part(*m.span(1), "HOUSE", True, False)
    for m in CORPUS_AFTER.finditer(t):
        yield Part(*m.span(1), "HOUSE", False, False, "corpus")
    for m in FLAT_AFTER.finditer(t):
        yield Part(*m.span(1), "APARTMENT", True, False)
    for m in CHAIN.finditer(ctx.text):
        if m[1].lower() in lexicon.cities:
            yield Part(*m.span(1), "CITY", False, True)
            yield Part(*m.span(2), "STREET", True, False, "chain")
            yield Part(*m.span(3), "HOUSE", True, False, "chain")
            if m[4]:
                yield Part(*m.span(4), "APARTMENT", True, False, "chain")
    words = ctx.words
    for i, (a, b, w) in enumerate(words):
        if not (ctx.case_blind or ctx.text[a].isupper()):
            continue
        two = f"{w} {words[i + 1][2]}" if i + 1 < len(words) and t[b : words[i + 1][0]] == " " else ""
        if two in lexicon.cities:
            yield Part(a, words[i + 1][1], "CITY", False, True, "name")
        elif w in lexicon.cities and len(w) > 3:
            yield Part(a, b, "CITY", False, True, "name")
        if two in lexicon.countries:
            yield Part(a, words[i + 1][1], "COUNTRY", False, False)
        elif w in lexicon.countries:
            yield Part(a, b, "COUNTRY", False, False)
    for m in POSTAL.finditer(t):
        cued = POSTAL_CUE.search(ctx.left(m.start(), 40))
        leading = re.match(rf",? ?(?:росси|рф|{M_CITY} ?[а-яё]|{M_STREET}|[а-яё-]+(?:ская|ский|ской) )", t[m.end() : m.end() + 60]) or re.match(r", ?([а-яё-]+)", t[m.end() : m.end() + 60]) and re.match(r", ?([а-яё-]+)", t[m.end() : m.end() + 60])[1] in lexicon.cities
        trailing = re.search(rf"(?:{M_HOUSE}|{M_FLAT}|{M_STREET}|{M_CORPUS}) ?[^.;\n]{{1,18}}, ?$", ctx.left(m.start(), 40))
        if cued or leading or trailing:
            yield Part(*m.span(1), "POSTAL_CODE", bool(cued), False)
    ends = [cased(ctx, m.start(1), m.end(1)) for m in STREET_AFTER.finditer(t)]
    ends += [m.end() for m in STREET_BEFORE.finditer(t) if ctx.case_blind or ctx.text[m.start(1)].isupper()]
    for end in ends:
        n = BARE_HOUSE.match(t, end)
        if n:
            yield Part(*n.span(1), "HOUSE", True, False, "bare")
            if n[2]:
                yield Part(*n.span(2), "APARTMENT", True, False, "bare")


def settle(parts: list[Part]) -> list[Part]:
    """One part for each place; of overlapping ones the longer, or the first found by a marker. Kept parts don't
    overlap, so only the neighbours of a place can."""
    kept: list[Part] = []
    for p in sorted(parts, key=lambda p: (-(p.end - p.start), not p.alone, p.start)):
        i = bisect_left(kept, (p.start,))
        if (i == 0 or kept[i - 1].end <= p.start) and (i == len(kept) or p.end <= kept[i].start):
            kept.insert(i, p)
    return kept


def judged(ctx: Context, p: Part, parts: list[Part]) -> tuple[float, str]:
    """The confidence of a component: anchored, beside another component, or a place of residence. parts by place."""
    pair = lambda q: q.type != p.type or p.hint == "corpus" or q.type == "CITY" and (q.hint == "region") != (p.hint == "region")
    at = bisect_left(parts, (p.start,))
    around = parts[max(0, at - 31) : at] + parts[at + 1 : at + 32]  # 60 bytes hold no more parts
    beside = [q for q in around if pair(q) and 0 <= max(q.start, p.start) - min(q.end, p.end) <= 60 and len(ctx.lower[min(q.end, p.end) : max(q.start, p.start)].encode()) <= 60]
    if bank(ctx, p.start):
        return 0, ""
    anchored = ANCHOR.search(ctx.left(p.start, 120)) is not None
    if p.hint == "corpus" and not any(q.type == "HOUSE" for q in beside):
        return 0, ""
    if p.alone or beside:
        if anchored:
            return 0.95, "anchored"
        if beside:
            return 0.80, "neighbour"
        return 0, ""
    if p.lives and RESIDENCE.search(ctx.left(p.start, 60)):
        return 0.90, "residence"
    return 0, ""


def bank(ctx: Context, at: int) -> bool:
    """Whether the address is an organisation's: named closer than a person, or the sentence's subject."""
    window = ctx.left(at, 200)
    b, p = nearest(BANK, window), nearest(PERSONAL, window)
    if b and (p is None or p.start() < b.start()) and "\n\n" not in window[b.end() :]:
        return True
    start, _ = ctx.sentence(at, at)
    head = ctx.lower[start:at]
    return bool(SUBJECT.search(head) or OWNER.search(window))
