"""The internal passport: number, subdivision, issuer, birth place; and citizenship."""

from __future__ import annotations

import re
from bisect import bisect_left

from veilframe.operators.scan.context import CYRILLIC, DIGIT, Context, Span, nearest, scanner
from veilframe.operators.scan.lexicon import Lexicon, same_stem
from veilframe.operators.scan.phrases import ENDINGS, forms, pattern, phrases

# what names a passport, what only sounds like one, and what names another document
ANCHOR = re.compile(r"(?<!\w)(?:паспорт(?!\w*уш)[а-яё]*|пасп\.|серия|серии|passports?|удостоверени[ея] личности|документ[а-яё]*,? удостоверяющ(?:ий|ие) личность|(?<!№ )(?<!номер )п/п)(?!\w)")
METAPHOR = re.compile(r"[ \t]*" + pattern("сделк{а} | издели{е} | безопасност{ь}"))
OTHER = phrases("загран~ | водительск~ | в/у | прав{о} | военн{ый} | военник~ | свидетельств{о} | снилс~ | инн | полис~ | омс | внж | рвп | на жительство | удостоверени{е} водит~ | карт{а} | счет~ | счёт~ | договор~ | страхов~ | телефон~")

D = r"[ \t]{0,3}"
NUMBER = re.compile(rf"(?<![\w.-])(?:[0-9]{{2}}{D}[0-9]{{2}}{D}(?:№{D})?[0-9]{{6}}|[0-9]{{4}}{D}[0-9]{{3}}{D}[0-9]{{3}}|[0-9]{{2}}-[0-9]{{2}}[ -][0-9]{{6}}|[0-9]{{4}}-[0-9]{{6}}|[0-9]{{2}} ?[0-9]{{2}}(?: [0-9]{{2}}){{3}}|[0-9]{{10}})(?![\w-]|\.[0-9])")
LABELLED = re.compile(rf"(?<!\w)(?:сер(?:ия|ии|\.)|с\.){D}[:№]?{D}([0-9]{{2}}{D}[0-9]{{2}})(?![0-9])([^0-9]{{0,40}}?)(?:номер[а-я]*|ном\.|н\.|№|#|n){D}[:.]?{D}([0-9]{{6}})(?![0-9])")
SERIES = re.compile(rf"(?<!\w)(?:сер(?:ия|ии|\.)){D}:?{D}([0-9]{{2}}{D}[0-9]{{2}})(?![0-9])")
NUMERO = re.compile(rf"(?<!\w)(?:номер|ном\.|№){D}:?{D}([0-9]{{6}})(?![0-9])")
PAIR = re.compile(r"(?<![\w.-])[0-9]{2} ?[0-9]{2} (?:№ ?)?[0-9]{6}(?![\w-]|\.[0-9])")
BARE = re.compile(r"\s*([0-9]{2} ?[0-9]{2} [0-9]{6})\s*")

CODE_LABELLED = re.compile(r"(?<!\w)(?:код[а-я]* подразделени[яйе]|код[а-я]* подр\.?|к/п|код органа)[ \t:—–№-]{0,6}([0-9]{3}[ -]?[0-9]{3})(?![0-9])")
CODE = re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{3})(?![\w-])")

# fixed values: abbreviations of the bodies that issue passports
STRONG = frozenset("мвд омвд умвд гумвд увмд овд ровд рувд увд гувд фмс уфмс оуфмс туфмс овм оувм увм гувм мро пвс овир mvd omvd ovd uvd ufms".split())
AUTHORITY = re.compile(r"(?<!\w)(?:" + "|".join(sorted(STRONG, key=len, reverse=True)) + r"|отдел\w*|управлени\w*|служб\w*)(?!\w)")
# a department is such a body if its name says of what
HEADS = frozenset(f"{stem}{end}" for stem, ends in (("отдел", ENDINGS[""]), ("отделени", ENDINGS["е"]), ("управлени", ENDINGS["е"]), ("служб", ENDINGS["а"])) for end in ends)
MATTERS = phrases("внутренн{ый} | полици{я}")
# shortened adjectives and bodies before the abbreviation of a body; whole adjectives are told by their ending
SHORT = frozenset("гу ту мо мп тп мро пвс пункт пункта".split())
ADJECTIVE_END = re.compile(r"(?:(?:ск|ч?н|ов|ев)(?:ый|ий|ой|ое|ая|ого|ому|ым|ом|ую|ие|ые|им)|о)$")
# what follows an issuer: the fields of a document, and what an office does when it is a sentence's subject
FIELDS = phrases("дат{а} | выдач{а} | код{} | подразделени{е} | зарегистрирован | зарегистрирован{а} | прожива~ | адрес{} | паспорт{} | сери{я} | номер{} | снилс | инн | телефон{} | мест{о} | рождени{е} | гражданств{о} | выдан | выдан{а} | выдано | выданы")
VERB_END = re.compile(r"[а-яё]{2,}(?:(?:[аеиыуя]л|[чкзс]л)(?:а|о|и)?|[аяуюе]ет|[ауюя]ют|[ие]т|[ая]т)(?:ся|сь)?$")
ABBREVIATED = frozenset("г гор обл окр респ р-н рн пос им тер мкр ул пер с д п мо спб".split())
# words of an issuer's name that alone name nobody
PLACE_WORDS = frozenset("край края краю крае".split()) | forms("город{} | район{} | округ{} | област{ь} | республик{а} | росси{я}") | frozenset("г гор рф".split())
GLUE = PLACE_WORDS | frozenset("в и на по имени дел".split())
ISSUED = re.compile(r"(?<!\w)(?:выдан[а-яё]{0,3}|кем выдан[ао]?|орган,? выдавший(?: документ)?|issued by)(?!\w)[ \t:—–-]{0,4}")
ITEM = re.compile(r"№ ?[0-9]+|[0-9]+(?!\w)|[\w-]+|[«»\"]|[.,;:!?\n()]", re.U)

BIRTH_STEM = re.compile(pattern("мест{о} рождени{е} | родился | родился в | родилась | родилась в | уроженец | уроженц{} | уроженк{а} | place of birth") + r"[ \t:—–-]{0,4}")
# kinds of places and states, which a birth place may have in lower case, and the fields that follow it
BIRTH_WORDS = PLACE_WORDS | forms("сел{о} | деревн{я} | посёлок | поселок | посёлк{} | поселк{} | станиц{а} | хутор{} | аул{} | федераци{я} | казахстан{}") | frozenset("в д дер нп обл п пгт пос р-н респ рн рп с ст х ао ссср рсфср".split())
BIRTH_STOPS = forms("дат{а} | паспорт{} | сери{я} | номер{} | выдан | выдан{а} | зарегистрирован{а} | зарегистрирован | гражданств{о} | адрес{} | телефон{} | снилс | инн") | frozenset("а и но проживает проживающий".split())

CITIZEN_STEM = re.compile(pattern("гражданств{о} | гражданин | гражданин{а} | гражданк{а} | подданств{о} | citizenship | citizen of | nationality") + r"[ \t:—–-]{0,4}")
# fixed values: names of states that aren't countries of the lexicon
CITIZEN_VALUES = frozenset("ссср рб рк республика республики российское российской российская российскую российского сша russia russian usa belarus kazakhstan ukraine китая израиль".split())
CITIZEN_TAILS = phrases("федераци{я} | республик{а} | беларус{ь} | казахстан{} | союз{} | federation")
# "украинское гражданство": an adjective of a country right before it
ADJECTIVE = re.compile(r"(?<!\w)([а-яё]{4,}ск(?:ое|ого|им|ому|ий|ая|ой|ую)) (?:гражданств|подданств)")
NO_COUNTRY = re.compile("иностран|двойн|советск|почетн|почётн")


ISSUER_EVIDENCE = re.compile(f"{CYRILLIC}|(?i:issued|ovd|uvd|ufms|mvd)")


@scanner(
    "passport",
    "PASSPORT",
    "SUBDIVISION_CODE",
    "PASSPORT_ISSUER",
    "BIRTH_PLACE",
    "CITIZENSHIP",
    needs={"PASSPORT": DIGIT, "SUBDIVISION_CODE": DIGIT, "PASSPORT_ISSUER": ISSUER_EVIDENCE.pattern, "BIRTH_PLACE": f"{CYRILLIC}|(?i:place of birth)", "CITIZENSHIP": f"{CYRILLIC}|(?i:citizen|nationality)"},
)
def passport(ctx: Context):
    on = ctx.enabled
    anchors = [m.span() for m in ANCHOR.finditer(ctx.lower) if not METAPHOR.match(ctx.lower, m.end())]
    issuers = list(issued_by(ctx, anchors)) if ISSUER_EVIDENCE.search(ctx.text) else []
    if "PASSPORT" in on:
        yield from numbers(ctx, anchors, issuers)
    yield from issuers
    if "SUBDIVISION_CODE" in on:
        yield from codes(ctx, issuers)
    if "BIRTH_PLACE" in on:
        yield from birth_places(ctx)
    if "CITIZENSHIP" in on:
        yield from citizenships(ctx)


def numbers(ctx: Context, anchors: list[tuple[int, int]], issuers: list[Span]):
    near = lambda a, b: any(0 <= len(ctx.lower[e:a].encode()) <= 60 and e <= a or 0 <= len(ctx.lower[b:s].encode()) <= 60 and s >= b for s, e in anchors)
    found: list[tuple[int, int]] = []
    for m in LABELLED.finditer(ctx.lower):
        if not other_document(ctx, m.start()):
            found += [m.span(1), m.span(3)]
            yield Span(*m.span(1), "PASSPORT", 0.98, "passport", "series")
            yield Span(*m.span(3), "PASSPORT", 0.98, "passport", "number")
    free = lambda a, b: all(b <= x or a >= y for x, y in found)
    for m in NUMBER.finditer(ctx.lower):
        a, b = m.span()
        if free(a, b) and near(a, b) and not other_document(ctx, a):
            found.append((a, b))
            yield Span(a, b, "PASSPORT", 0.98, "passport", "joined")
    for pattern, hint in ((SERIES, "series"), (NUMERO, "number")):
        for m in pattern.finditer(ctx.lower):
            if free(*m.span(1)) and near(*m.span(1)) and not other_document(ctx, m.start()):
                yield Span(*m.span(1), "PASSPORT", 0.98, "passport", hint)
    if issuers or CODE_LABELLED.search(ctx.lower):  # who issued it, or where, says what the number is
        for m in PAIR.finditer(ctx.lower):
            if free(*m.span()) and not other_document(ctx, m.start()):
                found.append(m.span())
                yield Span(*m.span(), "PASSPORT", 0.90, "passport", "corroborated")
    m = BARE.fullmatch(ctx.lower)
    if m and free(*m.span(1)):
        yield Span(*m.span(1), "PASSPORT", 0.90, "passport", "payload")


def other_document(ctx: Context, at: int) -> bool:
    """Whether the nearest document named on the left is another one."""
    window = ctx.left(at, 80)
    other, own = nearest(OTHER, window), nearest(ANCHOR, re.sub(r"сери[яи]", "     ", window))
    return other is not None and (own is None or own.start() < other.start())


def codes(ctx: Context, issuers: list[Span]):
    seen = set()
    for m in CODE_LABELLED.finditer(ctx.lower):
        seen.add(m.start(1))
        yield Span(*m.span(1), "SUBDIVISION_CODE", 0.95, "passport", "label")
    for m in CODE.finditer(ctx.lower):
        if m.start(1) in seen:
            continue
        beside = any(0 <= m.start(1) - s.end <= 30 or 0 <= s.start - m.end(1) <= 10 for s in issuers)
        if beside or ctx.lower.strip() == m[1]:
            yield Span(*m.span(1), "SUBDIVISION_CODE", 0.90, "passport", "authority" if beside else "payload")


def ends(ctx: Context, at: int, w: str) -> bool:
    """Whether a word ends an issuer's name: a field's label, or a verb - in lower case, and no department."""
    return bool(FIELDS.fullmatch(w)) or w not in HEADS and not w.startswith(("раздел", "филиал")) and not ctx.text[at].isupper() and predicate(w)


def predicate(w: str) -> bool:
    return len(w) > 4 and VERB_END.fullmatch(w) is not None


def walk(ctx: Context, at: int, limit: int):
    """The words of a name from a place on: (start, end, word), to a stop, a sentence's end or the limit."""
    end = at + limit
    for m in ITEM.finditer(ctx.lower, at):
        w = m[0]
        if m.end() > end or len(ctx.lower[at : m.end()].encode()) > limit:
            return
        if w in ".,;:!?\n()":
            before = ctx.lower[max(0, m.start() - 8) : m.start()].split()
            if w == "." and before and before[-1].lstrip("(") in ABBREVIATED:
                continue
            return
        if ends(ctx, m.start(), w):
            return
        if w in "«»\"":
            continue
        yield m.start(), m.end(), w


def issued_by(ctx: Context, anchors: list[tuple[int, int]]):
    taken: list[tuple[int, int]] = []
    for m in ISSUED.finditer(ctx.lower):
        at = m.end()
        date = re.match(r"[ \t]*[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}(?: г\.?)?[ \t,]*", ctx.lower[at : at + 30])
        at += date.end() if date else 0
        items = trimmed(list(walk(ctx, at, 160)))
        words = [w for _, _, w in items]
        if len([w for w in words if w not in GLUE]) >= 2 and authority(words):
            taken.append((items[0][0], items[-1][1]))
            yield Span(items[0][0], items[-1][1], "PASSPORT_ISSUER", 0.85, "passport", "issued")
    heads = list(AUTHORITY.finditer(ctx.lower))
    places = [a for a, _, _ in ctx.words] if heads else []
    for m in heads:
        i = bisect_left(places, m.start())
        if i == len(places) or places[i] != m.start():
            continue
        a, b, w = ctx.words[i]
        if any(a < y and x < b for x, y in taken) or not (w in STRONG or w in HEADS and any(MATTERS.fullmatch(x[2]) for x in ctx.words[i + 1 : i + 3])):
            continue
        start = a
        for x, y, left in reversed(ctx.words[max(0, i - 4) : i]):
            if not (left in HEADS or left in SHORT or ADJECTIVE_END.search(left)) or not ctx.lower[y:start].isspace():
                break
            start = x
        items = trimmed(list(walk(ctx, start, 160)))
        if len(items) < 2:
            continue
        a, b = items[0][0], items[-1][1]
        after = re.match(r"\W*(\w+)", ctx.lower[b : b + 30])
        if after is not None and predicate(after[1]) and not FIELDS.fullmatch(after[1]) and not anchors:
            continue
        if anchors or re.fullmatch(r"\s*" + re.escape(ctx.lower[a:b]) + r"\s*[.]?\s*(?:[0-9]{3}-[0-9]{3})?\s*", ctx.lower) or CODE.search(ctx.lower, b, b + 30):
            taken.append((a, b))
            yield Span(a, b, "PASSPORT_ISSUER", 0.80, "passport", "authority")


def authority(words: list[str]) -> bool:
    return any(w in STRONG or w in ("загс", "загса", "загсом", "мфц", "гибдд", "консульством", "консульство", "посольством", "посольство") for w in words) or any(w in HEADS for w in words) and any(MATTERS.fullmatch(w) for w in words)


def trimmed(items: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    while items and items[-1][2] in ("в", "по", "на", "и", "от", "с"):
        items.pop()
    while items and items[-1][2].isdigit():
        items.pop()
    return items


def birth_places(ctx: Context):
    for m in BIRTH_STEM.finditer(ctx.lower):
        if m[0].startswith("родил") and not m[0].rstrip().endswith(" в") or famous_before(ctx, m.start()):
            continue
        items = []
        for a, b, w in walk_commas(ctx, m.end(), 100):
            if w in BIRTH_STOPS or w[0].isdigit():
                break
            if not (w in BIRTH_WORDS or ctx.case_blind or ctx.text[a].isupper()):
                break
            items.append((a, b, w))
        while items and items[0][2] == "в":
            items.pop(0)
        while items and items[-1][2] in ("в", "г", "гор"):
            items.pop()
        if items and any(w not in BIRTH_WORDS for _, _, w in items):
            yield Span(items[0][0], items[-1][1], "BIRTH_PLACE", 0.80, "passport", "stem")


def famous_before(ctx: Context, at: int) -> bool:
    """Whether the sentence names a well-known person on the left: their birth place is no secret."""
    start, _ = ctx.sentence(max(0, at - 200), at)
    said = [w for a, b, w in ctx.words if start <= a and b <= at and at - a <= 200]
    famous = Lexicon.of(ctx.dictionaries.get("words", ())).famous
    return any(all(any(same_stem(w, p) for w in pair) for p in person) for pair in zip(said, said[1:], strict=False) for person in famous)


def walk_commas(ctx: Context, at: int, limit: int):
    for m in ITEM.finditer(ctx.lower, at):
        if len(ctx.lower[at : m.end()].encode()) > limit or m[0] in ";:!?\n()«»\"":
            return
        if m[0] == ".":
            before = ctx.lower[max(0, m.start() - 8) : m.start()].split()
            if not (before and before[-1].lstrip("(") in ABBREVIATED):
                return
            continue
        if m[0] != ",":
            yield m.start(), m.end(), m[0]


def citizenships(ctx: Context):
    values = CITIZEN_VALUES | Lexicon.of(ctx.dictionaries.get("words", ())).countries
    for m in ADJECTIVE.finditer(ctx.lower):
        if not NO_COUNTRY.match(m[1]):
            yield Span(*m.span(1), "CITIZENSHIP", 0.90, "passport", "adjective")
    for m in CITIZEN_STEM.finditer(ctx.lower):
        first = re.match(r"(?:—|–|-|:)?\s*([\w-]+)", ctx.lower[m.end() : m.end() + 60])
        if not first or first[1] not in values:
            continue
        start = m.end() + first.start(1)
        end = m.end() + first.end(1)
        while True:
            more = re.match(r"(?: |/| / )([\w-]+)", ctx.lower[end : end + 40])
            if not more or not (CITIZEN_TAILS.fullmatch(more[1]) or "/" in more[0] and more[1] in values):
                break
            end += more.end()
        yield Span(start, end, "CITIZENSHIP", 0.90, "passport", "stem")
