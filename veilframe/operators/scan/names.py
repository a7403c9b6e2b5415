"""Names of people, and of card holders in Latin letters."""

from __future__ import annotations

import re

from veilframe.operators.scan.context import CYRILLIC, Context, Span, cue, nearest, scanner
from veilframe.operators.scan.lexicon import LEGAL, STOP, Lexicon, is_patronymic, same_stem, surname_shape

WORD = re.compile(r"[а-яё]+(?:-[а-яё]+)*")
# stems that introduce a person in this package's own sentences; the strong ones name a client
STRONG = cue(["клиент", "заявител", "заёмщик", "получател", "отправител", "плательщи", "владел", "на имя"])
ANCHOR = cue(["директор", "подпис", "имя", "от", "пациент"])
FULL_NAME = re.compile(r"ф\. ?и\. ?о\.?[ :—–-]*$")
LABEL = re.compile(r"(?:фио|ф\. ?и\. ?о\.?|имя|фамилия|клиент|заявитель|получатель|плательщик|владелец|держатель|заемщик|заёмщик|отправитель)[ \t]*[:—–-][ \t]*$")
# what says that a mention is of a public person or a place
NEGATIVE = cue(["поэт", "писател", "ул.", "им."])
GEO = frozenset("город улица проспект".split())
ABBREVIATIONS = frozenset(["т.е", "т.д"])
AMBIGUOUS = frozenset("г д".split())

S = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
INITIALS_FIRST = re.compile(rf"(?<!\w)([А-ЯЁ])\. ?(?:([А-ЯЁ])\. ?)?({S})(?!\w)")
INITIALS_LAST = re.compile(rf"(?<!\w)({S})\s{{1,3}}([А-ЯЁ])\. ?(?:([А-ЯЁ])\.)?(?!\w)")

HOLDER_CUE = re.compile(r"держател|владел[а-яё]+ карт|holder|card|на карте|карт[аеуы]|картой")
CAPITALS = re.compile(r"(?<!\w)[A-Z]+(?:\.? [A-Z]+|-[A-Z]+)+(?!\w)")
# Latin capitals near a card that are no name
LATIN_NOISE = frozenset("and bank card cardholder mastercard of the thru valid visa world".split())
# endings of Russian and Ukrainian surnames in Latin letters
LATIN_SURNAME = re.compile(r".{2,}(?:ov|ova|ev|eva|yov|in|ina|yn|yna|sky|skiy|skii|skaya|enko|chuk|uk|yan|dze|shvili)$")


class Words:
    """The Cyrillic words of a text with what the dictionaries and endings say of each."""

    def __init__(self, ctx: Context, lexicon: Lexicon):
        self.ctx, self.lex = ctx, lexicon
        self.items = [(m.start(), m.end(), m[0]) for m in WORD.finditer(ctx.lower) if not ctx.lower[m.start() - 1 : m.start()].isalnum()]

    def loose(self, i: int, n: int) -> bool:
        """Whether n words without capitals are a given name and a patronymic, perhaps with a surname."""
        w = [x[2] for x in self.items[i : i + n]]
        if len(w) < n or any(x in STOP for x in w):
            return False
        first, last = (w[1], w[2]) if n == 3 else w
        return first in self.lex.first and is_patronymic(last) and (n == 2 or surname_shape(w[0])) and self.joined(i, i + n - 1)

    def capital(self, i: int) -> bool:
        return self.ctx.case_blind or self.ctx.text[self.items[i][0]].isupper()

    def kind(self, i: int) -> str:
        """first, patronymic, surname or '' of a capitalised word."""
        if not 0 <= i < len(self.items):
            return ""
        w = self.items[i][2]
        if not self.capital(i) or len(w) < 2 or w in STOP or w in LEGAL:
            return ""
        plain = w.replace("ё", "е")
        if w in self.lex.first or plain in self.lex.first:
            return "first"
        if is_patronymic(w):
            return "patronymic"
        if w in self.lex.surnames or all(surname_shape(p) or p in self.lex.surnames for p in w.split("-")):
            return "surname"
        return ""

    def joined(self, i: int, j: int) -> bool:
        """Whether the words from i to j follow each other with white space only."""
        return all(re.fullmatch(r"\s{1,3}", self.ctx.lower[self.items[k][1] : self.items[k + 1][0]]) for k in range(i, j))


@scanner("names", "FIO", "CARD_HOLDER", needs={"FIO": CYRILLIC, "CARD_HOLDER": "[A-Z]\\.? [A-Z]{2}"})
def names(ctx: Context):
    lexicon = Lexicon.of(ctx.dictionaries.get("words", ()))
    if "FIO" in ctx.enabled and re.search("[а-яё]", ctx.lower):
        yield from people(ctx, lexicon)
    if "CARD_HOLDER" in ctx.enabled:
        yield from holders(ctx, lexicon)


def people(ctx: Context, lexicon: Lexicon):
    words = Words(ctx, lexicon)
    taken: list[tuple[int, int]] = []
    for m in INITIALS_FIRST.finditer(ctx.text):
        first, second, surname = m[1].lower(), (m[2] or "").lower(), m[3].lower()
        if f"{first}.{second}" in ABBREVIATIONS or surname in STOP or vetoed(ctx, m.start(), m.end(), lexicon, (surname, first)):
            continue
        before = words_before(ctx, m.start())
        if not second and (before in GEO or first in AMBIGUOUS and not surname_shape(surname) or surname in lexicon.cities and first == "г"):
            continue
        taken.append(m.span())
        yield Span(m.start(), m.end(), "FIO", 0.95 if second else 0.85 if first in AMBIGUOUS else 0.90, "names", "initials-surname")
    for m in INITIALS_LAST.finditer(ctx.text):
        surname = m[1].lower()
        if any(m.start() < b and a < m.end() for a, b in taken) or surname in STOP or vetoed(ctx, m.start(), m.end(), lexicon, (surname, m[2].lower())):
            continue
        if not m[3] and not surname_shape(surname) and surname not in lexicon.surnames:
            continue
        taken.append(m.span())
        yield Span(m.start(), m.end(), "FIO", 0.95 if m[3] else 0.90, "names", "surname-initials")
    i, n = 0, len(words.items)
    while i < n:
        kinds = [words.kind(k) for k in range(i, i + 3)]
        step, conf, hint = 1, 0.0, ""
        if kinds[0] and i + 2 < n and words.joined(i, i + 2) and kinds in (["surname", "first", "patronymic"], ["first", "patronymic", "surname"], ["first", "surname", "patronymic"]):
            step, conf, hint = 3, 0.98, "three"
        elif i + 2 < n and kinds[2] == "patronymic" and words.joined(i, i + 2) and words.capital(i) and words.capital(i + 1) and kinds[0] in ("surname", "first") and words.items[i + 1][2] not in STOP:
            step, conf, hint = 3, 0.98, "three"
        elif i + 1 < n and kinds[0] and words.joined(i, i + 1) and {kinds[0], kinds[1]} in ({"first", "patronymic"}, {"first", "surname"}, {"surname", "patronymic"}):
            step, conf, hint = 2, 0.90, "two"
        elif words.loose(i, 3):
            step, conf, hint = 3, 0.90, "three"
        elif i + 1 < n and kinds[0] == "surname" and words.joined(i, i + 1) and words.capital(i + 1) and words.items[i + 1][2] not in STOP and not ctx.case_blind and strong(ctx, words.items[i][0]):
            step, conf, hint = 2, 0.80, "pair"
        elif kinds[0] == "surname" and anchored(ctx, words.items[i][0]):
            conf, hint = 0.75, "surname"
        elif kinds[0] and LABEL.search(ctx.left(words.items[i][0], 48)):
            conf, hint = 0.88, "label"
        elif not kinds[0] and words.items[i][2] in lexicon.common and introduced(ctx, words.items[i][0]):
            conf, hint = 0.75, "surname"
        elif kinds[0] == "first" and strong(ctx, words.items[i][0]):
            conf, hint = 0.82, "anchor"
        elif kinds[0] in ("first", "surname") and not ctx.case_blind and ctx.text.strip() == ctx.text[words.items[i][0] : words.items[i][1]]:
            conf, hint = 0.93, "payload"
        if conf:
            a, b = words.items[i][0], words.items[i + step - 1][1]
            parts = tuple(w for _, _, w in words.items[i : i + step])
            if not any(a < y and x < b for x, y in taken) and not vetoed(ctx, a, b, lexicon, parts):
                taken.append((a, b))
                yield Span(a, b, "FIO", conf, "names", hint)
        i += step


def words_before(ctx: Context, at: int) -> str:
    found = re.findall(r"[а-яё]+", ctx.left(at, 40))
    return found[-1] if found else ""


def anchored(ctx: Context, at: int) -> bool:
    window = " ".join(re.split(r"[.!?;\n]\s", ctx.left(at, 40))[-1].split()[-4:])
    return bool(STRONG.search(window) or ANCHOR.search(window))


def strong(ctx: Context, at: int) -> bool:
    return bool(FULL_NAME.search(ctx.left(at, 24)) or STRONG.search(re.split(r"[.!?;\n]\s", ctx.left(at, 60))[-1]))


def introduced(ctx: Context, at: int) -> bool:
    """Whether a client's role or a phrase that calls for a name stands right before a place."""
    window = re.split(r"[.!?;,\n]", ctx.left(at, 60))[-1]
    m = nearest(STRONG, window)
    return m is not None and len(window[m.end() :].split()) <= 1


def vetoed(ctx: Context, start: int, end: int, lexicon: Lexicon, parts: tuple[str, ...]) -> bool:
    """Whether the name is a public person's, a street's or a company's."""
    window = re.split(r"[.!?;\n]\s", ctx.left(start, 80))[-1]
    close = " ".join(window.split()[-3:])
    m = nearest(NEGATIVE, close)
    if m and not STRONG.search(close[m.end() :]):
        return True
    if words_before(ctx, start) in LEGAL or len(parts) == 1 and re.search(r"[«\"]\s*$", window):
        return True
    follows = re.match(r"\s([а-яё]+)", ctx.lower[end : end + 30])
    if follows and ctx.text[end + 1 : end + 2].isupper():
        parts = (*parts, follows[1])
    stems = [p[:-1] if p[-1] in "ауыеюя" else p for p in parts]
    known = any(all(any(same_stem(s, p) for s in stems) for p in person) for person in lexicon.famous) if len(parts) > 1 else False
    return known and not strong(ctx, start)


def holders(ctx: Context, lexicon: Lexicon):
    for run in CAPITALS.finditer(ctx.text):
        group: list[re.Match] = []
        for m in [*re.finditer(r"[A-Z]+\.?", run[0]), None]:
            if m is not None and m[0].rstrip(".").lower() not in LATIN_NOISE:
                group.append(m)
                continue
            if 2 <= len(group) <= 3 and sum(len(x[0].rstrip(".")) > 1 for x in group) >= 2 and len(group[-1][0]) > 1:
                yield from holder(ctx, lexicon, run.start() + group[0].start(), run.start() + group[-1].end(), [x[0].rstrip(".").lower() for x in group])
            group = []


def holder(ctx: Context, lexicon: Lexicon, start: int, end: int, parts: list[str]):
    left, right = ctx.left(start, 120), ctx.right(end, 40)
    carded = re.search(r"(?:[0-9][ -]?){13,19}", left) or re.search(r"(?:[0-9][ -]?){13,19}", right)
    known = any(p in lexicon.latin for p in parts)
    if HOLDER_CUE.search(left) or carded:
        yield Span(start, end, "CARD_HOLDER", 0.95 if known else 0.85, "names", "holder")
    elif ctx.text.strip() == ctx.text[start:end] and (known or len(parts) == 2 and any(LATIN_SURNAME.fullmatch(p) for p in parts)):
        yield Span(start, end, "CARD_HOLDER", 0.85, "names", "payload")
