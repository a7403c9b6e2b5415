"""Cue words and phrases as patterns, written as stems with the endings that a declension gives them.

A list is phrases divided by "|". In a word, "{x}" stands for all case endings of words whose basic form ends in x
(ENDINGS; "{}" is a masculine without an ending), "~" for any letters. So "дат{а} рождени{е}" is the phrase in every
case and number. A word is matched on its left edge, and on its right one unless it ends in "~" or a mark."""

from __future__ import annotations

import re

# the endings of a declension, by that of its basic form
ENDINGS = {
    "": ["", "а", "у", "ом", "ем", "е", "ы", "и", "ов", "ей", "ам", "ами", "ах"],
    "а": ["а", "ы", "и", "е", "у", "ой", "ою", "ей", "", "ам", "ами", "ах"],
    "я": ["я", "и", "е", "ю", "ей", "й", "ям", "ями", "ях"],
    "о": ["о", "а", "у", "ом", "е", "", "ам", "ами", "ах"],
    "е": ["е", "я", "ю", "ем", "и", "й", "ям", "ями", "ях"],
    "ь": ["ь", "я", "ю", "ем", "ём", "и", "ью", "е", "ей", "ям", "ями", "ях"],
    "ый": ["ый", "ий", "ой", "ого", "его", "ому", "ему", "ым", "им", "ом", "ем", "ая", "яя", "ей", "ую", "юю", "ое", "ее", "ые", "ие", "ых", "их", "ыми", "ими"],
}
SPACE = r"[ \t]{1,3}"


def word(text: str) -> str:
    """The pattern of one word of a phrase."""
    out = []
    for part in re.split(r"(\{[а-я]*\}|~)", text):
        if part == "~":
            out.append(r"\w*")
        elif part.startswith("{"):
            ends = sorted(ENDINGS[part[1:-1]], key=len, reverse=True)
            out.append("(?:" + "|".join(ends) + ")")
        else:
            out.append(re.escape(part))
    return "".join(out)


def pattern(text: str) -> str:
    """The pattern of a list of phrases, longer ones first."""
    made = []
    for phrase in sorted((p.strip() for p in text.split("|")), key=lambda p: (-len(p.split()), -len(p), p)):
        if phrase:
            last = phrase[-1]
            made.append(SPACE.join(map(word, phrase.split())) + (r"(?!\w)" if last.isalnum() or last == "}" else ""))
    return r"(?<!\w)(?:" + "|".join(made) + ")"


def phrases(text: str) -> re.Pattern:
    return re.compile(pattern(text))


def forms(text: str) -> frozenset[str]:
    """All words that a list of single words stands for, without "~"."""
    out = set()
    for w in (p.strip() for p in text.split("|")):
        stem, brace, rest = w.partition("{")
        out |= {stem + end for end in ENDINGS[rest[:-1]]} if brace else {w}
    return frozenset(out - {""})
