"""What scanners see of a text, and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache
from typing import NamedTuple

from veilframe.functions.types import CUSTOM_PRIORITY, PRIORITY


class Span(NamedTuple):
    start: int
    end: int
    type: str
    conf: float
    src: str
    hint: str = ""


SPACES = str.maketrans({c: " " for c in "      "})
TOKEN = re.compile(r"\w+(?:-\w+)*", re.U)
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")


def safe_lower(text: str) -> str:
    """Lower case with the same number of characters and bytes."""
    low = text.lower()
    if len(low) == len(text) and len(low.encode()) == len(text.encode()):
        return low
    return "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) and len(c.lower()) == 1 else c for c in text)


@dataclass
class Context:
    text: str
    enabled: frozenset[str]
    ref_year: int = 2025
    dictionaries: dict = field(default_factory=dict)

    @cached_property
    def lower(self) -> str:
        return safe_lower(self.text).translate(SPACES)

    @cached_property
    def case_blind(self) -> bool:
        """Whether capitals tell nothing: there are none, or there is nothing else."""
        return self.text.lower() == self.text or self.text.upper() == self.text

    @cached_property
    def words(self) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(self.lower)]

    def left(self, at: int, size: int) -> str:
        """The last `size` bytes before a place, in lower case."""
        return self.lower[max(0, at - size) : at].encode()[-size:].decode(errors="ignore")

    def right(self, at: int, size: int) -> str:
        return self.lower[at : at + size].encode()[:size].decode(errors="ignore")

    def sentence(self, start: int, end: int) -> tuple[int, int]:
        """The bounds of the sentence around a value."""
        a = max((m.end() for m in SENTENCE.finditer(self.lower, max(0, start - 400), start)), default=max(0, start - 400))
        m = SENTENCE.search(self.lower, end)
        return a, m.start() if m else len(self.lower)

    def on_edges(self, start: int, end: int) -> bool:
        t = self.lower
        inside = lambda i: 0 < i < len(t) and (t[i - 1].isalnum() or t[i - 1] == "_") and (t[i].isalnum() or t[i] == "_")
        return not inside(start) and not inside(end)


Scanner = Callable[[Context], Iterable[Span]]
SCANNERS: dict[str, tuple[frozenset[str], Scanner]] = {}
#: Without what a text holds nothing of a category: patterns that Java and Python read alike.
NEEDS: dict[str, str] = {}
DIGIT, CYRILLIC = "[0-9]", "[\\u0400-\\u04ff]"


def scanner(name: str, *types: str, needs: str | dict[str, str] = "") -> Callable[[Scanner], Scanner]:
    """Registers a scanner under a name of its own. needs: the evidence that its categories can't do without."""

    def register(f: Scanner) -> Scanner:
        if name in SCANNERS:
            raise ValueError(f"scanner {name!r} is registered already")
        SCANNERS[name] = (frozenset(types), f)
        NEEDS.update({t: needs if isinstance(needs, str) else needs.get(t, "") for t in types})
        return f

    return register


@lru_cache(256)
def evidence(types: frozenset[str]) -> str:
    """The pattern that a text must match to hold anything of the categories; empty if any text may."""
    needs = {NEEDS.get(t, "") for t in types}
    return "" if "" in needs else "|".join(sorted(needs))


@lru_cache(256)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def cue(words: Iterable[str], whole: bool = False) -> re.Pattern:
    """Any of some cue words, on a word boundary; with whole also on its right."""
    ordered = sorted(words, key=len, reverse=True)
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + ")" + (r"(?!\w)" if whole else ""))


def nearest(pattern: re.Pattern, window: str) -> re.Match | None:
    """The last match in a window."""
    found = None
    for found in pattern.finditer(window):
        pass
    return found


def order(s: Span) -> tuple:
    """Longest first, then priority, confidence and place. Length counts bytes, as callers convert first."""
    return (-(s.end - s.start), -PRIORITY.get(s.type, CUSTOM_PRIORITY), -s.conf, s.start)


def resolve(spans: list[Span]) -> list[Span]:
    """The spans that no better one overlaps, by place. Equal spans keep the order they came in."""
    if len(spans) < 2:
        return list(spans)
    kept: list[Span] = []
    if len(spans) <= 48:
        for s in sorted(spans, key=order):
            if all(s.end <= k.start or s.start >= k.end for k in kept):
                kept.append(s)
    else:
        taken = bytearray(max(s.end for s in spans))
        for s in sorted(spans, key=order):
            if s.start < s.end and not any(taken[s.start : s.end]):
                taken[s.start : s.end] = b"\x01" * (s.end - s.start)
                kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def scan(ctx: Context) -> list[Span]:
    """What all scanners of enabled categories find, in registry order, as byte ranges, unresolved."""
    there = {p: compiled(p).search(ctx.text) is not None for p in {NEEDS.get(t, "") for t in ctx.enabled}}
    possible = frozenset(t for t in ctx.enabled if there[NEEDS.get(t, "")])
    if possible != ctx.enabled:
        ctx = replace(ctx, enabled=possible)
    found = [s for types, f in SCANNERS.values() if types & possible for s in f(ctx) if s.type in possible]
    return to_bytes(ctx.text, found)


def to_bytes(text: str, spans: list[Span]) -> list[Span]:
    if not spans or text.isascii():
        return spans
    places = sorted({p for s in spans for p in (s.start, s.end)})
    at, size, offset = 0, 0, {}
    for p in places:
        size += len(text[at:p].encode())
        offset[p], at = size, p
    return [s._replace(start=offset[s.start], end=offset[s.end]) for s in spans]
