"""Detectors as pure column expressions: e-mail addresses, numbers (operators/digits.py) and users' own categories.

They are JVM code: no Python worker sees the text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import byte_view, col, matches, safe_lower, utf8
from veilframe.functions.types import SPANS
from veilframe.operators import digits
from veilframe.operators.digits import span

#: Ends with the letters of its last label, whatever touches them: the rest of a word with no blank before it isn't a reason
#: to cut a label off.
#: The letter beyond the sixteen-bit characters is there for Java, which looks back by characters, not by their halves, only then.
EDGE = r"(?<![\p{L}" + "\U0001d400" + r"\p{Nd}_.+-])"
EMAIL = EDGE + r"[a-z0-9][a-z0-9._+-]*@(?:[a-z0-9а-яё-]+\.)+(?:[a-z]{2,}|[а-яё]{2,})"
ASCII_EMAIL = EDGE + r"[a-z0-9][a-z0-9._+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}"
#: Mailboxes of a role, not of a person; a list of further institutions' domains is the caller's.
ROLES = ("admin", "contact", "help", "hr", "info", "noreply", "office", "press", "sales", "support")
INSTITUTIONS = ("sberbank.ru",)

#: What this module finds; everything else is the context scanners' (operators/scan).
TYPES = frozenset({"EMAIL", *digits.BY_WINDOWS})


def emails(text: Column | str, institutions: tuple[str, ...] = (), mailboxes: str = "personal") -> Column:
    """E-mail addresses. mailboxes: "personal" (neither role mailboxes nor those of institutions) or "ascii" (all, of
    ASCII letters only)."""
    if mailboxes == "ascii":
        return F.transform(matches(safe_lower(text), ASCII_EMAIL), lambda m: span(m, "EMAIL", 0.98))
    domains = "|".join(re.escape(d) for d in (*INSTITUTIONS, *institutions))
    local = lambda m: F.regexp_extract(m["text"], r"^([^@+]*)", 1)
    found = F.filter(matches(safe_lower(text), EMAIL), lambda m: ~local(m).isin(*ROLES) & ~m["text"].rlike(rf"[@.](?:{domains})$"))
    return F.transform(found, lambda m: span(m, "EMAIL", 0.98))


def detect(text: str, types: Iterable[str], institutions: tuple[str, ...] = (), mailboxes: str = "personal") -> Column:
    """All native detectors of some categories over a column in one array, unresolved; others are not even built."""
    mails = [F.when(F.col(text).contains("@"), emails(text, institutions, mailboxes)).otherwise(F.array().cast(SPANS))] if "EMAIL" in types else []
    return F.concat(*mails, digits.detect(text, types))


def custom(text: Column | str, name: str, pattern: str, anchors: list[str] | None = None, window: int = 40) -> Column:
    """A user's category: all matches of a pattern; with anchors, one must stand on word edges within
    `window` bytes on the left."""
    text = col(text)
    found = matches(text, pattern)
    if anchors:
        words = "|".join(byte_view_literal(a.lower()) for a in sorted(anchors, key=len, reverse=True))
        lower = utf8(safe_lower(text))
        left = lambda m: byte_view(byte_slice_lenient(lower, F.greatest(m["start"] - window, F.lit(0)), m["start"]))
        found = F.filter(found, lambda m: left(m).rlike(rf"(?s)(?:^|[^0-9a-z_\u0080-\u00ff])(?:{words})(?:$|[^0-9a-z_\u0080-\u00ff])"))
    return F.transform(found, lambda m: span(m, name, 0.9).withField("src", F.lit("custom")))


def byte_view_literal(word: str) -> str:
    return re.escape(word.encode().decode("latin-1"))


def byte_slice_lenient(data: Column, start: Column, end: Column) -> Column:
    """A slice that may start inside a character; what is left of that character is dropped."""
    raw = F.substring(data, start + 1, end - start)
    first = F.hex(F.substring(raw, 1, 2))
    skip = F.when(first.rlike("^[89AB].[89AB]"), 2).when(first.rlike("^[89AB]"), 1).otherwise(0)
    return F.decode(F.substring(raw, skip + 1, F.octet_length(raw)), "UTF-8")

