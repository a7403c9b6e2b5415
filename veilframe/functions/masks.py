"""Masking strategies as column functions of the value and its category."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.synthetic import synthetic as made_up
from veilframe.functions.types import FALLBACK_LABEL, LABEL

ALNUM = r"[\p{L}\p{Nd}]"
NOT_ALNUM = r"[^\p{L}\p{Nd}]"

#: What tokens are salted with unless the configuration says otherwise.
TOKEN_SALT = "veilframe.v1.token"


def stars(c: Column, head: int, tail: int) -> Column:
    """Letters and digits as stars, but for the first `head` and last `tail`; all if few."""
    n = F.length(F.regexp_replace(c, NOT_ALNUM, ""))
    every = F.regexp_replace(c, ALNUM, "*")
    if not head + tail:
        return every
    first = F.regexp_extract(c, rf"(?s)^((?:{NOT_ALNUM}*{ALNUM}){{{head}}})", 1) if head else F.lit("")
    last = F.regexp_extract(c, rf"(?s)((?:{ALNUM}{NOT_ALNUM}*){{{tail}}})$", 1) if tail else F.lit("")
    middle = F.substring(c, F.length(first) + 1, F.length(c) - F.length(first) - F.length(last))
    return F.when(n <= head + tail, every).otherwise(F.concat(first, F.regexp_replace(middle, ALNUM, "*"), last))


def stars_keep2(value: Column, type_: Column) -> Column:
    return stars(value, 2, 2)


def stars_all(value: Column, type_: Column) -> Column:
    return stars(value, 0, 0)


def initials_of(value: Column, letters: str) -> Column:
    """Each run of letters as its capital and a dot; a hyphen or slash before it stays."""
    words = F.regexp_extract_all(value, F.lit(f"{letters}+"), F.lit(0))
    gaps = F.split(value, f"{letters}+", -1)
    between = lambda i: F.when(i == 0, "").when(F.get(gaps, i).rlike("[-–‑]$"), "-").when(F.get(gaps, i).endswith("/"), "/").otherwise(" ")
    made = F.array_join(F.transform(words, lambda w, i: F.concat(between(i), F.upper(F.substring(w, 1, 1)), F.lit("."))), "")
    return F.when(F.size(words) > 0, made).otherwise(stars(value, 2, 2))


def initials(value: Column, type_: Column) -> Column:
    return initials_of(value, r"\p{L}")


def initials_latin(value: Column, type_: Column) -> Column:
    return initials_of(value, "[A-Za-z]")


def label(value: Column, type_: Column, custom: dict[str, str] | None = None) -> Column:
    known = {**LABEL, **(custom or {})}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(table, type_), F.lit(FALLBACK_LABEL))


def token(value: Column, type_: Column, salt: str = TOKEN_SALT) -> Column:
    name = F.when(F.length(type_) > 0, type_).otherwise(F.lit("PD"))
    digest = F.sha2(F.concat(F.encode(F.lit(salt), "UTF-8"), F.unhex(F.lit("00")), F.encode(value, "UTF-8")), 256)
    return F.concat(F.lit("PD_"), name, F.lit("_"), F.substring(digest, 1, 6))


def keep_domain(value: Column, type_: Column) -> Column:
    """The part after the last @ stays, and two characters of the part before it."""
    at = F.length(value) - F.instr(F.reverse(value), "@")
    local, domain = F.substring(value, F.lit(1), at), F.substring(value, at + 1, F.length(value))
    return F.when(value.contains("@") & (at > 0), F.concat(stars(local, 2, 0), domain)).otherwise(stars(value, 2, 2))


def none(value: Column, type_: Column) -> Column:
    return value


STRATEGIES: dict[str, Callable[[Column, Column], Column]] = {
    "stars_keep2": stars_keep2,
    "stars_all": stars_all,
    "initials": initials,
    "initials_latin": initials_latin,
    "label": label,
    "token": token,
    "keep_domain": keep_domain,
    "none": none,
}


def masked(value: Column, type_: Column, strategy: Column, synthetic: bool = True, labels: dict[str, str] | None = None, salt: str = TOKEN_SALT) -> Column:
    """The mask of a value by the name of its strategy; unknown names fall back to stars_keep2."""
    choice = None
    for name, make in STRATEGIES.items():
        if name == "label":
            out = label(value, type_, labels)
        elif name == "token":
            out = token(value, type_, salt)
        else:
            out = make(value, type_)
        choice = F.when(strategy == name, out) if choice is None else choice.when(strategy == name, out)
    if synthetic:  # a caller whose rules don't use it may leave its long expression out
        choice = choice.when(strategy == "synthetic", made_up(value, type_))
    return choice.otherwise(stars(value, 2, 2))
