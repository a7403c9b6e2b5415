"""Text preparation as column functions. Offsets are UTF-8 bytes, ranges half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}_]"
LEFT_EDGE, RIGHT_EDGE = rf"(?<!{WORD})", rf"(?!{WORD})"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8(c: Column | str) -> Column:
    """The bytes of a string; substring() of these counts bytes."""
    return F.encode(col(c), "UTF-8")


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """The string between two byte offsets of utf8(...)."""
    return F.decode(F.substring(data, start + 1, end - start), "UTF-8")


def byte_view(c: Column | str) -> Column:
    """One character per byte, so that string functions count bytes."""
    return F.decode(utf8(c), "ISO-8859-1")


def from_byte_view(c: Column | str) -> Column:
    return F.decode(F.encode(col(c), "ISO-8859-1"), "UTF-8")


#: Letters whose lower case is wider or narrower. Two of them may cancel out in a text's length, but not in between.
UNEVEN = "".join(c for c in map(chr, range(0x80, 0xD800)) if len(c.lower().encode()) != len(c.encode()))


def safe_lower(c: Column | str) -> Column:
    """Lower case of the same byte length: a letter whose lower case is wider or narrower stays."""
    c = col(c)
    low = F.lower(c)
    kept = F.transform(F.split(c, ""), lambda x: F.when(F.octet_length(F.lower(x)) == F.octet_length(x), F.lower(x)).otherwise(x))
    even = (F.octet_length(c) == F.length(c)) | (F.octet_length(low) == F.octet_length(c)) & ~c.rlike(f"[{UNEVEN}]")
    return F.when(even, low).otherwise(F.array_join(kept, ""))


def normalize_spaces(c: Column | str) -> Column:
    """No-break and narrow spaces as ASCII spaces, as many as they have bytes."""
    two = F.regexp_replace(col(c), "\u00a0", "  ")
    return F.regexp_replace(two, "[\u202f\u2007\u2009\u2002\u2003]", "   ")


def case_blind(c: Column | str) -> Column:
    return F.lower(col(c)) == col(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column, block: int = 32) -> Column:
    """The inclusive running sums of an array of integers. Sums inside a block start at the block, so that their cost is
    `block` steps an element; building the array one by one would copy it each time."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def summed(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: total(F.slice(x, b * block + 1, F.lit(block))))
        before = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        of = lambda i: F.floor(i / block).cast("int")
        return let(before, lambda s: F.transform(x, lambda _, i: F.get(s, of(i)) + total(F.slice(x, of(i) * block + 1, i % block + 1))))

    return let(sizes, lambda x: F.when(F.size(x) == 0, x).otherwise(summed(x)))


def with_offsets(parts: Column) -> Column:
    """Strings that follow each other -> array of (start, end, text) in bytes."""

    def placed(p: Column) -> Column:
        return let(running(F.transform(p, F.octet_length)), lambda ends: F.transform(p, lambda x, i: F.struct((F.get(ends, i) - F.octet_length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("text"))))

    return let(parts, placed)


def tokens(c: Column | str) -> Column:
    """Runs of spaces and of word characters, other characters one by one: (start, end, kind)."""
    parts = F.regexp_extract_all(col(c), F.lit(rf"(?s)\s+|{WORD}+|."), F.lit(0))
    kind = lambda t: (
        F.when(t.rlike(r"^\s"), "space").when(t.rlike(r"^\p{Nd}+$"), "number").when(t.rlike(r"^[\p{L}_]+$"), "word").when(t.rlike(rf"^{WORD}"), "alnum").otherwise("punct")
    )
    return F.transform(with_offsets(parts), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind(x["text"]).alias("kind")))


#: Stands around matches while a text is cut; where a text has one itself, it counts as another control character.
MARK = "\u0001"


def cut_at(c: Column, pattern: str | Column) -> Column:
    """The text in pieces: gap, match, gap, match, ..., gap. The pattern, which may be a column, runs once."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(F.regexp_replace(F.translate(c, MARK, "\u0002"), pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def matches(c: Column | str, pattern: str) -> Column:
    """All matches of a pattern that can't match the empty string: array of (start, end, text)."""
    found = "array<struct<start:int,end:int,text:string>>"

    def listed(pieces: Column) -> Column:
        at = lambda i: i % 2 == 1
        return F.when(F.size(pieces) < 2, F.array().cast(found)).otherwise(F.filter(with_offsets(pieces), lambda _, i: at(i)))

    return F.when(col(c).isNull(), F.array().cast(found)).otherwise(let(cut_at(col(c), pattern), listed))


def is_boundary(c: Column | str, at: Column) -> Column:
    """Whether a character offset is an edge of the text or has no word character on one of its sides."""
    c = col(c)
    word = lambda i: F.substring(c, i, 1).rlike(WORD)
    return (at <= 0) | (at >= F.length(c)) | ~(word(at) & word(at + 1))


def expand_word(c: Column | str, start: Column, end: Column) -> Column:
    """A character range grown to whole words: struct(start, end)."""
    c = col(c)
    left = F.length(F.regexp_extract(F.substring(c, F.lit(1), start), f"{WORD}*$", 0))
    right = F.length(F.regexp_extract(F.substring(c, end + 1, F.length(c)), f"^{WORD}*", 0))
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


def trim_edges(c: Column | str, start: Column, end: Column) -> Column:
    """A character range without what is neither letter nor digit at its edges: struct(start, end)."""
    value = F.substring(col(c), start + 1, end - start)
    left = F.length(F.regexp_extract(value, r"^[^\p{L}\p{Nd}]*", 0))
    right = F.length(F.regexp_extract(value, r"[^\p{L}\p{Nd}]*$", 0))
    return F.when(left >= end - start, F.struct(start.alias("start"), start.alias("end"))).otherwise(F.struct((start + left).alias("start"), (end - right).alias("end")))


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def count_digits(c: Column | str) -> Column:
    return F.length(digits_only(c))


def is_cyrillic_word(c: Column | str) -> Column:
    return col(c).rlike(r"^[\p{IsCyrillic}-]+$")


def is_latin_word(c: Column | str) -> Column:
    return col(c).rlike(r"^[A-Za-z-]+$")


def is_upper_first(c: Column | str) -> Column:
    return col(c).rlike(r"^\p{Lu}")


def estimate_tokens(c: Column | str) -> Column:
    """Cyrillic letters by three plus other characters by four, at least one if there is text."""
    c = col(c)
    cyrillic = F.length(F.regexp_replace(c, "[^\u0400-\u04ff]", ""))
    total = F.floor(cyrillic / 3) + F.floor((F.length(c) - cyrillic) / 4)
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.greatest(total, F.lit(1))).cast("int")


def store_key(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))
