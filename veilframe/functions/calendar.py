"""Dates as they are written, checked against the calendar without an error for what is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import col


def date_of(day: Column | str, month: Column | str, year: Column | str) -> Column:
    """The date, or null if the calendar has none of these numbers."""
    two = lambda c: F.lpad(col(c).cast("string"), 2, "0")
    text = F.concat_ws("-", F.lpad(col(year).cast("string"), 4, "0"), two(month), two(day))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def full_year(year: Column | str, ref_year: int) -> Column:
    """A year of two digits in the century that puts it at the reference year or before; others as they are."""
    y = col(year).cast("int")
    return F.when(y < 100, y + F.when(y <= ref_year % 100, ref_year // 100 * 100).otherwise(ref_year // 100 * 100 - 100)).otherwise(y)


def numeric_date(text: Column | str, ref_year: int = 2025) -> Column:
    """The date that three numbers with one separator write, day first or year first; else null."""
    t = col(text)
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    first, last = r"^([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})$", r"^([0-9]{4})([./-])([0-9]{1,2})\2([0-9]{1,2})$"
    day_first = date_of(part(first, 1), part(first, 3), full_year(part(first, 4), ref_year))
    year_first = date_of(part(last, 4), part(last, 3), part(last, 1))
    return F.when(t.rlike(first), day_first).when(t.rlike(last), year_first)
