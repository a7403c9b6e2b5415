"""Checksums of digit strings as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import col

# fixed values: control weights of the taxpayer number
INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]


def digit(c: Column, place: int) -> Column:
    return F.substring(c, place, 1).cast("int")


def weighted(c: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(c, i + 1) * w
    return total


def all_same(c: Column | str) -> Column:
    return col(c).rlike(r"^(.)\1*$")


def luhn_total(c: Column) -> Column:
    """The Luhn sum of a string of digits: every second one from the right doubled, less nine above nine."""

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(F.split(F.reverse(c), ""), worth), F.lit(0), lambda a, x: a + x)


def luhn(c: Column | str) -> Column:
    """Whether a string of digits passes the Luhn check."""
    c = col(c)
    return F.when(c.rlike("^[0-9]+$"), luhn_total(c) % 10 == 0).otherwise(F.lit(False))


def inn_valid(c: Column | str) -> Column:
    c = col(c)
    ten = weighted(c, INN_10) % 11 % 10 == digit(c, 10)
    twelve = (weighted(c, INN_11) % 11 % 10 == digit(c, 11)) & (weighted(c, INN_12) % 11 % 10 == digit(c, 12))
    return F.when(c.rlike("^[0-9]{10}$"), ten).when(c.rlike("^[0-9]{12}$"), twelve).otherwise(F.lit(False)) & ~all_same(c)


def snils_valid(c: Column | str) -> Column:
    c = col(c)
    rest = weighted(c, list(range(9, 0, -1))) % 101
    control = F.when(rest == 100, 0).otherwise(rest)
    return F.when(c.rlike("^[0-9]{11}$"), control == F.substring(c, 10, 2).cast("int")).otherwise(F.lit(False))


def iban_valid(c: Column | str) -> Column:
    """Two letters, two digits, 11 to 30 more characters, and remainder 1 modulo 97."""
    c = F.upper(F.regexp_replace(col(c), " ", ""))
    turned = F.split(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4)), "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda a, x: (a * F.when(x.rlike("[0-9]"), 10).otherwise(100) + value(x)) % 97)
    return F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


def card_scheme(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c.rlike("^220[0-4]"), "mir").when(c.startswith("4"), "visa").when(c.rlike("^[52]"), "mastercard").when(c.startswith("3"), "amex").when(c.startswith("6"), "discover").otherwise("")
    )


def card_grouping(groups: Column) -> Column:
    """Whether digit groups stand as they do on cards."""
    return F.array_join(F.transform(groups, lambda g: F.length(g).cast("string")), "-").rlike("^([0-9]+|4-6-5|4-4-8|(4-)+[1-4])$")
