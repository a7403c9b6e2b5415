"""The synthetic strategy: a made-up value of the same category, always the same for the same value, as column expressions.

Random numbers are read from a counter stream: number k of a value is eight hexadecimal digits of SHA-256 over salt,
category, value and the number of the block (eight numbers a block), with zero bytes between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.checks import luhn_total
from veilframe.functions.text import let

#: Material for made-up names and places.
SURNAMES = "Лебедев Соколов Морозов Волков Зайцев Павлов Семенов Голубев Виноградов Богданов".split()
NAMES = "Алексей Михаил Андрей Сергей Дмитрий Николай Павел Роман Антон Игорь".split()
PATRONYMICS = "Петрович Ильич Андреевич Сергеевич Павлович Юрьевич Олегович Львович Егорович Романович".split()
LATIN_NAMES = "IVAN PETR OLEG ANNA MARIA ELENA".split()
LATIN_SURNAMES = "SMIRNOV PETROV VOLKOV LEBEDEV MOROZOV".split()
CITIES = "Тверь Калуга Рязань Пенза Тула Вологда Курск Псков Омск Томск".split()
LOWER = "абвгдежзиклмнопрстуфхцчшэюя"
ZERO = "\u0000"


def stream(value: Column, kind: Column, salt: str, numbers: Column) -> Column:
    """The hexadecimal digits of so many numbers, in whole blocks."""
    last = F.floor((numbers - 1) / 8).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.sha2(F.concat_ws(ZERO, F.lit(salt), kind, value, b.cast("string")).cast("binary"), 256))
    return F.array_join(blocks, "")


def number(h: Column, k: Column | int, below: int) -> Column:
    """Number k of a stream, below a bound."""
    k = F.lit(k) if isinstance(k, int) else k
    return (F.conv(F.substring(h, k * 8 + 1, F.lit(8)), 16, 10).cast("long") % below).cast("int")


def pick(h: Column, k: int, of: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, of)), number(h, k, len(of)))


def digits(h: Column, first: int, count: Column) -> Column:
    """count digits from number `first` on."""
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: number(h, i + first, 10).cast("string")), "")).otherwise("")


def digits_into(value: Column, made: Column) -> Column:
    """value with its digits replaced, one by one, by those of made."""
    pieces = F.split(F.regexp_replace(value, "([0-9])", "\u0001"), "\u0001", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(F.split(value, "[0-9]", -1)) - 1, F.substring(made, i + 1, F.lit(1))).otherwise(""))), "")


def shaped(value: Column, h: Column) -> Column:
    """Another digit for each digit, another letter of its case and script for each letter."""

    def other(c: Column, i: Column) -> Column:
        cyrillic = F.substring(F.lit(LOWER), number(h, i, len(LOWER)) + 1, F.lit(1))
        latin = F.char(number(h, i, 26) + 97)
        cased = lambda x: F.when(F.lower(c) == c, x).otherwise(F.upper(x))
        return F.when(c.rlike("[0-9]"), number(h, i, 10).cast("string")).when(c.rlike("(?iu)[а-я]"), cased(cyrillic)).when(c.rlike("[A-Za-z]"), cased(latin)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def synthetic(value: Column, kind: Column, salt: str = "veilframe") -> Column:
    """A made-up value: cards pass the check digit, phones are mobile, dates exist; digits stand where they stood."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))

    def made(h: Column) -> Column:
        body = F.concat(F.lit("4"), digits(h, 0, n - 2))
        card = F.concat(body, ((10 - luhn_total(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
        eleven = n == 11
        phone = F.concat(F.when(eleven, "7").otherwise(""), F.lit("9"), digits(h, 0, n - F.when(eleven, 2).otherwise(1)))
        two = lambda k, below: F.lpad((number(h, k, below) + 1).cast("string"), 2, "0")
        date = F.concat(two(0, 28), two(1, 12), (number(h, 2, 40) + 1960).cast("string"))
        words = F.least(F.greatest(F.size(F.split(F.trim(value), r"\s+")), F.lit(1)), F.lit(3))
        name = F.array_join(F.slice(F.array(pick(h, 0, SURNAMES), pick(h, 1, NAMES), pick(h, 2, PATRONYMICS)), F.lit(1), words), " ")
        return (
            F.when(kind == "FIO", name)
            .when(kind == "CARD_HOLDER", F.concat_ws(" ", pick(h, 0, LATIN_NAMES), pick(h, 1, LATIN_SURNAMES)))
            .when((kind == "CARD_NUMBER") & (n > 1), digits_into(value, card))
            .when((kind == "PHONE") & (n >= 10), digits_into(value, phone))
            .when(kind == "EMAIL", F.concat(F.lit("user"), F.lpad(number(h, 0, 100_000).cast("string"), 5, "0"), F.lit("@example.com")))
            .when(kind.isin("BIRTH_DATE", "PASSPORT_ISSUE_DATE") & (n == 8) & value.rlike("[0-9]{4}$"), digits_into(value, date))
            .when(kind.isin("CITY", "BIRTH_PLACE"), pick(h, 0, CITIES))
            .otherwise(shaped(value, h))
        )

    return F.when(value.isNotNull(), let(stream(value, F.coalesce(kind, F.lit("")), salt, F.greatest(F.length(value), F.lit(8))), made))
