"""Scrubbing of log lines: placeholders for whatever could be personal, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import col

# fixed values: what is taken out of a line, in this order - a card in groups holds no run of six digits
EMAIL = r"[\p{L}0-9._%+-]+@[\p{L}0-9.-]+\.\p{L}{2,}"
PHONE = r"(?:\+7|\b8)[\s()-]*[0-9][0-9\s()-]{7,}[0-9]"
GROUPED = r"\b[0-9]{3,4}(?:[ -][0-9]{2,4})+\b"
LONG = r"[0-9]{6,}"
NAMES = r"\p{Lu}\p{L}+(?:[ .\u00a0]+\p{Lu}\p{L}+)+"


def counted(line: Column, pattern: str, name: str) -> Column:
    """The line with each match replaced by its kind and how many digits it has."""
    found, gaps = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern, -1)
    mark = lambda m: F.concat(F.lit(f"[{name}:"), F.length(F.regexp_replace(m, "[^0-9]", "")).cast("string"), F.lit(" redacted]"))
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(mark(F.get(found, i)), F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(line)


def scrub(line: Column | str) -> Column:
    """A log line without addresses, phones, numbers of six digits or more, and runs of capitalised words; what was there
    is told by kind and number of digits."""
    out = F.regexp_replace(col(line), EMAIL, "[email redacted]")
    for pattern, name in ((PHONE, "phone"), (GROUPED, "digits"), (LONG, "digits")):
        out = counted(out, pattern, name)
    return F.regexp_replace(out, NAMES, "[name redacted]")


def fingerprint(value: Column | str, salt: str) -> Column:
    """Eight hex digits that tell equal values of one process, and nothing else."""
    return F.substring(F.sha2(F.concat(F.lit(salt), col(value)), 256), 1, 8)


def looks_sensitive(value: Column | str) -> Column:
    v = col(value)
    return (F.length(v) > 64) | v.rlike(r"\p{Nd}{4}") | v.rlike(r"\p{Lu}\p{L}+[ .\u00a0]+\p{Lu}\p{L}+")


def redact_value(value: Column | str, salt: str = "") -> Column:
    """A value scrubbed, or only its length and fingerprint if it still looks sensitive then."""
    v = col(value)
    mark = F.concat(F.lit("[redacted len="), F.length(v).cast("string"), F.lit(" fp="), fingerprint(v, salt), F.lit("]"))
    return F.when(looks_sensitive(scrub(v)), mark).otherwise(scrub(v))


def sampled(df, every: int, order: str):
    """Every n-th row of each system, by an order column."""
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("system_id").orderBy(order))
    return df.withColumn("_n", number).where(F.col("_n") % every == 0).drop("_n")
