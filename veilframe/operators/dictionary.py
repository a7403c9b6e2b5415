"""Entries of a dictionary table in texts: a join of words, for dictionaries of any size.

A dictionary is a DataFrame (entry, kind): words or phrases in lower case, in Parquet or anything that Spark reads. Texts become
their words and phrases with byte offsets; those that the dictionary has are spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import col, let, matches, normalize_spaces, safe_lower
from veilframe.functions.types import SPANS
from veilframe.operators.detect import once
from veilframe.operators.spans import resolve

WORD = r"[\p{L}\p{Nd}_]+(?:-[\p{L}\p{Nd}_]+)*"


def phrases(text: Column | str, words: int) -> Column:
    """array of (start, end, entry): all runs of up to `words` words that only blanks part, in lower case."""
    word = "struct<start:int,end:int,text:string>"

    def runs(w: Column) -> Column:
        def run(i: Column, k: Column) -> Column:
            part = F.slice(w, i + 1, k)
            return F.struct(F.get(w, i)["start"].alias("start"), F.get(w, i + k - 1)["end"].alias("end"), F.array_join(F.transform(part, lambda x: x["text"]), " ").alias("entry"))

        def near(r: Column) -> Column:
            # only single blanks between the words: the bytes of the run are those of the entry
            return r["end"] - r["start"] == F.octet_length(r["entry"])

        return F.flatten(F.transform(w, lambda _, i: F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size(w) - i)), lambda k: run(i, k)), near)))

    found = matches(normalize_spaces(safe_lower(col(text))), WORD)
    if words == 1:
        return F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("entry")))
    return let(found, lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast(f"array<{word.replace('text', 'entry')}>")))


def entries(df: DataFrame, key: str, text: str, dictionary: DataFrame, words: int = 3, most_rows: int = 1_000_000, conf: float = 0.9) -> DataFrame:
    """(key, spans): the dictionary's entries in each text, the longest at a place; texts without any are left out.

    key must name a row. A dictionary that a count finds to have at most `most_rows` rows is broadcast to the texts. Of a
    larger one what the texts use is found first - their words are made distinct where they are read, so that a
    frequent word is one row of that join - and broadcast if that is few enough; else it is joined by a shuffle, whose
    crowded words adaptive execution splits. Null texts and entries match nothing; of several kinds of an entry all are spans, and
    resolution takes one."""
    runs = df.select(F.col(key).alias("key"), once(phrases(text, words)).alias("all")).select("key", F.explode("all").alias("r")).select("key", "r.*")
    known = dictionary.where(F.col("entry").isNotNull()).select(F.lower("entry").alias("entry"), "kind").distinct()
    few = lambda d: d.limit(most_rows + 1).count() <= most_rows
    small = few(known)
    if not small:
        known = known.join(runs.select("entry").distinct(), "entry", "left_semi")
        small = few(known)
    hits = runs.join(F.broadcast(known) if small else known, "entry")
    span = F.struct(F.col("start"), F.col("end"), F.col("kind").alias("type"), F.lit(conf).alias("conf"), F.lit("dictionary").alias("src"), F.lit("").alias("hint"))
    grouped = hits.groupBy("key").agg(F.sort_array(F.collect_list(span.cast(SPANS.removeprefix("array<").removesuffix(">")))).alias("spans"))
    return grouped.select("key", resolve(F.col("spans")).alias("spans"))
