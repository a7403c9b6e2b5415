"""Corpora of cases: JSON lines of id, text, expect_types and note."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "id string, text string, expect_types array<string>, note string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a file or glob; a malformed line fails, a blank one is skipped."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    return rows.where("id is not null or text is not null").withColumn("expect_types", F.coalesce("expect_types", F.array().cast("array<string>")))


def duplicate_ids(cases: DataFrame) -> DataFrame:
    """Ids that stand for several cases, ignoring case."""
    return cases.groupBy(F.lower("id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def checked(cases: DataFrame) -> DataFrame:
    """cases, if they have texts and unique ids."""
    if cases.where("text is null or text = ''").limit(1).count() or cases.limit(1).count() == 0:
        raise ValueError("a case without text, or no case at all")
    if duplicate_ids(cases).limit(1).count():
        raise ValueError("case ids are not unique")
    return cases


def payloads(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("payload_id"), F.col("text").alias("payload"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, value): the lower-cased entries of a word list, with the number after a tab if there is one."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line != ''")
    parts = F.split("line", "\t")
    return lines.select(F.lower(F.trim(parts[0])).alias("word"), F.try_element_at(parts, F.lit(2)).cast("int").alias("value")).distinct()
