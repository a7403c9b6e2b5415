"""Dictionary entries in texts against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators.dictionary import entries

TEXTS = ["Санкт-Петербург и Нижний Новгород", "нижний  новгород, нижний Новгород", "", None, "новгород" * 3, "Великий Новгород Великий Новгород Великий", "Ё ё\u00a0нижний новгород"]
WORDS = [("новгород", "CITY"), ("нижний новгород", "CITY"), ("Санкт-Петербург", "CITY"), ("великий новгород великий", "STREET"), (None, "CITY"), ("ё", "OWN")]


def plain(text, known, most):
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+(?:-\w+)*", (text or "").lower().replace("\u00a0", "  "))]
    found = []
    for i in range(len(words)):
        for k in range(1, most + 1):
            run = words[i : i + k]
            if len(run) == k and all(b[0] == a[1] + 1 for a, b in zip(run, run[1:], strict=False)) and " ".join(w[2] for w in run) in known:
                found.append((run[0][0], run[-1][1]))
    kept = []
    for a, b in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(b <= x or a >= y for x, y in kept):
            kept.append((a, b))
    return sorted(kept)


@pytest.mark.parametrize("most_rows", [0, 1000])
def test_entries(spark, most_rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    got = {r.key: r.spans for r in entries(df, "id", "text", spark.createDataFrame(WORDS, "entry string, kind string"), most_rows=most_rows).collect()}
    known = {w.lower() for w, _ in WORDS if w}
    for i, text in enumerate(TEXTS):
        want = plain(text, known, 3)
        data = (text or "").replace("\u00a0", "  ")
        assert [(s.start, s.end) for s in got.get(i, [])] == [(len(data[:a].encode()), len(data[:b].encode())) for a, b in want]


def test_a_million_entries_both_ways(spark):
    large = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("entry"), F.lit("OWN").alias("kind"))
    df = spark.range(2000).select("id", F.concat_ws(" ", F.lit("the"), F.concat(F.lit("W"), (F.col("id") * 977 % 2_000_000).cast("string")), F.lit("the w7"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("text"))
    ways = [sorted((r.key, [(s.start, s.end) for s in r.spans]) for r in entries(df, "id", "text", large, most_rows=n).collect()) for n in (0, 1_000_000)]
    assert ways[0] == ways[1] and len(ways[0]) == 2000
    assert sum(len(s) for _, s in ways[0]) == 2000 + sum(i * 977 % 2_000_000 < 1_000_000 for i in range(2000))
