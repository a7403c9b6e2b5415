"""Interval joins against brute force."""

import random

import pytest

from veilframe.operators.relational import interval_join

A, B = "id int, k string, start long, stop long", "name int, k string, begin long, finish long"


def tables(spark, seed, n, reach, longest):
    r = random.Random(seed)

    def rows(n, nulls):
        out = []
        for i in range(n):
            s = r.randrange(-reach, reach)
            e = s + (r.randrange(longest) if r.random() < 0.9 else r.randrange(longest * 30))
            out.append((i, r.choice(["x", "y", None]), s if r.random() > nulls else None, e if r.random() > 0.05 else s - 3))
        return out

    a, b = rows(n, 0.05), rows(n // 2, 0.05)
    return a, b, spark.createDataFrame(a, A).repartition(3), spark.createDataFrame(b, B).repartition(3)


def overlap(x, y):
    return None not in (x[2], x[3], y[2], y[3]) and x[2] <= x[3] and y[2] <= y[3] and x[2] < y[3] and y[2] < x[3]


@pytest.mark.parametrize("seed, n, reach, longest, most, cell", [(1, 120, 60, 5, 2048, 16), (2, 200, 2000, 40, 3, 64), (3, 60, 10, 3, 2, 1), (4, 150, 10**12, 10**11, 2048, 10**9)])
def test_interval_joins(spark, seed, n, reach, longest, most, cell):
    a, b, x, y = tables(spark, seed, n, reach, longest)
    y = y.withColumnRenamed("k", "other")
    want = sorted((i[0], j[0]) for i in a for j in b if overlap(i, j))
    got = interval_join(x, y, most=most, cell=cell).select("id", "name").collect()
    assert sorted(map(tuple, got)) == want
    met = {i for i, _ in want}
    assert sorted(r.id for r in interval_join(x, y, "left_semi", most=most, cell=cell).collect()) == sorted(met)
    assert sorted(r.id for r in interval_join(x, y, "left_anti", most=most, cell=cell).collect()) == sorted({i[0] for i in a} - met)
    both = interval_join(x, y, "left", most=most, cell=cell).collect()
    assert sorted((r.id, r.name) for r in both if r.name is not None) == want and {r.id for r in both} == {i[0] for i in a}


def test_interval_joins_by_key(spark):
    a, b, x, y = tables(spark, 7, 200, 300, 20)
    want = sorted((i[0], j[0]) for i in a for j in b if overlap(i, j) and i[1] is not None and i[1] == j[1])
    assert sorted((r.id, r.name) for r in interval_join(x, y, on=["k"]).collect()) == want
    assert {r.id for r in interval_join(x, y, "left_semi", on=["k"], cell=32).collect()} == {i for i, _ in want}


def test_empty_tables(spark):
    x, y = spark.createDataFrame([], A), spark.createDataFrame([], B.replace("k string", "other string"))
    full = spark.createDataFrame([(1, "x", 0, 5)], A)
    assert interval_join(full, y).count() == 0 == interval_join(x, y).count()
    assert interval_join(full, y, "left").count() == 1 == interval_join(full, y, "left_anti").count()


def test_a_hot_place(spark):
    """A hundred thousand intervals over one place: a semi join looks at no pairs, an inner join deals out blocks."""
    hot = spark.range(100_000).selectExpr("cast(id as int) as id", "cast(1000 + id % 3 as long) as start", "cast(1010 as long) as stop")
    some = spark.range(100_000).selectExpr("cast(id as int) as name", "cast(1005 + id % 2 as long) as begin", "cast(1006 + id % 2 as long) as finish")
    assert interval_join(hot, some, "left_semi").count() == 100_000
    assert interval_join(hot, some.where("name < 20"), most=5000).count() == 2_000_000
