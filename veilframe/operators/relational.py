"""Joins by place: the nearest row of another table, and rows whose intervals overlap."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, take: list[str], cell: int, within: int | None = None) -> DataFrame:
    """left and, as `near`, (at, take...) of the nearest row of right with the same key, the one before of two as
    near; null if there is none, or none `within` that distance. at: an integer column of both tables.

    The tables meet in cells of `cell` positions, in which a row sees the last one before it and the first one after
    it; what stands nearest in other cells is carried in from a summary of a row per cell. So a hot key is as
    many groups as it has cells, and nothing is compared pair by pair. Null keys and places have no partner."""
    place = lambda c: F.floor(F.col(c) / cell)
    facts = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), place(at).alias("cell"), F.col(at).cast("long").alias("at"), F.struct(F.col(at).cast("long").alias("at"), *take).alias("fact"))
    rows = left.select(F.struct("*").alias("row"), F.col(key).alias("k"), place(at).alias("cell"), F.col(at).cast("long").alias("at"))
    asked = rows.where("k is not null and at is not null")
    ends = facts.groupBy("k", "cell").agg(F.min("fact").alias("low"), F.max("fact").alias("high"))
    cells = ends.unionByName(asked.select("k", "cell").distinct(), allowMissingColumns=True).groupBy("k", "cell").agg(F.first("low", True).alias("low"), F.first("high", True).alias("high"))
    by_cell = Window.partitionBy("k").orderBy("cell")
    carried = cells.select(
        "k",
        "cell",
        F.last("high", True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("low", True).over(by_cell.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    both = asked.withColumn("turn", F.lit(1)).unionByName(facts.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("k", "cell").orderBy("at", "turn")
    seen = both.select(
        "row",
        "k",
        "cell",
        "at",
        "turn",
        F.last("fact", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.first("fact", True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("after"),
    )
    ends_of = seen.where("turn = 1").join(carried, ["k", "cell"], "left")
    ends_of = ends_of.withColumn("before", F.coalesce("before", "earlier")).withColumn("after", F.coalesce("after", "later"))
    ahead = F.col("after.at") - F.col("at")
    back = F.col("at") - F.col("before.at")
    pick = F.when(F.col("before").isNull() | (ahead < back), F.col("after")).otherwise(F.col("before"))
    near = ends_of.withColumn("near", pick)
    if within is not None:
        near = near.withColumn("near", F.when(F.abs(F.col("near.at") - F.col("at")) <= within, F.col("near")))
    lost = rows.where("k is null or at is null").withColumn("near", F.lit(None).cast(near.schema["near"].dataType))
    return near.select("row", "near").unionByName(lost.select("row", "near")).select("row.*", "near")


def interval_join(
    a: DataFrame, b: DataFrame, how: str = "inner", on: Iterable[str] = (), left: tuple[str, str] = ("start", "stop"), right: tuple[str, str] = ("begin", "finish"), most: int = 2048, cell: int = 4096
) -> DataFrame:
    """Rows of a and b whose intervals [start, stop) overlap: a.start < b.stop and b.start < a.stop, for whole numbers.

    how: inner, left (a's rows without a partner have nulls), left_semi or left_anti (each row of a once). No equality is
    needed; `on` names columns that must be equal as well. Other columns of a and b must have different names. An interval
    with a null end, or one that ends before it starts, overlaps nothing.

    Pairs are found in cells: one whose length is at most 2**k is in one or two cells of that width, so the longer of a
    pair fixes the width at which the two meet, and the cell in which the later of them starts reports it - once. Cells with
    more than `most` rows are dealt out in blocks of `most` x `most`. Semi and anti joins look at no pairs: a row has a
    partner if the largest stop of those that start before its own stop is beyond its start, which is a running maximum
    inside cells of `cell` numbers, and one over cells."""
    on = list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how!r}")
    if how in ("left_semi", "left_anti"):
        return partnered(a, b, on, left, right, cell, how == "left_semi")
    pairs = overlapping(a, b, on, left, right, most)
    if how == "inner":
        return pairs
    lone = partnered(a, b, on, left, right, cell, False)
    for f in b.schema:
        if f.name not in on:
            lone = lone.withColumn(f.name, F.lit(None).cast(f.dataType))
    return pairs.unionByName(lone)


def proper(ends: tuple[str, str]) -> Column:
    return F.coalesce(F.col(ends[0]) <= F.col(ends[1]), F.lit(False))


def partnered(a: DataFrame, b: DataFrame, on: list[str], left: tuple[str, str], right: tuple[str, str], cell: int, met: bool) -> DataFrame:
    """The rows of a that overlap a row of b, or those that don't."""
    own = [F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]
    none = F.lit(None).cast("long")
    rows = a.select(F.struct("*").alias("_row"), *own, proper(left).alias("_fit"), F.col(left[1]).cast("long").alias("_at"), F.lit(0).alias("_kind"), none.alias("_stop"), F.col(left[0]).cast("long").alias("_start"))
    points = b.where(proper(right)).select(*own, F.col(right[0]).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.col(right[1]).cast("long").alias("_stop"))
    keys = [f"_on{i}" for i in range(len(on))]
    # of equal places the row of a comes first: what starts where it stops doesn't overlap it
    both = rows.unionByName(points, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_at") / cell))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_at", "_kind")
    seen = both.withColumn("_most", F.max("_stop").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_kind = 0")
    cells = points.groupBy(*keys, F.floor(F.col("_at") / cell).alias("_c")).agg(F.max("_stop").alias("_stop"))
    # a maximum for every cell that has rows of a or b: one row for each
    wanted = seen.select(*keys, F.col("_cell").alias("_c")).distinct().withColumn("_stop", none)
    every = cells.unionByName(wanted).groupBy(*keys, "_c").agg(F.max("_stop").alias("_stop"))
    before = F.max("_stop").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_c"), before.alias("_carried"))
    same = F.col("_cell") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    found = seen.join(carried, same, "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hit = F.coalesce(F.col("_fit") & known & (F.greatest("_most", "_carried") > F.col("_start")), F.lit(False))
    return found.where(hit if met else ~hit).select("_row.*")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], left: tuple[str, str], right: tuple[str, str], most: int) -> DataFrame:
    """All overlapping pairs, each once."""
    level = lambda ends: F.ceil(F.log2(F.greatest(F.col(ends[1]) - F.col(ends[0]), F.lit(1)).cast("double"))).cast("int")
    sides = [x.where(proper(ends)).withColumn(f"_level{i}", level(ends)).withColumn(f"_row{i}", F.monotonically_increasing_id()) for i, (x, ends) in enumerate(((a, left), (b, right)))]
    there = [sorted(r[0] for r in x.select(f"_level{i}").distinct().collect()) for i, x in enumerate(sides)]  # at most 64 numbers

    def dealt(i: int) -> DataFrame:
        start, stop = (left, right)[i]
        own, other = F.col(f"_level{i}"), F.array(*map(F.lit, there[1 - i])).cast("array<int>")
        # its own width, and those of longer ones on the other side
        widths = F.concat(F.array(own), F.filter(other, lambda k: k > own))
        wide = sides[i].withColumn("_width", F.explode(widths))
        size = F.pow(F.lit(2.0), F.col("_width")).cast("long")
        first, last = F.floor(F.col(start) / size), F.floor(F.greatest(F.col(stop) - 1, F.col(start)) / size)
        return wide.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))

    keys = [*on, "_width", "_cell"]
    x, y = dealt(0), dealt(1)
    blocks = [d.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(f"_blocks{i}")).where(f"_blocks{i} > 1") for i, d in enumerate((x, y))]
    split = blocks[0].join(blocks[1], keys, "full").select(*keys, *[F.coalesce(f"_blocks{i}", F.lit(1)).alias(f"_blocks{i}") for i in (0, 1)])

    def spread(d: DataFrame, i: int) -> DataFrame:
        """Each row in one block of its own side and in all of the other's."""
        known = d.join(split, keys, "left")
        n = lambda k: F.coalesce(f"_blocks{k}", F.lit(1))
        mine = F.pmod(F.col(f"_row{i}"), n(i)).cast("int")
        return known.withColumn(f"_part{i}", mine).withColumn(f"_part{1 - i}", F.explode(F.sequence(F.lit(0), n(1 - i) - 1))).drop("_blocks0", "_blocks1")

    met = spread(x, 0).join(spread(y, 1), [*keys, "_part0", "_part1"])
    later = F.greatest(F.col(left[0]), F.col(right[0]))
    fits = (F.greatest("_level0", "_level1") == F.col("_width")) & (F.floor(later / F.pow(F.lit(2.0), F.col("_width")).cast("long")) == F.col("_cell"))
    over = (F.col(left[0]) < F.col(right[1])) & (F.col(right[0]) < F.col(left[1]))
    return met.where(fits & over).select(*a.columns, *[c for c in b.columns if c not in on])
