"""Counters, histograms, quantiles, rates, quality ratios and evictions over traffic and masking results.

Tables of traffic: requests(ts, system_id, op, status, latency_ms). Labels outside a closed set count as `other`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.types import NAMES

# fixed values: upper bounds of the latency histogram, in milliseconds
BOUNDS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]
OPERATIONS = ["mask", "demask", "again", "echo"]


def closed(c: Column, known: list[str]) -> Column:
    return F.when(c.isin(known), c).otherwise("other")


def pii_counts(masked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., type, n): replacements by category."""
    kinds = masked.select(*(by or []), F.explode("replacements.type").alias("type"))
    return kinds.groupBy(*(by or []), closed(F.col("type"), NAMES).alias("type")).agg(F.count("*").alias("n"))


def rollup_report(masked: DataFrame) -> DataFrame:
    """(system_id, type, n) with totals by system and of all."""
    kinds = masked.select("system_id", F.explode("replacements.type").alias("type"))
    return kinds.rollup("system_id", "type").agg(F.count("*").alias("n"))


def cube_report(requests: DataFrame) -> DataFrame:
    """(op, status, level, n): counts by operation and status, by either alone and of all; level tells which are meant."""
    return requests.cube("op", "status").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def slowest(requests: DataFrame, n: int) -> DataFrame:
    """The n requests that took longest: a top-k, of which each task keeps n rows."""
    return requests.orderBy(F.desc_nulls_last("latency_ms"), "event_id").limit(n)


def request_counts(requests: DataFrame, operations: list[str] = OPERATIONS) -> DataFrame:
    return requests.groupBy(closed(F.col("op"), operations).alias("op"), "status").agg(F.count("*").alias("n"))


def histogram(requests: DataFrame, value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """(le, n, cumulative): how many values are at most each bound; le is null for infinity."""
    bucket = F.coalesce(*[F.when(F.col(value) <= b, F.lit(float(b))) for b in bounds], F.lit(float("inf")))
    counted = requests.where(F.col(value).isNotNull()).groupBy(bucket.alias("le")).agg(F.count("*").alias("n"))
    grid = requests.sparkSession.createDataFrame([(float(b),) for b in [*bounds, float("inf")]], "le double")
    full = grid.join(F.broadcast(counted), "le", "left").select("le", F.coalesce("n", F.lit(0)).alias("n"))
    # one row per bound: a running sum over them is no bottleneck
    running = F.sum("n").over(Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0))
    return full.withColumn("cumulative", running).withColumn("le", F.when(F.col("le") < float("inf"), F.col("le")))


def bucket_quantile(hist: DataFrame, q: float) -> DataFrame:
    """The upper bound of the first bucket that holds the quantile."""
    total = hist.agg(F.max("cumulative").alias("total"))  # one row
    need = F.greatest(F.lit(1), F.floor(F.lit(q) * total.scalar()))
    return hist.where(F.col("cumulative") >= need).agg(F.min(F.coalesce("le", F.lit(float("inf")))).alias("quantile"))


def percentiles(requests: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """(p50, p90, p95, p99, max): exact, which keeps all distinct values, or from a summary whose size `accuracy` bounds."""
    p = lambda x: (F.percentile_approx(value, x, accuracy) if accuracy else F.percentile(value, F.lit(x))).alias(f"p{int(x * 100)}")
    return requests.agg(p(0.5), p(0.9), p(0.95), p(0.99), F.max(value).alias("max"))


#: What a sketch tells apart: values from LOW to HIGH; beyond them a value counts as the bound.
LOW, HIGH = 1e-3, 1e7


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch(rows: DataFrame, value: str, by: list[str], error: float = 0.01) -> DataFrame:
    """(by..., bucket, n): a mergeable summary of a value by group, of a size that doesn't depend on the rows.

    Bucket i holds the values above gamma**(i - 1) up to gamma**i; at an error of 0.01 there are 1152 buckets from LOW to
    HIGH. The partial sums of tasks, of windows of a stream or of days are merged by adding up counts (merged())."""
    x = F.least(F.greatest(F.col(value).cast("double"), F.lit(LOW)), F.lit(HIGH))
    bucket = F.ceil(F.log(x) / F.log(F.lit(gamma(error)))).cast("int")
    return rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of all rows that some sketches summarise, by fewer or the same groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, by: list[str], quantiles: list[float], error: float = 0.01) -> DataFrame:
    """(by..., quantile, estimate): for the value of rank floor(quantile * (count - 1)) a number that is off by `error` of
    it at most. A window sees the buckets of one group, which are bounded."""
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = sketches.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))
    asked = placed.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.floor(F.col("quantile") * (F.col("total") - 1))
    here = asked.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    g = gamma(error)
    return here.select(*by, "quantile", (F.pow(F.lit(g), F.col("bucket")) * (2 / (g + 1))).alias("estimate"))


def rates(requests: DataFrame, ts: str = "ts", seconds: int = 10) -> DataFrame:
    """(second, rate): events a second over the last `seconds` seconds, for each second with an event.

    Events are counted by second first, so the sliding sum works on one row a second."""
    tick = F.unix_seconds(F.col(ts).cast("timestamp"))
    counted = requests.groupBy(tick.alias("second")).agg(F.count("*").alias("n"))
    # a second adds to the windows of the next ones: an aggregate, not one ordered task
    spread = counted.select(F.col("second").alias("at"), "n", F.explode(F.sequence(F.col("second"), F.col("second") + seconds - 1)).alias("second"))
    sums = spread.groupBy("second").agg((F.sum("n") / seconds).alias("rate"), F.max(F.col("at") == F.col("second")).alias("own"))
    return sums.where("own").select("second", "rate")


def limited(requests: DataFrame, per_minute: int, key: str = "system_id") -> DataFrame:
    """requests with `allowed`: at most per_minute in the minute up to each one."""
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    before = Window.partitionBy(key).orderBy(second).rangeBetween(-60, 0)
    return requests.withColumn("in_minute", F.count("*").over(before)).withColumn("allowed", F.col("in_minute") <= per_minute)


def evicted(entries: DataFrame, keep: int, shards: int = 64) -> DataFrame:
    """entries(key, expires) that go first when more than `keep` are held: the oldest of each shard."""
    shard = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long") % shards
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("expires"), "key"))
    return entries.withColumn("shard", shard).withColumn("_n", place).where(F.col("_n") > max(1, keep // shards)).drop("_n", "shard")


def quality(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(expected, hit, recall, negatives, clean, clean_ratio). cases: id, expect_types; found: id, types, unchanged, and
    perhaps restored (whether restoring gave the text), which adds restore_ratio."""
    both = cases.join(found, "id", "left")
    want = F.size("expect_types")
    hits = F.size(F.array_intersect("expect_types", F.coalesce("types", F.array().cast("array<string>"))))
    sums = both.agg(
        F.sum(want).alias("expected"),
        F.sum(hits).alias("hit"),
        F.sum((want == 0).cast("int")).alias("negatives"),
        F.sum(((want == 0) & F.coalesce("unchanged", F.lit(False))).cast("int")).alias("clean"),
    )
    if "restored" in found.columns:
        back = both.agg(F.avg(F.coalesce("restored", F.lit(False)).cast("double")).alias("restore_ratio"))
        sums = sums.crossJoin(back)  # a row by a row
    return sums.withColumn("recall", F.try_divide("hit", "expected")).withColumn("clean_ratio", F.try_divide("clean", "negatives"))
