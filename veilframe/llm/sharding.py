"""Sharding by extendible hashing.

A shard is a prefix of the bits of a row's hash. The directory starts with one bucket; a bucket of
more than `limit` bytes, and no other, is split on its next bit, until every shard fits. Because a bucket's
bytes only shrink with each bit, a shard is a prefix that fits and whose parent doesn't. All splits of 16 bits are
found by one aggregate over 2^16 prefixes at most, those of the next 8 bits by one over the rows that are
still in too large ones, and so on. Texts are never shuffled for this.

What is joined is a bucket with its parent, never rows with sums of short prefixes that many of them share: a shard
of a level is written out as the level's prefixes that it covers (2^16 for all shards of the first level together,
2^8 for those of one split bucket of a further level), and rows are looked up by that prefix.

The hash's first 40 bits come from doc_id and text, the others from the row's place in the input, so equal
rows, however many, can be split too. A single row beyond the limit is a shard of its own, marked
oversized. Null text has no bytes, null doc_id hashes like an empty one; an empty table gives an empty
result; other columns are ignored, whatever their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, few

LIMIT = 1 << 20
CONTENT, BITS = 40, 64
LEVELS = [16, *range(24, BITS + 1, 8)]
SHARD = ["shard", "depth", "shard_bytes", "shard_rows"]


def content_bits() -> Column:
    """The bits that doc_id and text give."""
    digest = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), "UTF-8"))
    return F.lpad(F.conv(F.substring(digest, 1, CONTENT // 4), 16, 2), CONTENT, "0")


def row_bits() -> Column:
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), CONTENT)
    return F.concat(content_bits(), F.lpad(F.bin(place), BITS - CONTENT, "0"))


def rows_of(docs: DataFrame, *carried: Column) -> DataFrame:
    """What is placed: doc_id, n_bytes, bits and what goes along, computed once - the bits depend on a row's place."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut(docs.select("doc_id", n_bytes.alias("n_bytes"), row_bits().alias("bits"), *carried))


def placed(rows: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The directory (SHARD) and the rows with the columns SHARD, both in parts by level."""
    total = rows.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()
    if not total.n or total.b <= limit or total.n == 1:
        one = [F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total.b or 0).cast("long").alias("shard_bytes"), F.lit(total.n).cast("long").alias("shard_rows")]
        return [rows.sparkSession.range(min(total.n, 1)).select(*one)], [rows.select("*", *one)]
    shards, parts, start = [], [], 0
    for last in LEVELS:
        cells = rows.groupBy(F.substring("bits", 1, last).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(start + 1), F.lit(last))).alias("depth"))
        sums = depths.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        sums = cut(sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)))
        # a parent has two children, so no key of this join is frequent
        large = sums.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        child = sums.where("fits").withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
        found = cut(child.where(F.col("depth") == start + 1).unionByName(child.join(large, ["depth", "parent"], "left_semi")).select(SHARD))
        shards.append(found)
        rest = F.lit(last) - F.col("depth")
        covered = F.when(rest == 0, F.array("shard")).otherwise(
            F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), rest).cast("int") - 1), lambda i: F.concat("shard", F.lpad(F.bin(i), rest, F.lit("0"))))
        )
        cover = found.select(F.explode(covered).alias("cell"), *SHARD)
        cover = F.broadcast(cover) if start == 0 else cover
        keyed = rows.withColumn("cell", F.substring("bits", 1, last))
        parts.append(keyed.join(cover, "cell").drop("cell"))
        # beyond the first level, rows of buckets that are still too large are few unless they are equal
        if last == BITS or sums.where((F.col("depth") == last) & ~F.col("fits")).isEmpty():
            break
        over = sums.where((F.col("depth") == last) & ~F.col("fits")).select(F.col("shard").alias("cell"))
        rows = cut(keyed.join(F.broadcast(over) if few(over) else over, "cell", "left_semi").drop("cell"))
        start = last
    return shards, parts


def together(parts: list[DataFrame], limit: int) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).withColumn("oversized", F.col("shard_bytes") > limit)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, shard (bits), depth, shard_bytes, shard_rows, oversized."""
    return together(placed(rows_of(docs), limit)[1], limit).select("doc_id", "n_bytes", *SHARD, "oversized")


def directory(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per shard: shard (the prefix of hash bits), depth, shard_bytes, shard_rows, oversized."""
    return together(placed(rows_of(docs), limit)[0], limit)


def lookup(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """docs and the shard that a directory has for each row, also for rows that came later: `shard` is null where
    no row was before, and for rows that only their place told apart."""
    name = free_name(docs, "shard")
    depths = [r.depth for r in shards.select("depth").distinct().collect()]  # at most 65
    bits = docs.select(F.struct("*").alias("row"), content_bits().alias("bits"), F.monotonically_increasing_id().alias("at"))
    bits = cut(bits)
    known = shards.select("depth", F.col("shard").alias("prefix"))
    asked = bits.select("at", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("prefix")) for d in depths if d <= CONTENT])).alias("k")).select("at", "k.*") if depths else None
    if asked is None:
        return docs.withColumn(name, F.lit(None).cast("string"))
    found = cut(asked.join(F.broadcast(known) if few(known) else known, ["depth", "prefix"]).select("at", F.col("prefix").alias(name)))
    return bits.join(found, "at", "left").select("row.*", name)


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Writes docs with one folder for each shard (`shard=<bits>`, "all" for a single one); the directory.

    The rows that are written are those that were placed: they are carried along, not looked up a second time. A
    shard holds at most `limit` bytes, so each is one task's work."""
    shards, parts = placed(rows_of(docs, F.struct("*").alias("row")), limit)
    name = free_name(docs, "shard")
    out = reduce(DataFrame.unionByName, parts).select("row.*", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias(name))
    out.repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)
    return together(shards, limit)


ORACLE = f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS h, row_number() OVER () AS row FROM documents),
     x AS (SELECT *, list_aggregate(list_transform(range(1, {CONTENT // 4 + 1}), lambda i: lpad(bin(('0x' || h[i:i])::BIGINT), 4, '0')), 'string_agg', '') AS bits FROM r),
     p AS (SELECT row, doc_id, n_bytes, d AS depth, bits[1:d] AS shard FROM x, (SELECT unnest(range(0, {CONTENT + 1})) AS d)),
     s AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY 1, 2)
SELECT doc_id, n_bytes, shard, depth::INT AS depth, shard_bytes, shard_rows, shard_bytes > {LIMIT} AS oversized
FROM p JOIN s USING (depth, shard) WHERE shard_bytes <= {LIMIT} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY row ORDER BY depth) = 1
"""
