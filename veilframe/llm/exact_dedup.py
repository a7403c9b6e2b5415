"""Exact dedup (native): heavy-hitter split on digests of normalised texts.

A first pass turns each row into (doc_id, digest). Misra-Gries counters (approx_top_k) name the
digests that may be frequent; their exact counts and smallest rows are verified by a map-side
combined aggregate, and the verified winners - `hot` rows at most - are broadcast, so that rows of
large groups are settled where they were read. Only the other digests are shuffled. Any digest of more than about
rows / tracked rows is among the candidates; as only the `hot` most frequent of these are broadcast, one that is
shuffled holds at most about rows / hot rows.

Null text counts as empty; empty texts equal each other; a null doc_id counts as larger than any
other; of rows with equal text and equal doc_id exactly one is kept; an empty table gives an empty
result; other columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, frequent, without


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def settle(rows: DataFrame, hot: int = 4096, tracked: int = 32768) -> DataFrame:
    """rows (id, digest) -> (id, digest, first, group_size, kept): the smallest id of the digest."""
    numbered = cut(rows.select("id", "digest", F.monotonically_increasing_id().alias("row")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    candidates = frequent(numbered, "digest", hot, tracked).withColumnRenamed("key", "digest")
    verified = (
        numbered.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    )
    winners = cut(verified)
    marked = numbered.join(F.broadcast(winners), "digest", "left")
    large = marked.where("best is not null")
    cold = numbered.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    small = cold.join(
        cold.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "digest"
    )
    columns = ["id", "digest", F.col("best.id").alias("first"), "group_size", (F.col("row") == F.col("best.row")).alias("kept")]
    return large.select(*columns).unionByName(small.select(*columns))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        F.col(id_column).alias("id"), F.sha2(F.encode(normalised(F.col(text_column)), "UTF-8"), 256).alias("digest")
    )
    return settle(rows, hot).select(
        F.col("id").alias("doc_id"),
        F.col("first").alias("keep_id"),
        "group_size",
        "kept",
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, same columns, with one row of each group of equal texts: the one of the smallest id.

    Rows to drop are named by (id, digest), so that an id that stands for two texts loses only the
    one that is a copy; of fully equal rows of one id, which no key tells apart, the first stays."""
    keys = ["_none", "_id", "_digest"]
    named = lambda id_, digest: [F.isnull(id_).alias("_none"), F.coalesce(F.col(id_), F.lit(0)).alias("_id"), digest.alias("_digest")]
    found = exact_dedup(docs, id_column, text_column)
    gone = found.where("not kept").select(*named("doc_id", F.col("text_sha256")), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("twin"))
    gone = cut(gone)
    twins = cut(gone.where("twin").select(keys).distinct())
    keyed = docs.select("*", *named(id_column, F.sha2(F.encode(normalised(F.col(text_column)), "UTF-8"), 256)))
    kept = without(keyed, gone.where("not twin"), keys)
    if twins.isEmpty():
        return kept.select(docs.columns)
    single = kept.join(twins, keys, "left_anti").select(docs.columns)
    several = kept.join(twins, keys, "left_semi").dropDuplicates(keys).select(docs.columns)
    return single.unionByName(several)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
