"""What the corpus operators share: the shared folder, lineage cuts, frequent keys, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, with its file system. The cluster names it in spark.checkpoint.dir; only where
    that is unset (tests on one machine) a temporary folder is set instead."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilframe-"))
    return qualified(spark, named or spark.sparkContext.getCheckpointDir())


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of its file system: without one it is in Hadoop's default file system, as for Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame) -> None:
    """Deletes what cut() kept of frames that nothing reads any more."""
    for df in frames:
        kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if kept.isDefined():
            remove(df.sparkSession, kept.get())


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frequent(df: DataFrame, column: str, k: int = 4096, tracked: int = 32768) -> DataFrame:
    """Candidates for the values of a column that are frequent: a DataFrame (key) of k rows at most.

    approx_top_k keeps a Misra-Gries style table of `tracked` counters in each task and merges the
    tables; a value with more than about rows / tracked occurrences can't be missing from it. Only
    the at most k winners leave the aggregate, so what a caller broadcasts has a fixed bound."""
    found = df.where(F.col(column).isNotNull()).agg(F.expr(f"approx_top_k({column}, {k}, {tracked})").alias("top"))
    top = F.explode("top").alias("t")
    return found.select(top).where("t.count > 1").select(F.col("t.item").alias("key"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; null counts as empty. No copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mapped(df: DataFrame, f, schema, most: int = 4 << 20) -> DataFrame:
    """df.mapInArrow(f, schema), with batches of about `most` bytes: rows hold whole texts, and Spark's
    default of ten thousand of them a batch would be held several times over on both sides. Spark reads the
    setting when the plan runs, so it stays set for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df.mapInArrow(f, schema)


def give_back() -> None:
    """Returns freed memory to the system: a worker that is done with a task may idle beside busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` text bytes, one row at least, so that the working
    arrays of a kernel stay small whatever the batch size is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(batch.num_rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether df (already cut) has so few rows that it may be broadcast."""
    return df.count() <= most


def looked_up(rows: DataFrame, facts: DataFrame, key: str | list[str], hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with facts (already cut), of one row per key. Rows whose (first) key is in `hot` - at most as many
    keys as frequent() gives - are settled where they are, by a broadcast; the others are shuffled. how: inner or left."""
    if few(facts):
        return rows.join(F.broadcast(facts), key, how)
    keys = [key] if isinstance(key, str) else key
    hot = cut((frequent(rows, keys[0]) if hot is None else hot).select(F.col("key").alias(keys[0])))
    large = cut(facts.join(F.broadcast(hot), keys[0], "left_semi"))
    small = rows.join(F.broadcast(large.select(keys)), keys, "left_anti").join(facts, keys, how)
    return rows.join(F.broadcast(large), keys).unionByName(small)


def without(docs: DataFrame, dropped: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """docs less the rows whose keys are in dropped. Up to `most` keys are broadcast, so that the
    texts stay where they are; more than that are joined by a shuffle. Rows with null keys stay."""
    dropped = cut(dropped.select(keys).dropDuplicates())
    return docs.join(F.broadcast(dropped) if few(dropped, most) else dropped, keys, "left_anti")


def within(docs: DataFrame, wanted: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """The rows of docs whose keys are in wanted (already distinct and cut); see without()."""
    return docs.join(F.broadcast(wanted) if few(wanted, most) else wanted, keys, "left_semi")
