"""The mapping store of a stream with a bound on its entries, and one that outlives changes of the rules.

capped_guard keeps entries in shards. A shard's queue numbers them by the time they were last masked; a timer sweeps what is
beyond its time to live from the queue's front, and so does a shard over its cap, which drops the oldest. Each
step looks at the front only, so that a shard of any size costs as much as what leaves it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilframe.plans.config import Config
from veilframe.plans.engine import Engine
from veilframe.streaming.guard import RESULT, decide, prepared

ENTRY = StructType([StructField("original", StringType()), StructField("masked", StringType()), StructField("number", LongType())])
PLACE = StructType([StructField("key", StringType()), StructField("until", LongType())])
ENDS = StructType([StructField("head", LongType()), StructField("tail", LongType()), StructField("count", LongType()), StructField("timer", LongType())])
KEY, NUMBER = StructType([StructField("key", StringType())]), StructType([StructField("number", LongType())])


class Shelf:
    """Entries by id and their queue, over two maps (get, put, remove) and the numbers of the queue's ends."""

    def __init__(self, entries, queue, head: int = 0, tail: int = 0, count: int = 0):
        self.entries, self.queue, self.head, self.tail, self.count = entries, queue, head, tail, count

    def get(self, key: str) -> tuple[str, str] | None:
        found = self.entries.get(key)
        return (found[0], found[1]) if found else None

    def put(self, key: str, original: str, masked: str, until: int) -> None:
        """Stores an entry or restarts its time to live: its place is the queue's end now."""
        self.count += self.entries.get(key) is None
        self.entries.put(key, (original, masked, self.tail))
        self.queue.put(self.tail, (key, until))
        self.tail += 1

    def front(self) -> tuple[str, int] | None:
        """The oldest entry (key, until); places that their entries have left are passed over."""
        while self.head < self.tail:
            place = self.queue.get(self.head)
            entry = self.entries.get(place[0]) if place else None
            if entry and entry[2] == self.head:
                return place
            self.queue.remove(self.head)
            self.head += 1
        return None

    def drop(self, key: str) -> None:
        self.entries.remove(key)
        self.queue.remove(self.head)
        self.head, self.count = self.head + 1, self.count - 1

    def expire(self, now: int) -> list[str]:
        """Drops what is beyond its time to live."""
        gone = []
        while (oldest := self.front()) and oldest[1] <= now:
            self.drop(oldest[0])
            gone.append(oldest[0])
        return gone

    def evict(self, cap: int) -> list[str]:
        """Drops the oldest entries over the cap."""
        gone = []
        while self.count > cap and (oldest := self.front()):
            self.drop(oldest[0])
            gone.append(oldest[0])
        return gone


class Kept:
    """A MapState of one-column keys as get, put and remove."""

    def __init__(self, state):
        self.state = state

    def get(self, key):
        return tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None

    def put(self, key, value) -> None:
        self.state.updateValue((key,), value)

    def remove(self, key) -> None:
        self.state.removeKey((key,))


class CappedGuard(StatefulProcessor):
    def __init__(self, ttl_ms: int, cap: int, max_value_bytes: int, identity: bool = False):
        self.ttl_ms, self.cap, self.max_value_bytes, self.identity = ttl_ms, cap, max_value_bytes, identity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries, self.queue = Kept(handle.getMapState("entries", KEY, ENTRY)), Kept(handle.getMapState("queue", NUMBER, PLACE))
        self.ends = handle.getValueState("ends", ENDS)

    def shelf(self) -> tuple[Shelf, int]:
        head, tail, count, timer = self.ends.get() if self.ends.exists() else (0, 0, 0, 0)
        return Shelf(self.entries, self.queue, head, tail, count), timer

    def keep(self, shelf: Shelf, timer: int, now: int) -> None:
        """Saves the queue's ends; a timer waits for the oldest entry, one at a time."""
        oldest = shelf.front()
        if oldest and timer <= now:
            timer = max(oldest[1], now + 1)
            self.handle.registerTimer(timer)
        self.ends.update((shelf.head, shelf.tail, shelf.count, timer))

    def told(self, operation: str, keys: list[str]) -> Iterator[pd.DataFrame]:
        if keys:
            yield pd.DataFrame([(None, k, operation, None) for k in keys], columns=[f.name for f in RESULT]).astype({"seq": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        shelf, timer = self.shelf()
        yield from self.told("expired", shelf.expire(now))
        for frame in rows:
            out = []
            for r in frame.sort_values("seq", kind="stable").itertuples():
                known = shelf.get(r.key)
                operation, result, entry = decide(r, known, self.max_value_bytes, self.identity)
                if entry is not None and operation in ("mask", "again") and (entry != known or operation == "again"):
                    shelf.put(r.key, *entry, now + self.ttl_ms)
                out.append((r.seq, r.payload_id, operation, result))
            yield pd.DataFrame(out, columns=[f.name for f in RESULT])
            yield from self.told("evicted", shelf.evict(self.cap))
        self.keep(shelf, timer, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        shelf, _ = self.shelf()
        yield from self.told("expired", shelf.expire(now))
        self.keep(shelf, 0, now)

    def close(self) -> None:
        pass


def capped_guard(stream: DataFrame, engine: Engine, mode: str = "append") -> DataFrame:
    """guard() with at most config.store.max_entries entries, in config.store.shards shards, each with its part of them.

    Besides what was decided, rows tell ids that left: operation `expired` or `evicted`, without seq and result. Rows of one
    id are decided in the order of their Arrow batches, inside one by seq."""
    store = engine.config.store
    rows = prepared(stream, engine).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(store.shards)).cast("int"))
    processor = CappedGuard(store.ttl_ms, max(1, store.max_entries // store.shards), store.max_value_bytes, identity=engine.config.on_error == "echo")
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=processor, outputStructType=RESULT, outputMode=mode, timeMode="ProcessingTime")


MAPPING = "key string, original string, masked string, types array<string>"


def reloading_guard(stream: DataFrame, load: Callable[[], Config], folder: str, write: Callable[[DataFrame, int], None], batches: int | None = None) -> DataStreamWriter:
    """Masks and restores a stream (payload_id, payload, system_id, ...) by the rules that load() gives for each micro-batch,
    with a mapping that rule changes don't touch: a payload masked under earlier rules is restored after them.

    The mapping is a table in `folder`, which executors share: a part for each batch, overwritten if the batch is
    repeated, and joined by id. Only the last `batches` parts are looked at, if given, which bounds an entry's life. write(results, batch_id)
    gets the rows with operation and result, and must be idempotent. Rows of one batch don't see each other's mapping."""
    part = lambda n: f"{folder}/batch={n}"

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark, engine = rows.sparkSession, Engine(load())
        spark.createDataFrame([], MAPPING).write.mode("overwrite").parquet(part(-1))  # so that there is a table
        table = spark.read.schema(f"{MAPPING}, batch long").parquet(folder)
        seen = table.where((F.col("batch") < batch_id) & (F.col("batch") >= (batch_id - batches if batches else -1)))
        known = seen.groupBy("key").agg(F.max_by(F.struct("original", "masked"), "batch").alias("e")).select("key", "e.*")
        done = engine.demask(rows, known).persist()
        changed = done.where("operation = 'mask' AND result != payload").withColumn("masked", F.col("result"))
        new = engine.mapping(changed.withColumn("replacements", F.array(F.lit(1))).withColumn("types", F.array().cast("array<string>")))
        new.write.mode("overwrite").parquet(part(batch_id))
        write(done, batch_id)
        done.unpersist()

    return stream.writeStream.foreachBatch(batch)
