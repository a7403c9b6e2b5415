"""The masking state over a stream: what each payload id maps to, with a time to live.

Rows arrive with what they would be masked to; the state decides per id, in arrival order, whether a row is
masked, restored, answered with its earlier mask or echoed. Ids are compared without case and blanks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from veilframe.functions.text import store_key
from veilframe.operators.spans import looks_label_masked, looks_masked
from veilframe.plans.config import Config
from veilframe.plans.engine import Engine

ENTRY = StructType([StructField("original", StringType()), StructField("masked", StringType())])
RESULT = StructType([StructField("seq", LongType()), StructField("payload_id", StringType()), StructField("operation", StringType()), StructField("result", StringType())])


class Guard(StatefulProcessor):
    """One entry per id. A repeated mask restarts the time to live; an entry beyond it is a miss."""

    def __init__(self, ttl_ms: int, max_value_bytes: int, identity: bool = False):
        self.ttl_ms, self.max_value_bytes, self.identity = ttl_ms, max_value_bytes, identity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.entry.get() if self.entry.exists() else None
        for frame in rows:  # one at a time: an id may have any number of rows
            out = []
            for r in frame.sort_values("seq", kind="stable").itertuples():
                operation, result, known = decide(r, known, self.max_value_bytes, self.identity)
                out.append((r.seq, r.payload_id, operation, result))
            yield pd.DataFrame(out, columns=[f.name for f in RESULT])
        if known is not None:
            self.entry.update(tuple(known))

    def close(self) -> None:
        pass


def decide(row, known, max_value_bytes: int, identity: bool = False):
    """(operation, result, entry afterwards) of a row, given the entry of its id. With `identity` a payload that was
    left as it is has an entry, too, so that the way back finds it whatever its text looks like."""
    if known is not None and row.payload == known[1]:
        return "demask", known[0], known
    if known is not None and row.payload == known[0]:
        return "again", known[1], known
    if known is None and row.masked_already:
        return "echo", row.payload, None
    stored = (identity or row.masked != row.payload) and row.may_store and max(len(row.payload.encode()), len(row.masked.encode())) <= max_value_bytes
    return "mask", row.masked, (row.payload, row.masked) if stored else known


def prepared(stream: DataFrame, engine: Engine) -> DataFrame:
    """(seq, payload_id, payload, masked, masked_already, may_store, key): what deciding needs. Detection is done here, before
    the shuffle by key."""
    config = engine.config
    allowed = [s.id for s in config.systems if s.demask]
    known = [s.id for s in config.systems]
    system = F.when(F.col("system_id").isin(known), F.col("system_id")).otherwise(config.default_system)
    return engine.mask(stream.withColumn("payload", F.coalesce("payload", F.lit("")))).select(
        "seq",
        "payload_id",
        "payload",
        "masked",
        (looks_masked("payload") | looks_label_masked("payload", engine.has_label_rule(stream))).cast(BooleanType()).alias("masked_already"),
        (system.isin(allowed) & (F.length(F.trim("payload_id")) > 0)).alias("may_store"),
        F.when(F.length(F.trim("payload_id")) > 0, store_key("payload_id")).otherwise(F.concat(F.lit("\u0000"), F.col("seq").cast("string"))).alias("key"),
    )


def guard(stream: DataFrame, engine: Engine, mode: str = "append") -> DataFrame:
    """(seq, payload_id, operation, result) of a stream (seq, payload_id, payload, system_id).

    An empty id has no entry and is only masked. Where a failing detector leaves a payload as it is (on_error "echo"), the
    payload is stored as its own mask. Rows of one id are decided in the order of their Arrow batches, inside one by
    seq. The state store must be RocksDB."""
    config = engine.config
    processor = Guard(config.store.ttl_ms, config.store.max_value_bytes, identity=config.on_error == "echo")
    return prepared(stream, engine).groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=RESULT, outputMode=mode, timeMode="ProcessingTime")


def masked_with_reload(stream: DataFrame, load: Callable[[], Config], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Masks each micro-batch by the configuration that load() gives when the batch begins, so that changed rules, systems
    and word lists hold from the next batch on without a restart. write(masked, batch_id) must be idempotent."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        write(Engine(load()).mask(rows), batch_id)

    return stream.writeStream.foreachBatch(batch)
