"""A token bucket per key over a stream: refilled continuously, up to a minute's allowance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

BUCKET = StructType([StructField("tokens", DoubleType()), StructField("at", DoubleType())])
RESULT = StructType([StructField("seq", LongType()), StructField("key", StringType()), StructField("allowed", BooleanType()), StructField("retry_after", DoubleType())])


def take(tokens: float, last: float, now: float, per_minute: int) -> tuple[bool, float, float]:
    """(allowed, tokens left, seconds until the next token) of a request at `now`."""
    tokens = min(float(per_minute), tokens + max(0.0, now - last) * per_minute / 60)
    if tokens >= 1:
        return True, tokens - 1, 0.0
    return False, tokens, (1 - tokens) * 60 / per_minute


class Bucket(StatefulProcessor):
    def __init__(self, per_minute: int):
        self.per_minute = per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a bucket that rested for a minute is full: it needn't be kept
        self.bucket = handle.getValueState("bucket", BUCKET, ttlDurationMs=120_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        tokens, last = self.bucket.get() if self.bucket.exists() else (float(self.per_minute), float(batch["at"].iloc[0]))
        out = []
        for r in batch.itertuples():
            allowed, tokens, wait = take(tokens, last, r.at, self.per_minute)
            last = max(last, r.at)
            out.append((r.seq, key[0], allowed, wait))
        self.bucket.update((tokens, last))
        yield pd.DataFrame(out, columns=[f.name for f in RESULT])

    def close(self) -> None:
        pass


def limit(stream: DataFrame, per_minute: int, key: str = "system_id", ts: str = "ts") -> DataFrame:
    """(seq, key, allowed, retry_after) of a stream with seq, a key and a time."""
    rows = stream.select("seq", F.coalesce(F.col(key), F.lit("")).alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Bucket(per_minute), outputStructType=RESULT, outputMode="append", timeMode="ProcessingTime")
