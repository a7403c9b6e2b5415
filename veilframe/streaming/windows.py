"""Event-time windows over streams of traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(stream: DataFrame, ts: str = "ts", size: str = "10 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """(start, end, op, n): requests by sliding window; rows later than the watermark are left out."""
    w = F.window(F.col(ts).cast("timestamp"), size, slide).alias("w")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(w, "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "n")


def sessions(stream: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, system_id, n): runs of a system's requests without a longer gap."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), "system_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "system_id", "n")
