"""Detection over a text column: native detectors, context scanners in Arrow batches, long texts in chunks, users' categories."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.types import SPANS
from veilframe.operators import native
from veilframe.operators.scan import Context, scan
from veilframe.operators.scan.context import Span, evidence, resolve
from veilframe.operators.spans import resolve as resolved

def cuts(data: bytes, size: int) -> list[int]:
    """Where a payload of more than `size` bytes is cut: at the last newline, else the last space, of the
    last quarter of each window, else between two characters."""
    out, at = [], 0
    while len(data) - at > size:
        window = data[at : at + size]
        low = size - size // 4
        place = window.rfind(b"\n", low)
        if place < 0:
            place = window.rfind(b" ", low)
        cut = at + place + 1 if place >= 0 else at + size
        while cut > at + 1 and data[cut] & 0xC0 == 0x80:
            cut -= 1
        out.append(cut)
        at = cut
    return out


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(byte offset, text) of each chunk; each reaches `overlap` bytes back into the one before."""
    data = text.encode()
    if len(data) <= size:
        return [(0, text)]
    out, start = [], 0
    for cut in [*cuts(data, size), len(data)]:
        back = max(0, start - overlap)
        while back and data[back] & 0xC0 == 0x80:
            back -= 1
        out.append((back, data[back:cut].decode()))
        start = cut
    return out


def spans_of(text: str | None, enabled: frozenset[str], ref_year: int, dictionaries: dict, size: int, overlap: int) -> list[Span]:
    """The resolved spans of one text, in bytes."""
    if not text:
        return []
    parts = chunks(text, size, overlap)
    if len(parts) == 1:
        return resolve(scan(Context(text, enabled, ref_year, dictionaries)))
    found = []
    for offset, part in parts:
        found += [s._replace(start=s.start + offset, end=s.end + offset) for s in resolve(scan(Context(part, enabled, ref_year, dictionaries)))]
    return resolve(found)


def scanned(text: Column, types: Iterable[str], ref_year: int = 2025, dictionaries: dict | None = None, size: int = 64 << 10, overlap: int = 256, on_error: str = "fail") -> Column:
    """The spans that the context scanners find, resolved. Disabled categories aren't looked for. A
    scanner's failure fails the task, or with on_error "echo" leaves the text without spans.

    Python sees only texts that match a pattern of what the categories can't do without (a digit, a Cyrillic
    letter, an @ ...), which the JVM tests; of other texts not a byte is sent."""
    enabled, words = frozenset(types), dictionaries or {}

    def one(text: str | None) -> list[dict]:
        try:
            return [s._asdict() for s in spans_of(text, enabled, ref_year, words, size, overlap)]
        except Exception:
            if on_error == "fail":
                raise
            return []

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    gate = evidence(enabled)
    # the mark keeps Catalyst from merging a second detection into what reads it, as it must not in an aggregate
    return found.asNondeterministic()(F.when(text.rlike(gate), text) if gate else text)


def explode_chunks(df: DataFrame, key: str, text: str, size: int = 64 << 10, overlap: int = 256) -> DataFrame:
    """(key, offset, chunk): rows of bounded size for documents of any length, so that one huge
    document is many tasks' work. Regroup what was found by key and resolve it again."""
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            keys, offsets, parts = [], [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for offset, part in chunks(t or "", size, overlap):
                    keys.append(k)
                    offsets.append(offset)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(offsets, pa.int32()), pa.array(parts, pa.string())], ["key", "offset", "chunk"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, offset int, chunk string")


class Chunks:
    """The table function text_chunks(text, size, overlap): (offset, chunk)."""

    def eval(self, text: str, size: int, overlap: int):
        yield from chunks(text or "", size, overlap)


def register_chunks(spark) -> None:
    spark.udtf.register("text_chunks", F.udtf(Chunks, returnType="offset: int, chunk: string"))


def both(text: str, types: Iterable[str], ref_year: int, dictionaries: dict | None, size: int, overlap: int, on_error: str, mailboxes: str = "personal") -> Column | None:
    """The spans of native detectors and context scanners, unresolved; None if no category is enabled. Python is in the
    plan only if a category needs a scanner."""
    types = set(types)
    institutions = tuple(dict((dictionaries or {}).get("words", ())).get("institutions", ()))
    parts = []
    if types & native.TYPES:
        parts.append(native.detect(text, sorted(types & native.TYPES), institutions, mailboxes))
    if types - native.TYPES:
        parts.append(F.coalesce(scanned(F.col(text), types - native.TYPES, ref_year, dictionaries, size, overlap, on_error), F.array().cast(SPANS)))
    return (parts[0] if len(parts) == 1 else F.concat(*parts)) if parts else None


def users(text: Column, custom: Iterable) -> list[Column]:
    return [native.custom(text, t.name, t.pattern, t.anchors, t.window or 40) for t in custom]


def detect_long(df: DataFrame, key: str, text: str = "payload", types: Iterable[str] = (), custom: Iterable = (), ref_year: int = 2025, dictionaries: dict | None = None, size: int = 64 << 10, overlap: int = 256, on_error: str = "fail", mailboxes: str = "personal") -> DataFrame:
    """(key, spans): what detect() finds, for tables with documents of any length: their chunks are rows of their
    own, dealt out anew, so that one huge document is many tasks' work. Only spans come back together. A value of a
    user-defined category is found if it and its anchor fit into what two chunks share."""
    parts = explode_chunks(df, key, text, size, overlap).repartition("key", "offset")
    found = both("chunk", types, ref_year, dictionaries, size + overlap + 4, overlap, on_error, mailboxes)
    columns = ([] if found is None else [found]) + users(F.col("chunk"), custom)
    spans = parts.select("key", "offset", (F.concat(*columns) if columns else F.array().cast(SPANS)).alias("spans"))
    moved = F.transform("spans", lambda s: s.withField("start", s["start"] + F.col("offset")).withField("end", s["end"] + F.col("offset")))
    grouped = spans.select("key", F.explode_outer(moved).alias("s")).groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    return grouped.select("key", resolved(F.col("spans")).alias("spans"))


def detect(df: DataFrame, text: str = "payload", types: Iterable[str] = (), custom: Iterable = (), ref_year: int = 2025, dictionaries: dict | None = None, size: int = 64 << 10, overlap: int = 256, out: str = "spans", on_error: str = "fail", mailboxes: str = "personal") -> DataFrame:
    """df with a column of resolved spans.

    E-mail addresses, numbers and user-defined categories are native columns; the context scanners run, in one Python
    pass, for names, passports, dates and addresses only. Overlaps are resolved last."""
    c = F.col(text)
    found = both(text, types, ref_year, dictionaries, size, overlap, on_error, mailboxes)
    columns = ([] if found is None else [found]) + users(c, custom)
    raw = F.concat(*columns) if columns else F.array().cast(SPANS)
    return df.withColumn(out, once(F.when(c.isNotNull(), resolved(raw))))


def once(c: Column) -> Column:
    """c, which Catalyst must not compute again in what reads it: filters that it infers for a later explode or aggregate
    would repeat a whole detection. An expression that isn't deterministic is never copied."""
    return F.when(F.spark_partition_id() >= 0, c)
