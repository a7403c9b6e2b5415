"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the
words of every document, with hits verified byte by byte.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is `n`
consecutive words of one benchmark item; an item of fewer words, but not none, is one window of its
own length. The set of a block of items is a few flat arrays, about five times as large as the items' text. Blocks
hold at most `block_bytes` of text (or one item that is longer); `per_pass` of them are broadcast at a time and scanned
in one pass over the documents. A benchmark of more blocks takes more passes, and what the passes have found so far is
kept in the shared folder between them, so that no worker ever holds more than one pass's blocks.

Null texts have no words; items without words are ignored; items
with equal texts are all reported; an item_id may be null (it is then reported as an empty string).
Repeated rows are judged one by one, a null doc_id like any other; a text of any length is scanned whole; further columns
of either table are ignored, whatever their names; empty tables give an empty result or no hits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from veilframe.llm.bytesig import LOWER, WORD, U, hashes, spans, windows
from veilframe.llm.common import cut, mapped, pieces, utf8

SCHEMA = "doc_id long, n_words long, n_hit long, hit_items array<string>, spans array<struct<start:int,stop:int>>"
ITEMS, SPANS = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
BLOCK_BYTES, PER_PASS = 4 << 20, 4


class Windows:
    """Windows of one length: sorted hashes, the first word of a window with each, and the items that hold it (those
    from edge[i] to edge[i + 1])."""

    __slots__ = ("size", "marks", "word", "edge", "item")

    def __init__(self, size: int, marks: np.ndarray, word: np.ndarray, item: np.ndarray, text: Callable[[int, int], bytes]):
        order = np.lexsort((word, item, marks))
        marks, word, item = marks[order], word[order], item[order]
        first = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        fresh, kept = np.zeros(len(marks), bool), np.append(True, (marks[1:] != marks[:-1]) | (item[1:] != item[:-1]))
        fresh[first] = True
        for a, b in zip(first, np.append(first[1:], len(marks)), strict=True):
            if b - a > 1 and len({text(w, size) for w in word[a:b].tolist()}) > 1:  # other words with the same hash
                texts = [text(w, size) for w in word[a:b].tolist()]
                again = sorted(range(b - a), key=lambda i: (texts[i], item[a + i]))  # noqa: B023
                word[a:b], item[a:b] = word[a:b][again], item[a:b][again]
                for i in range(1, b - a):
                    fresh[a + i] = texts[again[i]] != texts[again[i - 1]]
                    kept[a + i] = fresh[a + i] or item[a + i] != item[a + i - 1]
        fresh, word, item, marks = fresh[kept], word[kept], item[kept], marks[kept]
        self.size, self.marks, self.word = size, marks[fresh], word[fresh]
        self.edge, self.item = np.append(np.flatnonzero(fresh), len(item)).astype(np.uint32), item


class WindowSet:
    """The windows of some benchmark items, by length, and the items' words, joined by single spaces."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = [i for i, _ in items]
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        starts, ends, rows = spans(data, offsets, WORD)
        size, count = ends - starts, np.bincount(rows, minlength=len(items)) if len(rows) else np.zeros(len(items), np.int64)
        self.words = np.full(int(size.sum()) + len(starts), 0x20, np.uint8)
        self.words[np.arange(size.sum()) + np.repeat(np.arange(len(starts)), size)] = data[WORD[data]]
        self.at = np.append(0, np.cumsum(size + 1)).astype(np.uint32 if len(self.words) < 1 << 32 else np.uint64)
        marks, first = hashes(data, starts, ends), np.cumsum(count) - count
        found: dict[int, list[tuple]] = defaultdict(list)
        seen = windows(marks, n)
        whole = np.flatnonzero(rows[: len(seen)] == rows[n - 1 :]) if len(seen) else np.empty(0, np.int64)
        if len(whole):
            found[n].append((seen[whole], whole, rows[whole]))
        for i in np.flatnonzero((count > 0) & (count < n)):
            k = int(count[i])
            found[k].append((windows(marks[first[i] : first[i] + k], k), np.array([first[i]]), np.array([i])))
        self.tables = [Windows(k, *(np.concatenate(c).astype(t) for c, t in zip(zip(*parts, strict=True), (U, np.uint32, np.uint32), strict=True)), self.text) for k, parts in sorted(found.items())]

    def text(self, word: int, size: int) -> bytes:
        return self.words[self.at[word] : self.at[word + size] - 1].tobytes()

    def nbytes(self) -> int:
        return self.words.nbytes + self.at.nbytes + sum(getattr(t, k).nbytes for t in self.tables for k in ("marks", "word", "edge", "item"))


def scan(sets: list[WindowSet], data: np.ndarray, offsets: np.ndarray):
    """For each row: number of words, mask of hit words, items; and all words' bounds and rows."""
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets, WORD)
    hit, items = np.zeros(len(starts), bool), defaultdict(set)
    marks = hashes(data, starts, ends)
    for size in sorted({t.size for known in sets for t in known.tables}):
        if len(starts) < size:
            continue
        seen = windows(marks, size)
        whole = rows[: len(seen)] == rows[size - 1 :]
        for known in sets:
            for t in known.tables:
                if t.size != size:
                    continue
                at = np.searchsorted(t.marks, seen)
                here = np.flatnonzero((t.marks[np.minimum(at, len(t.marks) - 1)] == seen) & whole)
                for i, k in zip(here.tolist(), at[here].tolist(), strict=True):
                    text = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True))
                    while k < len(t.marks) and t.marks[k] == seen[i]:
                        if known.text(int(t.word[k]), size) == text:
                            hit[i : i + size] = True
                            items[int(rows[i])].update(known.names[x] for x in t.item[t.edge[k] : t.edge[k + 1]].tolist())
                            break
                        k += 1
    return np.bincount(rows, minlength=len(offsets) - 1), hit, items, starts, ends, rows


def hit_runs(hit, starts, ends, rows, offsets, n: int) -> list[list[dict]]:
    """For each of n rows the byte ranges of its runs of hit words."""
    runs: list[list[dict]] = [[] for _ in range(n)]
    edge = np.flatnonzero(hit)
    if len(edge):
        breaks = np.flatnonzero((np.diff(edge) > 1) | (np.diff(rows[edge]) > 0))
        for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(edge) - 1), strict=True):
            row = int(rows[edge[a]])
            runs[row].append({"start": int(starts[edge[a]] - offsets[row]), "stop": int(ends[edge[b]] - offsets[row])})
    return runs


def blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[WindowSet]:
    """The benchmark's windows in blocks of bounded size, read to the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        more = len((row.text or "").encode())
        if block and size + more > block_bytes:
            yield WindowSet(block, n)
            block, size = [], 0
        block.append((row.i or "", row.text))
        size += more
    yield WindowSet(block, n)


class Found:
    """What has been found in a batch: of each row the number of words, the items, and byte ranges of hit runs."""

    def __init__(self, sets: list[WindowSet], texts: pa.Array, before: tuple[list, list] | None):
        data, offsets = utf8(texts)
        self.n = len(offsets) - 1
        self.n_words, hit, items, starts, ends, rows = scan(sets, data, offsets)
        old_items, old_spans = before or ([()] * self.n, [()] * self.n)
        for row, runs in enumerate(old_spans):
            lo, hi = np.searchsorted(rows, [row, row + 1]) if runs else (0, 0)
            for r in runs or ():  # a word that two blocks hit counts once
                hit[lo:hi] |= (starts[lo:hi] - offsets[row] >= r["start"]) & (ends[lo:hi] - offsets[row] <= r["stop"])
        self.n_hit = np.bincount(rows[hit], minlength=self.n)
        self.items = [sorted({*(old_items[i] or ()), *items.get(i, ())}) for i in range(self.n)]
        self.spans = hit_runs(hit, starts, ends, rows, offsets, self.n)

    def columns(self) -> list[pa.Array]:
        return [pa.array(self.items, ITEMS), pa.array(self.spans, SPANS)]


def swept(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, per_pass: int, last: Callable, schema) -> DataFrame:
    """docs after as many passes as the benchmark takes. last(batch of docs, found) makes what the last pass gives, by
    `schema`; a pass before it adds two columns of what has been found, which go before the others in its batches."""
    todo = blocks(benchmark, n, block_bytes)
    sets, state = list(islice(todo, per_pass)), False
    at, texts = docs, docs.columns.index("text")
    names = ["_" * (1 + max(map(len, docs.columns))) + k for k in ("items", "spans")]  # no column of docs is called so
    while sets:
        more = list(islice(todo, per_pass))
        known = docs.sparkSession.sparkContext.broadcast(sets)

        def run(batches, known=known, state=state, final=not more):
            skip = 2 if state else 0
            for batch in pieces(batches, texts + skip):
                rest = pa.RecordBatch.from_arrays(batch.columns[skip:], schema=pa.schema(list(batch.schema)[skip:]))
                found = Found(known.value, rest.column(texts), tuple(c.to_pylist() for c in batch.columns[:2]) if state else None)
                yield last(rest, found) if final else pa.RecordBatch.from_arrays([*found.columns(), *rest.columns], [*names, *rest.schema.names])

        if more:
            fields = _parse_datatype_string(f"{names[0]} array<string>, {names[1]} array<struct<start:int,stop:int>>").fields
            at = cut(mapped(at, run, StructType([*fields, *(StructField(f.name, f.dataType) for f in docs.schema)])))
        else:
            return mapped(at, run, schema)
        sets, state = more, True
    raise AssertionError("blocks() gives one block at least")


def find_overlap(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES, per_pass: int = PER_PASS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, hit_items, spans (byte ranges of hit runs)."""

    def last(batch, found):
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.n_words, pa.int64()), pa.array(found.n_hit, pa.int64()), *found.columns()], ["doc_id", "n_words", "n_hit", "hit_items", "spans"])

    return swept(docs.select("doc_id", "text"), benchmark, n, block_bytes, per_pass, last, SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of a find_overlap result."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("hit_items"), ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_spans(text: str | None, ranges) -> str | None:
    """text without the given byte ranges."""
    if text is None or not ranges:
        return text
    data, at, kept = text.encode(), 0, []
    for r in ranges:
        kept.append(data[at : r["start"]])
        at = r["stop"]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "documents", block_bytes: int = BLOCK_BYTES, per_pass: int = PER_PASS) -> DataFrame:
    """docs with the same columns, less contaminated documents ("documents") or hit spans ("spans").

    The texts are scanned and filtered without a shuffle: all columns travel along."""
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    at = docs.columns.index("text")

    def last(batch, found):
        if action == "documents":
            return batch.filter(pa.array(found.n_hit == 0))
        if found.n_hit.any():
            texts = [cut_spans(t, found.spans[i]) for i, t in enumerate(batch.column(at).to_pylist())]
            return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        return batch

    return swept(docs, benchmark, n, block_bytes, per_pass, last, docs.schema)


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
     b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
     k AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     s AS (SELECT DISTINCT n FROM k),
     x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN s ON len(w) >= n)),
     h AS (SELECT x.doc_id, x.i, x.n, k.item_id FROM x JOIN k USING (n, g)),
     c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
