"""Token-id files as directly addressable codes.

An id is split into chunks of `width` bits; level k holds, in order, the k-th chunks of the ids that
have one. Each level has a continuation bitmap (does this id go on in the next level?) and a rank
directory (how many set bits stand before each block of 512 bits), so the id at any position is found by one
rank per level, without decoding a block. A file holds the ids of consecutive documents in ascending
doc_id order, each followed by the end id, and a table of doc_ids and first positions.

File layout, little-endian: magic, header JSON and its length, then the arrays it names, each
with its dtype, offset and length.

Texts are range-partitioned by doc_id before they are encoded, so the ids themselves are never
shuffled; rows that share a doc_id are ranges of their own, by a hash of the text and by place. Files carry a name of
the task attempt, and only files named in the written catalogue are read. Null texts have the end id alone; rows of equal
doc_id stand in order of a hash of their text; null doc_ids come first; an empty table writes no file;
other columns are ignored.

Reading seeks: a reader takes a file's header, then of each array just the piece that some documents or one token
need. read() goes through all documents that way, lookup() fetches single tokens.

Texts are encoded by the tokenizers library, each distinct word once per worker (bpe_tree.Memo)."""

from __future__ import annotations

import json
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.bpe_tree import load, memo, tokenizer_bytes
from veilframe.llm.common import fresh_folder, mapped, pieces
from veilframe.llm.files import attempt_name, locate

MAGIC = b"VFDAC001"
RANK_BITS = 512
BLOCK = RANK_BITS // 8


class Codes:
    """A sequence of ids as chunk levels with continuation bitmaps and rank directories, wherever these are.

    level(k, a, b), bits(k, a, b) (bytes) and rank(k, i) give pieces of the arrays of level k."""

    width: int
    n: int
    depth: int

    def __getitem__(self, at: int) -> int:
        """The id at one position: a chunk and a rank for each of its levels."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k in range(self.depth):
            value |= int(self.level(k, at, at + 1)[0]) << (k * self.width)
            block = at // RANK_BITS
            bits = self.bits(k, block * BLOCK, (at >> 3) + 1)
            if not bits[-1] >> (at & 7) & 1:
                break
            at = self.rank(k, block) + ones_before(bits, at - block * RANK_BITS)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions start to stop; each level is one contiguous piece, found by one rank."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, at, to = np.arange(len(out)), start, stop
        for k in range(self.depth):
            if at >= to:
                break
            out[where] |= self.level(k, at, to).astype(np.uint32) << np.uint32(k * self.width)
            block = at // RANK_BITS
            bits = self.bits(k, block * BLOCK, (to + 7) >> 3)
            here = np.unpackbits(bits, bitorder="little")[at - block * RANK_BITS : to - block * RANK_BITS].astype(bool)
            where = where[here]
            at = self.rank(k, block) + ones_before(bits, at - block * RANK_BITS)
            to = at + len(where)
        return out


def ones_before(bits: np.ndarray, at: int) -> int:
    """Set bits before position `at` of a piece of a bitmap."""
    count = int(np.bitwise_count(bits[: at >> 3]).sum())
    return count + ((int(bits[at >> 3]) & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)


class Dac(Codes):
    """Codes in memory."""

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray], width: int, n: int):
        self.levels, self.bitmaps, self.ranks, self.width, self.n, self.depth = levels, bitmaps, ranks, width, n, len(levels)

    @classmethod
    def build(cls, ids: np.ndarray, width: int = 8) -> Dac:
        rest, levels, bitmaps, ranks = ids.astype(np.uint32), [], [], []
        while True:
            levels.append((rest & ((1 << width) - 1)).astype(np.uint8 if width <= 8 else np.uint16))
            rest = rest >> width
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % BLOCK))
            counts = np.bitwise_count(bits.reshape(-1, BLOCK)).sum(1, dtype=np.uint64)
            bitmaps.append(bits)
            ranks.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)]))
            if not more.any():
                return cls(levels, bitmaps, ranks, width, len(ids))
            rest = rest[more]

    def level(self, k: int, a: int, b: int) -> np.ndarray:
        return self.levels[k][a:b]

    def bits(self, k: int, a: int, b: int) -> np.ndarray:
        return self.bitmaps[k][a:b]

    def rank(self, k: int, i: int) -> int:
        return int(self.ranks[k][i])


class DacFile(Codes):
    """Codes in a file, of which only what is asked for is read: a token takes its chunks, at most one block of each
    bitmap and one entry of each rank directory. source: anything with read_at(size, offset)."""

    def __init__(self, source):
        start = source.read_at(len(MAGIC) + 8, 0)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(start[len(MAGIC) :], "little")
        head = json.loads(source.read_at(size, len(start)))
        self.source, self.body, self.arrays = source, len(start) + size, head["arrays"]
        self.width, self.n, self.depth = head["width"], head["n"], head["levels"]
        self.n_docs = self.arrays["doc_ids"][2]

    def part(self, name: str, a: int, b: int) -> np.ndarray:
        kind, at, n = self.arrays[name]
        kind = np.dtype(kind)
        a, b = max(0, a), min(b, n)
        return np.frombuffer(self.source.read_at((b - a) * kind.itemsize, self.body + at + a * kind.itemsize), kind)

    def level(self, k: int, a: int, b: int) -> np.ndarray:
        return self.part(f"level{k}", a, b)

    def bits(self, k: int, a: int, b: int) -> np.ndarray:
        return self.part(f"bits{k}", a, b)

    def rank(self, k: int, i: int) -> int:
        return int(self.part(f"rank{k}", i, i + 1)[0])

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents a to b: doc_ids, whether each is known (not null), and bounds (one more)."""
        return self.part("doc_ids", a, b), self.part("known", a, b).astype(bool), self.part("starts", a, b + 1)


def pack(dac: Dac, doc_ids: np.ndarray, starts: np.ndarray, known: np.ndarray) -> bytes:
    """A file's bytes. known: whether each doc_id is not null; starts has one more entry than docs."""
    arrays = {"doc_ids": doc_ids.astype("<i8"), "known": known.astype("<u1"), "starts": starts.astype("<i8")}
    for k in range(len(dac.levels)):
        arrays |= {f"level{k}": dac.levels[k], f"bits{k}": dac.bitmaps[k], f"rank{k}": dac.ranks[k].astype("<u8")}
    at, entries, parts = 0, {}, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        entries[name] = [array.dtype.str, at, len(array)]
        parts.append(data)
        at += len(data)
    head = json.dumps({"width": dac.width, "n": dac.n, "levels": len(dac.levels), "arrays": entries}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *parts])


#: Words that a worker remembers, about 70 MB. Texts whose words come again only after more than half of these are encoded anew.
WORDS = 500_000

CATALOGUE = "file string, part long, number long, first_id long, n_docs long, n_tokens long"


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, file_bytes: int = 12 << 20, most_tokens: int = 2 << 20, most_ranges: int = 50_000) -> DataFrame:
    """Writes the token files; their catalogue, in order, also written as Parquet.

    Documents are dealt out in ranges of about file_bytes of text, but never in more than most_ranges: larger tables
    have larger ranges, of which a task writes file after file of most_tokens. So the keys that are sampled for the
    ranges' bounds, and what bases() orders and broadcasts, are bounded whatever the table's size."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer_path))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(most_ranges, max(1, -(-total // file_bytes)))
    # a doc_id that many rows share is split, too: by a hash of the text, equal rows by their place
    keys = ["doc_id", "mark", "place"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        tokenizer = load(sent.value)
        system, root = locate(folder)
        system.create_dir(root, recursive=True)
        ids, doc_ids, size, made = [], [], 0, 0

        def flush():
            nonlocal ids, doc_ids, size, made
            known = np.array([d is not None for d in doc_ids], bool)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            data = pack(Dac.build(np.concatenate(ids)), np.array([d or 0 for d in doc_ids], np.int64), starts, known)
            name = attempt_name("tokens", f"{made}.dac")
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            row = [[name], [int(name.split("-")[1])], [made], [doc_ids[0]], [len(doc_ids)], [size]]
            ids, doc_ids, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.string(), *[pa.int64()] * 5], strict=True)], ["file", "part", "number", "first_id", "n_docs", "n_tokens"])

        for batch in pieces(batches, "text", 2 << 20):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), memo(tokenizer, WORDS).encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids.append(np.append(found, np.uint32(end_id)))
                doc_ids.append(doc_id)
                size += len(found) + 1
                if size >= most_tokens:
                    yield flush()
        if ids:
            yield flush()

    catalogue = mapped(ordered, run, CATALOGUE)
    catalogue.write.mode("overwrite").parquet(f"{folder}/catalogue")
    return spark.read.parquet(f"{folder}/catalogue")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bases(catalogue: DataFrame) -> DataFrame:
    """(file, base, n_tokens): ids before each file. A catalogue has a row per file of millions of tokens; files of
    a range are summed by range first, so that what is ordered at once and broadcast are the ranges, most_ranges at most."""
    parts = catalogue.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    done = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = catalogue.join(F.broadcast(parts.select("part", F.coalesce(done, F.lit(0)).alias("done"))), "part")
    return placed.select("file", (F.col("done") + F.coalesce(before, F.lit(0))).cast("long").alias("base"), "n_tokens")


def crcs(file: DacFile, starts: np.ndarray, step: int) -> list[int]:
    """The checksum of each document's ids, read by `step` tokens at a time, wherever these start."""
    out = [0] * (len(starts) - 1)
    for x in range(int(starts[0]), int(starts[-1]), step):
        y = min(x + step, int(starts[-1]))
        data = memoryview(file.slice(x, y).astype("<u4").tobytes())
        lo, hi = int(np.searchsorted(starts, x, "right")) - 1, int(np.searchsorted(starts, y))
        edges = ((np.clip(starts[lo : hi + 1], x, y) - x) * 4).tolist()
        for i, a, b in zip(range(lo, hi), edges[:-1], edges[1:], strict=True):
            out[i] = zlib.crc32(data[a:b], out[i])
    return out


def read(catalogue: DataFrame, folder: str, docs: int = 1 << 14, step: int = 1 << 18, task_tokens: int = 8 << 20) -> DataFrame:
    """One row per stored document, read from the files: `docs` documents and `step` tokens at a time, each found by
    the file's directories, so that no file is ever read whole. A task reads files of about `task_tokens` tokens."""

    def run(batches):
        system, root = locate(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    file = DacFile(source)
                    for a in range(0, file.n_docs, docs):
                        doc_ids, known, starts = file.documents(a, a + docs)
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=~known), pa.array(starts[:-1] + row["base"]), pa.array(np.diff(starts)), pa.array(crcs(file, starts, step), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    total = catalogue.agg(F.sum("n_tokens")).first()[0] or 0
    return mapped(bases(catalogue).repartition(max(1, -(-total // task_tokens)), "file"), run, READ)


def lookup(catalogue: DataFrame, folder: str, positions: DataFrame, cell: int = 1 << 22) -> DataFrame:
    """(position, id) of some positions (a column `position`) in the whole sequence: each is read by itself, a few
    hundred bytes of its file. Positions outside the sequence are left out.

    Files are found by the cells of `cell` positions that they reach into, an equi join."""
    reach = F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("base") + F.col("n_tokens") - 1) / cell))
    files = bases(catalogue).withColumn("cell", F.explode(reach))
    near = positions.select("position", F.floor(F.col("position") / cell).alias("cell")).join(files, "cell")
    hit = near.where((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n_tokens")))
    asked = hit.select("position", "file", "base").repartition("file").sortWithinPartitions("file", "position")

    def run(batches):
        system, root = locate(folder)
        for batch in batches:
            rows = batch.to_pylist()
            for name, group in groupby(rows, key=lambda r: r["file"]):
                with system.open_input_file(f"{root}/{name}") as source:
                    file, own = DacFile(source), [(r["position"], r["position"] - r["base"]) for r in group]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int64()), pa.array([file[i] for _, i in own], pa.int64())], ["position", "id"])

    return mapped(asked, run, "position long, id long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    folder = fresh_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer_path, end_id), folder)
