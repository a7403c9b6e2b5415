"""WARC, index first.

Writing: a WARC record for each page, gzipped one by one, and with it one index row of file, offset,
length, URL and payload digest. Records of equal payloads become revisits of the one with the smallest
page_id. Each task writes one file, under a name of its own attempt, with its records in a fixed order;
the index is the only way to the files, so what lost tasks left behind is never read.

Reading: index rows are selected first, grouped by file and block of offsets, sorted, merged where
they are at most `gap` bytes apart, and each merged byte range is read at once.

Null html is an empty payload; null or odd URLs are percent-encoded in headers; of rows with equal
payload and the same smallest page_id all are responses; a null page_id counts as larger than any
other and refers_to of its revisits is null; an empty table writes no record; other columns are ignored."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, few, fresh_folder, looked_up, mapped, pieces
from veilframe.llm.files import attempt_name, locate

DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string"


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One gzipped record."""
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]-._~")
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, target)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The headers of a record, its HTTP headers and its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return {"fields": fields, "http": inner, "payload": payload}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(digest, first) of payloads that occur on several pages, first being the smallest page_id."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.where(F.octet_length(html) >= min_bytes).select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def maybe_among(facts: DataFrame, digest: Column, hex_digits: int = 6):
    """Whether a digest may be among those of facts: a Bloom filter of fixed size (two places of 4 `hex_digits` bits
    each, 4 MiB), made by an aggregate and broadcast; false is sure. A null digest isn't among them."""
    places = [f"cast(conv(substring(digest, {1 + k * hex_digits}, {hex_digits}), 16, 10) as long)" for k in range(2)]
    one = facts.select(F.expr(f"explode(array({places[0]} * 2, {places[1]} * 2 + 1)) as p"))
    words = one.groupBy(F.expr("p div 32 as w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int))) as b")).toArrow()
    grid = np.zeros(max(1, 2 * 16**hex_digits // 32), np.uint32)
    grid[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint64).astype(np.uint32)
    sent = facts.sparkSession.sparkContext.broadcast(grid)

    @F.pandas_udf("boolean")
    def may(digests: pd.Series) -> pd.Series:
        known = digests.notna().to_numpy()
        found = known.copy()
        for k in range(2):
            p = np.array([int(d[k * hex_digits : (k + 1) * hex_digits], 16) for d in digests[known]], np.int64) * 2 + k
            found[known] &= (sent.value[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool)
        return pd.Series(found)

    return may(digest)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives into folder; the index (see INDEX), also written there as Parquet.

    What a page refers to is looked up by digest: where few digests repeat (by a count), by broadcast, and no page
    is shuffled. Where many do, pages of the most frequent digests are settled by broadcast, those without a
    repeated digest stay where they are as far as a Bloom filter tells, and only the others are shuffled."""
    html = F.coalesce("html", F.lit(""))
    first = cut(originals(pages, min_bytes))
    marked = pages.select("page_id", "url", html.alias("html"), F.when(F.octet_length(html) >= min_bytes, F.sha1(F.encode(html, "UTF-8"))).alias("digest"))
    if few(first):
        placed = marked.join(F.broadcast(first), "digest", "left")
    else:
        probed = marked.withColumn("_may", maybe_among(first, F.col("digest")))
        alone = probed.where("not _may").drop("_may").withColumn("first", F.lit(None).cast("long"))
        placed = alone.unionByName(looked_up(probed.where("_may").drop("_may"), first, "digest", how="left"))

    def run(batches):
        system, root = locate(folder)
        system.create_dir(root, recursive=True)
        name, at, out = None, 0, None
        try:
            for batch in pieces(batches, "html", 4 << 20):
                if out is None:
                    name = attempt_name("pages", "warc.gz")
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                rows = []
                for r in batch.to_pylist():
                    payload = r["html"].encode()
                    digest = sha1_base32(payload)
                    revisit = r["first"] is not None and r["page_id"] != r["first"]
                    data = record(r["page_id"], r["url"], payload, digest, r["first"], revisit)
                    out.write(data)
                    rows.append((r["page_id"], r["url"], name, at, len(data), "revisit" if revisit else "response", digest))
                    at += len(data)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, INDEX_TYPES, strict=True)], ["page_id", "url", "file", "offset", "length", "record_type", "payload_digest"]
                )
        finally:
            if out is not None:
                out.close()

    index = mapped(placed.select("page_id", "url", "html", "first"), run, INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(selected: DataFrame, folder: str, block: int = 4 << 20, gap: int = 64 << 10, with_payload: bool = False) -> DataFrame:
    """The records of the selected index rows. Every payload is verified against its digest."""
    # index rows are small and what they point to is not: tasks are counted by archive bytes
    total = selected.agg(F.sum("length")).first()[0] or 0
    dealt = selected.withColumn("block", F.floor(F.col("offset") / block)).repartition(max(1, -(-total // (4 * block))), "file", "block")
    ranges = dealt.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))

    def run(batches):
        system, root = locate(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    for run_ in merged(row["at"], gap):
                        start = run_[0]["offset"]
                        data = source.read_at(run_[-1]["offset"] + run_[-1]["length"] - start, start)
                        got = [unpack(data[x["offset"] - start : x["offset"] - start + x["length"]], with_payload) for x in run_]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), READ_TYPES, strict=True)], READ_NAMES)

    found = mapped(ranges, run, READ)
    return found if with_payload else found.drop("payload")


READ_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
READ_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def merged(ranges: list[dict], gap: int) -> list[list[dict]]:
    """Sorted ranges in runs that are read at once."""
    runs: list[list[dict]] = []
    for x in ranges:
        if runs and x["offset"] - (runs[-1][-1]["offset"] + runs[-1][-1]["length"]) <= gap:
            runs[-1].append(x)
        else:
            runs.append([x])
    return runs


def unpack(member: bytes, with_payload: bool) -> tuple:
    got = parse(member)
    fields, payload = got["fields"], got["payload"]
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x) if x else None
    return number(fields["X-Page-Id"]), int(got["http"]["Content-Length"]), digest, kind, number(fields.get("X-Refers-To-Page-Id")), payload if with_payload else None


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of all pages and reads every record back through the index."""
    folder = fresh_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIVE_SQL = "'" + BASE32 + "'[((v // {0}) % 32 + 1)::INT]"  # one base32 digit of a 20-bit number
ORACLE = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
                  list_transform(range(0, 8), lambda i: ('0x' || h[5 * i + 1:5 * i + 5])::BIGINT) AS parts FROM t)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(parts, lambda v: {" || ".join(FIVE_SQL.format(32**k) for k in (3, 2, 1, 0))}), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
