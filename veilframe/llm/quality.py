"""Quality classifier: a byte-level convolutional network in numpy.

Input: the bytes of the whole text, as they are. `filters` learned filters, `width` bytes wide, slide over
every position; positions are cut into chunks of `chunk` bytes whose windows overlap by width - 1,
each filter is max-pooled within a chunk, and the chunks' pooled values are combined as their mean and
their maximum into one logistic output. A document of any length is scored whole, in bounded memory.

The network is fitted on the driver from a bounded sample: at most `per_class` labelled documents
of each class, chosen by a hash of doc_id, those of more than `most_bytes` bytes left out, so that the sample has a fixed
bound in bytes, too. Labels enter only from rows whose crc32(doc_id as text)
mod 4 is not 2 ("held out" rows); labels, lang, source and doc_id are never inputs.

Null and empty texts are one chunk of padding and get a score like any other; repeated rows are
scored one by one; a null doc_id is scored and held_out is null; without any labelled row of both classes every
score is 0.5; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, mapped, pieces, utf8


@dataclass
class Net:
    """tables[j, byte, f]: what a byte at offset j of a window adds to filter f."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # of the mean, then of the maximum, of the chunks' pooled values; last: constant
    chunk: int = 64

    @property
    def width(self) -> int:
        return self.tables.shape[0]


def layout(data: np.ndarray, offsets: np.ndarray, width: int, chunk: int):
    """Padded bytes of all rows, first position of each chunk, and first chunk of each row."""
    sizes = np.diff(offsets)
    chunks = -(-(sizes + width) // chunk)  # room for padding, so that no window needs the next row's bytes
    first = np.concatenate([[0], np.cumsum(chunks)])
    padded = np.zeros(first[-1] * chunk + width, np.uint8)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    padded[np.arange(len(data)) - offsets[rows] + first[rows] * chunk] = data
    return padded, first


def convolve(net: Net, padded: np.ndarray, last: np.ndarray) -> np.ndarray:
    """chunks x positions x filters, before the rectifier. last: the rows' last chunks, whose last
    windows would reach into the next row and don't count."""
    n = len(padded) - net.width
    total = net.tables[0][padded[:n]]
    for j in range(1, net.width):
        total += net.tables[j][padded[j : n + j]]
    total = total.reshape(-1, net.chunk, total.shape[1])
    total[last, 1 - net.width :] = -np.inf
    return total


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """The rectified maximum of each filter in each chunk, `step` chunks at a time."""
    padded, first = layout(data, offsets, net.width, net.chunk)
    parts = []
    for at in range(0, first[-1], step):
        to = min(first[-1], at + step)
        last = first[1:] - 1 - at
        last = last[(last >= 0) & (last < to - at)]
        parts.append(convolve(net, padded[at * net.chunk : to * net.chunk + net.width], last).max(1))
    return np.maximum(np.concatenate(parts) + net.bias, 0), first


def combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(values, first[:-1]) / np.diff(first)[:, None]
    return np.hstack([sums, np.maximum.reduceat(values, first[:-1]), np.ones((len(sums), 1), np.float32)])


def score(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = combine(*pooled(net, data, offsets)) @ net.out
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def fit(texts: list[str], labels: list[int], filters: int = 12, width: int = 5, chunk: int = 64, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Net:
    """Adam on the logistic loss; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = Net((rng.normal(size=(width, 256, filters)) * 0.15).astype(np.float32), np.zeros(filters, np.float32), (rng.normal(size=2 * filters + 1) * 0.3).astype(np.float32), chunk)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    params = [net.tables, net.bias, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for epoch in range(epochs):
        step_rate = rate * (1 - epoch / epochs) + 0.001
        for at in range(0, len(y), batch):
            if at == 0:
                order = rng.permutation(len(y))
            pick = order[at : at + batch]
            data, offsets = utf8(pa.array([texts[i] for i in pick], pa.string()))
            padded, first = layout(data, offsets, width, chunk)
            acts = convolve(net, padded, first[1:] - 1)
            where = acts.argmax(1)
            raw = np.take_along_axis(acts, where[:, None, :], 1)[:, 0] + net.bias
            values = np.maximum(raw, 0)
            h = combine(values, first)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out, -30, 30)))
            dz = (p - y[pick]) * weight[pick] / len(pick)
            rows = np.repeat(np.arange(len(pick)), np.diff(first))
            dh = dz[:, None] * net.out[None, :]
            dv = dh[rows, :filters] / np.diff(first)[rows, None]
            top = values == h[rows, filters : 2 * filters]
            share = np.add.reduceat(top.astype(np.float32), first[:-1])[rows]
            dv = dv + top * dh[rows, filters : 2 * filters] / share
            dv = np.where(raw > 0, dv, 0.02 * dv).astype(np.float32)
            grads = [np.zeros_like(net.tables), dv.sum(0), h.T @ dz + 1e-4 * net.out]
            base = np.arange(first[-1])[:, None] * chunk + where
            f = np.broadcast_to(np.arange(filters), base.shape)
            for j in range(width):
                flat = padded[base + j].astype(np.int64) * filters + f
                grads[0][j] += np.bincount(flat.ravel(), dv.ravel(), 256 * filters).reshape(256, filters)
            t += 1
            for p_, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= step_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> tuple[list[str], list[int]]:
    """The bounded sample: ids are chosen from the labels alone, so only their texts are read."""
    labels = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [labels.where(F.col("_quality") == q).orderBy(order).limit(per_class) for q in (0, 1)]
    chosen = cut(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_quality").alias("q")).orderBy("doc_id").collect()
    return [r.text or "" for r in rows], [r.q for r in rows]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800, most_bytes: int = 1 << 18) -> Net:
    return fit(*training_rows(docs, labels, per_class, most_bytes))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(net_value, batches):
    for batch in pieces(batches, "text"):
        values = score(net_value.value, *utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values)], schema=SCHEMA)


def quality(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    found = mapped(docs.select("doc_id", "text"), lambda batches: scored(sent, batches), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least threshold, with the same columns; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(score(sent.value, *utf8(batch.column("text"))) >= threshold))

    return mapped(docs, run, docs.schema)
