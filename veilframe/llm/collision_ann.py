"""Approximate nearest neighbours by cosine: collision-counting hashing with query-centred windows.

The rows are dealt into shards of bounded size. A shard keeps, for each of m random projections, the projections of its
distinct unit vectors in one sorted array. A query's window of radius R in an array is its own projection +- T * R; a
vector in it collides. Virtual rehashing: R grows level by level, only the two new ends of each window are read, and the
collisions of each vector are counted. A vector at distance R collides with probability p = P(|N(0, 1)| <= T) in each array, so
what has LEAST collisions or more (a bound that all but a few percent of vectors at distance R reach) is verified by its
exact cosine. A query is done in a shard when its k-th verified neighbour isn't farther than R; once k are verified, R
jumps to the k-th distance. Where no window finds k, all that is left is verified, so that small shards are exact.

Every query meets every shard; queries stream past a shard that is held alone, so memory is bounded by one
shard and one batch, and nothing goes through the driver. Equal vectors of a shard are one entry with their ids, of
which the k + 1 smallest can be answers.

Defined results: rows with a null id, and vectors that are null, zero, hold null or non-finite entries or have another
length than most, take no part. Of several rows of one id the smallest vector (entry by entry) counts, once. Ties go to
the smaller id. A query has fewer than k rows only if there are fewer other vectors; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import cut, give_back, mapped
from veilframe.llm.whitening import matrix, usable, usual_length

#: Vectors of a shard, on average.
ROWS = 8192
PROJECTIONS = 64
#: Half a window at radius 1, in standard deviations: where a collision tells most about a distance.
T = 1.4
#: How many standard deviations below its expectation the count of a vector at distance R may be.
SLACK = 1.6
#: Radii of the levels: unit vectors are at most 2 apart.
LEVELS = (1 / 64, 1 / 16, 1 / 4, 0.5, 0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 1.75, 2.0)


def least(m: int) -> int:
    p = erf(T / sqrt(2))
    return int(m * p - SLACK * sqrt(m * p * (1 - p)))


@lru_cache(4)
def directions(m: int, d: int) -> np.ndarray:
    """m random directions, the same in every task."""
    return np.random.default_rng(20_240_613 + d).standard_normal((m, d))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest entries first, so that no square under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Shard:
    """Distinct unit vectors with their ids, and their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int):
        distinct, group = np.unique(vectors, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((ids, group))
        self.ids, self.starts = ids[order], np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(distinct)))])
        self.units = unit(distinct)
        values = directions(m, vectors.shape[1]) @ self.units.T
        self.order = np.argsort(values, axis=1, kind="stable").ravel()
        # all arrays in one: array j is moved up by j * apart, so that one search finds all windows
        self.apart = 4 * float(np.abs(values).max()) + 16
        self.values = (np.sort(values, axis=1) + self.apart * np.arange(m)[:, None]).ravel()
        self.m, self.size, self.least = m, len(distinct), least(m)

    def nearest(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest found, of other ids than the query's own."""
        m, u = self.m, self.size
        at = directions(m, len(query)) @ query + self.apart * np.arange(m)
        # windows never leave their own arrays
        floor, ceiling = np.arange(m) * u, np.arange(1, m + 1) * u
        low = high = np.searchsorted(self.values, at)
        counts, scores = np.zeros(u, np.int32), np.full(u, -np.inf)
        radius, step, kth = LEVELS[0], 0, np.inf
        while True:
            reach = T * radius + 1e-9
            a, b = np.maximum(np.searchsorted(self.values, at - reach), floor), np.minimum(np.searchsorted(self.values, at + reach, "right"), ceiling)
            counts += self.collisions(np.concatenate([a, high]), np.concatenate([low, b]))
            low, high = a, b
            fresh = np.flatnonzero((counts >= self.least) & (scores == -np.inf))
            if len(fresh):
                scores[fresh] = (self.units[fresh] * query).sum(axis=1)
                kth = self.distance(scores, own, k)
            if kth <= radius:
                break
            while step < len(LEVELS) and LEVELS[step] <= radius:
                step += 1
            if step == len(LEVELS):
                rest = np.flatnonzero(scores == -np.inf)
                scores[rest] = (self.units[rest] * query).sum(axis=1)
                break
            radius = min(LEVELS[step], max(kth, radius * 1.0001))
        return self.best(scores, own, k)

    def collisions(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each vector stands in some ranges of the sorted arrays."""
        lengths = np.maximum(stop - start, 0)
        first = np.cumsum(lengths) - lengths
        places = np.arange(int(lengths.sum())) + np.repeat(start - first, lengths)
        return np.bincount(self.order[places], minlength=self.size)

    def best(self, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero(scores > -np.inf)
        if len(found) > k + 1:  # the k + 1 best entries and what ties with them hold the k best rows
            bound = -np.partition(-scores[found], k)[k]
            found = found[scores[found] >= bound]
        rows = np.concatenate([np.arange(a, min(b, a + k + 1)) for a, b in zip(self.starts[found], self.starts[found + 1], strict=True)] or [np.empty(0, np.int64)])
        got = np.repeat(scores[found], np.minimum(np.diff(self.starts)[found], k + 1))
        other = self.ids[rows] != own
        rows, got = rows[other], got[other]
        order = np.lexsort((self.ids[rows], -got))[:k]
        return self.ids[rows][order], got[order]

    def distance(self, scores: np.ndarray, own: int, k: int) -> float:
        """The distance of the k-th best row so far; infinite if there are fewer."""
        _, got = self.best(scores, own, k)
        return sqrt(max(0.0, 2 - 2 * got[-1])) if len(got) == k else np.inf


def vectors_of(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, one for each id; cut."""
    x = F.col(vector)
    fit = usable(x, float("inf")) & F.exists(x, lambda e: e != 0)
    found = cut(rows.where(F.col(id).isNotNull() & fit).groupBy(F.col(id).cast("long").alias("id")).agg(F.min(x.cast("array<double>")).alias("vector")))
    return found.where(F.size("vector") == usual_length(found, "vector"))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", rows_a_shard: int = ROWS, projections: int = PROJECTIONS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows that are found for each query.

    queries: a DataFrame with a column of ids that are to be queries; they are rows of the table, too."""
    there = vectors_of(rows, id, vector)
    shards = max(1, -(-there.count() // rows_a_shard))
    asked = there.join(queries.select(F.col(id).cast("long").alias("id")).distinct(), "id", "left_semi")
    dealt = there.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "vector")
    # a query is sent to every shard: the stated set against all rows, in blocks of one shard
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "vector")
    met = dealt.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, ids, parts = None, None, [], []
        for batch in batches:
            numbers, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                own = batch.column("id").slice(a, b - a).to_numpy()
                column = batch.column("vector").slice(a, b - a)
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if numbers[a] != now:
                    now, shard, ids, parts = numbers[a], None, [], []
                if not asks[a]:
                    ids.append(own.copy())
                    parts.append(x.copy())
                    continue
                if shard is None and parts:
                    shard = Shard(np.concatenate(ids), np.concatenate(parts), projections)
                if shard is not None:
                    found = [(i, *shard.nearest(q, i, k)) for i, q in zip(own.tolist(), unit(x), strict=True)]
                    counts = [len(f[1]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own, counts)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"]
                    )
        give_back()

    found = mapped(met, run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every(rows: DataFrame, step: int, id: str = "vec_id") -> DataFrame:
    """The ids that are divisible by step."""
    return rows.where(F.col(id) % step == 0).select(id)
