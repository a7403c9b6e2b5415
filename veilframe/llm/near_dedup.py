"""MinHash near-dedup by ProbMinHash.

Documents are sets of shingles of five words; a shingle weighs 1 however often it occurs, so that the bands
find by the measure that verifies, and a line repeated a thousand times doesn't outweigh a text. Each shingle emits the
arrivals of a Poisson process whose rate is its weight; every arrival picks one of `registers`
registers, a register keeps its earliest arrival, and a document's arrivals end as soon as they come
later than the latest kept one. Two registers agree with the probability Jaccard similarity of the
documents, which with equal weights is that of the sets. Bands of registers give candidate pairs, which are verified by the exact Jaccard similarity
of their shingle sets.

Texts with the same words collapse to one node (the smallest doc_id) before banding. In a band
bucket the nodes are compared with the bucket's smallest node, never all with all; the verified links
are joined to components. Buckets in which several components are left are open. Their nodes are compared across
components through their rarest shingles: two sets of similarity t have a shingle in common among the first
size - ceil(t x size) + 1 of either, in any order of all shingles, and the first such one is so early in both that enough
can follow. In an order by frequency that shingle is on few lists, and few of a list's nodes come early enough to ask the
others. Only lists of over `small` nodes are compared in tiles of bounded size. Inside a component a further link changes
nothing. Frequent buckets, words and lists are settled by broadcasts of bounded size; every step is a
DataFrame join or aggregate, and no unbounded group is collected.

Null, empty and wordless texts form no links and are a class of their own each; texts of fewer than
five words have one shingle, of all their words; rows that share a doc_id count as one document, linked with
whatever any of them is linked with; a row without doc_id has a null class and is kept; a text of any length is compared
whole; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytesig import LOWER, WORD, U, hashes, mix, spans, windows
from veilframe.llm.common import cut, forget, give_back, looked_up, mapped, pieces, utf8, within, without


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each shingle, and two digests of each row's words (0 where it has none)."""
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets, WORD)
    words, count = hashes(data, starts, ends), np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.minimum(n, count)
    marks = windows(words, n)
    full = np.flatnonzero(rows[: len(marks)] == rows[n - 1 :]) if len(marks) else np.empty(0, np.int64)
    row, mark = rows[full], marks[full]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([windows(words[first[i] : first[i + 1]], int(size[i]))[0] for i in short], U)
        row, mark = np.concatenate([row, short]), np.concatenate([mark, extra])
    digests = []
    place = (np.arange(len(words)) - first[rows]).astype(U) if len(words) else np.empty(0, U)
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(words ^ mix(place * U(seed) + U(seed >> 1))), dtype=U)])
        digests.append(np.where(count > 0, mix(total[first[1:]] - total[first[:-1]] + count.astype(U)), U(0)))
    return row, mark, digests[0], digests[1]


def distinct(row: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, shingle) once, in order of row, then shingle."""
    order = np.lexsort((mark, row))
    row, mark = row[order], mark[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    return row[new], mark[new]


def prob_minhash(row: np.ndarray, mark: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m shingle hashes) of the rows' weighted shingles."""
    best, owner = np.full(n * m, np.inf), np.zeros(n * m, U)
    at, latest = np.zeros(len(row)), np.full(n, np.inf)
    live, turn = np.arange(len(row)), 0
    while len(live):
        noise = mix(mark[live] ^ mix(np.full(1, turn + 1, U) * U(0x9FB21C651E98DF25)))
        uniform = ((noise >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
        at[live] -= np.log(uniform) / weight[live]
        live = live[at[live] < latest[row[live]]]
        pick = (mix(mark[live] + np.full(1, turn, U) * U(0xD6E8FEB86659FD93)) >> U(33)) % U(m)
        slot = row[live] * m + pick.astype(np.int64)
        np.minimum.at(best, slot, at[live])
        won = at[live] == best[slot]
        owner[slot[won]] = mark[live[won]]
        latest = best.reshape(n, m).max(1)
        turn += 1
    return owner.reshape(n, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signatures), bands), U)
    for b in range(bands):
        acc = np.full(len(signatures), U(b * 2654435761 + 1))
        for r in range(rows):
            acc = mix(acc ^ signatures[:, b * rows + r]) + U(r + 1)
        out[:, b] = mix(acc)
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets, given as sorted 32-bit hashes without repeats."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


FEATURES = "doc_id long, h1 long, h2 long, bands array<long>"


def features(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            row, mark, h1, h2 = shingles(*utf8(batch.column("text")), n)
            row, mark = distinct(row, mark)
            signatures = prob_minhash(row, mark, np.ones(len(row)), batch.num_rows, bands * rows)
            buckets = band_hashes(signatures, bands, rows).view(np.int64)
            mask = (h1 == 0) & (h2 == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, bands, dtype=np.int32)), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(h1.view(np.int64), mask=mask), pa.array(h2.view(np.int64), mask=mask), lists],
                ["doc_id", "h1", "h2", "bands"],
            )

    return mapped(docs.select("doc_id", "text"), run, FEATURES)


def contents(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and its set of shingles as sorted 32-bit hashes."""

    def run(batches):
        for batch in pieces(batches, "text"):
            row, mark, _, _ = shingles(*utf8(batch.column("text")), n)
            small = (mark >> U(32)).astype(np.uint32)
            row, small = distinct(row, small)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = [small[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(parts, pa.binary())], ["id", "content"])

    return mapped(docs.select("doc_id", "text"), run, "id long, content binary")


def verify(pairs: DataFrame, content: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b, ...) of documents that have a similarity of threshold or more.

    Of a document as a there are few pairs; a centre b of many is a skewed partition of an inner join with nothing above
    it but a narrow step, which adaptive execution splits."""

    def run(batches):  # in batches of bounded bytes, of which only the pairs that are alike come back
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            yield batch.filter(pa.array([similarity(a, b) >= threshold for a, b in zip(x, y, strict=True)], pa.bool_())).drop_columns(["x", "y"])
        give_back()

    left = content.select(F.col("id").alias("a"), F.col("content").alias("x"))
    right = content.select(F.col("id").alias("b"), F.col("content").alias("y"))
    return mapped(pairs.join(left, "a").join(right, "b").select(*pairs.columns, "x", "y"), run, pairs.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the links (a, b) is connected with.

    Labels flow over the links and jump to their label's label; a round with no change ends it."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"))
    kept = None
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        top = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        moved = cut(near.join(top, "comp", "left").select("node", "old", F.least("comp", F.coalesce("jump", "comp")).alias("comp")))
        forget(labels if kept is None else kept)
        labels, kept = moved.select("node", "comp"), moved
        if moved.where("comp != old").isEmpty():
            return labels


def links(docs: DataFrame, nodes: DataFrame, known: DataFrame, threshold: float, n: int, spent: DataFrame | None = None) -> DataFrame:
    """(node, comp) of the nodes that have a link; nodes: node, bands; known: links (a, b) that need no proof. spent: what
    cut() kept for nodes only; as of all that is no longer read, its files go as soon as the buckets are known."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    near = cut(looked_up(members, cut(shared), "bucket"))  # (bucket, node, centre) of buckets with several nodes
    if spent is not None:
        forget(spent)
    pairs = near.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    involved = cut(near.select(F.col("node").alias("doc_id")).distinct())
    content = cut(contents(within(docs, involved, ["doc_id"]), n))  # read by every verification
    comps = components(cut(verify(pairs, content, threshold).unionByName(known)))
    placed = cut(near.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")))
    split = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    open_ = cut(looked_up(placed, cut(split.select("bucket")), "bucket").select("node", "comp").distinct())
    forget(near, placed)
    if open_.isEmpty():
        forget(content)
        return comps
    sets = cut(open_.join(content.withColumnRenamed("id", "node"), "node"))
    forget(content)
    content = sets.select(F.col("node").alias("id"), "content")  # what is settled isn't shuffled again
    pairs, blocked = remainder(sets, content, threshold)
    found = cut(verify(pairs, content, threshold).unionByName(blocked).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    forget(sets)
    if found.isEmpty():
        return comps
    merged = components(found)
    moved = comps.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return moved.select("node", F.coalesce("to", "comp").alias("comp")).unionByName(merged).distinct()


def prefixes(sets: DataFrame, threshold: float, heavy: dict[int, int]) -> DataFrame:
    """(mark, node, comp, size, left, prev): the rarest shingles of each set (node, comp, content), as many as have to be
    looked at, how many of the set's shingles are left from each on, and the one before it (-1 if none).

    The order is by how often a shingle is among the frequent ones (`heavy`), then by its hash, alike for all sets."""
    sent = sets.sparkSession.sparkContext.broadcast((np.array(sorted(heavy), np.uint32), np.array([heavy[m] for m in sorted(heavy)], np.int64)))

    def run(batches):
        marks, counts = sent.value
        for batch in batches:
            parts = []
            for content in batch.column("content").to_pylist():
                own = np.frombuffer(content, np.uint32)
                at = np.minimum(np.searchsorted(marks, own), max(len(marks) - 1, 0))
                weight = np.where(marks[at] == own, counts[at], 0) if len(marks) else np.zeros(len(own), np.int64)
                parts.append(own[np.lexsort((own, weight))][: len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1])
            sizes, taken = np.array([len(c) // 4 for c in batch.column("content").to_pylist()]), np.array([len(x) for x in parts])
            place = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            columns = [np.concatenate([*parts, np.empty(0, np.uint32)]).astype(np.int64), *(np.repeat(np.asarray(x, np.int64), taken) for x in (batch.column("node"), batch.column("comp"), sizes))]
            prev = np.where(place > 0, np.roll(columns[0], 1), -1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, columns[3] - place, prev)], ["mark", "node", "comp", "size", "left", "prev"])

    return mapped(sets, run, "mark long, node long, comp long, size long, left long, prev long")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(mark): every shingle of every set."""

    def run(batches):
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(marks.astype(np.int64))], ["mark"])

    return mapped(sets.select("content"), run, "mark long")


def remainder(open_: DataFrame, content: DataFrame, threshold: float, small: int = 64, top: int = 16384, tracked: int = 131072):
    """Candidate pairs (a, b, ca, cb) of the nodes (node, comp) of different components, and links (a, b, ca, cb) found
    where a list is too long for pairs; together they miss no pair of similarity threshold or more. The nodes may have
    their content with them."""
    sets = open_ if "content" in open_.columns else cut(open_.join(content.withColumnRenamed("id", "node"), "node"))
    found = shingle_rows(sets).agg(F.expr(f"approx_top_k(mark, {top}, {tracked})").alias("t")).first().t
    # sets of n and m shingles need t / (1 + t) x (n + m) in common, from their first common one on: one of the two has
    # 2t / (1 + t) of its own left there, and asks
    need = threshold / (1 + threshold)
    asks = F.col("left") >= 2 * need * F.col("size") - 1e-9
    rows = cut(prefixes(sets, threshold, {r["item"]: r["count"] for r in found or ()}).withColumn("asks", asks))
    lists = rows.groupBy("mark").agg(F.count("*").alias("n"), F.count_if("asks").alias("askers"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    lists = cut(lists.where("low < high and askers > 0").select("mark", "n", "askers"))
    every, rows = rows, cut(looked_up(rows, lists, "mark"))
    forget(every, lists)
    short = rows.where(F.col("n") <= small).groupBy("mark").agg(F.collect_list(F.struct("node", "comp", "size", "left", "prev")).alias("l"))
    one = short.select(F.explode("l").alias("x"), "l")
    # two sets that have the shingle before this one in common, too, meet there already
    fresh = lambda x, y: (x["prev"] != y["prev"]) | (x["prev"] < 0)
    fits = lambda x, y: (x["comp"] != y["comp"]) & (x["node"] > y["node"]) & fresh(x, y) & (F.least(x["left"], y["left"]) >= need * (x["size"] + y["size"]) - 1e-9)
    both = one.select("x", F.explode(F.filter("l", lambda y: fits(F.col("x"), y))).alias("y"))
    pairs = both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct()
    return pairs, tiled(askers(rows.where(F.col("n") > small)), content, threshold)


def askers(great: DataFrame) -> DataFrame:
    """(mark, node, comp, asks, n, askers): which rows of a list have to be compared with all others: those with enough left,
    or, if these are fewer, those that don't have the shingle before in common with most of the list."""
    before = great.where("prev >= 0").groupBy("mark", "prev").agg(F.count("*").alias("k"))
    most = cut(before.groupBy("mark").agg(F.max(F.struct("k", "prev")).alias("most")))
    known = looked_up(great, most, "mark", how="left")
    odd = F.col("n") - F.coalesce("most.k", F.lit(0))
    alone = (F.col("prev") < 0) | ~F.col("prev").eqNullSafe(F.col("most.prev"))
    few_ask = F.col("askers") <= odd
    return cut(known.select("mark", "node", "comp", "n", F.when(few_ask, F.col("asks")).otherwise(alone).alias("asks"), F.when(few_ask, F.col("askers")).otherwise(odd).alias("askers"))).where("askers > 0")


def tiled(great: DataFrame, content: DataFrame, threshold: float, x_tile: int = 128, y_tile: int = 256) -> DataFrame:
    """Links (a, b, ca, cb) between nodes of one list (mark, node, comp, asks, n, askers) and different components: those
    that ask against all, in tiles of bounded size, by exact matrix products inside a tile. Of each node the most
    similar one of each other component at most."""
    tiles = lambda count, size: F.ceil(F.col(count) / size).cast("int")
    own = lambda count, size: F.pmod(F.xxhash64("node"), tiles(count, size)).cast("int")
    every = lambda count, size: F.explode(F.sequence(F.lit(0), tiles(count, size) - 1))
    asked = great.where("asks").select("mark", "node", "comp", own("askers", x_tile).alias("tx"), every("n", y_tile).alias("ty"), F.lit(True).alias("asks"))
    others = great.select("mark", "node", "comp", own("n", y_tile).alias("ty"), every("askers", x_tile).alias("tx"), F.lit(False).alias("asks"))
    rows = asked.unionByName(others).join(content.withColumnRenamed("id", "node"), "node")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        return tile_links(tile[tile.asks], tile[~tile.asks], threshold)

    return rows.groupBy("mark", "tx", "ty").applyInPandas(compare, "a long, b long, ca long, cb long")


def tile_links(x: pd.DataFrame, y: pd.DataFrame, threshold: float, columns: int = 8192) -> pd.DataFrame:
    """Exact similarities of the rows of x with those of y (node, comp, content)."""
    sets = [[np.frombuffer(c, np.uint32) for c in side.content] for side in (x, y)]
    known = [np.concatenate([*side, np.empty(0, np.uint32)]) for side in sets]
    lengths = [np.array([len(s) for s in side], np.int64) for side in sets]
    words = np.intersect1d(*known)
    shared = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(words), columns):
        part = words[at : at + columns]
        grids = []
        for marks, sizes in zip(known, lengths, strict=True):
            grid = np.zeros((len(sizes), len(part)), np.float32)
            place = np.minimum(np.searchsorted(part, marks), len(part) - 1)
            here = part[place] == marks
            grid[np.repeat(np.arange(len(sizes)), sizes)[here], place[here]] = 1
            grids.append(grid)
        shared += grids[0] @ grids[1].T
    alike = shared / np.maximum(lengths[0][:, None] + lengths[1][None, :] - shared, 1)
    xs, ys, cx, cy = (v.to_numpy() for v in (x.node, y.node, x.comp, y.comp))
    i, j = np.nonzero((alike >= threshold) & (cx[:, None] != cy[None, :]))
    best = pd.DataFrame({"i": i, "j": j, "c": cy[j], "s": alike[i, j]}).sort_values(["s", "j"], ascending=[False, True]).drop_duplicates(["i", "c"])
    return pd.DataFrame({"a": xs[best.i], "b": ys[best.j], "ca": cx[best.i], "cb": cy[best.j]})


def shared_ids(worded: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of different texts that have one doc_id."""
    several = worded.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low != high").select("doc_id")
    nodes = cut(worded.join(cut(several), "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(groups, ["h1", "h2"]).select("doc_id", F.col("node").alias("a")))
    least = nodes.groupBy("doc_id").agg(F.min("a").alias("b"))
    return nodes.join(least, "doc_id").where("a != b").select("a", "b").distinct()


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), kept."""
    found = cut(features(docs, n, bands, rows))
    worded = found.where("doc_id is not null and h1 is not null")
    groups = cut(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    first = groups.select("node").distinct()
    nodes = worded.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "bands")
    slim = cut(found.drop("bands"))
    comps = links(docs, nodes, shared_ids(worded, groups), threshold, n, spent=found)
    worded = slim.where("doc_id is not null and h1 is not null")
    comps = cut(groups.join(comps, "node", "left").select("h1", "h2", F.coalesce("comp", "node").alias("class_id")))
    placed = looked_up(worded.select("doc_id", "h1", "h2"), comps, ["h1", "h2"]).select("doc_id", "class_id")
    others = slim.where("doc_id is null or h1 is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return placed.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """docs, same columns, less the rows whose class has a smaller doc_id."""
    dropped = classes(docs, threshold, n).where("not kept").select("doc_id")
    return without(docs, dropped, ["doc_id"]).select(docs.columns)
