"""Conversation prefix trie by distributed MSD radix partitioning over dictionary-encoded turns.

Turns are numbered inside their conversations over ranges of rows, so that a conversation may be longer than a task, and
(role, text) is encoded by a dictionary. Conversations with equal turns become one class with a count. The classes start
in one bucket; a bucket with more turns than a task should hold is split by the next turn's code, all such buckets in
one round of joins and aggregates. What all of a bucket share is skipped in the same round: a depth at
which its smallest and largest code agree and no class has ended doesn't split it. Buckets that are small enough are finished
where they are, by multikey quicksort whose recursion into the middle part is a node; a class alone in its bucket is a
path. Sums over subtrees above the local buckets are sums over the buckets below.

Defined results: rows of a null conv_id belong to no conversation; a null role or text is empty; turns of one number are
ordered by role, then by the digest of the text, and repeated rows are turns of their own. c - c % 20 is SQL's remainder,
which has the sign of c. Without conversations there are no nodes, not even a root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import cut, looked_up, mapped

#: Turns of a bucket that one task finishes.
LOCAL = 16_384
#: Turns of a conversation in one row.
SEGMENT = 256
WORD = r"[^\x20\x09-\x0D]+"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
EMPTY = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, digest), at = place among a conversation's turns in a range of rows, and the dictionary
    (digest, code, words). Both cut."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(named, 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # splits even equal rows into ranges
    ranged = cut(rows.repartitionByRange("conv_id", "turn", "role", "digest", "row").withColumn("part", F.spark_partition_id()))
    ordered = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "digest", "row")
    turns = ranged.select("conv_id", "part", "digest", F.row_number().over(ordered).alias("at"))
    words = ranged.groupBy("digest").agg(F.first("words").alias("words"))
    return cut(turns), cut(words.select("digest", F.monotonically_increasing_id().alias("code"), "words"))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, code, words): every turn with its place in its conversation, from 1. Cut."""
    turns, codes = encoded(conversations)
    pieces = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a range has one conversation at most that began before it: as many rows as ranges
    moved = pieces.select("conv_id", "part", before.alias("before")).where("before > 0")
    placed = turns.join(F.broadcast(moved), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest")
    return cut(looked_up(placed, codes, "digest").select("conv_id", "pos", "code", "words"))


def rebuilt(turns: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (conv_id) and their turns (conv_id, depth, code, words): the first h turns of conversation
    conv_id - conv_id % every, then a conversation's own turns after its first h; h = crc32(conv_id) % heads."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lengths = cut(turns.groupBy("conv_id").agg(F.count("*").alias("len")))
    convs = lengths.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = lengths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("there"))
    facts = cut(convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("b")))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "code", "words")
    shared = facts.join(first, "base").where("depth <= h").select("conv_id", "depth", "code", "words")
    # own turns move by h - b, which isn't 0 only below short or absent bases
    short = cut(facts.where("b < h").select("conv_id", (F.col("h") - F.col("b")).alias("missing")))
    own = looked_up(turns.where(F.col("pos") > h), short, "conv_id", how="left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("depth"), "code", "words")
    return facts.select("conv_id"), shared.unionByName(own)


def classed(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv_id, a, b, len), whose digest of all turns is (a, b), and classes (rep, n, a, b, len). Members are cut."""
    each = turns.select("conv_id", F.xxhash64("depth", "code", F.lit(1)).alias("a"), F.xxhash64("code", "depth", F.lit(2)).alias("b"), F.lit(1).alias("len"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("len"))
    members = cut(each.unionByName(none).groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("len").alias("len")))
    return members, cut(members.groupBy("a", "b", "len").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")))


def ends(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(ends, ends_sha256): SHA-256 of the comma-joined ids of each class, under the class's rep. Ids are joined range
    by range, so that the one task that a digest needs reads a few long strings instead of a row for each member."""
    ranged = members.select("a", "b", "len", "conv_id").repartitionByRange("a", "b", "len", "conv_id").sortWithinPartitions("a", "b", "len", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "len")])
            ids, edges = batch.column("conv_id").to_numpy(), np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            starts = np.concatenate([[0], edges]).astype(np.int64)
            stops = np.concatenate([edges, [batch.num_rows]]).astype(np.int64)
            texts = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array(ids[starts]), pa.array(texts, pa.large_string()).cast(pa.string())], ["a", "b", "len", "first", "ids"])

    pieces = mapped(ranged, join, "a long, b long, len long, first long, ids string").repartition("a", "b", "len").sortWithinPartitions("a", "b", "len", "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, sha, out = None, None, None, []
        for batch in batches:
            for *key, start, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "len", "first", "ids")), strict=True):
                if key != now:
                    if sha:
                        out.append((first, sha.hexdigest()))
                    now, first, sha = key, start, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out])], ["ends", "ends_sha256"])
                out = []
        if sha:
            out.append((first, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["ends", "ends_sha256"])

    return mapped(pieces, digest, "ends long, ends_sha256 string")


def segments(classes: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """(rep, n, len, seg, codes, words): the classes' turns, `segment` of them in a row; the first row is there even if
    a class has no turn. Cut."""
    listed = F.array_sort(F.collect_list(F.struct("depth", "code", "words")))
    got = turns.withColumnRenamed("conv_id", "rep").join(classes.select("rep"), "rep", "left_semi")
    rows = got.groupBy("rep", F.floor((F.col("depth") - 1) / segment).cast("int").alias("seg")).agg(listed.alias("t")).select("rep", "seg", F.col("t.code").alias("codes"), F.col("t.words").alias("words"))
    none = F.array().cast("array<bigint>")
    blank = classes.where("len = 0").select("rep", F.lit(0).alias("seg"), none.alias("codes"), none.alias("words"))
    return cut(rows.unionByName(blank).join(classes.select("rep", "n", "len"), "rep"))


class Local:
    """The nodes of one bucket: classes that share their first d0 turns."""

    def __init__(self, d0: int, parent: int | None, top_words: int, skipped: int):
        self.d0, self.parent, self.top_words = d0, parent, top_words
        self.skipped = skipped  # turns of segments that all of the bucket share
        self.rows: dict[int, list] = {}

    def add(self, rep: int, n: int, length: int, codes: np.ndarray, words: np.ndarray) -> None:
        self.rows.setdefault(rep, [n, [], [], length])
        self.rows[rep][1].append(codes)
        self.rows[rep][2].append(words)

    def nodes(self) -> dict[str, np.ndarray]:
        """All nodes of the bucket's subtree, its top first."""
        reps = np.array(sorted(self.rows), np.int64)
        n = np.array([self.rows[r][0] for r in reps.tolist()], np.int64)
        codes = [np.concatenate(self.rows[r][1]) for r in reps.tolist()]
        words = [np.concatenate(self.rows[r][2]) for r in reps.tolist()]
        lens, skip = np.array([self.rows[r][3] for r in reps.tolist()], np.int64), self.skipped
        node: list[list] = []  # conv, depth, parent's place, n_convs, children, words, ends

        def make(members: np.ndarray, depth: int, above: int, last: int) -> int:
            done = members[lens[members] == depth]
            node.append([int(reps[members].min()), depth, above, int(n[members].sum()), 0, last, int(reps[done[0]]) if len(done) else None])
            if above >= 0:
                node[above][4] += 1
            return len(node) - 1

        everyone = np.arange(len(reps))
        top = make(everyone, self.d0, -1, self.top_words)
        open_ = [(everyone[lens > self.d0], self.d0, top)]
        while open_:  # multikey quicksort: by the turn at this depth, a middle part goes on at the next
            members, depth, above = open_.pop()
            if not len(members):
                continue
            if len(members) == 1:  # a path
                k = int(members[0])
                for d in range(depth + 1, int(lens[k]) + 1):
                    above = make(members, d, above, int(words[k][d - 1 - skip]))
                continue
            here = np.fromiter((codes[k][depth - skip] for k in members.tolist()), np.int64, len(members))
            pivot = np.partition(here, len(here) // 2)[len(here) // 2]
            same = members[here == pivot]
            at = make(same, depth + 1, above, int(words[int(same[0])][depth - skip]))
            open_ += [(members[here < pivot], depth, above), (members[here > pivot], depth, above), (same[lens[same] > depth + 1], depth + 1, at)]
        saved = [(x[3] - 1) * x[5] for x in node]
        leaves = [int(not x[4]) for x in node]
        for at in range(len(node) - 1, 0, -1):  # a node comes after its parent
            saved[node[at][2]] += saved[at]
            leaves[node[at][2]] += leaves[at]
        parents = [self.parent if x[2] < 0 else node[x[2]][0] for x in node]
        return {"conv_id": [x[0] for x in node], "depth": [x[1] for x in node], "parent_conv_id": parents, "n_convs": [x[3] for x in node], "n_children": [x[4] for x in node], "n_leaves": leaves, "saved_tokens": saved, "ends": [x[6] for x in node]}


def path(rep: int, n: int, length: int, words: np.ndarray, first: int, after: int, d0: int, parent: int | None) -> dict[str, list] | None:
    """Nodes of a class that is alone in its bucket, of one segment. first: the segment's first
    depth; after: words of later segments."""
    depths = np.arange(first, first + len(words))
    tail = np.cumsum(words[::-1])[::-1] + after
    keep = depths >= d0
    depths, tail = depths[keep], tail[keep]
    if first == 1 and d0 == 0:  # the root has no text of its own
        depths, tail = np.concatenate([[0], depths]), np.concatenate([tail[:1] if len(tail) else [after], tail])
    if not len(depths):
        return None
    k = len(depths)
    above = [parent if d == d0 else rep for d in depths.tolist()]
    last = depths == length
    return {"conv_id": [rep] * k, "depth": depths.tolist(), "parent_conv_id": above, "n_convs": [n] * k, "n_children": (~last).astype(int).tolist(), "n_leaves": [1] * k, "saved_tokens": ((n - 1) * tail).tolist(), "ends": [rep if x else None for x in last.tolist()]}


def finished(rows: DataFrame, segment: int) -> DataFrame:
    """The nodes of all buckets that are not split further, with the bucket's key at its top node."""
    schema = f"{NODES}, top string"
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(found: list[tuple[str, dict]]) -> pa.RecordBatch:
        columns = [[v for _, f in found for v in f[c]] for c in names[:-1]]
        tops = [key if d == d0 else None for (key, d0), f in found for d in f["depth"]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(tops, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, now, found, size = None, None, [], 0

        def close():
            if bucket is not None and bucket.rows:
                found.append(((now, bucket.d0), bucket.nodes()))
                return len(found[-1][1]["conv_id"])
            return 0

        for batch in batches:
            lists = {c: batch.column(c) for c in ("codes", "words")}
            flat = {c: v.flatten().to_numpy() for c, v in lists.items()}
            offsets = lists["codes"].offsets.to_numpy() - lists["codes"].offsets[0].as_py()
            plain = {c: batch.column(c).to_pylist() for c in ("rep", "n", "len", "seg", "key", "d0", "parent", "top_words", "after", "lone")}
            for i in range(batch.num_rows):
                r = {c: v[i] for c, v in plain.items()}
                codes, words = (flat[c][offsets[i] : offsets[i + 1]] for c in ("codes", "words"))
                if r["key"] != now:
                    size += close()
                    now, bucket = r["key"], None if r["lone"] else Local(r["d0"], r["parent"], r["top_words"], r["seg"] * segment)
                if r["lone"]:
                    got = path(r["rep"], r["n"], r["len"], words, r["seg"] * segment + 1, r["after"], r["d0"], r["parent"])
                    if got:
                        found.append(((now, r["d0"]), got))
                        size += len(got["conv_id"])
                else:
                    bucket.add(r["rep"], r["n"], r["len"], codes.copy(), words.copy())
                if size > 20_000:
                    yield batch_of(found)
                    found, size = [], 0
        close()
        if found:
            yield batch_of(found)

    return mapped(rows.repartition("key", F.when(F.col("lone"), F.col("seg"))).sortWithinPartitions("key", "rep", "seg"), run, schema)


def trie(conversations: DataFrame, every: int = 20, heads: int = 4, local: int = LOCAL, segment: int = SEGMENT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(numbered(conversations), every, heads)
    turns = cut(turns)
    members, classes = classed(convs, turns)
    rows = segments(classes, turns, segment).withColumn("key", F.lit(""))
    start = classes.agg(F.count("*").alias("m"), F.sum("len").alias("turns"), F.min("rep").alias("conv"), F.sum("n").alias("n")).where("m > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    buckets = cut(start.select(F.lit("").alias("key"), zero.alias("d0"), "m", "turns", "conv", "n", none.alias("parent"), zero.alias("top_words"), F.array().cast("array<string>").alias("path")))
    done, paths, splits, chains, stops = [], [], [], [], []
    while True:
        paths.append(buckets.select("key", "path"))
        large = (F.col("m") > 1) & (F.col("turns") > local)
        done.append(looked_up(rows, cut(buckets.where(~large).select("key", "d0", "m", "parent", "top_words")), "key"))
        some = cut(buckets.where(large))
        if some.isEmpty():
            break
        here = looked_up(rows, cut(some.select("key", "d0", "m")), "key")
        each = here.select("key", "d0", "m", "seg", F.posexplode(F.arrays_zip("codes", "words")).alias("i", "t")).withColumn("depth", (F.col("seg") * segment + F.col("i") + 1).cast("long"))
        # which turns all of a bucket share: at the first depth where one has ended or another code, it splits
        counted = each.where("depth > d0").groupBy("key", "depth")
        profile = cut(counted.agg(F.min("t.codes").alias("low"), F.max("t.codes").alias("high"), F.count("*").alias("c"), F.first("m").alias("m"), F.min("t.words").alias("words")))
        limits = cut(profile.where("c < m OR low < high").groupBy("key").agg((F.min("depth") - 1).alias("until")))
        splits.append(cut(some.join(limits, "key")))
        chains.append(cut(profile.join(limits, "key").where("depth <= until").select("key", "depth", "words")))
        at = looked_up(here.drop("d0", "m"), limits, "key")
        stops.append(cut(at.where("len = until AND seg = 0").select("key", F.col("rep").alias("ends"))))
        # the turn that splits a bucket stands in one segment of each class
        place = (F.col("until") % segment).cast("int")
        turn = at.where((F.col("len") > F.col("until")) & (F.col("seg") == F.floor(F.col("until") / segment)))
        turn = turn.select("rep", "n", "len", "key", "until", F.get("codes", place).alias("code"), F.get("words", place).alias("top_words"))
        moved = cut(turn.withColumn("next", F.md5(F.concat_ws(":", "key", F.col("until").cast("string"), F.col("code").cast("string")))))
        grown = moved.groupBy("next").agg(
            F.first("key").alias("key"), F.first("until").alias("until"), F.count("*").alias("m"), F.sum(F.col("len") - F.col("until")).alias("turns"),
            F.min("rep").alias("conv"), F.sum("n").alias("n"), F.first("top_words").alias("top_words"),
        )
        above = some.select("key", F.col("conv").alias("parent"), "path")
        buckets = cut(
            grown.join(above, "key").select(F.col("next").alias("key"), (F.col("until") + 1).alias("d0"), "m", "turns", "conv", "n", "parent", "top_words", F.concat("path", F.array("key")).alias("path"))
        )
        # segments before the one of the split hold nothing that isn't shared
        left = at.where((F.col("seg") + 1) * segment > F.col("until")).select("rep", "n", "len", "seg", "codes", "words")
        rows = cut(left.join(moved.select("rep", F.col("next").alias("key")), "rep"))
    below = cut(finished(with_after(union(done), segment), segment))
    nodes = below.drop("top")
    if splits:
        nodes = nodes.unionByName(upper(*map(union, (paths, splits, chains, stops)), below))
    ended = nodes.where("ends IS NOT NULL").join(ends(members, classes), "ends")
    other = nodes.where("ends IS NULL").withColumn("ends_sha256", F.lit(EMPTY))
    return ended.unionByName(other).drop("ends")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_after(rows: DataFrame, segment: int) -> DataFrame:
    """Rows of finished buckets; of a class that is alone in its bucket with the words of its later segments."""
    later = Window.partitionBy("rep").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    long_ = (F.col("m") == 1) & (F.col("len") > segment)
    several = rows.where(long_).withColumn("after", F.coalesce(F.sum(total).over(later), F.lit(0)))
    one = rows.where(~long_).withColumn("after", F.lit(0).cast("long"))
    return several.unionByName(one).select("rep", "n", "len", "seg", "codes", "words", "key", "d0", "parent", "top_words", "after", (F.col("m") == 1).alias("lone"))


def upper(paths: DataFrame, splits: DataFrame, chains: DataFrame, stops: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of the buckets that were split: a bucket's top, the chain that all of it share, and the node that splits.

    paths: (key, path) of all buckets, path = the keys of the buckets above; stops: the class that ends at a splitting node."""
    tops = splits.select("key", F.col("d0").alias("depth"), F.col("top_words").alias("words"))
    chain = tops.unionByName(chains).join(splits.select("key", "d0", "until", "conv", "n", "parent"), "key").withColumn("saved", (F.col("n") - 1) * F.col("words"))
    children = paths.where(F.size("path") > 0).groupBy(F.element_at("path", -1).alias("key")).agg(F.count("*").alias("children"))
    # what each bucket adds to those above: a finished one its top's sums, a split one its own chain
    added = below.where("top IS NOT NULL").select(F.col("top").alias("key"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    added = added.unionByName(chain.groupBy("key").agg(F.lit(0).cast("long").alias("leaves"), F.sum("saved").alias("saved")))
    under = added.join(paths, "key").select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("under"))
    suffix = F.sum("saved").over(Window.partitionBy("key").orderBy(F.desc("depth")))
    nodes = chain.withColumn("chain", suffix).join(under, "key").join(children, "key").join(stops, "key", "left")
    last = F.col("depth") == F.col("until")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("d0"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("chain") + F.col("under")).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"),
    )


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, o: list_reduce(list_prepend(xor(acc, o), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"""

#: Prefixes as lists of digests; a node's subtree is found through the prefixes of its nodes.
ORACLE = f"""
WITH turns AS (
    SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
    SELECT c.conv_id, 0 AS own, pos, t, words FROM convs c JOIN turns b ON b.conv_id = c.base AND b.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, pos, t, words FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.pos > c.h),
whole AS (SELECT conv_id, list(t ORDER BY own, pos) AS ts, list(words ORDER BY own, pos) AS ws FROM parts GROUP BY conv_id),
full_ AS (SELECT c.conv_id, coalesce(ts, []) AS ts, coalesce(ws, []) AS ws FROM convs c LEFT JOIN whole w ON w.conv_id = c.conv_id),
prefixes AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts, ws FROM full_),
keyed AS (SELECT conv_id, n, depth, sha256(array_to_string(ts[:depth], ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(ts[:depth - 1], ',')) END AS above, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words FROM prefixes),
nodes AS (
    SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, bool_and(n = depth) AS leaf,
        sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM keyed GROUP BY node, depth),
sums AS (SELECT k.node, k.depth, sum(v.leaf::BIGINT) AS n_leaves, sum(v.saved) AS saved_tokens FROM nodes v JOIN keyed k ON k.conv_id = v.conv_id AND k.depth <= v.depth GROUP BY k.node, k.depth),
kids AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above, depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1"""
