"""The prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from veilframe.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    members, children, out = defaultdict(list), defaultdict(set), {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    for node in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children[node]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = sorted(c for c in members[node] if built[c] == node)
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), sum(b[5] for b in below) or 1,
            (len(members[node]) - 1) * words + sum(b[6] for b in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, **options).collect()), key=lambda r: (r[1], r[0]))
    assert got == brute(rows)


def chats(seed, convs, words=3, longest=7):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"]), " ".join("ab"[r.randrange(2)] for _ in range(r.randrange(1, words)))) for c in range(convs) for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize("local", [60, 100_000])
def test_random_conversations(spark, local):
    check(spark, chats(1, 60, 2), local=local)


def test_long_equal_and_nested_conversations(spark):
    base = [("user" if t % 2 else "bot", f"turn {t % 5}") for t in range(23)]
    rows = [(c, t, *base[t]) for c in range(300, 312) for t in range(23 if c < 308 else c - 297)]
    rows += [(400 + k, t, "user", "other" if t == 13 + k else f"turn {t % 5}") for k in range(6) for t in range(21)]
    check(spark, rows, local=120, segment=4)
    check(spark, rows, segment=4)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 1, "u", "x y"), (1, 1, "u", "x y"), (1, 1, "b", "z"), (None, 1, "u", "x"), (21, 5, "u", ""), (20, 1, None, ""), (-7, 2, "u", "x"), (0, 1, "u", " \t")]
    check(spark, rows)
    check(spark, rows, local=8)


def test_empty_and_turnless(spark):
    check(spark, [])
    check(spark, [(None, 1, "u", "x")])
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]  # their only turn is replaced by none
    check(spark, [(c, 1, "u", "x") for c in turnless])
    check(spark, [(c, 1, "u", "x") for c in turnless] + [(c + 40, t, "u", str(t)) for c in range(5) for t in range(6)], local=20)


def test_long_texts_and_a_hot_conversation(spark):
    rows = [(60, t, "u", f"t{t % 3} " * (20_000 if t == 5 else 1)) for t in range(900)] + chats(3, 30)
    check(spark, rows, local=700, segment=64)
