"""Nearest neighbours and whitening against brute force."""

import numpy as np
import pytest

from veilframe.llm import collision_ann, whitening

KIND = "vec_id long, embedding array<double>, rank string"


def vectors(n, d=24, seed=1, scale=1.0):
    return np.random.default_rng(seed).standard_normal((n, d)) * scale


def nearest(ids, x, query, k):
    """The k nearest by brute force: [(id, score)]."""
    norms = np.sqrt((x * x).sum(1))
    i = ids.index(query)
    rows = sorted((-float(x[i] @ x[j]) / float(norms[i] * norms[j]), ids[j]) for j in range(len(ids)) if ids[j] != query)
    return [(j, -s) for s, j in rows[:k]]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard", [100, 10_000])
def test_recall_and_scores(spark, shard):
    x = vectors(1500)
    x[700:760] = x[700] + 0.01 * vectors(60, seed=2)  # a tight group
    ids = list(range(0, 3000, 2))
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x, strict=True)], KIND)
    got = found(collision_ann.search(rows, collision_ann.every(rows, 50), rows_a_shard=shard))
    queries = [i for i in ids if i % 50 == 0]
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        want, there = nearest(ids, x, q, 5), got[q]
        assert len(there) == 5 and [s for _, s in there] == sorted((s for _, s in there), reverse=True)
        exact = dict(nearest(ids, x, q, len(ids)))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in there)
        hits += len({i for i, _ in want} & {i for i, _ in there})
    assert hits >= 0.95 * 5 * len(queries)


def test_ties_copies_and_few_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0], None) for i in range(40)] + [(50, [0.0, 3.0], None), (100, [0.0, -2.0], None), (51, [1.0, 1.0], None)], KIND)
    got = found(collision_ann.search(rows, collision_ann.every(rows, 50), rows_a_shard=7))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and all(s == 1.0 for _, s in got[0])
    assert got[50][0][0] == 51 and [i for i, _ in got[50][1:]] == [0, 1, 2, 3]
    assert [i for i, _ in got[100]] == [0, 1, 2, 3, 4]
    few = spark.createDataFrame([(0, [1.0, 0.0], ""), (3, [0.5, 0.5], "")], KIND)
    assert [i for i, _ in found(collision_ann.search(few, collision_ann.every(few, 50)))[0]] == [3]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(50, None, ""), (100, [0.0, 0.0], ""), (150, [nan, 1.0], ""), (200, [inf, 1.0], ""), (None, [1.0, 0.0], ""), (250, [None, 1.0], ""), (300, [], ""), (350, [1.0], "")]
    rows = spark.createDataFrame([*bad, (0, [1.0, 0.0], ""), (0, [1.0, 0.0], ""), (7, [2.0, 1e-200], ""), (8, [1e-200, 0.0], "")], KIND)
    got = found(collision_ann.search(rows, collision_ann.every(rows, 50)))
    assert list(got) == [0] and [i for i, _ in got[0]] == [7, 8]
    assert found(collision_ann.search(rows.limit(0), collision_ann.every(rows, 50))) == {}
    assert whitening.whiten(rows.limit(0)).collect() == []
    assert {r["vec_id"] for r in whitening.whiten(rows).collect()} == {None, 0, 7, 8, 100}


def whole(x):
    """n, deviations, eigenvalues and covariance by integers."""
    a = (np.floor(1024 * x).astype(int) + 100000).astype(object)
    n, s = len(a), a.sum(0)
    dev = n * a - s
    v = np.array([[float((dev[:, i] * dev[:, j]).sum()) / n**3 for j in range(a.shape[1])] for i in range(a.shape[1])])
    return n, (dev**2).sum(1), v, np.array(dev / n, float)


def test_whitening(spark):
    x = vectors(400, 12) * np.linspace(0.3, 4, 12)
    rows = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], KIND).repartition(7)
    got = whitening.whiten(rows).collect()
    n, dev, v, c = whole(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    assert len(got) == 8 * n
    z = np.zeros((n, 8))
    for r in got:
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-12)
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = c @ u / np.sqrt(e)
    assert np.abs(z * np.sign((z * want).sum(0)) - want).max() < 1e-9
    assert got[0]["identity_error"] < 1e-12


def test_covariance_keeps_what_doubles_lose(spark):
    """A mean of 1e12 and a spread of a few units: sums of squares in doubles would leave nothing."""
    x = np.random.default_rng(4).integers(0, 5, (300, 3)).astype(float) / 1024 + 2.0**30
    rows = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], KIND).repartition(5)
    n, sums = whitening.summed(rows, "embedding", 3)
    _, _, v, _ = whole(x)
    assert np.abs(whitening.covariance(rows, "embedding", n, sums) / v - 1).max() < 1e-15


def test_products_against_fractions():
    from fractions import Fraction

    a = vectors(33, 4, scale=1e6)
    low = vectors(33, 4, seed=9, scale=1e-11)
    p = whitening.Products(4)
    p.add(a, low)
    for k, (i, j) in enumerate(zip(p.i, p.j, strict=True)):
        exact = sum((Fraction(x) + Fraction(y)) * (Fraction(z) + Fraction(w)) for x, y, z, w in zip(a[:, i], low[:, i], a[:, j], low[:, j], strict=True))
        assert abs(Fraction(p.sum[0][k]) + Fraction(p.sum[1][k]) - exact) < abs(exact) * Fraction(1, 2**90) + Fraction(1, 10**12)


def test_constant_and_single_vectors(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], None), (1, [0.5, 2.0], None)], KIND)).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], None), (2, [0.5, 3.0], None)], KIND)).collect()
    assert sorted(r["whitened"] for r in got if r["component"] == 1) == pytest.approx([-1, 1]) and all(r["whitened"] is None for r in got if r["component"] == 2)
    huge = spark.createDataFrame([(i, [float(i % 2) * 2.0**39], None) for i in range(10)], KIND)
    assert all(r["deviation"] is None for r in whitening.whiten(huge).collect())
