"""op12 against all distances, in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from quillgraph.llm import centroids
from quillgraph.llm.centroids import Compressed, Means

from tests.llm import brute


def kept(rows: list, dim: int) -> list:
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in good]
    return [(i, y) for i, y in good if sum(x * x for x in y) < 1 << 56]


def want(rows: list, p: Means) -> list:
    good = kept(rows, p.dim)
    cents = [y for _, y in sorted((hashlib.sha256(f"{p.seed}{i}".encode()).hexdigest(), y) for i, y in good if i is not None)][: p.k]
    if not cents:
        return []
    far = lambda y, c: sum((a - b) ** 2 for a, b in zip(y, c, strict=True))
    near = lambda y: min((far(y, c), j) for j, c in enumerate(cents))
    for _ in range(p.rounds):
        mine = [near(y)[1] for _, y in good]
        for j in range(len(cents)):
            if own := [y for (_, y), m in zip(good, mine, strict=True) if m == j]:
                cents[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    last = [(i, *near(y)) for i, y in good]
    sums = [sum(d for _, d, k in last if k == j) for j in range(len(cents))]
    return sorted(((i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


def odd(n: int, dim: int) -> list:
    rnd = random.Random(3)
    out = [(i, [rnd.gauss(0, 0.2) for _ in range(dim)]) for i in range(n)]
    out += [(n + i, list(rnd.choice(out)[1])) for i in range(n)]  # copies, and so empty clusters and ties
    out += [(5, [1.0] * dim), (5, [-1.0] * dim), (None, [0.1] * dim), (3000, None), (3001, []), (3002, [0.0] * dim), (3003, [None] + [1.0] * (dim - 1)), (3004, [float("nan")] * dim)]
    out += [(3005, [float("-inf")] * dim), (3006, [1.0] * (dim + 1)), (3007, [1e5] * dim), (3008, [-1e5] * dim), (3009, [1e7] * dim), (3010, [1e300] * dim), (3011, [1e-300] * dim), (3012, [-1e-300] * dim)]
    return out


SCHEMA = "vec_id long, embedding array<double>, cluster int, y int, label int, codes string"


@pytest.mark.parametrize("p", [Means(dim=6, k=9, rounds=4, blocks=3), Means(dim=6, k=500, rounds=2, bits=2, blocks=1), Means(dim=5, k=4, rounds=0, bits=8, blocks=5)])
def test_clusters_are_those_of_all_distances(spark, p):
    rows = odd(150, p.dim)
    df = spark.createDataFrame([(i, v, 1, 2, None, "c") for i, v in rows], SCHEMA).repartition(5)
    found = centroids.clusters(spark, df, p).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == want(rows, p)
    assert all(len(r.centroid) == p.dim for r in found)


def test_few_and_no_vectors(spark):
    p = Means(dim=2, k=40)
    df = lambda rows: spark.createDataFrame([(i, v, 1, 2, None, "c") for i, v in rows], SCHEMA)
    for rows in ([(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [9.0, 9.0])], [(None, [0.5, 1.0])], [(1, [0.5])], []):
        assert sorted((tuple(r)[:6] for r in centroids.clusters(spark, df(rows), p).collect()), key=repr) == want(rows, p)


def test_sums_beyond_64_bits_of_a_half():
    """Halves of 32 bits give back the mean of negative sums."""
    x = np.array([[-(1 << 27), 5], [-(1 << 27) + 1, 6]], dtype=np.int64).repeat(1000, axis=0)
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    assert [((h << 32) + w) // len(x) for w, h in zip(low.tolist(), high.tolist(), strict=True)] == [int(c) // len(x) for c in x.sum(axis=0)]


def test_bounds_hold_and_leave_out_most():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(-120, 120, (500, 64)), rng.integers(-(1 << 24), 1 << 24, (200, 64)), np.zeros((1, 64), dtype=np.int64)])
    c = x[rng.permutation(len(x))[:40]]
    for bits in (2, 4, 5, 8):
        small = Compressed.of(x, Means(bits=bits))
        again = Compressed.read(small.columns(), 64)
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (small.bounds(c, 8) <= far).all() and (again.bounds(c, 8) == small.bounds(c, 8)).all()
        cluster, d, n = centroids.nearest(x, small, c, 8)
        assert (cluster == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    assert n.mean() < 4


def test_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{brute.DATA}/embeddings.parquet").collect()]
    found = centroids.op12_centroids(spark, brute.DATA)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == want(rows, Means())
