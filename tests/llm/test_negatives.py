"""op11 against all scores, in Python's integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from quillgraph.llm import negatives
from quillgraph.llm.negatives import Cells, Mining

from tests.llm import brute


def want(rows: list, p: Mining) -> list:
    """rows: (vec_id, embedding, label)."""
    good: dict = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        y = tuple(math.floor(p.scale * x) for x in v)
        if sum(x * x for x in y) < 1 << 56:
            row = ((label + 1) % p.labels if i % p.relabelled == 0 else label, y)
            good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, y) in good.items():
        if a % p.every:
            continue
        scores = [(sum(s * t for s, t in zip(y, z, strict=True)), b, other) for b, (other, z) in good.items() if b != a and len(z) == len(y)]
        for s, b, _ in sorted((x for x in scores if x[2] == label), key=lambda x: (-x[0], x[1]))[: p.positives]:
            fit = [x for x in scores if x[2] != label and p.low * s <= 100 * x[0] <= p.high * s]
            for k, (t, c, _) in enumerate(sorted(fit, key=lambda x: (-x[0], x[1]))[: p.negatives]):
                out.append((a, b, k + 1, c, s, t))
    return sorted(out)


def odd(n: int, dim: int) -> list:
    rnd = random.Random(11)
    out = [(i, [rnd.gauss(0, 0.3) for _ in range(dim)], rnd.randrange(4)) for i in range(n)]
    out += [(n + i, list(rnd.choice(out)[1]), rnd.choice([0, 1, 9])) for i in range(n)]  # copies, within labels and across
    out += [(2 * n + i, [0.5] * dim, 3) for i in range(40)]  # a class larger than any answer
    bad = [None, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [1e7] * dim, [1e300] * dim]
    out += [(7000 + 20 * i, v, 1) for i, v in enumerate(bad)] + [(8000, [1.0] * dim, None), (None, [1.0] * dim, 1)]
    out += [(9000, [], 1), (9001, [], 2), (9020, [], 1), (9002, [], 1), (9040, [0.0] * dim, 1), (9060, [1000.0] * dim, 1), (9061, [900.0] * dim, 2), (9062, [1000.0] * dim, 1)]
    out += [(9100 + i, [0.1 * i, 0.2], i % 3) for i in range(30)] + [(20, [9.0] * dim, 0), (20, [0.1] * dim, 0), (20, [0.1] * dim, 0), (-40, [0.2] * dim, -3), (-7, [0.2] * dim, -3)]
    return out


SCHEMA = "vec_id long, embedding array<double>, label int, cid int, rank int, score string, y int"


@pytest.mark.parametrize("p", [Mining(every=20), Mining(every=20, cells=4, least=16, chunk=50, asked=5), Mining(every=5, positives=2, negatives=3, dims=2, least=64), Mining(every=20, positives=12, negatives=1, low=0, high=100)])
def test_mining_is_all_scores(spark, p):
    rows = odd(120, 6)
    df = spark.createDataFrame([(i, v, y, 1, 2, "s", 3) for i, v, y in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, negatives.mine(spark, df, p).collect()))
    assert got == want(rows, p)
    assert len(got) > 100


def test_no_rows(spark):
    df = lambda rows: spark.createDataFrame([(i, v, y, 1, 2, "s", 3) for i, v, y in rows], SCHEMA)
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(1, [1.0], 1), (2, [1.0], 1)], [(0, [], 1), (1, [], 2), (3, [], 2)]):
        assert sorted(map(tuple, negatives.mine(spark, df(rows)).collect())) == want(rows, Mining())


def test_cells_bound_and_leave_out_most():
    rng = np.random.default_rng(2)
    x, asked = np.floor(rng.standard_normal((5000, 64)) * 32).astype(np.int64), np.floor(rng.standard_normal((40, 64)) * 32).astype(np.int64)
    edges = [(int(c.min()), int(c.max()), np.quantile(c, np.arange(1, 64) / 64).astype(int).tolist()) for c in x.T]
    cells = Cells(edges, 64)
    lo, hi = cells.bounds(cells.encode(x), asked)
    exact = x @ asked.T
    assert (lo <= exact).all() and (exact <= hi).all()
    share = np.mean([negatives.possible(lo[:, a], hi[:, a], 10, *negatives.window(25_000, Mining())).mean() for a in range(40)])
    assert share < 0.05
    assert negatives.window(-5, Mining())[0] > negatives.window(-5, Mining())[1] and negatives.window(0, Mining()) == (0, 0)


def test_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{brute.DATA}/embeddings.parquet").collect()]
    assert sorted(map(tuple, negatives.op11_negatives(spark, brute.DATA).collect())) == want(rows, Mining())
