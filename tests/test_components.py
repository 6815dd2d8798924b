"""Components and reach of all nodes, against closures in plain Python."""

from __future__ import annotations

import random

from quillgraph.operators import components


def closure(edges: set) -> dict:
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    out = {}
    for s in near:
        seen, todo = set(), list(near[s])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += near[x]
        out[s] = seen
    return out


def graphs() -> set:
    """Several graphs side by side."""
    rnd = random.Random(5)
    between = {("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("d", "t"), ("r", "a"), ("s", "s"), ("s", "a"), ("t", "u")}
    sparse = {(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(66)}
    layers = {(f"l{i}.{rnd.randrange(40)}", f"l{j}.{rnd.randrange(40)}") for i in range(2) for j in range(i + 1, 3) for _ in range(90)}
    ring = {(f"{i:02}", f"{(i + 1) % 6:02}") for i in range(6)} | {("05", "x"), ("y", "00")}
    return between | sparse | layers | ring


def test_components_and_reach_are_those_of_the_closure(spark):
    edges = graphs()
    reach = closure(edges)
    df = spark.createDataFrame([*edges, *list(edges)[:5], (None, "a"), ("a", None)], "src string, dst string")
    together = {s: min({s, *(x for x in reach[s] if s in reach[x])}) for s in reach}
    assert {r.id: r.component for r in components.cycles(df).collect()} == {s: c for s, c in together.items() if s in reach[s]}
    rows = components.reach_all(df, block=40).collect()
    assert {r.id: r.n for r in rows} == {s: len(reach[s] - {s}) for s in reach} and len(rows) == len(reach)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert components.strong_components(none).count() == components.cycles(none).count() == components.reach_all(none).count() == 0


def test_what_is_above_lies_in_few_words(spark):
    """Of a tree, a node's ancestors lie in a word for six levels or so; wide and narrow parts of a graph give the same reach as by definition."""
    n = 2048
    tree = spark.range(2, n).selectExpr("id div 2 AS src", "id AS dst")
    own, above = components.reached_by_words(tree, spark.range(1, n).selectExpr("id", "id AS node"))
    assert above.count() < 4 * n
    met = above.withColumnRenamed("bits", "a").join(own.withColumnsRenamed({"id": "before", "bits": "o"}), "word").where("a & o <> 0").select("id", "before").distinct()
    want = sorted((i, i >> k) for i in range(1, n) for k in range(1, 12) if i >> k and 2 * i < n)
    assert sorted((r.id, r.before) for r in met.where(f"2 * id < {n}").collect()) == want
    wide = tree.union(spark.range(300).selectExpr("1L AS src", "id + 10000 AS dst")).union(spark.range(300).selectExpr("id + 10000 AS src", "id % 7 + 20000 AS dst"))
    below = {i: sum(1 for j in range(i + 1, n) if any(j >> k == i for k in range(1, 12))) for i in range(1, n)}
    below |= {1: n - 2 + 307} | {i + 10000: 1 for i in range(300)} | {i + 20000: 0 for i in range(7)}
    assert {r.id: r.n for r in components.reach_all(wide).collect()} == below


def test_reach_without_cycles_looks_for_no_components(spark, monkeypatch):
    """Without cycles nodes are placed by counting; starts whose edges go to ends alone are counted by these, and an edge to the node itself is none."""

    def never(*_):
        raise AssertionError("no components here")

    monkeypatch.setattr(components, "strong_components", never)
    edges = [("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("b", "y"), ("b", "y"), ("r", "x"), ("a", "a"), ("s", "s"), ("c", "a"), ("c", "z"), (None, "a"), ("a", None)]
    got = {r.id: r.n for r in components.reach_all(spark.createDataFrame(edges, "src string, dst string"), block=1).collect()}
    assert got == {"r": 4, "a": 1, "b": 2, "c": 3, "s": 0, "x": 0, "y": 0, "z": 0}
