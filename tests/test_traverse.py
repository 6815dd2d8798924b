"""Walks over edges in buckets, past nodes that let through, and what their plans shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from quillgraph.operators import lineage, selection, traverse, walks


@pytest.fixture
def unbroadcast(spark):
    """As with frontiers that are too large to be broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_level_does_not_shuffle_edges(spark, capsys, unbroadcast):
    graph = traverse.Graph.of(spark.range(300).select((F.col("id") % 40).alias("src"), (F.col("id") % 70).alias("dst")))
    frontier = spark.range(9)
    told = plan(frontier.join(graph.edges, frontier["id"] == graph.edges["src"]), capsys)
    assert "Exchange hashpartitioning(src" not in told and "Exchange hashpartitioning(id" in told
    assert graph.edges.count() == len({(i % 40, i % 70) for i in range(300)})


def test_a_walk_by_labels_does_not_shuffle_edges(spark, capsys, unbroadcast):
    nodes = spark.range(60).select("id", F.col("id").alias("name"))
    edges = spark.range(200).select((F.col("id") % 20).alias("src"), (20 + F.col("id") % 40).alias("dst"))
    tests = spark.range(50).select("id", (F.col("id") + 1000).alias("test"))
    u = selection.Universe(nodes, edges, tests)
    hops = u.with_test_hops
    u.pick(F.col("id") == 3, at=True, mode="empty", walk_tests=True)
    assert u.with_test_hops is hops
    assert "Exchange hashpartitioning(src" not in plan(spark.range(9).join(walks._moves(hops.edges, walks.CHILDREN_AND_TESTS), F.col("id") == F.col("src")), capsys)


def test_hidden_counts_edges_of_the_nodes_alone(spark, capsys):
    graph = traverse.Graph.of(spark.createDataFrame([(1, 2), (2, 3), (4, 2), (3, 5), (2, 6), (8, 9)], "src int, dst int"))
    got = lineage.hidden(graph, spark.createDataFrame([(2,), (3,), (7,)], "id int"))
    assert sorted(map(tuple, got.collect())) == [(2, 2, 1), (3, 0, 1), (7, 0, 0)]
    assert "keys=[src#" not in plan(got, capsys).split("dst#")[0]


def test_walks_past_nodes_that_let_through(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "y"), ("b", "b")], "src string, dst string")
    through = spark.createDataFrame([("a",), ("b",)], "id string")
    got = traverse.bfs(edges, spark.createDataFrame([("a",)], "id string"), through=through)
    assert sorted((r["id"], r["depth"]) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2), ("x", 1)]


@pytest.mark.parametrize("seed", range(2))
def test_seen_through_against_walks_of_each_node(spark, seed):
    rnd = random.Random(seed)
    kinds = {i: rnd.choice(["built", "passes", "passes", "hides"]) for i in range(30)}
    edges = {(rnd.randrange(32), rnd.randrange(30)) for _ in range(70)}
    want = {}
    for b in (i for i, k in kinds.items() if k == "built"):
        at, seen, depth = [b], set(), 0
        while at:
            depth += 1
            met = {s for s, d in edges if d in at}
            for s in met:
                if kinds.get(s) == "built":
                    want.setdefault((b, s), depth)
            at = [s for s in met if kinds.get(s) == "passes" and s not in seen]
            seen.update(at)
    nodes = spark.createDataFrame([(i, k == "built", k == "passes") for i, k in kinds.items()], "id int, built boolean, passes boolean")
    rows = traverse.seen_through(spark.createDataFrame(sorted(edges), "src int, dst int"), nodes)
    got = {(r["id"], r["end"]): r["steps"] for r in rows.groupBy("id", "end").agg(F.min("steps").alias("steps")).collect()}
    assert got == want
