"""Walks by an automaton and within a budget."""

from __future__ import annotations

from quillgraph.operators import components, selection, walks
from quillgraph.operators.walks import CUTS, OPEN, Drawn


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.split(">")) for r in rows], "src string, dst string")


def cut(spark, *rows):
    """a>b is plain, a>b>x is cut."""
    return spark.createDataFrame([(*r.split(">")[:2], len(r.split(">")) == 3) for r in rows], "src string, dst string, cut boolean")


def test_a_budget_takes_the_first_of_a_level_and_never_joins_the_next(spark):
    e = frame(spark, "p>f", "f>c", "f>b", "f>d", "b>x", "c>y", "x>z", "f>f", "f>b", "c>f")
    seen = lambda d: (sorted((i, n) for i, (n, _) in d.nodes.items()), d.truncated)
    whole = [("b", 1), ("c", -1), ("d", 1), ("f", 0), ("p", -1), ("x", 2), ("z", 3)]  # c is above, so it isn't met below, nor is y
    assert seen(walks.lineage_within(e, "f", 1, 9, 100)) == (whole, False)
    assert seen(walks.lineage_within(e, "f", 1, 9, 7)) == (whole, False)  # full, and nothing was turned away
    assert seen(walks.lineage_within(e, "f", 1, 9, 4)) == ([("b", 1), ("c", -1), ("f", 0), ("p", -1)], True)
    assert seen(walks.lineage_within(e, "f", 1, 9, 2)) == ([("c", -1), ("f", 0)], True)
    cut_short = Drawn(3)
    walks.within(walks.labelled(e, "edge"), "f", {(OPEN, "edge"): OPEN}, 9, cut_short)
    assert sorted(cut_short.nodes) == ["b", "c", "f"] and cut_short.truncated and cut_short.jobs == 1  # d was turned away, so no level follows


def test_stops_are_taken_back_and_take_no_room(spark):
    e = cut(spark, "f>a", "f>s>x", "a>s", "s>t", "f>u>x", "u>v")
    stops = lambda d: {i: v for i, v in d.nodes.items()}
    assert stops(walks.columns_within(e, "f", 0, 9, 100)) == {"f": (0, False), "a": (1, False), "s": (1, False), "u": (1, True), "t": (3, False)}
    few = walks.columns_within(e, "f", 0, 9, 4)
    assert stops(few) == {"f": (0, False), "a": (1, False), "s": (1, False), "u": (1, True)} and few.truncated
    label = e.selectExpr("src", "dst", "if(cut, 'cut', 'plain') AS label")
    nodes = walks.nodes_of(walks.walk(label, spark.createDataFrame([("f",)], "id string"), CUTS))
    assert {r.id: (r.depth, r.stop) for r in nodes.collect()} == stops(walks.columns_within(e, "f", 0, 9, 100))
    assert {(r.src, r.dst) for r in walks.drawn_edges(e, nodes).collect()} == {("f", "a"), ("f", "s"), ("a", "s"), ("s", "t"), ("f", "u")}


def test_walks_keep_keys_apart_and_end_on_cycles(spark):
    e = walks.labelled(frame(spark, "a>b", "b>c", "c>a", "x>y"), "edge").union(spark.createDataFrame([(None, "a", "edge"), ("a", None, "edge"), ("c", "d", None), ("c", "e", "other")], "src string, dst string, label string"))
    seeds = spark.createDataFrame([("k", "a"), ("k", "x"), ("m", "c"), ("m", None)], "seed string, id string")
    got = {(r.seed, r.id): r.depth for r in walks.walk(e, seeds, {(OPEN, "edge"): OPEN}).collect()}
    assert got == {("k", "a"): 0, ("k", "b"): 1, ("k", "c"): 2, ("k", "x"): 0, ("k", "y"): 1, ("m", "c"): 0, ("m", "a"): 1, ("m", "b"): 2}


def test_needs_are_seen_through_what_passes(spark):
    nodes = spark.createDataFrame([("m", True, False), ("e1", False, True), ("e2", False, True), ("p", True, False), ("q", True, False), ("s", False, False)], "id string, built boolean, passes boolean")
    e = frame(spark, "e1>m", "e2>e1", "p>e2", "q>p", "q>e1", "s>m", "p>s", "e1>e2", "m>e2")
    assert {(r.id, r.need, r.steps) for r in walks.needs_through(e, nodes).collect()} == {("m", "p", 3), ("m", "q", 2), ("p", "q", 1)}


def test_pairs_that_reach(spark):
    e = frame(spark, "a>b", "b>a", "b>c", "c>d", "s>s", "x>y")
    asked = frame(spark, "a>b", "a>a", "a>d", "d>a", "c>c", "s>s", "x>d", "x>y", "a>zz", "c>d", "c>d")
    assert sorted((r.src, r.dst) for r in components.reached(e, asked, block=1).collect()) == [("a", "a"), ("a", "b"), ("a", "d"), ("c", "d"), ("s", "s"), ("x", "y")]


def test_selections_walk_to_tests(spark):
    nodes = spark.createDataFrame([(i,) for i in ("r", "a", "b", "c")], "id string")
    tests = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("c", "t2"), ("zz", "t3")], "id string, test string")
    u = selection.Universe(nodes, frame(spark, "r>a", "a>c"), tests, mode="empty")
    from pyspark.sql import functions as F

    ids = lambda **k: sorted(r.id for r in u.pick(F.col("id") == "a", walk_tests=True, **k).ids.collect())
    assert ids(down=1) == ["a", "c", "t1"] and ids(down=None) == ["a", "c", "t1", "t2"] and ids(up=1) == ["a", "r"]
    assert ids(at=True) == ["a", "b", "c", "r", "t1", "t2"]


def test_closure_by_deltas_is_the_definition(spark):
    """Links with a ring, groups that wait on each other, and points that are updaters of several assets."""
    import random

    from quillgraph.operators import jobs

    rnd = random.Random(3)
    name = lambda: f"p{rnd.randrange(14)}"
    links = {(name(), name()) for _ in range(9)} | {("r1", "r2"), ("r2", "r1"), ("r1", "p0")}
    groups = {(name(), rnd.choice("xyz"), name()) for _ in range(14)} | {("g", "x", "r1"), ("g", "x", "r2"), ("h", "y", "g")}
    before = {(d, s) for s, d in links}
    while True:
        more = {(d, z) for s, d in links for y, z in before if y == s}
        for d, a in {(d, a) for d, a, _ in groups}:
            members = [s for e, b, s in groups if (e, b) == (d, a)]
            more |= {(d, z) for z in {z for _, z in before} | set(members) if all(z == s or (s, z) in before for s in members)}
        if more <= before:
            break
        before |= more
    got = jobs.ancestors_all(spark.createDataFrame([*links, (None, "p1")], "src string, dst string"), spark.createDataFrame([*groups, *groups], "dst string, asset string, src string")).collect()
    assert sorted((r.point, r.before) for r in got) == sorted(before)


def test_ranks_follow_the_queue(spark):
    """Against a queue, with a test as a start, parts that no start reaches, and rings."""
    import random

    from quillgraph.operators import lineage

    rnd = random.Random(2)
    edges = {(f"n{rnd.randrange(26)}", f"n{rnd.randrange(26)}") for _ in range(14)} | {("a1", "a2"), ("a2", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1")}
    ids = sorted({x for e in edges for x in e})
    label = {i: f"{chr(99 - ord(i[0]) % 3)}{i[1:]}" for i in ids}  # names in another order than ids, some alike
    order = lambda xs: sorted(set(xs), key=lambda i: (label[i], i))
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in ids}
    fed = {b for a, b in edges if a != b}
    rank: list = order([ids[-1], ids[-2]])
    head, roots = 0, False
    while len(rank) < len(ids):
        if head == len(rank):
            fresh = [] if roots else order(i for i in ids if i not in rank and i not in fed)
            roots = True
            rank += fresh or order(i for i in ids if i not in rank)[:1]
            continue
        rank += order(i for i in near[rank[head]] if i not in rank)
        head += 1
    nodes = spark.createDataFrame(list(label.items()), "id string, name string")
    e = spark.createDataFrame(list(edges), "src string, dst string")
    starts = spark.createDataFrame([(ids[-1],), ("t",), ("unknown",)], "id string")
    hosts = spark.createDataFrame([("t", ids[-2]), ("other", ids[0])], "test string, id string")
    got = {r.id: r.rank for r in lineage.nearest_first(nodes, e, starts, hosts).collect()}
    assert sorted(got, key=got.get) == rank and sorted(got.values()) == list(range(len(ids)))
    every = {r.turn for r in lineage.nearest_first(nodes, e, nodes).collect()}
    assert every == {1, 2}  # all are starts, so none is
