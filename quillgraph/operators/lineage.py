"""Node lineage: signed distances, drawn edges, hidden counts, levels, reach, degree, layering and clone plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.operators.traverse import Graph, ancestors, backwards, bfs, descendants, fixpoint, longest_paths, numbered, seen_through


def lineage(edges: DataFrame | Graph, focus: DataFrame, up: int | None, down: int | None, cap: int | None = None) -> DataFrame:
    """(id, distance): up the parents, then down the children of focus (id); distances upward are below 0. A node that is reached
    upward isn't met again downward. With a cap, the nearest nodes stay, upward ones first, by id within a level."""
    graph = Graph.of(edges)
    above = bfs(graph.flipped(), focus, up).select("id", (-F.col("depth")).alias("distance"))
    below = bfs(graph, focus, down).where("depth > 0").select("id", F.col("depth").alias("distance")).join(above.select("id"), "id", "left_anti")
    both = above.unionByName(below)
    if cap is None:
        return both
    return both.orderBy(F.col("distance") > 0, F.abs("distance"), "id").limit(cap)


def drawn_edges(edges: DataFrame | Graph, nodes: DataFrame) -> DataFrame:
    """(src, dst) of edges both of whose ends are in nodes (id), each once."""
    ids = nodes.select("id").distinct()
    inner = _rows(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return inner.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def _rows(edges: DataFrame | Graph) -> DataFrame:
    return (edges.edges if isinstance(edges, Graph) else edges).select("src", "dst")


def hidden(edges: DataFrame | Graph, nodes: DataFrame) -> DataFrame:
    """(id, hidden_up, hidden_down): parents and children of nodes (id) that aren't among them."""
    e, ids = _rows(edges), Scratch(nodes.sparkSession).save(nodes.select("id").distinct())
    e = e if isinstance(edges, Graph) else e.distinct()
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    # only edges of the nodes are kept before anything is counted
    away_up = e.join(dst, "dst", "left_semi").join(src, "src", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("hidden_up"))
    away_down = e.join(src, "src", "left_semi").join(dst, "dst", "left_anti").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("hidden_down"))
    return ids.join(away_up, "id", "left").join(away_down, "id", "left").na.fill(0)


def levels(nodes: DataFrame, walk: DataFrame) -> DataFrame:
    """(depth, label, n, name) of a walk (id, depth) over nodes (id, label, name): the only node of a level is named."""
    tally = walk.where("depth > 0").join(nodes.select("id", "label", "name"), "id")
    return tally.groupBy("depth", "label").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("name")).alias("name"))


def reach_counts(edges: DataFrame | Graph, seeds: DataFrame) -> DataFrame:
    """(seed, n): how many nodes each of seeds (seed, id) reaches, all walked at once; a seed counts only along a cycle.

    What is held is a row for each seed and node that it reaches, so seeds are to be some: a project's page, not all its nodes."""
    n = descendants(edges, seeds).groupBy("seed").agg(F.count("*").alias("n"))
    return seeds.select("seed").distinct().join(n, "seed", "left").na.fill(0, ["n"])


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_in, n_out) without self-edges; an edge counts once."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(sums, "id", "left").na.fill(0)


def layering(nodes: DataFrame, edges: DataFrame | Graph) -> DataFrame:
    """(id, depth) of nodes in the graph that edges induce on them, by longest path."""
    return longest_paths(nodes, edges)


def clone_plan(edges: DataFrame | Graph, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """(id): what has to exist before focus (id) can be built alone: its parents, those that aren't built replaced by theirs.
    nodes: (id, passes) where passes marks those that are expanded in place."""
    up = Graph.of(edges).flipped()
    met = bfs(up, descendants(up, focus.select("id"), 1), through=nodes.where("passes"))
    return nodes.where("not passes").select("id").join(met.select("id"), "id", "left_semi").distinct()


def unbuilt_upstream(edges: DataFrame | Graph, nodes: DataFrame) -> DataFrame:
    """(id, parent) for every node that is built: the nearest built nodes above it, seen through those that aren't."""
    rows = seen_through(edges, nodes.select("id", (~F.col("passes")).alias("built"), "passes"))
    return rows.select("id", F.col("end").alias("parent")).distinct()


def round_robin(tests: DataFrame, cap: int) -> DataFrame:
    """(node, test, turn): the first test of every node, in order of name, before the second of any; cap rows at most."""
    turn = F.row_number().over(Window.partitionBy("node").orderBy("name", "test"))
    return tests.withColumn("turn", turn).orderBy("turn", "node", "test").limit(cap).select("node", "test", "turn")


def _queued(both: DataFrame, names: DataFrame, ranked: list[DataFrame], seeds: DataFrame, first: int, turn: int) -> int:
    """Adds to ranked (id, rank, turn, depth) the seeds, by name and id, and level by level what is near them: by the rank of the first that
    met it, then by name and id. Returns the next rank."""
    scratch, depth = Scratch(both.sparkSession), 0
    level = seeds.select("id").distinct().join(names, "id").withColumn("by", F.lit(0).cast("long"))
    while True:
        rows = numbered(level, ["by", "name", "id"], first).select("id", "rank", F.lit(turn).alias("turn"), F.lit(depth).alias("depth"))
        path, n = scratch.save_counted(rows)
        if not n:
            return first
        here = scratch.read(path, schema=rows.schema)
        ranked.append(here)
        first, depth = first + n, depth + 1
        met = both.join(here.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("rank").alias("by"))
        level = met.join(reduce(DataFrame.unionByName, ranked).select("id"), "id", "left_anti").join(names, "id")


def nearest_first(nodes: DataFrame, edges: DataFrame | Graph, starts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """(id, rank, turn, depth): the order in which a page takes nodes (id, name): breadth first along edges of either direction from the starts
    (turn 0), each node's neighbours by name and id; then the parts that no start reaches, from all their roots together (turn 1); then what
    hangs on cycles alone, part by part, each from its first node (turn 2).

    A start that is no node, such as a test, stands for its hosts (test, id). If all nodes are starts, none is. A level's ranks come from a sort by
    ranges, so no task holds a level."""
    names = nodes.select("id", "name").distinct()
    scratch = Scratch(nodes.sparkSession)
    names = scratch.save(names)
    links = drawn_edges(edges, names).where("src <> dst")
    both = scratch.save(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    asked = starts.select("id").distinct()
    seeds = asked.join(names, "id", "left_semi")
    if hosts is not None:
        outside = asked.join(names, "id", "left_anti").withColumnRenamed("id", "test")
        seeds = seeds.unionByName(hosts.select("test", "id").join(outside, "test", "left_semi").select("id").join(names, "id", "left_semi")).distinct()
    path, n = scratch.save_counted(seeds)
    seeds = scratch.read(path, schema=seeds.schema)
    ranked: list[DataFrame] = []
    at = _queued(both, names, ranked, seeds, 0, 0) if n != names.count() else 0
    left = lambda: names.join(reduce(DataFrame.unionByName, ranked).select("id"), "id", "left_anti") if ranked else names
    roots = left().join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    at = _queued(both, names, ranked, roots, at, 1)
    rest = scratch.save(left())
    if not rest.isEmpty():
        # parts without a root: each is known by its first node, from which it is walked, and keeps its ranks together
        inner = both.join(rest.select(F.col("id").alias("src")), "src", "left_semi")
        step = lambda changed: inner.join(changed.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "head")
        heads = fixpoint(rest.select("id", F.struct("name", "id").alias("head")), step, ["id"], {"head": F.min("head")})
        own: list[DataFrame] = []
        _queued(inner, names, own, heads.where("head.id = id").select("id"), 0, 2)
        rows = reduce(DataFrame.unionByName, own).join(heads, "id").select("id", F.col("rank").alias("within"), "turn", "depth", F.col("head.name").alias("h1"), F.col("head.id").alias("h2"))
        ranked.append(numbered(rows, ["h1", "h2", "within"], at).select("id", "rank", "turn", "depth"))
    return reduce(DataFrame.unionByName, ranked) if ranked else names.select("id", F.lit(0).cast("long").alias("rank"), F.lit(0).alias("turn"), F.lit(0).alias("depth")).limit(0)


def upstream_relations(edges: DataFrame, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """(id, relation) of what a compiled text reads: the parents of focus (id), those that pass (nodes: id, passes, relation) replaced by
    theirs; blank relations are left out."""
    above = clone_plan(edges, nodes, focus)
    return above.join(nodes.select("id", "relation"), "id").where("trim(coalesce(relation, '')) <> ''").distinct()


def clone_answer(edges: DataFrame, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """(id, name, kind, how) of a clone plan over nodes (id, name, kind, passes): what is cloned, and sources, which are only read."""
    rows = clone_plan(edges, nodes, focus).join(nodes.select("id", "name", "kind"), "id")
    return rows.select("id", "name", "kind", F.when(F.col("kind") == "source", "read").otherwise("clone").alias("how"))


__all__ = ["ancestors", "clone_answer", "clone_plan", "degree", "drawn_edges", "hidden", "layering", "levels", "lineage", "nearest_first", "reach_counts", "round_robin", "unbuilt_upstream", "upstream_relations"]
