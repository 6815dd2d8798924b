"""Macros: who calls them, how nodes reach them, and why one that no node reaches may still run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.operators.traverse import Graph, bfs

HOW = ("listed", "through", "written")


@dataclass(frozen=True)
class MacroGraph:
    """users: (macro, node) of what nodes list. written: (macro, node) of calls in a node's text that it doesn't list. calls: (src, dst)
    of macros that call others, not themselves. reached: (macro) that some node reaches."""

    users: DataFrame
    written: DataFrame
    calls: Graph
    reached: DataFrame


def build(macros: DataFrame, listed: DataFrame, written: DataFrame, calls: DataFrame) -> MacroGraph:
    """Of macros (id), listed and written (node, macro), and calls (caller, callee); ids of no macro are passed over."""
    scratch = Scratch(macros.sparkSession)
    ids = macros.select(F.col("id").alias("macro")).distinct()
    known = lambda df, c: df.join(ids.withColumnRenamed("macro", c), c, "left_semi")
    users = scratch.save(known(listed, "macro").select("macro", "node").distinct())
    found = scratch.save(known(written, "macro").select("macro", "node").distinct().join(users, ["macro", "node"], "left_anti"))
    links = Graph.of(known(known(calls, "caller"), "callee").where("caller <> callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    seeds = users.select(F.col("macro").alias("id")).unionByName(found.select(F.col("macro").alias("id")))
    return MacroGraph(users, found, links, bfs(links, seeds).select(F.col("id").alias("macro")).distinct())


def walk(graph: MacroGraph, macros: DataFrame) -> DataFrame:
    """(macro, node, how, depth) of every node that reaches each of some macros (macro), once: by listing it, through the nearest macro that
    calls it, or, only where neither is recorded, as it is written."""
    above = bfs(graph.calls.flipped(), macros.select("macro", F.col("macro").alias("id")).distinct()).select("macro", F.col("id").alias("caller"), "depth")
    by = lambda df: above.join(df.select(F.col("macro").alias("caller"), "node"), "caller")
    rows = by(graph.users).withColumn("how", F.when(F.col("depth") == 0, 0).otherwise(1)).unionByName(by(graph.written).withColumn("how", F.lit(2)))
    best = rows.groupBy("macro", "node").agg(F.min(F.struct("how", "depth")).alias("x"))
    words = F.array(*map(F.lit, HOW))
    return best.select("macro", "node", F.get(words, F.col("x.how")).alias("how"), "x.depth")


def tally(usage: DataFrame, nodes: DataFrame) -> DataFrame:
    """(macro, kind, n, through, written) of a walk: the nodes (id, kind) by kind, and how many come only through others or as written."""
    rows = usage.join(nodes.select(F.col("id").alias("node"), "kind"), "node")
    return rows.groupBy("macro", "kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("how") == "through", 1)).alias("through"), F.count(F.when(F.col("how") == "written", 1)).alias("written"))


def why(macros: DataFrame, graph: MacroGraph, run_by_tool: Column, winning: DataFrame | None = None) -> DataFrame:
    """(id, why) of macros (id, name) that no node reaches: run by the tool itself or by what it runs (tool), run as the macro by which a
    materialization is built (run; winning: materialization, id), another materialization's or a variant's (dispatch), called by macros
    (macros), a test's (test), or none."""
    roots = macros.where(run_by_tool).select("id")
    by_tool = bfs(graph.calls, roots).select("id").distinct().withColumn("tool", F.lit(True))
    called = graph.calls.edges.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    bases = macros.select(F.col("name").alias("base")).distinct().withColumn("variant", F.lit(True))
    rows = macros.join(graph.reached.withColumnRenamed("macro", "id"), "id", "left_anti").join(by_tool, "id", "left").join(called, "id", "left")
    rows = rows.withColumn("base", F.regexp_extract("name", "__(.+)$", 1)).join(bases, "base", "left")
    first = macros.select("id").limit(0) if winning is None else winning.select("id").distinct()
    rows = rows.join(first.withColumn("wins", F.lit(True)), "id", "left")
    reason = (
        F.when(F.col("tool"), "tool").when(F.col("wins"), "run").when(F.col("name").startswith("materialization_"), "dispatch").when(F.col("called"), "macros").when(F.col("name").startswith("test_"), "test").when(F.col("variant"), "dispatch").otherwise("none")
    )
    return rows.select("id", reason.alias("why"))


def report(reasons: DataFrame, macros: DataFrame, root: str) -> DataFrame:
    """(why, call, id) of the root's macros that no node reaches, in order of reason and name."""
    own = macros.where(F.col("package") == root).select("id", F.concat_ws(".", "package", "name").alias("call"))
    return reasons.join(own, "id").select("why", "call", "id").orderBy("why", "call")


def search(macros: DataFrame, query: str, root: str, limit: int = 200) -> DataFrame:
    """(id, step) of macros (id, package, name) by how their names hold the query, the root's first, then by shortness, name and package. A query
    with a dot is looked for in package.name."""
    q = query.strip().lower()
    name = F.lower(F.concat_ws(".", "package", "name") if "." in q else F.col("name"))
    step = F.when(name == q, 0).when(name.startswith(q), 1).when(F.contains(name, F.lit(q)), 2)
    found = macros.withColumn("step", step.cast("long")).where("step is not null")
    return found.orderBy("step", F.col("package") != root, F.octet_length("name"), "name", "package", "id").limit(limit).select("id", "step")


def winners(macros: DataFrame, adapter: str, parents: dict[str, str], root: str, internal: list[str]) -> DataFrame:
    """(materialization, id): the macros that a materialization runs by: the nearest to the adapter, then the root's, a package's, the tool's
    own; ties all win. Where the tool has one of its own, a package's gives way."""
    near = {adapter: 2, parents.get(adapter, ""): 1, "default": 0}
    parts = macros.withColumn("m", F.regexp_extract("name", "^materialization_(.+)_([a-z]+)$", 1)).withColumn("on", F.regexp_extract("name", "^materialization_(.+)_([a-z]+)$", 2))
    score = F.lit(None).cast("int")
    for k, v in near.items():
        score = F.when(F.col("on") == k, v).otherwise(score)
    local = F.when(F.col("package") == root, 2).when(F.col("package").isin(*internal), 0).otherwise(1)
    rows = parts.where("m <> ''").select("m", "id", score.alias("near"), local.alias("local")).where("near is not null")
    own = Window.partitionBy("m")
    top = F.max(F.struct("near", "local")).over(own)
    rows = rows.withColumn("top", top).withColumn("builtin", F.max(F.col("local") == 0).over(own))
    rows = rows.where(~((F.col("top.local") == 1) & F.col("builtin") & (F.col("local") == 1)))
    return rows.withColumn("best", F.max(F.struct("near", "local")).over(own)).where(F.struct("near", "local") == F.col("best")).select(F.col("m").alias("materialization"), "id")


def card(macros: DataFrame, usage: DataFrame, reasons: DataFrame, calls: Graph, named: int = 5) -> DataFrame:
    """(id, users, callers, callers_of, why) of each macro (id, name): how many nodes reach it, the first macros that call it and how many
    do, and else why it may run."""
    n = usage.groupBy(F.col("macro").alias("id")).agg(F.count("*").alias("users"))
    by = calls.edges.join(macros.select(F.col("id").alias("src"), "name"), "src").select(F.col("dst").alias("id"), "name")
    callers = by.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("name"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= named, F.col("name")))), ",").alias("callers"), F.count("*").alias("callers_of"))  # named at most
    out = macros.select("id").join(n, "id", "left").join(callers, "id", "left").join(reasons, "id", "left")
    return out.select("id", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callers_of", F.lit(0)).alias("callers_of"), "why")


def node_reads(graph: MacroGraph, reads: DataFrame) -> DataFrame:
    """(node, read) of what nodes read of their surroundings through the macros they list, and those below. reads: (macro, read). What is read
    is carried up to all macros that come to it, so nodes, which are many, are joined once and never walk."""
    seeds = reads.where("macro is not null").select(F.struct("read").alias("what"), F.col("macro").alias("id")).distinct()  # a struct is alike with null in it
    above = bfs(graph.calls.flipped(), seeds).select("what.read", F.col("id").alias("macro"))
    return graph.users.join(above, "macro").select("node", "read").distinct()
