"""Strongly connected components, and how many nodes every node reaches, both distributed.

Components are found by colours: each node takes the greatest id that reaches it, so nodes of one component share a colour, and edges between
colours leave. Backwards from the nodes whose colour is their own id, within the colour, lie exactly their components, which leave too; the
rest is coloured again. Nodes without an edge in or out are trimmed first, a few rounds at a time, for they are alone.

Reach is counted on the graph of components, which has no cycles, level by level, by longest path. A component carries the starts that
reach it as words of 64 bits, small subtrees of starts in a word, so it never has more rows than pairs of start and component and
up to 64 times fewer. A level's words are finished when it is taken; they are joined once to the edges that leave it, and wait in the folder of
the level that they go to. So each edge is crossed once for a block of starts, whatever the levels between its ends. A start whose edges all go to ends is
not carried to be counted: it reaches what it has edges to. Components are looked for only if there are cycles. Blocks bound what is
held at a time: no more than starts / 64 rows for each component.

Null ends are no edges, repeated edges count once, and a node with an edge to itself is on a cycle of its own. Rounds are as many as the
longest path, so both are for graphs that are wide rather than deep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.operators.traverse import Graph, bfs, fixpoint, longest_paths

#: Starts of a word, and levels of a tree of two children each that fit into one.
BITS, BAND = 64, 6
#: Tasks among which the rows of a word are dealt.
SHARES = 16


def _trimmed(live: DataFrame, n: int, scratch: Scratch, rounds: int) -> tuple[DataFrame, int]:
    """Edges whose source is entered and whose end is left by others, after some rounds."""
    for _ in range(rounds):
        kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        path, m = scratch.save_counted(kept.select("src", "dst"))
        live = scratch.read(path, schema=live.schema)
        if m in (0, n):
            return live, m
        n = m
    return live, n


def strong_components(edges: DataFrame | Graph, trims: int = 4) -> DataFrame:
    """(id, component) of all ends of edges (src, dst): the smallest id of those that a node reaches and that reach it."""
    graph = Graph.of(edges).edges
    scratch = Scratch(graph.sparkSession)
    ends = graph.select(F.col("src").alias("id")).union(graph.select("dst")).distinct()
    path, n = scratch.save_counted(graph.where("src <> dst").select("src", "dst"))
    live, found = scratch.read(path, schema=graph.select("src", "dst").schema), []
    while n:
        live, n = _trimmed(live, n, scratch, trims)
        if not n:
            break
        nodes = live.select(F.col("src").alias("id")).union(live.select("dst")).distinct()
        hops = live
        step = lambda changed: hops.join(changed, hops["src"] == changed["id"]).select(F.col("dst").alias("id"), "colour")  # noqa: B023, E731
        colours = fixpoint(nodes.withColumn("colour", F.col("id")), step, ["id"], {"colour": F.max("colour")})
        named = lambda end: colours.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        within = live.join(named("src"), "src").join(named("dst"), "dst").where("src_colour = dst_colour").select("src", "dst")
        within = scratch.save(within)
        whole = bfs(Graph(within).flipped(), colours.where("id = colour").select("id")).select("id")
        path, _ = scratch.save_counted(colours.join(whole, "id", "left_semi"))
        done = scratch.read(path, schema=colours.schema)
        found.append(path)
        rest = within.join(done.select(F.col("id").alias("src")), "src", "left_anti").join(done.select(F.col("id").alias("dst")), "dst", "left_anti")
        path, n = scratch.save_counted(rest.select("src", "dst"))
        live = scratch.read(path, schema=live.schema)
    if not found:
        return ends.select("id", F.col("id").alias("component"))
    parts = scratch.read(*found, schema=colours.schema)
    first = parts.groupBy("colour").agg(F.min("id").alias("component"))
    return scratch.save(ends.join(parts.join(first, "colour").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def cycles(edges: DataFrame | Graph) -> DataFrame:
    """(id, component) of the nodes that reach themselves."""
    graph = Graph.of(edges)
    parts = strong_components(graph)
    large = parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    own = graph.edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    return parts.join(large, "component", "left_semi").select("id", "component").unionByName(parts.join(own, "id", "left_semi").select("id", "component")).distinct()


def condensed(edges: DataFrame | Graph, parts: DataFrame) -> DataFrame:
    """(src, dst) between the components of the ends of edges, each once."""
    named = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part"))
    rows = Graph.of(edges).edges.join(named("src"), "src").join(named("dst"), "dst").where("src_part <> dst_part")
    return rows.select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct()


def _roots(onward: DataFrame, some: DataFrame, scratch: Scratch) -> DataFrame:
    """some (part, level) with a band and the root of the subtree of one parent each within BAND levels that they lie in. If that has more than a word's parts,
    each is its own root, and the band is of its level alone."""
    up = onward.where(f"from_level = level - 1 and level % {BAND} <> 0").groupBy(F.col("dst").alias("part")).agg(F.min("src").alias("root"))
    rows = scratch.save(some.join(up, "part", "left").select("part", "level", F.coalesce("root", "part").alias("root")))
    for _ in range((BAND - 1).bit_length() - 1):
        above = rows.select(F.col("part").alias("root"), F.col("root").alias("higher"))
        rows = scratch.save(rows.join(above, "root", "left").select("part", "level", F.coalesce("higher", "root").alias("root")))
    large = rows.groupBy("root").agg(F.count("*").alias("n")).where(f"n > {BITS}").select("root", F.lit(True).alias("large"))
    band = F.when(F.col("large"), 2 * F.col("level") + 1).otherwise(F.expr(f"2 * (level div {BAND})"))
    return rows.join(large, "root", "left").select("part", "level", band.alias("band"), F.when(F.col("large"), F.col("part")).otherwise(F.col("root")).alias("root"))


def _starts(some: DataFrame, onward: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, level, mix, word, bit) of components (part, level) that edges leave: small subtrees are dealt among the words of their band of levels by a hash, a
    few dozen parts each. So what is above a part in its own tree lies in a word for a band or two, not in one for each level. A word's number is
    its smallest part's place where they were written."""
    rows = scratch.save(_roots(onward, some, scratch))
    many = rows.groupBy("band").agg(F.ceil(F.count("*") / (BITS / 2)).cast("long").alias("words"))
    dealt = rows.join(many, "band").select("part", "level", "root", "band", F.pmod(F.xxhash64("root"), "words").alias("deal"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("band", "deal").orderBy("root", "level", "part")) - 1  # a few dozen of a word
    placed = scratch.save(dealt).withColumn("place", place).withColumn("more", F.expr(f"place div {BITS}"))
    word = F.min("at").over(Window.partitionBy("band", "deal", "more"))
    return placed.select("part", "level", F.xxhash64("band", "deal").alias("mix"), word.alias("word"), F.pmod("place", F.lit(BITS)).cast("int").alias("bit"))


def _peeled(graph: Graph, scratch: Scratch) -> DataFrame | None:
    """(part, level) of all ends by longest path, or None if there are cycles other than of a node with itself. A node counts the edges that still enter
    it, and an edge is met once, where it lies, in the round in which its source is placed."""
    hops = graph.edges.where("src <> dst")
    entered = hops.groupBy(F.col("dst").alias("part")).agg(F.count("*").alias("n"))
    path, n = scratch.save_counted(entered)
    left = scratch.read(path, schema=entered.schema)
    top = graph.edges.select(F.col("src").alias("part")).distinct().join(left, "part", "left_anti").select("part", F.lit(0).alias("level"))
    path, placed = scratch.save_counted(top)
    done = [path]
    while n:
        if not placed:
            return None
        now = scratch.read(path, schema=top.schema)
        hit = now.join(hops, now["part"] == hops["src"]).groupBy(F.col("dst").alias("part")).agg(F.count("*").alias("hit"))
        rest = scratch.save(left.join(hit, "part", "left").select("part", (F.col("n") - F.coalesce("hit", F.lit(0))).alias("n")))
        path, placed = scratch.save_counted(rest.where("n = 0").select("part", F.lit(len(done)).alias("level")))
        done.append(path)
        n -= placed
        left = rest.where("n > 0")
    return scratch.read(*done, schema=top.schema)


@dataclass(frozen=True)
class _Carried:
    """Starts (part, word, bit), and of each component that they reach the words that reach it (part, word, bits). near: (part, met) of those that are not
    carried, for all that they reach are ends: how many nodes they reach, with their own. single: every component is one node."""

    parts: DataFrame
    starts: DataFrame
    words: DataFrame
    sizes: DataFrame
    near: DataFrame
    single: bool


def _carry(graph: Graph, block: int, asked: DataFrame | None = None, with_near: bool = True) -> _Carried:
    """Carries starts along the levels, all of them or those of the nodes asked (id); with_near: also those that reach nothing but ends."""
    spark = graph.edges.sparkSession
    scratch = Scratch(spark)
    levels = _peeled(graph, scratch)
    single = levels is not None
    if single:
        hops = graph.edges.where("src <> dst").select("src", "dst")
        parts, sizes = levels.select(F.col("part").alias("id"), F.col("part").alias("component")), levels.select("part", F.lit(1).cast("long").alias("size"))
    else:
        parts = strong_components(graph)
        hops = scratch.save(condensed(graph, parts))
        sizes = scratch.save(parts.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("size")))
        depth = longest_paths(sizes.select(F.col("part").alias("id")), Graph(hops))
        levels = scratch.save(depth.select(F.col("id").alias("part"), F.col("depth").alias("level")))
    some = levels if asked is None else levels.join(parts.join(asked, "id", "left_semi").select(F.col("component").alias("part")).distinct(), "part", "left_semi")
    leave = hops.select(F.col("src").alias("part")).distinct()
    ends = levels.join(leave.withColumn("leaves", F.lit(True)), "part", "left").select(F.col("part").alias("dst"), "level", "leaves")
    onward = scratch.save(hops.join(levels.select(F.col("part").alias("src"), F.col("level").alias("from_level")), "src").join(ends, "dst").select("src", "dst", "from_level", "level", "leaves"))
    far = onward.where("leaves").select(F.col("src").alias("part")).distinct()
    reach = hops.join(far, F.col("src") == F.col("part"), "left_anti")
    reach = reach.withColumn("size", F.lit(1)) if single else reach.join(sizes.withColumnRenamed("part", "dst"), "dst")
    near = reach.groupBy(F.col("src").alias("part")).agg(F.sum("size").alias("met")).join(sizes, "part").select("part", (F.col("met") + F.col("size")).alias("met"))
    dealt = _starts(some.join(leave if with_near else far, "part", "left_semi"), onward, scratch)
    path, n = scratch.save_counted(dealt)
    starts = scratch.read(path, schema=dealt.schema)
    last = levels.agg(F.max("level")).first()[0]
    blocks = -(-n // block)
    own = starts.select("part", "level", "mix", "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    done, schema = [], own.select("part", "word", "bits").schema
    for b in range(blocks):
        mine, waiting = own.where(F.pmod("mix", F.lit(blocks)) == b), scratch.path()
        for level in range(last + 1):
            here = mine.where(F.col("level") == level).select("part", "word", "bits")
            if scratch.exists(f"{waiting}/level={level}"):
                come = spark.read.schema(schema).parquet(f"{waiting}/level={level}")
                here = here.unionByName(come).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
            path, held = scratch.save_counted(here)
            if not held:
                continue
            done.append(path)
            if level < last:
                here = scratch.read(path, schema=schema)
                sent = here.join(onward.where(F.col("from_level") == level), here["part"] == onward["src"]).select(F.col("dst").alias("part"), "word", "bits", "level")
                sent.groupBy("part", "word", "level").agg(F.bit_or("bits").alias("bits")).write.mode("append").partitionBy("level").parquet(waiting)
    return _Carried(parts, starts, scratch.read(*done, schema=schema) if done else spark.createDataFrame([], schema), sizes, near, single)


def reach_all(edges: DataFrame | Graph, block: int = 1 << 22) -> DataFrame:
    """(id, n) of all ends of edges: how many others each reaches. block: starts that are carried at a time."""
    c = _carry(Graph.of(edges), block, with_near=False)
    words = c.words.withColumn("size", F.lit(1).cast("long")) if c.single else c.words.join(c.sizes, "part")
    # rows go to their sums, which are far wider than they are, some tasks for a word
    words = words.select("word", F.pmod(F.xxhash64("part"), F.lit(SHARES)).alias("share"), "bits", "size")
    words = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word", "share")
    sums = [F.sum(F.when(F.getbit("bits", F.lit(i)) == 1, F.col("size"))).alias(f"b{i}") for i in range(BITS)]
    counts = words.groupBy("word", "share").agg(*sums).groupBy("word").agg(*(F.sum(f"b{i}").alias(f"b{i}") for i in range(BITS)))
    counts = counts.select("word", F.array(*(F.col(f"b{i}") for i in range(BITS))).alias("counts"))
    per = c.starts.join(counts, "word").select("part", F.get("counts", F.col("bit")).alias("met")).unionByName(c.near)
    rows = c.parts.select("id", F.col("component").alias("part")).join(c.sizes, "part").join(per, "part", "left")
    return rows.select("id", (F.coalesce("met", "size") - 1).alias("n"))


def reached(edges: DataFrame | Graph, pairs: DataFrame, block: int = 1 << 22) -> DataFrame:
    """(src, dst) of pairs whose first node reaches the second, over one edge at least; only the first nodes are carried."""
    graph = Graph.of(edges)
    asked = pairs.select("src", "dst").where("src is not null and dst is not null").distinct()
    c = _carry(graph, block, asked.select(F.col("src").alias("id")).distinct())
    named = lambda end: c.parts.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part"))
    rows = asked.join(named("src"), "src").join(named("dst"), "dst")
    apart = rows.where("src_part <> dst_part").join(c.starts.select(F.col("part").alias("src_part"), "word", "bit"), "src_part")
    apart = apart.join(c.words.select(F.col("part").alias("dst_part"), "word", "bits"), ["dst_part", "word"]).where(F.getbit("bits", "bit") == 1)
    # of one component, any node reaches any other; itself, if it has others or an edge to itself
    alone = c.sizes.where("size = 1").select(F.col("part").alias("src_part"))
    own = graph.edges.where("src = dst").select("src", F.lit(True).alias("own")).distinct()
    together = rows.where("src_part = dst_part").join(alone.withColumn("alone", F.lit(True)), "src_part", "left").join(own, "src", "left").where("alone is null or own")
    return apart.select("src", "dst").unionByName(together.select("src", "dst"))


def reached_by_words(edges: DataFrame | Graph, rows: DataFrame, block: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """(id, word, bits) twice, of rows (id, node) whose nodes are on no cycle: the starts that id's nodes are, each word once, and those that reach any of
    them from another node, a word as often as nodes have it. Two ids with a common bit have a node that reaches one of the other's; no pairs of
    nodes are made."""
    graph = Graph.of(edges)
    c = _carry(graph, block, rows.select(F.col("node").alias("id")).distinct())
    placed = rows.join(c.parts.select(F.col("id").alias("node"), F.col("component").alias("part")), "node").select("id", "part")
    mine = c.starts.select("part", "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    others = c.words.join(mine.withColumnRenamed("bits", "mine"), ["part", "word"], "left").select("part", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("mine", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")
    own = placed.join(mine, "part").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    return own, placed.join(Scratch(others.sparkSession).save(others), "part").select("id", "word", "bits")
