"""Graph traversals over edges (src, dst): level by level joins, each level written once and read by the next.

A level's frontier is joined to the edges, made distinct and stripped of what was seen before, so an edge is followed once from each
seed and cycles end. Depth is the shortest distance. A Graph's edges are made distinct and written once, dealt into buckets by their source, so
no level shuffles them: small frontiers are broadcast, large ones are shuffled to the buckets. Buckets grow in number with the edges, so a
task's part of them doesn't. Nothing is collected but a level's number of rows, which its own write counts. Null ends never join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch


#: Edges of a bucket, about.
BUCKET = 1 << 19


@dataclass(frozen=True)
class Graph:
    """Distinct edges (src, dst) without null ends, written once in buckets of their src."""

    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame | Graph, most: int | None = None) -> Graph:
        if isinstance(edges, Graph):
            return edges
        return Graph(prepared(edges.select("src", "dst"), most))

    def flipped(self) -> Graph:
        """The edges with their ends exchanged, read where they are: for walks whose frontiers are small."""
        return Graph(backwards(self.edges))


def prepared(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (src, dst, …) without null ends, each once, written in buckets of their src; most: rows that they are at most, where that is known."""
    spark = edges.sparkSession
    rows = edges.where("src is not null and dst is not null")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.count() if most is None else most) // BUCKET))
    # dealt before they are made distinct, so that neither step holds more than a bucket
    return Scratch(spark).save_dealt(rows.repartition(parts, "src").distinct(), parts, "src")


def backwards(edges: DataFrame | Graph) -> DataFrame | Graph:
    """edges with their ends exchanged; other columns as they are."""
    if isinstance(edges, Graph):
        return edges.flipped()
    return edges.withColumnRenamed("src", "__s").withColumnRenamed("dst", "src").withColumnRenamed("__s", "dst").select(*edges.columns)


def bfs(edges: DataFrame | Graph, seeds: DataFrame, max_depth: int | None = None, with_seeds: bool = True, through: DataFrame | None = None) -> DataFrame:
    """(…keys, id, depth) of all that is reached from seeds (…keys, id), keys naming the seed where many are walked at once.

    With seeds, they stand at depth 0 and aren't reached again. Without, a seed is reached only along a cycle, as any other node. Only nodes in
    through (id) are walked past, if it is given.
    """
    hops = Graph.of(edges).edges
    scratch = Scratch(seeds.sparkSession)
    keys = [c for c in seeds.columns if c != "id"]
    first = seeds.select(*keys, "id").where("id is not null").distinct().withColumn("depth", F.lit(0))
    path, n = scratch.save_counted(first)
    frontier = scratch.read(path, schema=first.schema)
    levels, depth = [path] if with_seeds else [], 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        if through is not None:
            frontier = scratch.save(frontier.join(through.select("id"), "id"))  # the smaller side is broadcast, whichever it is; written, so that its size is known
        reached = frontier.join(hops, frontier["id"] == hops["src"]).select(*keys, F.col("dst").alias("id")).distinct()
        if levels:
            reached = reached.join(scratch.read(*levels, schema=first.schema).select(*keys, "id"), [*keys, "id"], "left_anti")
        reached = reached.select(*keys, "id", F.lit(depth).alias("depth"))
        path, n = scratch.save_counted(reached)
        frontier = scratch.read(path, schema=first.schema)
        if n:
            levels.append(path)
    return scratch.read(*levels, schema=first.schema) if levels else first.limit(0)


def descendants(edges: DataFrame | Graph, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    return bfs(edges, seeds, depth, with_seeds=False).select(*[c for c in seeds.columns if c != "id"], "id").distinct()


def ancestors(edges: DataFrame | Graph, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    return descendants(backwards(edges), seeds, depth)


def seen_through(edges: DataFrame | Graph, nodes: DataFrame) -> DataFrame:
    """(id, end, steps) of built nodes: the nearest built nodes above, seen through those that pass, and over how many edges; the same two may come
    over several. nodes: (id, built, passes); what does neither hides what is above it. A node that passes is walked from once, whatever is
    built below it."""
    scratch = Scratch(nodes.sparkSession)
    kinds = nodes.select("id", F.when(F.col("built"), "built").when(F.col("passes"), "passes").alias("kind")).where("kind is not null")
    end = lambda name: kinds.select(F.col("id").alias(name), F.col("kind").alias(f"{name}_kind"))
    hops = scratch.save(Graph.of(edges).edges.join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", "src_kind", "dst_kind"))
    between = lambda above, below: hops.where((F.col("src_kind") == above) & (F.col("dst_kind") == below))
    direct = between("built", "built").select(F.col("dst").alias("id"), F.col("src").alias("end"), F.lit(1).alias("steps"))
    near = between("built", "passes").select(F.col("dst").alias("id"), F.col("src").alias("end"))
    chain = between("passes", "passes").select("src", "dst")
    chained = bfs(Graph(backwards(chain)), chain.select(F.col("dst").alias("seed"), F.col("dst").alias("id")), with_seeds=False)
    above = near.select(F.col("id").alias("seed"), "end", F.lit(1).alias("steps")).unionByName(chained.join(near, "id").select("seed", "end", (F.col("depth") + 1).alias("steps")))
    below = between("passes", "built").join(above, F.col("src") == F.col("seed"))
    return direct.unionByName(below.select(F.col("dst").alias("id"), "end", (F.col("steps") + 1).alias("steps")))


def fixpoint(start: DataFrame, step, key: list[str], best: dict[str, Column], most: int = 10_000) -> DataFrame:
    """The least fixpoint of state = best(state, step(changed rows)): rows (…key, …values), best naming the aggregate of each value.

    Only rows that a round improved are stepped in the next (semi-naive), so a monotone step over a finite order ends. A round is one job and
    writes what it improved; the state is the best of all that was written, put together again every few rounds."""
    scratch = Scratch(start.sparkSession)
    values = list(best)
    put = lambda df: df.groupBy(*key).agg(*[best[v].alias(v) for v in values])
    first = put(start)
    path, n = scratch.save_counted(first)
    written, schema = [path], first.schema
    for _ in range(most):
        if not n:
            return put(scratch.read(*written, schema=schema))
        changed = scratch.read(path, schema=schema)
        if len(written) > 8:
            written = [scratch.save_counted(put(scratch.read(*written, schema=schema)))[0]]
        proposed = put(step(changed).select(*key, *values))
        asked = [F.col(k).alias(f"__{k}") for k in key]
        held = scratch.read(*written, schema=schema)
        same = reduce(Column.__and__, (held[k].eqNullSafe(F.col(f"__{k}")) for k in key))
        touched = put(held.join(proposed.select(*asked), same, "left_semi"))
        merged = put(touched.unionByName(proposed))
        alike = [merged[k].eqNullSafe(touched[k]) for k in key] + [merged[v].eqNullSafe(touched[v]) for v in values]
        path, n = scratch.save_counted(merged.join(touched, alike, "left_anti"))
        written.append(path)
    raise RuntimeError("no fixpoint: the step isn't monotone")


def numbered(rows: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """rows with their place (rank) in an order of columns, from first on, without a task that sorts them all: they are dealt into ranges and
    sorted there, written once, and each range begins where those before it end."""
    scratch = Scratch(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.save(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    place = placed.withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = place.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.lit(first) + F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return place.join(F.broadcast(starts), "__range").withColumn("rank", rank).drop("__at", "__range", "__start")


def walk_with_cuts(edges: DataFrame, seeds: DataFrame, cut: Column, max_depth: int) -> DataFrame:
    """(id, depth, stop) of a walk along edges (src, dst, …): behind an edge for which cut holds, a node is drawn as a stop and isn't
    walked past. If an edge without cut reaches it within max_depth later on, it is walked past and keeps its smaller depth."""
    scratch = Scratch(edges.sparkSession)
    hops = scratch.save(edges.select("src", "dst", cut.alias("cut")).groupBy("src", "dst").agg(F.min("cut").alias("cut")))
    open_ = seeds.select("id", F.lit(0).alias("depth")).distinct()
    stops = open_.limit(0)
    frontier = scratch.save(open_)
    open_ = frontier
    for depth in range(1, max_depth + 1):
        hit = frontier.join(hops, frontier["id"] == hops["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("cut").alias("cut"))
        hit = scratch.save(hit.join(open_.select("id"), "id", "left_anti"))
        fresh = hit.where("not cut").select("id")
        frontier = scratch.save(fresh.join(stops, "id", "left").select("id", F.coalesce("depth", F.lit(depth)).alias("depth")))
        stopped = hit.where("cut").select("id").join(stops.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        stops = scratch.save(stops.unionByName(stopped).join(frontier.select("id"), "id", "left_anti"))
        open_ = scratch.save(open_.unionByName(frontier))
        if frontier.isEmpty():
            break
    return open_.withColumn("stop", F.lit(False)).unionByName(stops.withColumn("stop", F.lit(True)))


def longest_paths(nodes: DataFrame, edges: DataFrame | Graph) -> DataFrame:
    """(id, depth): the longest path to a node from one without parents, along edges both of whose ends are in nodes (id). Nodes on a cycle
    or behind one stay at 0. Edges whose source is placed are left out of the next round."""
    scratch = Scratch(nodes.sparkSession)
    ids = scratch.save(nodes.select("id").where("id is not null").distinct())
    rows = edges.edges if isinstance(edges, Graph) else edges.select("src", "dst").distinct()
    hops = rows.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    hops, shape = scratch.save(hops.select("src", "dst")), ids.withColumn("depth", F.lit(0)).schema
    done: list[str] = []
    while True:
        left = ids.join(scratch.read(*done, schema=shape).select("id"), "id", "left_anti") if done else ids
        ready = left.join(hops.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("depth", F.lit(len(done)))
        path, now = scratch.save_counted(ready)
        if not now:
            rest = left.withColumn("depth", F.lit(0))
            return scratch.read(*done, schema=shape).unionByName(rest) if done else rest
        done.append(path)
        hops = scratch.save(hops.join(scratch.read(path, schema=shape).select(F.col("id").alias("src")), "src", "left_anti"))
