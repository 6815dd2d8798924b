"""Columns by what they are built from: fingerprints, the sources of values, and the columns of another project that are like one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.operators.columns import is_row
from quillgraph.operators.traverse import Graph, bfs, fixpoint

# Roles that carry a value over as it is, the one that hides it, and the classes' names in their order.
COPIES = ("passthrough", "rename", "cast", "inferred")
CLASSES = ("copy", "computed", "hashed")


def value_class(role: Column) -> Column:
    """0 for a copy, 1 for what is computed, 2 for a hash; null for row roles."""
    r = F.lower(role)
    return F.when(is_row(role), None).when(r.isin(*COPIES), 0).when(r == "hash", 2).otherwise(1)


def fingerprints(edges: DataFrame, columns: DataFrame, sources: DataFrame) -> DataFrame:
    """(seed, id, class, row) of the source columns (id) that each of some columns (id) is built from: by the strongest class of any path
    of value edges (null if none), and whether it only decides rows. A walk along all levels that carries each start's best and walks on
    only from what has become better; cycles end. A path is worth the same either way, so it starts from the columns or from the sources,
    whichever are fewer: no more rows are held than nodes for each of those. Values start in sources that no value edge enters, or that are set where they are
    (roots) or outside of the project (sources: id, and own, true for those two); rows in sources that no edge enters at all and that carry
    no value of that column."""
    scratch = Scratch(edges.sparkSession)
    rows = edges.where("src <> dst").select(F.col("src"), F.col("dst"), value_class(F.col("role")).alias("c"))
    hops = scratch.save(rows.groupBy("src", "dst").agg(F.max("c").alias("c"), F.max(F.col("c").isNull()).alias("row")))
    asked, own = columns.select("id").distinct(), F.coalesce(F.col("own"), F.lit(False)) if "own" in sources.columns else F.lit(False)
    known = scratch.save(sources.withColumn("own", own).groupBy("id").agg(F.max("own").alias("own")))
    down = known.count() < asked.count()
    near, far = ("src", "dst") if down else ("dst", "src")
    leaving = scratch.save(hops.select(F.col(near).alias("id")).distinct())
    start = (known if down else asked).select(F.col("id").alias("seed"), "id", F.lit(0).alias("class"), F.lit(False).alias("row"))

    def step(changed: DataFrame) -> DataFrame:
        # written, so that few rows are broadcast and none shuffle the edges
        now = scratch.save(changed.join(leaving, "id", "left_semi").select("seed", F.col("id").alias(near), F.col("class").alias("held"), F.col("row").alias("was")))
        met = hops.join(now, near)
        through = F.when(F.col("held").isNotNull() & F.col("c").isNotNull(), F.greatest("held", "c"))
        return met.select("seed", F.col(far).alias("id"), through.alias("class"), (F.col("row") | (F.col("was") & F.col("c").isNotNull())).alias("row"))

    reach = fixpoint(start, step, ["seed", "id"], {"class": F.max("class"), "row": F.max("row")})
    if down:
        reach = reach.join(asked, "id", "left_semi").select(F.col("id").alias("seed"), F.col("seed").alias("id"), "class", "row")
    entered = hops.groupBy(F.col("dst").alias("id")).agg(F.max(F.col("c").isNotNull()).alias("valued"), F.lit(True).alias("entered"))
    ends = reach.join(known, "id").join(entered, "id", "left").na.fill(False, ["valued", "entered"])
    value = F.col("class").isNotNull() & (~F.col("valued") | F.col("own"))
    rows_only = F.col("row") & ~F.col("entered") & ~value
    named = F.get(F.array(*map(F.lit, CLASSES)), F.col("class"))
    return ends.where(value | rows_only).select("seed", "id", F.when(value, named).alias("class"), rows_only.alias("row"))


def value_sources(edges: DataFrame, columns: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, n, sources) of columns (id): the source columns that value edges lead from, cycles being one."""
    up = Graph.of(edges.where(~is_row(F.col("role")))).flipped()
    ends = bfs(up, columns.select(F.col("id").alias("seed"), "id")).join(sources.select("id").distinct(), "id", "left_semi")
    return ends.groupBy("seed").agg(F.count_distinct("id").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("sources")).withColumnRenamed("seed", "id")  # of one column


def depth_to(edges: DataFrame, columns: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, depth): the fewest value edges from a column up to one of the shared source columns; 0 if it reaches none."""
    up = Graph.of(edges.where("src <> dst").where(~is_row(F.col("role")))).flipped()
    seeds = columns.select(F.col("id").alias("seed"), "id")
    met = bfs(up, seeds).join(shared.select("id").distinct(), "id", "left_semi").groupBy("seed").agg(F.min("depth").alias("depth"))
    return columns.select("id").distinct().join(met.withColumnRenamed("seed", "id"), "id", "left").na.fill(0, ["depth"])


def candidates(edges: DataFrame, shared: DataFrame, most: int = 20) -> DataFrame:
    """(id, hits, hops) of the columns that the values of shared source columns (id) flow into: how many of them do, and the fewest edges
    from any; the first by hits, hops and id. What is held is a row for each shared source and column below it."""
    down = bfs(Graph.of(edges.where(~is_row(F.col("role")))), shared.select(F.col("id").alias("seed"), "id"), with_seeds=False)
    met = down.groupBy("id").agg(F.count_distinct("seed").alias("hits"), F.min("depth").alias("hops"))
    return met.orderBy(F.desc("hits"), "hops", "id").limit(most)


def same_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seed_a, seed_b, shares, agree) of fingerprints that share sources: how many, and in how many of them the classes agree."""
    x = a.select(F.col("seed").alias("seed_a"), "id", F.col("class").alias("ca"))
    y = b.select(F.col("seed").alias("seed_b"), "id", F.col("class").alias("cb"))
    return x.join(y, "id").groupBy("seed_a", "seed_b").agg(F.count("*").alias("shares"), F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("agree"))


def ranked(overlaps: DataFrame, most: int = 20) -> DataFrame:
    """(owner, shares, total, turn) of overlaps (owner, shares, total), the largest share first, then by owner. Shares are compared as exact
    fractions: in lowest terms, by whole part of a large multiple, then by what is left."""
    scale = F.lit(1 << 30)
    whole, rest = F.floor(F.col("shares") * scale / F.col("total")), (F.col("shares") * scale) % F.col("total")
    rows = overlaps.where("total > 0").withColumns({"q": whole, "r": rest / F.col("total")}).orderBy(F.desc("q"), F.desc("r"), "owner").limit(most)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("q"), F.desc("r"), "owner")  # most rows
    return rows.withColumn("turn", F.row_number().over(order)).select("owner", "shares", "total", "turn")
