"""Joins that bring one artifact into another: catalogs, column caches, objects, config paths, and two versions compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_catalog(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(node, name, type, undeclared) of columns (node, name, type, ord): blank types are filled from the catalog by name in
    either case, the first of a name wins, and what only the catalog has is undeclared."""

    def first(df: DataFrame) -> DataFrame:
        own = Window.partitionBy("node", "name_lc").orderBy("ord")
        return df.withColumn("name_lc", F.lower("name")).withColumn("k", F.row_number().over(own)).where("k = 1").select("node", "name_lc", "name", "type")

    c = first(catalog).select("node", "name_lc", F.col("name").alias("cname"), F.col("type").alias("ctype"))
    both = first(declared).join(c, ["node", "name_lc"], "full_outer")
    return both.select("node", F.coalesce("name", "cname").alias("name"), F.coalesce(F.nullif("type", F.lit("")), "ctype", F.lit("")).alias("type"), F.col("name").isNull().alias("undeclared"))


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, role) of edges (src, dst, role, ord) with both ends among nodes (id); of one pair, the first edge."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.groupBy("src", "dst").agg(F.min_by("role", "ord").alias("role"))


def add_edges(have: DataFrame, new: DataFrame) -> DataFrame:
    """have (src, dst, role) and those of new whose ends, in either case, it lacks."""
    key = lambda df: df.withColumn("k1", F.lower("src")).withColumn("k2", F.lower("dst"))
    fresh = key(new).join(key(have).select("k1", "k2"), ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(F.min(F.struct("src", "dst", "role")).alias("x"))
    return have.select("src", "dst", "role").unionByName(fresh.select("x.src", "x.dst", "x.role"))


def compare_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, change, role_a, role_b) of edges that only b has (gained), only a has (lost), or that changed role."""
    x = a.select("src", "dst", F.col("role").alias("role_a"), F.lit(True).alias("in_a"))
    y = b.select("src", "dst", F.col("role").alias("role_b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "gained").when(F.col("in_b").isNull(), "lost").when(~F.col("role_a").eqNullSafe(F.col("role_b")), "changed")
    return x.join(y, ["src", "dst"], "full_outer").withColumn("change", change).where("change is not null").select("src", "dst", "change", "role_a", "role_b")


def unique_objects(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(object, id) of objects (object) by name in either case among nodes (id, name, enabled): enabled ones go first; if more
    than one is left the id is null."""
    named = nodes.groupBy(F.lower("name").alias("key"), "enabled").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = named.groupBy("key").agg(F.max_by(F.struct("n", "id"), "enabled").alias("x"))
    found = objects.withColumn("key", F.lower("object")).join(best, "key", "left")
    return found.select("object", F.when(F.col("x.n") == 1, F.col("x.id")).alias("id"))


def used_prefixes(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(path, used): whether a configured path (parts) begins some full name (fqn), part by part. The names' prefixes are joined
    by equality, so there is no comparison of all pairs."""
    prefix = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda k: F.array_join(F.slice(c, 1, k), "\x1f"))
    have = names.where(F.size("fqn") > 0).select(F.explode(prefix(F.col("fqn"))).alias("key")).distinct().withColumn("hit", F.lit(True))
    asked = paths.withColumn("key", F.array_join("parts", "\x1f"))
    return asked.join(have, "key", "left").select(F.array_join("parts", "/").alias("path"), F.coalesce("hit", F.lit(False)).alias("used"))


def overlaps(sets: DataFrame, focus: str) -> DataFrame:
    """(owner, shares, total) of sets (owner, item) that share items with the focus: the sizes of intersection and union. Ranks
    by exact fractions, so no division."""
    rows = sets.select("owner", "item").distinct()
    mine = rows.where(F.col("owner") == focus).select("item")
    n = rows.groupBy("owner").agg(F.count("*").alias("size"))
    own = n.where(F.col("owner") == focus).select(F.col("size").alias("own"))
    hits = rows.where(F.col("owner") != focus).join(mine, "item", "left_semi").groupBy("owner").agg(F.count("*").alias("shares"))
    return hits.join(n, "owner").join(F.broadcast(own)).select("owner", "shares", (F.col("size") + F.col("own") - F.col("shares")).alias("total"))


def compare_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    """(clause, sources, side) of rules (rule, clause, source): the same clause over the same set of sources is one rule."""

    def keyed(df: DataFrame) -> DataFrame:
        one = df.groupBy("rule", "clause").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))  # of one rule
        return one.select("clause", "sources").distinct()

    both = keyed(a).withColumn("in_a", F.lit(True)).join(keyed(b).withColumn("in_b", F.lit(True)), ["clause", "sources"], "full_outer")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b")
    return both.select("clause", "sources", side.alias("side"))


def setting_paths(paths: DataFrame) -> DataFrame:
    """(path, key) of each setting that a path's own mapping (path, settings) has."""
    return paths.select("path", F.explode(F.map_keys("settings")).alias("key")).distinct()
