"""Names to nodes: by id, by name in either case, by base name, and suggestions where nothing is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import identifier

# Kinds of nodes that a person writes.
WRITTEN = ("model", "source", "seed", "snapshot", "exposure", "analysis")


def node_by_name(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, n) of asked (asked) among nodes (id, name, base, package, version, enabled): by id, else by name, else by name in either
    case, else the newest version of a base name in each package; enabled ones if there are any. With n above 1 the id is null."""
    ids = F.col("id").cast("string")
    newest = Window.partitionBy("package", "base").orderBy(F.desc(F.col("version").try_cast("double")), F.desc("version"))
    bases = nodes.where("version is not null").withColumn("k", F.row_number().over(newest)).where("k = 1")
    each = ((nodes, ids, False, 0), (nodes, F.col("name"), False, 1), (nodes, F.lower("name"), True, 2), (bases, F.col("base"), False, 3))
    found = [asked.withColumn("key", F.lower("asked") if low else F.col("asked")).join(df.select(key.alias("key"), "id", "enabled"), "key").select("asked", "id", "enabled", F.lit(turn).alias("turn")) for df, key, low, turn in each]
    all_found = reduce(DataFrame.unionByName, found)
    best = all_found.groupBy("asked").agg(F.min(F.struct("turn", (~F.col("enabled")).alias("off"))).alias("best"))
    kept = all_found.join(best, "asked").where((F.col("turn") == F.col("best.turn")) & (~F.col("enabled") == F.col("best.off")))
    per = kept.groupBy("asked").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    out = asked.distinct().join(per, "asked", "left")
    return out.select("asked", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


def references(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id) of names: enabled nodes before disabled ones, models before others, then the least id."""
    rank = F.col("enabled").cast("int") * 2 + (F.col("kind") == "model").cast("int")
    best = nodes.groupBy("name").agg(F.min_by("id", F.struct(-rank, "id")).alias("id"))
    return asked.select("asked").distinct().join(best.withColumnRenamed("name", "asked"), "asked", "left")


def suggestions(nodes: DataFrame, asked: list[str], most: int = 5) -> DataFrame:
    """(asked, id, name, turn): the first nodes (id, name, kind, path) whose names, or else paths, hold what was asked for, by likeness,
    shortness, name and id. Kinds that a person writes stand alone if any of them is among the hits; of one name the first is shown."""
    low, want = F.lower("name"), F.lower("asked")
    hits = nodes.select("id", "name", "path", F.col("kind").isin(*WRITTEN).alias("written"), F.explode(F.array(*map(F.lit, asked))).alias("asked"))
    score = F.when(low == want, 0).when(low.startswith(want), 1).when(F.contains(low, want), 2).when(F.contains(F.lower("path"), want), 3)
    hits = hits.withColumn("score", score).where("score is not null")
    # a limit by rank is taken in every task before the words meet
    turn = F.row_number().over(Window.partitionBy("asked", "written").orderBy("score", F.octet_length("name"), "name", "id"))
    first = hits.withColumn("turn", turn).where(F.col("turn") <= most)
    any_written = F.max("written").over(Window.partitionBy("asked"))  # two lists of most
    first = first.withColumn("best", any_written).where("written = best")
    again = F.row_number().over(Window.partitionBy("asked", "name").orderBy("turn"))
    return first.withColumn("again", again).where("again = 1").select("asked", "id", "name", "turn")


def same_places(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b) of the sources of two projects that are one table: by schema and name as identifiers, whatever the database."""
    key = lambda df, out: df.select(F.col("id").alias(out), identifier(F.col("schema")).alias("k1"), identifier(F.col("name")).alias("k2"))
    return key(a, "id_a").join(key(b, "id_b"), ["k1", "k2"]).select("id_a", "id_b")


def macro_calls(calls: DataFrame, macros: DataFrame, root: str) -> DataFrame:
    """(caller, call, macro) of calls (caller, package, call) among macros (id, package, name): with a package as written; else of the
    caller's own package, else of the root's."""
    at = lambda package, name, out: macros.select(F.col("package").alias(package), F.col("name").alias(name), F.col("id").alias(out))
    dotted = F.contains("call", F.lit("."))
    rows = calls.withColumn("p", F.when(dotted, F.substring_index("call", ".", 1)).otherwise(F.col("package"))).withColumn("m", F.substring_index("call", ".", -1))
    own = rows.join(at("p", "m", "own"), ["p", "m"], "left")
    tops = at("q", "m", "top").where(F.col("q") == root).drop("q")
    return own.join(tops, "m", "left").select("caller", "call", F.coalesce("own", F.when(~dotted, F.col("top"))).alias("macro"))


def priority(*pairs: tuple[Column, str]) -> Column:
    """The word of the first condition that holds."""
    out = F.lit(None).cast("string")
    for when, word in reversed(pairs):
        out = F.when(when, word).otherwise(out)
    return out
