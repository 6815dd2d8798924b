"""A project's graph from its manifest: nodes by the rules of names and switches, edges, tests and what they declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.sources.artifacts import Manifest

#: Pairs of a task, about.
PAIRS = 1 << 17


def nodes(manifest: Manifest) -> DataFrame:
    """The manifest's nodes, the first of an id, with the name that is shown: a source's with its group's, a versioned model's with
    its version."""
    scratch, keys = Scratch(manifest.nodes.sparkSession), ["project", "id"]
    # only ids that occur again are gathered with their columns; of all others no more than their names is shuffled
    again = scratch.save(manifest.nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"__{c}") for c in keys)))
    same = F.col("project").eqNullSafe(F.col("__project")) & F.col("id").eqNullSafe(F.col("__id"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "ord"))
    rows = manifest.nodes.join(again, same, "left_semi").withColumn("k", first).where("k = 1").drop("k").unionByName(manifest.nodes.join(again, same, "left_anti"))
    shown = F.when(F.col("kind") == "source", F.concat_ws(".", "source_name", "name")).when((F.col("kind") == "model") & F.col("version").isNotNull(), F.concat(F.col("name"), F.lit(".v"), F.col("version"))).otherwise(F.col("name"))
    return rows.withColumn("shown", shown).drop("place", "ord")


def edges(manifest: Manifest, known: DataFrame) -> DataFrame:
    """(project, src, dst, test) of ids that are both known and differ; test: the child is a test. Tests and operations have no
    children."""
    ends = known.select("project", "id", "kind")
    pairs = manifest.parents.select("project", F.col("parent").alias("src"), F.col("id").alias("dst")).where("src <> dst")
    # by number, for names take far less room where they are shuffled than in a task
    tasks = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS))
    pairs = pairs.repartition(tasks, "project", "src").distinct()  # dealt as the next join asks
    pairs = pairs.join(ends.select("project", F.col("id").alias("src"), F.col("kind").alias("src_kind")), ["project", "src"])
    pairs = pairs.join(ends.select("project", F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), ["project", "dst"])
    return pairs.where("dst_kind = 'test' or src_kind not in ('test', 'operation')").select("project", "src", "dst", (F.col("dst_kind") == "test").alias("test"))


def declaring(known: DataFrame, links: DataFrame) -> DataFrame:
    """(project, test, node): the node that a column's test hangs on: the one it names, else the one its file key names, else a
    parent in the same file. A key of a source goes by its group's name."""
    tests = known.where("kind = 'test'").select("project", F.col("id").alias("test"), "attached_node", F.col("file_key_name").alias("key"), F.col("original_file_path").alias("file"))
    hosts = known.where("kind <> 'test'").select("project", F.col("id").alias("node"), F.when(F.col("kind") == "source", F.concat(F.lit("sources."), F.col("source_name"))).otherwise(F.concat(F.col("kind"), F.lit("s."), F.col("name"))).alias("host_key"), F.col("original_file_path").alias("host_file"))
    named = tests.join(hosts.select("project", F.col("node").alias("attached_node")), ["project", "attached_node"]).select("project", "test", F.col("attached_node").alias("node"), F.lit(0).alias("turn"))
    parents = links.where("test").select("project", F.col("src").alias("node"), F.col("dst").alias("test")).join(hosts, ["project", "node"]).join(tests, ["project", "test"])
    turn = F.when(F.col("key") == F.col("host_key"), 1).when(F.col("file") == F.col("host_file"), 2)
    near = parents.select("project", "test", "node", turn.alias("turn")).where("turn is not null")
    return named.unionByName(near).groupBy("project", "test").agg(F.min_by("node", F.struct("turn", "node")).alias("node"))


def universe(known: DataFrame, with_tests: bool) -> DataFrame:
    """Nodes that a selection may enter or cross: none that is disabled, no operations, tests only if they are wanted."""
    return known.where(~F.col("disabled") & (F.col("kind") != "operation") & ((F.col("kind") != "test") | F.lit(with_tests)))
