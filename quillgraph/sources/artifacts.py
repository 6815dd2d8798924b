"""Scans of the artifacts that a build of a project leaves: manifests, catalogs, column caches and run results.

Each file is one JSON document, read under an explicit schema: unknown keys are passed over, missing ones are null, and values of a
loose shape are kept as JSON text (or as variants, where null and absent differ). A folder of many projects' files is read at once,
a task for each file; manifests, column caches and run results may also be kept as lines, a document each, which are read by ranges. A row names the file's project. Maps keep the order of the file (`ord`), which decides between equal keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch

NODE = """struct<name string, resource_type string, package_name string, original_file_path string, fqn array<string>, version string,
latest_version string, schema string, database string, source_name string, alias string, description string, tags array<string>,
relation_name string, column_name string, attached_node string, file_key_name string, raw_code string,
depends_on struct<nodes array<string>, macros array<string>>, test_metadata struct<name string, namespace string>, freshness variant,
config struct<materialized string, enabled boolean, incremental_strategy string, unique_key string, severity string, store_failures string,
`where` string, `limit` string, fail_calc string, warn_if string, error_if string>>"""
MACRO = "struct<name string, package_name string, original_file_path string, description string, macro_sql string, depends_on struct<macros array<string>>>"
MANIFEST = f"""metadata struct<project_name string, generated_at string, adapter_type string, invocation_id string>, nodes map<string, {NODE}>,
sources map<string, {NODE}>, exposures map<string, {NODE}>, disabled map<string, array<{NODE}>>, parent_map map<string, array<string>>,
macros map<string, {MACRO}>"""
COLUMNS = "map<string, struct<columns map<string, struct<name string, type string, comment string>>>>"
CATALOG = f"metadata struct<project_name string>, nodes {COLUMNS}, sources {COLUMNS}"
CACHE = """version int, source string, target string, generated_at string, producer string, errors array<string>,
edges array<struct<`from` string, from_col string, `to` string, to_col string, kind string>>,
roots array<struct<node string, column string, expressions array<string>>>,
expressions array<struct<node string, column string, kind string, text string, steps int, cut boolean>>,
partial array<struct<node string, column string, reason string, name string>>,
rules array<struct<node string, clause string, text string, cut boolean, columns array<struct<node string, column string>>>>"""
RUN = """metadata struct<dbt_schema_version string, dbt_version string, generated_at string, invocation_id string>,
results array<struct<unique_id string, status string, execution_time double, failures string, message string, relation_name string>>,
elapsed_time double, args struct<which string, command string, `select` string, exclude string, selector string>"""


def document(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A row for each document: a file each, or a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def _entries(df: DataFrame, column: str) -> DataFrame:
    """(project, ord, id, x) of a map column."""
    return df.select(F.col("metadata.project_name").alias("project"), F.posexplode(F.map_entries(column)).alias("ord", "e")).select("project", "ord", "e.key", "e.value").toDF("project", "ord", "id", "x")


@dataclass(frozen=True)
class Manifest:
    """nodes: every entry, as the file has it. parents: (project, id, parent, listed) with listed true for those of a parent map."""

    nodes: DataFrame
    parents: DataFrame
    macros: DataFrame


def manifest(spark: SparkSession, path: str, lines: bool = False) -> Manifest:
    """A manifest's parts. Files are read once for the entries of all four maps, which are written as a table, and once for the parents, which
    are too: whatever is asked of them later reads no file again."""
    df, scratch = document(spark, path, MANIFEST, lines), Scratch(spark)
    entry = lambda place, x: lambda e, i: F.struct(F.lit(place).alias("place"), i.alias("ord"), e["key"].alias("id"), x(e["value"]).alias("x"))
    firsts = {"nodes": lambda v: v, "sources": lambda v: v, "exposures": lambda v: v, "disabled": lambda v: F.get(v, F.lit(0))}
    each = [F.coalesce(F.transform(F.map_entries(c), entry(place, x)), F.array()) for place, (c, x) in enumerate(firsts.items())]
    rows = df.select(F.col("metadata.project_name").alias("project"), F.explode(F.concat(*each)).alias("e")).select("project", "e.*")
    rows = rows.where("place <> 3 or (x is not null and coalesce(x.resource_type, '') <> 'test')")
    known = (F.col("place") == 3) | F.coalesce("x.config.enabled", F.lit(True))
    own = F.col("x").getField
    nodes = rows.where(known).select(
        "project", "place", "ord", "id", (F.col("place") == 3).alias("disabled"),
        F.when(F.col("place") == 1, "source").when(F.col("place") == 2, "exposure").otherwise(own("resource_type")).alias("kind"),
        *(own(c).alias(c) for c in ("name", "package_name", "original_file_path", "fqn", "version", "latest_version", "schema", "database", "source_name", "alias", "description", "tags", "relation_name", "column_name", "attached_node", "file_key_name", "raw_code", "freshness", "config")),
        F.col("x.test_metadata.name").alias("test_name"), F.col("x.depends_on.nodes").alias("depends_on"), F.col("x.depends_on.macros").alias("macros"),
    )
    nodes = scratch.save(nodes)
    # a file without a parent map gives one row without an id
    map_of = df.select(F.col("metadata.project_name").alias("project"), F.explode_outer(F.map_entries("parent_map")).alias("e")).select("project", "e.key", "e.value").toDF("project", "id", "parents")
    map_of = scratch.save(map_of)
    listed = map_of.where("id is not null").select("project", "id", F.explode("parents").alias("parent"), F.lit(True).alias("listed"))
    without = map_of.where("id is null").select(F.col("project").alias("owner")).distinct()
    named = nodes.select("project", "id", F.explode("depends_on").alias("parent"), F.lit(False).alias("listed")).join(without, F.col("project").eqNullSafe(F.col("owner")), "left_semi")
    macros = _entries(df, "macros").select("project", "ord", "id", "x.name", "x.package_name", "x.original_file_path", "x.description", "x.macro_sql", F.col("x.depends_on.macros").alias("calls"))
    return Manifest(nodes, listed.unionByName(named), macros)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(project, node, ord, name, type, comment): columns of nodes, then of sources."""
    df = document(spark, path, CATALOG)
    both = _entries(df, "nodes").unionByName(_entries(df, "sources"))
    rows = both.select("project", F.col("id").alias("node"), F.posexplode(F.map_entries("x.columns")).alias("ord", "c"))
    return rows.select("project", "node", "ord", F.coalesce("c.value.name", "c.key").alias("name"), F.coalesce("c.value.type", F.lit("")).alias("type"), F.col("c.value.comment").alias("comment"))


@dataclass(frozen=True)
class Cache:
    header: DataFrame
    edges: DataFrame
    roots: DataFrame
    expressions: DataFrame
    partial: DataFrame
    rules: DataFrame


def column_cache(spark: SparkSession, path: str, newest: int = 1, lines: bool = False) -> Cache:
    """A column cache's parts, each row with its place in the document; reading one of a newer version fails."""
    df = document(spark, path, CACHE, lines).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    late = F.raise_error(F.concat(F.lit("column cache of version "), F.col("version").cast("string"), F.lit(": too new")))
    # the check is part of every column that is read, so no plan leaves it out
    checked = lambda c: F.when(F.coalesce("version", F.lit(0)) > newest, late.cast("string")).otherwise(F.lit(None)).isNull() & F.col(c).isNotNull()
    part = lambda c: df.where(checked(c)).select("file", F.posexplode(c).alias("ord", "x")).select("file", "ord", "x.*")
    header = df.where(checked("file")).select("file", "version", "source", "target", "generated_at", "producer", F.size(F.coalesce("errors", F.array().cast("array<string>"))).alias("errors"))
    return Cache(header, *(part(c) for c in ("edges", "roots", "expressions", "partial", "rules")))


def run_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each result, with the invocation's fields."""
    df = document(spark, path, RUN, lines)
    rows = df.select(F.col("metadata.invocation_id").alias("invocation"), F.col("metadata.generated_at").alias("at"), "elapsed_time", F.coalesce("args.which", "args.command").alias("command"), F.posexplode("results").alias("ord", "r"))
    return rows.select("invocation", "at", "elapsed_time", "command", "ord", "r.*").withColumnRenamed("unique_id", "id").withColumnRenamed("execution_time", "seconds")


def compare_versions(spark: SparkSession, a: str, b: str, lines: bool = False) -> tuple[Cache, Cache]:
    """Two kept versions of a column cache, to be compared."""
    return column_cache(spark, a, lines=lines), column_cache(spark, b, lines=lines)


def file_index(spark: SparkSession, root: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """(path, changed, bytes) of the files below a folder, their contents unread; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.removeprefix("file:").rstrip("/") + "/")
    rows = files.select(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/").alias("path"), F.col("modificationTime").alias("changed"), F.col("length").alias("bytes"))
    rows = rows.select(F.call_function("substring_index", F.col("path"), base, F.lit(-1)).alias("path"), "changed", "bytes").where(~F.col("path").rlike(r"(^|/)[._]"))
    return rows if most is None else rows.orderBy("path").limit(most)


def compiled_files(nodes: DataFrame, files: DataFrame, built: Column) -> DataFrame:
    """(id, path, stale) of nodes (id, project, file): the compiled text, else the one that was run; stale if older than `built`."""
    tries = nodes.select("id", F.posexplode(F.array(*(F.concat_ws("/", F.lit(d), "project", "file") for d in ("compiled", "run")))).alias("turn", "path"))
    best = tries.join(files, "path").groupBy("id").agg(F.min_by(F.struct("path", "changed"), "turn").alias("x"))
    return nodes.select("id").join(best, "id", "left").select("id", "x.path", (F.col("x.changed") < built).alias("stale"))
