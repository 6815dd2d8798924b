"""Settings by path in nested mappings of any depth, and those that no node uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch

#: What stands between the parts of a path where it is compared.
EDGE = "\x1f"


def blocks(docs: DataFrame, names: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """(project, block, v) of documents (project, v variant): the mappings under some names. renamed: other names of blocks, which count
    where the document has no block of the name itself."""
    at = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    other = {new: old for old, new in (renamed or {}).items()}
    held = [F.struct(F.lit(n).alias("block"), (F.coalesce(at(n), at(other[n])) if n in other else at(n)).alias("v")) for n in names]
    return docs.select("project", F.explode(F.array(*held)).alias("x")).select("project", "x.block", "x.v").where("v is not null")


def tree(held: DataFrame) -> DataFrame:
    """(project, block, parts): the paths of mappings (project, block, v) that set something. A key is a part of a path if it holds a mapping and
    doesn't begin with a plus; anything else is a setting of the mapping that it stands in.

    Level by level: all mappings of a depth are exploded by one job, whatever project they are in, until no deeper ones are left."""
    scratch = Scratch(held.sparkSession)
    level = held.select("project", "block", F.array().cast("array<string>").alias("parts"), "v")
    found = []
    while True:
        entries = level.select("project", "block", "parts", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "x"))
        deeper = F.schema_of_variant("x").startswith("OBJECT") & ~F.col("key").startswith("+")
        entries = entries.withColumn("deeper", deeper)
        path, n = scratch.save_counted(entries)
        if not n:
            break
        rows = scratch.read(path, schema=entries.schema)
        found.append(path)
        level = rows.where("deeper").select("project", "block", F.array_append("parts", F.col("key")).alias("parts"), F.col("x").alias("v"))
    if not found:
        return level.select("project", "block", "parts").limit(0)
    return scratch.read(*found, schema=entries.schema).where("not deeper").select("project", "block", "parts").distinct()


def unused(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, block, path) of paths (project, block, parts) that begin no full name of their block's nodes (project, block, fqn). Prefixes of the
    names are joined by equality; a path without parts is that of all nodes of its block."""
    prefix = F.transform(F.sequence(F.lit(0), F.size("fqn")), lambda k: F.array_join(F.slice("fqn", 1, k), EDGE))
    have = nodes.select("project", "block", F.explode(prefix).alias("key")).distinct()
    asked = paths.select("project", "block", F.array_join("parts", EDGE).alias("key"), F.array_join("parts", ".").alias("path"))
    return asked.join(have, ["project", "block", "key"], "left_anti").select("project", "block", "path")
