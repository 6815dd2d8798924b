"""Findings over a project's nodes: one row for each rule a node breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(nodes: DataFrame, tested: DataFrame) -> DataFrame:
    """(rule, id) of nodes (id, description) and the ids that tests name (id): untested, undescribed, repeated, and tests of
    nodes that aren't known. A null id is no node's."""
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "id")
    blank = F.coalesce(F.trim("description"), F.lit("")) == ""
    return reduce(
        DataFrame.unionByName,
        [
            rule(nodes.join(tested, "id", "left_anti"), "untested"),
            rule(nodes.where(blank), "undescribed"),
            rule(nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "repeated"),
            rule(tested.where("id is not null").join(nodes, "id", "left_anti"), "unknown"),
        ],
    )
