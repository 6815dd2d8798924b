"""Column lineage: walks both ways with cuts at row edges, levels, rules, reach tables and the box of a whole model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.lineage import reach_counts
from quillgraph.operators.traverse import Graph, backwards, walk_with_cuts

# Roles that decide which rows there are, from the weakest.
ROW_ROLES = ("filter", "join_key", "dedup_key")
MODES = ("hidden", "columns", "models")


def is_row(role: Column) -> Column:
    return F.lower(role).isin(*ROW_ROLES)


def column_lineage(edges: DataFrame, focus: DataFrame, up: int, down: int, mode: str = "columns", extra: Column | None = None) -> DataFrame:
    """(id, distance, stop) of columns above (below 0) and below a column. Row edges are left out (hidden), or drawn but not walked
    past: their columns (columns) or their models (models: the id is the model's, by edges' src_model and model). What is behind
    an edge for which extra holds is a stop too. A column that is reached upward isn't met again downward."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    row = is_row(F.col("role"))
    cut = row if extra is None else row | extra
    rows = edges.where(~row) if mode == "hidden" else edges
    sides = []
    for sign, seen, far, end in ((-1, backwards(rows), up, "src_model"), (1, rows, down, "model")):
        hops = seen.withColumn("dst", F.when(row, F.concat(F.lit("model "), F.col(end).cast("string"))).otherwise(F.col("dst"))) if mode == "models" else seen
        sides.append(walk_with_cuts(hops, focus, cut, far).select("id", (sign * F.col("depth")).alias("distance"), "stop"))
    above, below = sides
    return above.unionByName(below.where("distance > 0").join(above.select("id"), "id", "left_anti"))


def column_levels(walk: DataFrame, most: int = 20) -> DataFrame:
    """(distance, n, more): columns at each distance of a walk that went one level farther than is shown."""
    beyond = F.abs("distance") > most
    return walk.where("distance <> 0").groupBy(F.when(beyond, F.signum("distance") * (most + 1)).otherwise(F.col("distance")).cast("long").alias("distance")).agg(F.count("*").alias("n"), F.max(beyond).alias("more"))


def rules_of(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """(node, column, rule, clause) of columns (node, column) that rules (rule, clause, columns array of (node, column)) name, in either
    case."""
    each = rules.select("rule", "clause", F.explode("columns").alias("c")).select("rule", "clause", F.col("c.node").alias("node"), F.lower("c.column").alias("key")).distinct()
    return columns.withColumn("key", F.lower("column")).join(each, ["node", "key"]).select("node", "column", "rule", "clause")


def reach_table(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, up, down): of each column (id) of a node, how many columns lie above it and below it."""
    graph = Graph.of(edges)
    seeds = columns.select(F.col("id").alias("seed"), "id")
    up = reach_counts(graph.flipped(), seeds).select(F.col("seed").alias("id"), F.col("n").alias("up"))
    down = reach_counts(graph, seeds).select(F.col("seed").alias("id"), F.col("n").alias("down"))
    return up.join(down, "id")


def model_box(edges: DataFrame, model: object) -> DataFrame:
    """(other, side, n, rows): what links a whole model with others: of edges (src_model, model, role), their number and how many of
    them decide rows."""
    row = F.sum(is_row(F.col("role")).cast("long")).alias("rows")
    side = lambda own, other, word: edges.where((F.col(own) == model) & (F.col(other) != model)).groupBy(F.col(other).alias("other")).agg(F.count("*").alias("n"), row).withColumn("side", F.lit(word))
    return reduce(DataFrame.unionByName, [side("model", "src_model", "above"), side("src_model", "model", "below")])


def by_model(columns: DataFrame) -> DataFrame:
    """(model, answer): columns (model, column, depth) of a walk as one line for each model, the nearest first."""
    one = columns.groupBy("model", "column").agg(F.min("depth").alias("depth"))
    return one.groupBy("model").agg(F.to_json(F.struct(F.min("depth").alias("depth"), F.transform(F.array_sort(F.collect_list(F.struct("depth", "column"))), lambda x: x["column"]).alias("columns"))).alias("answer"))  # of one model
