"""Counts and tallies over nodes, edges, runs and jobs. All are one grouping, summed on the map side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import folders_above, status


def count_by(nodes: DataFrame, key: Column, missing: str = "unset") -> DataFrame:
    """(key, n); a null or blank key counts as missing."""
    return nodes.groupBy(F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit(missing)).alias("key")).agg(F.count("*").alias("n"))


def count_by_tag(nodes: DataFrame, tags: Column) -> DataFrame:
    """(key, n): a node counts once for each of its tags, one without under (no tag)."""
    each = F.when(F.size(tags) > 0, F.array_distinct(tags)).otherwise(F.array(F.lit("(no tag)")))
    return nodes.select(F.explode(each).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def folder_rollup(files: DataFrame, path: str, depth: int) -> DataFrame:
    """(folder, depth, n): files in each folder's whole subtree, for folders of that depth at most."""
    rows = files.select(F.posexplode(F.slice(folders_above(F.col(path)), 1, depth)).alias("at", "folder"))
    return rows.groupBy("folder", (F.col("at") + 1).cast("long").alias("depth")).agg(F.count("*").alias("n"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    """(kind, n): disabled nodes (disabled) are counted apart, under their own word."""
    return nodes.groupBy(F.when(F.col("disabled"), "disabled").otherwise(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))


def sandbox(nodes: DataFrame, place: list[str], share: float = 0.95, least: int = 20) -> DataFrame:
    """(…place, n, total) of the place that holds so large a share of the nodes; no row if none does."""
    per = nodes.groupBy(*place).agg(F.count("*").alias("n"))
    total = nodes.agg(F.count("*").alias("total"))  # one row
    return per.join(F.broadcast(total), F.col("n") >= F.col("total") * share).where(F.col("total") >= least)


def role_counts(edges: DataFrame) -> DataFrame:
    return count_by(edges, F.col("role"), "unknown").withColumnRenamed("key", "role")


def strongest_roles(edges: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(src, model, rank): the strongest row role between a column and a model other than its own."""
    r = F.lit(0)
    for role, k in rank.items():
        r = F.when(F.col("role") == role, k).otherwise(r)
    return edges.withColumn("rank", r.cast("long")).where("rank > 0 and src_model <> model").groupBy("src", "model").agg(F.max("rank").alias("rank"))


def status_histogram(results: DataFrame) -> DataFrame:
    """(status, n, seconds) of run results (status, seconds)."""
    return results.groupBy(status(F.col("status")).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"))


def slowest(results: DataFrame, most: int = 25) -> DataFrame:
    return results.orderBy(F.desc("seconds"), "id").limit(most).select("id", "seconds")


def coverage(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, reason) of nodes whose best start over the steps (id, start) isn't a yes. start: 0 no, 1 unread, 2 yes."""
    best = steps.groupBy("id").agg(F.max("start").alias("start"))
    found = nodes.select("id").join(best, "id", "left")
    reason = F.when(F.col("start").isNull(), "never").when(F.col("start") == 0, "unscheduled").otherwise("unread")
    return found.where("start is null or start < 2").select("id", reason.alias("reason"))


def key_sets(declared: DataFrame) -> DataFrame:
    """(key, n) of declared keys (owner, column): two declarations of one set of columns are one key."""
    one = declared.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("column")))), ",").alias("key"))  # columns of one key
    return one.groupBy("key").agg(F.count("*").alias("n"))


def key_health(rows: DataFrame, key: list[str]) -> DataFrame:
    """(n, n_null, n_repeated) of a key's columns: rows, rows with a null in it, and values that come more than once."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.first(whole).alias("whole"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("n"))), F.lit(0)).alias("n_null"), F.count(F.when(F.col("whole") & (F.col("n") > 1), 1)).alias("n_repeated")
    )


def nullable_keys(keys: DataFrame, covered: DataFrame) -> DataFrame:
    """(owner, open): of keys (owner, column), the columns that no not-null test (owner, column) covers."""
    bare = keys.select("owner", "column").distinct().join(covered.select("owner", "column").distinct(), ["owner", "column"], "left_anti")
    return bare.groupBy("owner").agg(F.count("*").alias("open"))


def bucketed_runs(items: DataFrame, group: str, order: str, most: int, size: Column | None = None, bytes_most: int = 1 << 62) -> DataFrame:
    """(group, run, n, first, last): runs of at most so many items in order, in each group; with sizes, an item whose bytes would begin
    beyond a multiple of bytes_most begins a run too, so no run holds much more than that.

    Places are counted in two steps, over coarse ranges of the order first, so a large group is spread over many tasks."""
    size = F.lit(0) if size is None else size
    cuts = items.stat.approxQuantile(order, [k / 32 for k in range(1, 32)], 0.01) if items.schema[order].dataType.typeName() in ("long", "integer", "double", "float") else []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col(order) >= F.lit(c)).cast("int")
    rows = items.select(group, order, size.cast("long").alias("size"), part.alias("part"))
    heads = rows.groupBy(group, "part").agg(F.count("*").alias("k"), F.sum("size").alias("s"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 32 rows of a group
    heads = heads.select(group, "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    own = Window.partitionBy(group, "part").orderBy(order)
    so_far = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("k", F.row_number().over(own) - 1).withColumn("s", F.coalesce(F.sum("size").over(so_far), F.lit(0))).join(heads, [group, "part"])
    by_items, by_bytes = F.floor((F.col("k") + F.col("k0")) / most), F.floor((F.col("s") + F.col("s0")) / bytes_most)
    per = placed.groupBy(group, by_items.alias("run"), by_bytes.alias("piece")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    if bytes_most >= 1 << 62:
        return per.drop("piece")
    turn = F.row_number().over(Window.partitionBy(group).orderBy("run", "piece")) - 1  # a row for each run
    return per.withColumn("run", turn.cast("long")).drop("piece")


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b, change) of two counters (key, n); what one side lacks is 0."""
    both = a.select("key", F.col("n").alias("a")).join(b.select("key", F.col("n").alias("b")), "key", "full_outer").na.fill(0, ["a", "b"])
    return both.select("key", "a", "b", (F.col("b") - F.col("a")).alias("change"))
