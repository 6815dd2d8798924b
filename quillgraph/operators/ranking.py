"""Ranked searches, last rows of groups, pages and capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The steps of a score, by where the query stands in a name or path, and without a query.
EXACT, PREFIX, INSIDE, IN_PATH, ANY = 0, 10, 20, 30, 50


def _score(query: str, name: Column, path: Column) -> Column:
    query = query.strip()
    q, n = F.lit(query.lower()), F.lower(name)
    if not query:
        return F.lit(ANY)
    return F.when(n == q, EXACT).when(n.startswith(q), PREFIX).when(F.contains(n, q), INSIDE).when(F.contains(F.lower(path), q), IN_PATH)


def search(nodes: DataFrame, query: str, limit: int = 200, kinds: list[str] | None = None) -> DataFrame:
    """(id, name, score) of nodes (id, name, path, kind if kinds are given) by how their names hold the query, then by shortness, name and id."""
    score = (_score(query, F.col("name"), F.col("path")) * 1_000_000 + F.least(F.octet_length("name"), F.lit(999)) * 1000).cast("long")
    rows = nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))
    found = rows.select("id", "name", score.alias("score")).where("score is not null")
    return found.orderBy("score", "name", "id").limit(limit)


def search_paths(files: DataFrame, query: str, limit: int = 200, vendored: str = "vendor/") -> DataFrame:
    """(path, score) of files (path); vendored ones come last."""
    name = F.element_at(F.split("path", "/"), -1)
    base = _score(query, name, F.col("path")) + F.when(F.contains(F.col("path"), F.lit(vendored)), 100).otherwise(0)
    found = files.select("path", base.cast("long").alias("score")).where("score is not null")
    return found.orderBy("score", F.octet_length("path"), "path").limit(limit)


def grep(docs: DataFrame, query: str, per_file: int, most: int) -> DataFrame:
    """(doc_id, line, text): lines of docs (doc_id, text) that hold the query in either case, the first of each document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    hit = lines.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    return hit.withColumn("turn", turn).where(F.col("turn") <= per_file).orderBy("doc_id", "line").limit(most).drop("turn")


def last_rows(rows: DataFrame, group: list[str], at: str, tie: str, success: Column) -> DataFrame:
    """The last row of each group, with the last time of a success in it (last_success); a null in a group is a value."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    per = rows.groupBy(*group).agg(F.max_by(whole, F.struct(at, tie)).alias("row"), F.max(F.when(success, F.col(at))).alias("last_success"))
    return per.select("row.*", "last_success")


def page(rows: DataFrame, at: str, tie: str, before: tuple | None, size: int) -> DataFrame:
    """The newest rows before a place (at, tie), one more than the page holds, so that a next page shows."""
    if before is not None:
        t, k = F.lit(before[0]), F.lit(before[1])
        rows = rows.where((F.col(at) < t) | ((F.col(at) == t) & (F.col(tie) < k)))
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(size + 1)


def capped(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows with how many there are (of)."""
    total = rows.agg(F.count("*").alias("of"))  # one row
    return rows.orderBy(*order).limit(most).join(F.broadcast(total))


def first_names(links: DataFrame, most: int = 8) -> DataFrame:
    """(id, names, more) of links (id, name): the first names and how many are left."""
    own = Window.partitionBy("id")
    ranked = links.distinct().withColumn("k", F.row_number().over(own.orderBy("name")))
    return ranked.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("name")))), ",").alias("names"),  # most at most
        F.count(F.when(F.col("k") > most, 1)).alias("more"),
    )
