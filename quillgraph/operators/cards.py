"""Answers about single nodes and lists of them: cards, drawing facts, and lines for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line of the compact listing holds.
HEADER = ("name", "kind", "path", "parents", "children")


def neighbours(links: DataFrame, own: str, other: str, out: str) -> DataFrame:
    """(id, out): the sorted ids at the other end of a node's links, each once."""
    return links.select(F.col(own).alias("id"), F.col(other).alias("x")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("x")).alias(out))  # of one node


def node_card(nodes: DataFrame, links: DataFrame, columns: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, name, kind, path, parents, children, columns, tested, tests): all about each node (id, name, kind, path): its links (src, dst), its
    columns (id, column), how many of them tests (id, column) name, and how many tests it has."""
    per = columns.join(tests.select("id", "column").distinct().withColumn("t", F.lit(1)), ["id", "column"], "left").groupBy("id").agg(F.count_distinct("column").alias("columns"), F.count_distinct(F.when(F.col("t") == 1, F.col("column"))).alias("tested"))
    n = tests.groupBy("id").agg(F.count("*").alias("tests"))
    out = nodes.select("id", "name", "kind", "path").join(neighbours(links, "dst", "src", "parents"), "id", "left").join(neighbours(links, "src", "dst", "children"), "id", "left")
    out = out.join(per, "id", "left").join(n, "id", "left").na.fill(0, ["columns", "tested", "tests"])
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.array_join(F.coalesce(c, none), ",") for c in ("parents", "children")})


def box_facts(nodes: DataFrame, degrees: DataFrame, hidden: DataFrame) -> DataFrame:
    """(id, label, kind, n_in, n_out, hidden_up, hidden_down, faded): what is drawn of each node of a page."""
    rows = nodes.select("id", F.col("name").alias("label"), "kind", F.col("disabled").alias("faded"))
    return rows.join(hidden, "id").join(degrees, "id", "left").na.fill(0, ["n_in", "n_out"])


def json_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, line): each node (id, name, kind, path) as a JSON object with its parents, sorted and each once."""
    rows = nodes.join(neighbours(links, "dst", "src", "nodes"), "id", "left")
    parents = F.struct(F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))
    body = F.struct("name", F.col("kind").alias("resource_type"), F.col("path").alias("original_file_path"), F.col("id").alias("unique_id"), parents.alias("depends_on"))
    return rows.select("id", F.to_json(body, {"ignoreNullFields": "true"}).alias("line"))


def flat(column: Column) -> Column:
    """Text without characters that would break a line or a field."""
    return F.regexp_replace(column, r"[\x00-\x1f\x7f]", " ")


def compact(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(turn, line): a header, then a line of fields between tabs for each node (id, name, kind, path, enabled), in order of name and id. A
    name that more than one enabled node has stands as the id."""
    spark = nodes.sparkSession
    shared = nodes.where("enabled").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("shared"))
    count = lambda end, out: links.select("src", "dst").distinct().groupBy(F.col(end).alias("id")).agg(F.count("*").alias(out))
    rows = nodes.join(shared, "name", "left").join(count("dst", "parents"), "id", "left").join(count("src", "children"), "id", "left").na.fill(0, ["parents", "children"])
    shown = F.when(F.col("shared"), F.col("id").cast("string")).otherwise(F.col("name"))
    lines = rows.select("name", F.col("id").cast("string").alias("id"), F.concat_ws("\t", flat(shown), "kind", flat(F.col("path")), F.col("parents").cast("string"), F.col("children").cast("string")).alias("line"))
    head = spark.createDataFrame([(0, "", "", "\t".join(HEADER))], "turn int, name string, id string, line string")
    return head.unionByName(lines.withColumn("turn", F.lit(1))).orderBy("turn", "name", "id").select("turn", "line")


def rules_answer(walk: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, distance, clause, text) of rules (node, clause, text) of the nodes of a walk (node, distance)."""
    near = walk.groupBy("node").agg(F.min_by("distance", F.abs("distance")).alias("distance"))
    return rules.join(near, "node").select("node", "distance", "clause", "text").distinct()


def attach_sql(nodes: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(id, sql, cut) of nodes (id, path) with the text of their file (path, text), its first characters only where it is longer."""
    rows = nodes.select("id", "path").join(texts.select("path", "text"), "path", "left")
    return rows.select("id", F.substring("text", 1, most).alias("sql"), F.coalesce(F.length("text") > most, F.lit(False)).alias("cut"))


def column_notes(columns: DataFrame, partial: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, column, notes) of columns (node, column): why a cache gave up on one (node, column, reason, name), and whether its value
    begins there (roots: node, column); columns are the same in either case."""
    key = lambda df: df.withColumn("key", F.lower("column")).drop("column")
    gaps = key(partial).select("node", "key", F.when(F.coalesce("name", F.lit("")) == "", F.col("reason")).otherwise(F.concat_ws(" ", "reason", "name")).alias("note"))
    notes = gaps.unionByName(key(roots).select("node", "key", F.lit("begins here").alias("note")))
    per = notes.groupBy("node", "key").agg(F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("notes"))  # of one column
    return columns.withColumn("key", F.lower("column")).join(per, ["node", "key"]).select("node", "column", "notes")


def selected_columns(ids: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, column, turn) of the columns (id, column, ord) of a selection, in the order of their nodes' files."""
    rows = columns.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select("id", "column", F.row_number().over(Window.partitionBy("id").orderBy("ord", "column")).alias("turn"))


def resolved_variables(asked: DataFrame, values: DataFrame) -> DataFrame:
    """(package, name, value, scope) of variables (package, name) that are read: the line's own value, else the package's, else the
    project's. values: (scope, package, name, value), scope line, package or project."""
    rank = F.when(F.col("scope") == "line", 0).when(F.col("scope") == "package", 1).otherwise(2)
    v = values.select(F.col("package").alias("of"), "name", "value", "scope", rank.alias("rank"))
    rows = asked.distinct().join(v, "name", "left").where((F.col("rank") != 1) | F.col("rank").isNull() | (F.col("of") == F.col("package")))
    best = rows.groupBy("package", "name").agg(F.min_by(F.struct("value", "scope"), "rank").alias("x"))
    return asked.distinct().join(best, ["package", "name"], "left").select("package", "name", "x.value", "x.scope")


def setting_folders(nodes: DataFrame, settings: DataFrame) -> DataFrame:
    """(id, path, value) of nodes (id, fqn): the longest configured path (parts, value) that begins the fqn; an equi-join on prefixes."""
    cut = lambda c, k: F.array_join(F.slice(c, 1, k), "\x1f")
    each = nodes.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("fqn")), lambda k: F.struct(k.alias("k"), cut(F.col("fqn"), k).alias("key")))).alias("p")).select("id", "p.k", "p.key")
    found = each.join(settings.select(F.array_join("parts", "\x1f").alias("key"), F.array_join("parts", "/").alias("path"), "value"), "key")
    return found.groupBy("id").agg(F.max_by(F.struct("path", "value"), "k").alias("x")).select("id", "x.path", "x.value")


def strategies(nodes: DataFrame, macros: DataFrame) -> DataFrame:
    """(id, strategy, known) of incremental nodes (id, strategy): as configured, else what the project's own default macro says (macros: name,
    body), else append; known: some macro of that strategy's name is there."""
    own = macros.where("name = 'get_incremental_default_sql'").select(F.regexp_extract("body", r"get_incremental_(\w+)_sql", 1).alias("default")).where("default <> ''").agg(F.min("default").alias("default"))
    names = macros.select(F.regexp_extract("name", r"^get_incremental_(\w+)_sql$", 1).alias("strategy")).where("strategy <> ''").distinct().withColumn("known", F.lit(True))
    rows = nodes.join(F.broadcast(own)).select("id", F.coalesce(F.nullif(F.lower(F.trim("strategy")), F.lit("")), "default", F.lit("append")).alias("strategy"))  # one row
    return rows.join(names, "strategy", "left").select("id", "strategy", F.coalesce("known", F.lit(False)).alias("known"))


def folder_freshness(nodes: DataFrame, files: DataFrame, built: Column, held: DataFrame) -> DataFrame:
    """(project, edited, committed, gone, state) of each project: its node files (project, path) against the files there (project, path,
    changed): newer ones that are held back (project, path) are edited, other newer ones committed, missing ones gone."""
    newer = files.where(F.col("changed") > built).join(held.withColumn("mine", F.lit(True)), ["project", "path"], "left")
    n = newer.groupBy("project").agg(F.count("mine").alias("edited"), (F.count("*") - F.count("mine")).alias("committed"))
    lost = nodes.select("project", "path").distinct().join(files, ["project", "path"], "left_anti").groupBy("project").agg(F.count("*").alias("gone"))
    rows = nodes.select("project").distinct().join(n, "project", "left").join(lost, "project", "left").na.fill(0)
    state = F.when((F.col("committed") > 0) | (F.col("gone") > 0), "stale").when(F.col("edited") > 0, "edited").otherwise("fresh")
    return rows.select("project", "edited", "committed", "gone", state.alias("state"))
