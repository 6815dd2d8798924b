"""Reports on a project: overviews, runs, the seven checks, and where a column cache comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import folders_above, status
from quillgraph.sources.reports import Report

# How statuses are told apart in a report, and kinds that a graph holds.
LISTS = {"problem": ("error", "fail"), "warned": ("warn", "partial"), "skipped": ("skipped",)}
INDEXED = ("model", "seed", "snapshot", "test", "source", "analysis", "operation")


def overview(nodes: DataFrame, facets: dict[str, Column], path: str, depth: int) -> DataFrame:
    """(facet, key, n) of nodes: each facet's values, and the files below each folder; one pass over the nodes."""
    keys = F.array(*[F.struct(F.lit(k).alias("facet"), F.coalesce(v.cast("string"), F.lit("unset")).alias("key")) for k, v in facets.items()])
    folders = F.transform(F.slice(folders_above(F.col(path)), 1, depth), lambda f: F.struct(F.lit("folder").alias("facet"), f.alias("key")))
    return nodes.select(F.explode(F.concat(keys, folders)).alias("x")).groupBy("x.facet", "x.key").agg(F.count("*").alias("n"))


def folder_tally(nodes: DataFrame, folder: Column, kinds: list[str], looks: list[str]) -> DataFrame:
    """(folder, n, a column for each kind and each materialization)."""
    each = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds] + [F.count(F.when(F.col("materialized") == k, 1)).alias(k) for k in looks]
    return nodes.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), *each)


def selection_tally(nodes: DataFrame, ids: DataFrame, most: int = 5000) -> DataFrame:
    """(kind, n, names) of a selection: how many of each kind, with the first names."""
    rows = nodes.join(ids.select("id").distinct(), "id", "left_semi").select("kind", "name", "id")
    k = F.row_number().over(Window.partitionBy("kind").orderBy("name", "id"))
    # a limit by rank is taken in every task before the kinds meet
    first = rows.withColumn("k", k).where(F.col("k") <= most).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))  # most at most
    return rows.groupBy("kind").agg(F.count("*").alias("n")).join(first, "kind")


def run_kinds(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, ran, of, ok, bad): of results (id, status), how many of each kind ran, of how many nodes (id, kind, runs) that run at
    all, and how they ended. Results whose node is gone are left to gone()."""
    known = results.join(nodes.select("id", "kind"), "id").withColumn("s", status(F.col("status")))
    ran = known.groupBy("kind").agg(F.count("*").alias("ran"), F.count(F.when(F.col("s").isin("ok", "noop", "reused"), 1)).alias("ok"), F.count(F.when(F.col("s").isin(*LISTS["problem"]), 1)).alias("bad"))
    of = nodes.where("runs").groupBy("kind").agg(F.count("*").alias("of"))
    return ran.join(of, "kind", "left").select("kind", "ran", F.coalesce("of", F.lit(0)).alias("of"), "ok", "bad")


def run_lists(results: DataFrame, most: dict[str, int]) -> DataFrame:
    """(list, turn, id, status, of): problems with errors first, warnings and skips of results (id, name, status), the first of each by
    name and id, and how many there are."""
    s = status(F.col("status"))
    which = reduce(lambda out, kv: F.when(s.isin(*kv[1]), kv[0]).otherwise(out), LISTS.items(), F.lit(None).cast("string"))
    rows = results.select("id", "name", s.alias("status"), which.alias("list")).where("list is not null")
    of = rows.groupBy("list").agg(F.count("*").alias("of"))
    # the first rows of each list by itself: no task sorts a whole list
    firsts = [rows.where(F.col("list") == k).orderBy(F.col("status") != "error", "name", "id").limit(n) for k, n in most.items()]
    own = Window.partitionBy("list").orderBy(F.col("status") != "error", "name", "id")
    return reduce(DataFrame.unionByName, firsts).withColumn("turn", F.row_number().over(own)).join(F.broadcast(of), "list").select("list", "turn", "id", "status", "of")  # three rows


def gone(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of results whose node a graph would hold and doesn't."""
    kind = F.substring_index("id", ".", 1)
    return results.where(kind.isin(*INDEXED)).select("id").distinct().join(nodes.select("id"), "id", "left_anti")


def checks(nodes: DataFrame, tested: DataFrame, links: DataFrame, keys: DataFrame, not_null: DataFrame) -> DataFrame:
    """(rule, id, detail): the seven checks. nodes: (id, kind, description, fresh, incremental, ignored), enabled and of the root. tested: (id)
    of nodes with a test. links: (src, dst). keys: (id, key, columns, in_config, tested). not_null: (id, column). A key that only the
    config declares and that is ignored isn't checked."""
    models, sources = nodes.where("kind = 'model'"), nodes.where("kind = 'source'")
    row = lambda df, rule, detail=None: df.select(F.lit(rule).alias("rule"), "id", (F.lit("") if detail is None else detail).alias("detail"))
    own = keys.join(models.select("id", "incremental", "ignored"), "id")
    each = own.where(~(F.col("ignored") & F.col("in_config") & ~F.col("tested"))).select("id", "key", F.explode(F.array_distinct("columns")).alias("column"))
    bare = each.join(not_null.select("id", "column").distinct(), ["id", "column"], "left_anti").groupBy("id", "key").agg(F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("open"))  # of one key
    return reduce(
        DataFrame.unionByName,
        [
            row(sources.where("fresh = 'no'"), "sources_without_freshness"),
            row(sources.join(links.select(F.col("src").alias("id")), "id", "left_anti"), "sources_not_read"),
            row(models.join(tested.select("id"), "id", "left_anti"), "models_without_test"),
            row(models.where("trim(coalesce(description, '')) = ''"), "models_without_description"),
            row(bare, "keys_maybe_null", F.concat(F.lit("key "), F.col("key"), F.lit(": no not_null on "), F.col("open"))),
            row(own.where("incremental and not ignored and in_config and not tested"), "unique_keys_untested", F.concat(F.lit("unique_key "), F.col("key"))),
            row(models.join(keys.where("tested").select("id"), "id", "left_anti"), "models_without_key"),
        ],
    )


def ordered(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Findings in the order of folder, file, name, id and detail, the first of them."""
    return rows.orderBy("folder", "file", "name", "id", "detail").limit(most)


def provenance(edges: DataFrame, nodes: DataFrame, partial: DataFrame) -> DataFrame:
    """(edges, dropped, partial): how many edges (src, dst) a cache holds, how many have an end that no node has, and how many columns
    it gave up on; one row."""
    ids = nodes.select("id").distinct().withColumn("known", F.lit(True))
    e = edges.join(ids.withColumnsRenamed({"id": "src", "known": "a"}), "src", "left").join(ids.withColumnsRenamed({"id": "dst", "known": "b"}), "dst", "left")
    n = e.agg(F.count("*").alias("edges"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("dropped"))
    return n.join(F.broadcast(partial.select("node", "column").distinct().agg(F.count("*").alias("partial"))))  # one row each


def stale(caches: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project, stale) of caches (project, at): whether one is older than its manifest (project, at)."""
    m = manifests.select("project", F.col("at").alias("made"))
    return caches.join(m, "project", "left").select("project", F.coalesce(F.col("at") < F.col("made"), F.lit(False)).alias("stale"))


def producer_summary(models: DataFrame, top: int = 3) -> DataFrame:
    """(models, parsed, reasons) of models (id, reason), reason null where it was parsed: the reasons that come most, then by name."""
    per = models.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)
    first = per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))), lambda x: x["reason"]), ",").alias("reasons"))  # top rows
    return models.agg(F.count("*").alias("models"), F.count(F.when(F.col("reason").isNull(), 1)).alias("parsed")).join(F.broadcast(first))  # one row each


def agreement(values: DataFrame) -> DataFrame:
    """(total, agree) of values (found, parsed): how many, and how many equal what was parsed."""
    return values.agg(F.count("*").alias("total"), F.count(F.when(F.col("found") == F.col("parsed"), 1)).alias("agree"))


def index(reports: dict[str, DataFrame]) -> DataFrame:
    """(report, n, filled) of each report."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("report"), "n", (F.col("n") > 0).alias("filled")) for k, df in reports.items()]
    return reduce(DataFrame.unionByName, each)


def to_investigate(report: Report) -> DataFrame:
    """(document, n): how many models and relations the findings name, each once: those of the findings that the program worded itself, where
    there are any."""
    own = report.written.select("document", "id").distinct().groupBy("document").agg(F.count("*").alias("own"))
    filed = report.findings.select("document", "id").distinct().groupBy("document").agg(F.count("*").alias("filed"))
    rows = report.head.select("document").distinct().join(own, "document", "left").join(filed, "document", "left")
    return rows.select("document", F.coalesce("own", "filed", F.lit(0)).alias("n"))


def report_summary(report: Report, top: int = 3) -> DataFrame:
    """(document, models, parsed, from_files, set_aside, reasons, to_investigate): a report's counters, and the reasons why models weren't
    parsed, the most frequent first, then by name."""
    names = {"models": "models", "parsed": "parsed", "from_files": "sql_from_files", "set_aside": "sql_from_files_set_aside"}
    totals = report.totals.groupBy("document").agg(*(F.coalesce(F.max(F.when((F.col("counter") == v) & (F.col("value") >= 0), F.col("value"))), F.lit(0)).cast("long").alias(k) for k, v in names.items()))
    per = report.models.where("parse_error <> ''").groupBy("document", "parse_error").agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("document").orderBy(F.desc("n"), "parse_error"))
    first = per.withColumn("turn", turn).where(F.col("turn") <= top).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("turn", "parse_error", "n"))).alias("x"))  # top rows
    reasons = F.array_join(F.transform("x", lambda x: F.concat(x["parse_error"], F.lit(" x"), x["n"].cast("string"))), "; ")
    rows = report.head.select("document").distinct().join(totals, "document", "left").join(first.select("document", reasons.alias("reasons")), "document", "left")
    return rows.join(to_investigate(report).withColumnRenamed("n", "to_investigate"), "document").na.fill(0, list(names)).na.fill("", ["reasons"])


def compare_reports(a: Report, b: Report) -> DataFrame:
    """(document, part, key, a, b, change): counters (totals) and numbers of findings by kind (findings) of two versions, where either has one."""
    total = lambda r: r.totals.where("value >= 0 and value = floor(value)").select("document", F.lit("totals").alias("part"), F.col("counter").alias("key"), F.col("value").cast("long").alias("n"))
    found = lambda r: r.findings.groupBy("document", F.lit("findings").alias("part"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    side = lambda r, name: total(r).unionByName(found(r)).withColumnRenamed("n", name)
    both = side(a, "a").join(side(b, "b"), ["document", "part", "key"], "full_outer").na.fill(0, ["a", "b"])
    return both.withColumn("change", F.col("b") - F.col("a"))


def moved_models(a: Report, b: Report, edges: DataFrame) -> DataFrame:
    """(document, id, gained, lost, changed, read_a, read_b): models whose edges in (document, dst, change) differ between two versions, or that
    the two read in unlike ways; a model that a report doesn't list was parsed."""
    n = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    per = edges.groupBy("document", F.col("dst").alias("id")).agg(n("gained"), n("lost"), n("changed"))
    last = lambda r, name: r.models.where("id <> ''").groupBy("document", "id").agg(F.max_by("provenance", "place").alias(name))
    ways = last(a, "read_a").join(last(b, "read_b"), ["document", "id"], "full_outer").na.fill("parsed", ["read_a", "read_b"])
    rows = per.join(ways, ["document", "id"], "full_outer").na.fill(0, ["gained", "lost", "changed"]).na.fill("parsed", ["read_a", "read_b"])
    return rows.where("gained + lost + changed > 0 or read_a <> read_b")
