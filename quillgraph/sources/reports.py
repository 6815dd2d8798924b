"""Scan of the report that a column reader leaves beside its cache: what it couldn't read, model by model.

The report is another program's file, so nothing of its shape is relied on: a document is parsed as a variant, and a field of another type than
expected counts as absent and costs only what it would have said. A model is exploded into its fields, list fields into their items, and
the ends of lost columns once more, all in one pass: a long table with a row for each thing said, which one projection files under its kind. A
row is one document, so many projects' reports are read at once, and a model's findings are put together by its place in its document.

Texts that are no JSON, null documents and models that are no objects give nothing. An id may be listed by two models; each keeps its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The kinds of findings, in the order in which they are listed.
KINDS = (
    "no_compiled_sql", "compiled_elsewhere", "catalog_elsewhere", "columns_missing", "columns_unexpected", "yaml_stale", "thin", "undeclared_relation",
    "unknown_parent", "unbacked_read", "merged_scope", "relation_collision", "short_upstream", "phantom", "parse_failed", "ambiguous", "engine_issue",
    "lost_in_expression", "lost_unresolved",
)
#: Items of a finding and names of a column's note that are listed; the rest is a number.
ITEMS, NAMES = 20, 5

ANY = "array<variant>"


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_at(v: Column, path: str) -> Column:
    """A string below a variant, else an empty one; other types are no strings."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(found) == "STRING", F.try_variant_get(found, "$", "string")).otherwise("")


def list_at(v: Column, path: str) -> Column:
    """A list below a variant; null if there is none."""
    return F.try_variant_get(v, path, ANY)


def true_at(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.coalesce((kind_of(found) == "BOOLEAN") & F.try_variant_get(found, "$", "boolean"), F.lit(False))


def count_at(v: Column, path: str) -> Column:
    """A whole number that isn't negative, else 0."""
    found = F.try_variant_get(v, path, "variant")
    whole = (kind_of(found) == "BIGINT") & (F.try_variant_get(found, "$", "long") >= 0)
    return F.when(whole, F.try_variant_get(found, "$", "long")).otherwise(0).cast("long")


def texts_of(items: Column) -> Column:
    """The strings of a list of variants."""
    strings = F.filter(items, lambda x: F.coalesce(kind_of(x) == "STRING", F.lit(False)))
    return F.transform(F.coalesce(strings, F.array().cast(ANY)), lambda x: F.try_variant_get(x, "$", "string"))


@dataclass(frozen=True)
class Report:
    """head: (document, project, generated_at, version, adapter). totals: (document, counter, value) of counters that are numbers. models:
    (document, place, id, provenance, parse_error, issues, sql_file, set_aside). findings: (document, turn, kind, id, place, detail, items, of).
    notes: (document, place, id, column, kind, detail, names, of, ord). written: (document, ord, category, owner, severity, title, why, action,
    columns, id, name, detail, model), the findings that the program worded itself."""

    head: DataFrame
    totals: DataFrame
    models: DataFrame
    findings: DataFrame
    notes: DataFrame
    written: DataFrame


def documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(value): a document a file, or one a line."""
    return spark.read.text(path, wholetext=not lines)


def report(docs: DataFrame) -> Report:
    """The parts of reports (value), one of each project, which names it."""
    v = F.col("v")
    docs = docs.select(F.try_parse_json("value").alias("v")).where(kind_of(v).startswith("OBJECT")).select(text_at(v, "$.project").alias("document"), "v")
    head = docs.select("document", text_at(v, "$.project").alias("project"), text_at(v, "$.generated_at").alias("generated_at"), text_at(v, "$.dbt_version").alias("version"), text_at(v, "$.adapter").alias("adapter"))
    counters = docs.select("document", F.explode(F.try_variant_get(v, "$.totals", "map<string,variant>")).alias("counter", "x"))
    totals = counters.where(kind_of(F.col("x")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select("document", "counter", F.try_variant_get("x", "$", "double").alias("value"))
    each = docs.select("document", F.posexplode(list_at(v, "$.models")).alias("place", "m")).where(kind_of(F.col("m")).startswith("OBJECT"))
    return Report(head, totals, _models(each), _findings(docs, each), _notes(each), _written(docs))


def _models(each: DataFrame) -> DataFrame:
    m = F.col("m")
    rows = each.select(
        "document", "place", text_at(m, "$.unique_id").alias("id"), text_at(m, "$.provenance").alias("provenance"), text_at(m, "$.parse_error").alias("parse_error"),
        F.size(F.coalesce(list_at(m, "$.issues"), F.array().cast(ANY))).cast("long").alias("issues"), text_at(m, "$.sql_file").alias("sql_file"), true_at(m, "$.sql_file_set_aside").alias("set_aside"),
    )
    return rows


def _fact(kind: str | Column, role: str, text: Column, given: Column, repeats: bool = False) -> Column:
    """Something said under a kind, if given: an item of its list, a piece of its detail, or only that it holds (mark). Those that repeat
    are listed again."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(given, F.struct(kind.alias("kind"), F.lit(role).alias("role"), text.alias("text"), F.lit(repeats).alias("repeats")))


def _said() -> Column:
    """What a row (error, inferred, file, key, x, item, end) of the long table says, as a list of facts."""
    error, inferred, key, x, item, end = (F.col(c) for c in ("error", "inferred", "key", "x", "item", "end"))
    none, missing = F.lit(""), error.startswith("no compiled_code")
    plain = kind_of(item) == "STRING"
    own = F.when(plain, F.try_variant_get(item, "$", "string"))
    here = lambda name: (key == name) & item.isNotNull()
    column = text_at(item, "$.column")
    thin = F.concat(count_at(x, "$.computed").cast("string"), F.lit(" of "), count_at(x, "$.declared").cast("string"))
    reason = text_at(end, "$.reason")
    lost = F.when(end.isNotNull() & (reason == "phantom"), "phantom").when(end.isNotNull() & (reason == "names_unreached"), "lost_in_expression").otherwise("lost_unresolved")
    return F.array_compact(F.array(
        _fact("no_compiled_sql", "detail", error, (key == "parse_error") & missing),
        _fact("parse_failed", "detail", error, (key == "parse_error") & ~missing & (error != "")),
        _fact("compiled_elsewhere", "detail", F.col("file"), (key == "sql_file_set_aside") & true_at(x, "$")),
        _fact("columns_missing", "item", own, here("missing_columns") & plain & (error == ""), True),
        _fact("columns_unexpected", "item", own, here("unexpected_columns") & plain & (error == ""), True),
        _fact("yaml_stale", "mark", none, (key == "yaml_stale") & true_at(x, "$")),
        _fact("thin", "detail", thin, (key == "thin") & kind_of(x).startswith("OBJECT")),
        _fact("undeclared_relation", "item", own, here("undeclared_relations") & plain, True),
        _fact("unknown_parent", "item", own, here("unknown_relations") & plain, True),
        _fact("unbacked_read", "item", column, here("unbacked")),
        _fact("unbacked_read", "detail", text_at(item, "$.cte"), here("unbacked")),
        _fact("merged_scope", "item", text_at(item, "$.name"), here("merged_scopes") & inferred),
        _fact("short_upstream", "item", column, here("read_downstream_but_absent")),
        _fact("ambiguous", "item", column, here("ambiguous_inferred") & (text_at(item, "$.by") == "every") & (column != "")),
        _fact("engine_issue", "item", text_at(item, "$.code"), here("issues") & ~true_at(item, "$.self_reference") & (text_at(item, "$.code") != "")),
        _fact(lost, "item", column, here("lost_columns")),
        _fact(lost, "detail", F.when(lost == "phantom", text_at(end, "$.via")).otherwise(""), here("lost_columns") & end.isNotNull()),
    ))


def _findings(docs: DataFrame, each: DataFrame) -> DataFrame:
    ends = F.when(F.col("key") == "lost_columns", list_at(F.col("item"), "$.ends"))
    # fields of a model, then items of its lists, then ends of lost columns: what has none goes on as one row
    m = F.col("m")
    rows = each.select("document", "place", text_at(m, "$.unique_id").alias("id"), text_at(m, "$.parse_error").alias("error"), text_at(m, "$.provenance").isin("inferred", "unresolved").alias("inferred"), text_at(m, "$.sql_file").alias("file"), F.explode(F.try_variant_get("m", "$", "map<string,variant>")).alias("key", "x"))
    rows = rows.select("*", F.posexplode_outer(list_at(F.col("x"), "$")).alias("i", "item"))
    rows = rows.select("*", F.posexplode_outer(ends).alias("j", "end"))
    said = rows.select("document", "place", "id", F.struct("i", "j").alias("ord"), F.explode(_said()).alias("f")).select("document", "place", "id", "ord", "f.*")
    of_reports = docs.select("document", F.posexplode(list_at(F.col("v"), "$.catalog_elsewhere")).alias("place", "c")).select(
        "document", F.lit("catalog_elsewhere").alias("kind"), "place", text_at(F.col("c"), "$.unique_id").alias("id"), text_at(F.col("c"), "$.catalog_relation").alias("detail"), F.array().cast("array<string>").alias("items")
    )
    collided = docs.select("document", F.posexplode(list_at(F.col("v"), "$.relation_collisions")).alias("place", "c")).select(
        "document", F.lit("relation_collision").alias("kind"), "place", text_at(F.col("c"), "$.relation").alias("id"), F.lit("").alias("detail"), texts_of(list_at(F.col("c"), "$.nodes")).alias("items")
    )
    # each text once, where it is first, unless its kind repeats; then the lists of a model's kind, in order
    once = said.groupBy("document", "place", "id", "kind", "role", "text", F.when(F.col("repeats"), F.col("ord")).alias("again"), "repeats").agg(F.min("ord").alias("ord"))
    listed = lambda role: F.array_sort(F.collect_list(F.when((F.col("role") == role) & (F.col("repeats") | (F.col("text") != "")), F.struct("ord", "text"))))
    per = once.groupBy("document", "place", "id", "kind").agg(listed("item").alias("items"), listed("detail").alias("details"))  # of one model
    others = F.max((F.col("kind") != "engine_issue").cast("int")).over(Window.partitionBy("document", "place"))  # a model's kinds, 18 at most
    per = per.withColumn("others", others).where((F.col("kind") != "engine_issue") | (F.col("others") == 0))
    words = lambda c: F.transform(c, lambda x: x["text"])
    of_models = per.select("document", "kind", "place", "id", F.array_join(words("details"), ", ").alias("detail"), words("items").alias("items"))
    every = of_models.unionByName(of_reports).unionByName(collided).where("id <> ''")
    turn = (F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")) - 1).cast("int")
    n = F.size("items").cast("long")
    return every.select("document", turn.alias("turn"), "kind", "id", "place", "detail", F.slice("items", 1, ITEMS).alias("items"), F.when(n > ITEMS, n).otherwise(0).alias("of"))


def _notes(each: DataFrame) -> DataFrame:
    """What is said of single columns. Names are cut after the first few."""
    item, end, key = F.col("item"), F.col("end"), F.col("key")
    #: key: the note's kind, where its detail stands, where its names do
    lists = {"unbacked": ("unbacked", "$.cte", "$.owners"), "read_downstream_but_absent": ("read_downstream", "$.against", "$.read_by"), "ambiguous_inferred": ("ambiguous", "$.by", "$.chosen")}
    plain = {"missing_columns": "missing", "unexpected_columns": "unexpected"}
    rows = each.select("document", "place", text_at(F.col("m"), "$.unique_id").alias("id"), F.explode(F.try_variant_get("m", "$", "map<string,variant>")).alias("key", "x"))
    rows = rows.where(key.isin("lost_columns", *lists, *plain)).select("*", F.posexplode(list_at(F.col("x"), "$")).alias("i", "item"))
    rows = rows.select("*", F.posexplode_outer(F.when(key == "lost_columns", list_at(item, "$.ends"))).alias("j", "end"))
    pick = lambda make, other: F.coalesce(*(F.when(key == k, make(v)) for k, v in lists.items()), other)
    kind = F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in plain.items()), pick(lambda v: F.lit(v[0]), F.lit("lost")))
    own = F.when(kind_of(item) == "STRING", F.try_variant_get(item, "$", "string"))
    column = F.lower(F.when(key.isin(*plain), F.coalesce(own, F.lit(""))).otherwise(text_at(item, "$.column")))
    via = F.try_variant_get(end, "$.via", "variant")
    stops = F.when(kind_of(via) == "STRING", F.array(text_at(end, "$.via"))).otherwise(texts_of(list_at(end, "$.names")))
    names = F.when(key.isin(*plain), F.array().cast("array<string>")).otherwise(pick(lambda v: texts_of(list_at(item, v[2])), stops))
    detail = F.when(key.isin(*plain), "").otherwise(pick(lambda v: text_at(item, v[1]), F.coalesce(text_at(end, "$.reason"), F.lit(""))))
    rows = rows.select("document", "place", "id", column.alias("column"), kind.alias("kind"), detail.alias("detail"), F.coalesce(names, F.array().cast("array<string>")).alias("names"), F.struct("i", "j").alias("ord"))
    n = F.size("names").cast("long")
    return rows.where("column <> '' and id <> ''").select("document", "place", "id", "column", "kind", "detail", F.slice("names", 1, NAMES).alias("names"), F.when(n > NAMES, n).otherwise(0).alias("of"), "ord")


def _written(docs: DataFrame) -> DataFrame:
    f, m = F.col("f"), F.col("m")
    rows = docs.select("document", F.posexplode(list_at(F.col("v"), "$.findings")).alias("ord", "f")).where(text_at(f, "$.title") != "")
    rows = rows.select("*", F.posexplode(list_at(f, "$.models")).alias("model", "m")).where(text_at(m, "$.unique_id") != "")
    own = [text_at(f, f"$.{c}").alias(c) for c in ("category", "owner", "severity", "title", "why", "action")]
    return rows.select("document", "ord", *own, count_at(f, "$.columns").alias("columns"), text_at(m, "$.unique_id").alias("id"), text_at(m, "$.name").alias("name"), text_at(m, "$.detail").alias("detail"), "model")
