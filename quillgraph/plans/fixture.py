"""Artifacts of invented projects, written as JSON from the star schema: a project for a brand's parts in each run of 4,000 numbers, so that there
are more projects, not larger ones, where there are more parts.

A part is a model; parts of size 1 and 2 are disabled ones, of size 3 a disabled test, above 45 switched off where they stand. Its
suppliers (by order lines) are its sources, listed in a parent map for brands from "Brand#2" on and as what it depends on for the
others. Parts of size 40 and more have a test each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.plans.project import once, table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their project as the brand."""
    run = F.expr("p_partkey div 4000").cast("string")
    return table(spark, sf_dir, "part").withColumn("p_brand", F.concat("p_brand", F.lit("_"), run))


def model_id() -> Column:
    return F.concat_ws(".", F.lit("model"), "p_brand", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))


def write(df: DataFrame, project: str, body: Column) -> str:
    """One JSON file for each project; returns their folder."""
    scratch = Scratch(df.sparkSession)
    out = scratch.path()
    df.select(F.to_json(body, {"ignoreNullFields": "true"}).alias("value"), F.col(project).alias("project")).repartition("project").write.partitionBy("project").text(out)
    return f"{out}/*"


def write_lines(df: DataFrame, body: Column, compression: str = "none") -> str:
    """A JSON document a line, many to a file, so that files grow in number with bytes, not with projects; returns their folder."""
    out = Scratch(df.sparkSession).path()
    df.select(F.to_json(body, {"ignoreNullFields": "true"}).alias("value")).write.option("compression", compression).text(out)
    return out


def _map(key: Column, value: Column, given: Column) -> Column:
    return F.map_from_entries(F.filter(F.collect_list(F.when(given, F.struct(key.alias("key"), value.alias("value")))), lambda x: x.isNotNull()))


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    """Order lines are shuffled once, as numbers of parts and suppliers; parts then go to their project with their suppliers' numbers, and
    names and documents are made there."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").repartition(tasks, "p_partkey").distinct()
    own = links.groupBy("p_partkey").agg(F.collect_list("l_suppkey").alias("suppliers"))  # of one model
    columns = parts(spark, sf_dir).select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    part = columns.join(own, "p_partkey", "left").repartition(tasks, "p_brand")
    source_id = lambda k: F.concat_ws(".", F.lit("source"), "p_brand", F.lit("s"), F.concat(F.lit("t"), k.cast("string")))
    part = part.withColumn("suppliers", F.coalesce("suppliers", F.array().cast("array<bigint>"))).withColumn("sources", F.array_sort(F.transform("suppliers", source_id)))
    size, name = F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("_"))
    node = F.struct(
        name.alias("name"), F.when(size == 3, "test").otherwise("model").alias("resource_type"), F.col("p_brand").alias("package_name"),
        F.concat(F.lit("models/"), F.lower("p_type"), F.lit("/"), name, F.lit(".sql")).alias("original_file_path"), F.array(F.col("p_brand"), F.lower("p_type"), name).alias("fqn"),
        F.when(size > 20, size).alias("version"), F.when(size > 20, F.lit(30)).alias("latest_version"), F.lower("p_type").alias("schema"), F.lit("db").alias("database"), F.array("p_type").alias("tags"),
        F.when(size < 10, "").otherwise("about").alias("description"), F.struct(F.when(F.col("p_brand") < "Brand#2", F.col("sources")).otherwise(F.array().cast("array<string>")).alias("nodes")).alias("depends_on"),
        F.struct(F.when(size < 20, "view").otherwise("table").alias("materialized"), F.when(size > 45, False).alias("enabled")).alias("config"),
    )
    test = F.struct(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"), F.lit("test").alias("resource_type"), F.col("p_brand").alias("package_name"), model_id().alias("attached_node"), F.lit("key").alias("column_name"),
        F.struct(F.when(size >= 45, "unique").otherwise("not_null").alias("name")).alias("test_metadata"), F.struct(F.array(model_id()).alias("nodes")).alias("depends_on"),
    )
    test_id = F.concat_ws(".", F.lit("test"), "p_brand", F.concat(F.lit("t"), F.col("p_partkey").cast("string")))
    per = part.groupBy("p_brand").agg(
        _map(model_id(), F.parse_json(F.to_json(node)), size > 3).alias("models"), _map(test_id, F.parse_json(F.to_json(test)), size >= 40).alias("tests"), _map(model_id(), F.array(node), size <= 3).alias("disabled"),
        _map(model_id(), F.col("sources"), (size > 3) & (F.col("p_brand") >= "Brand#2")).alias("parents"), _map(test_id, F.array(model_id()), (size >= 40) & (F.col("p_brand") >= "Brand#2")).alias("test_parents"),
        F.collect_set("suppliers").alias("suppliers"),  # of one project's parts
    )
    source = lambda k: F.struct(F.concat(F.lit("t"), k.cast("string")).alias("name"), F.lit("source").alias("resource_type"), F.lit("s").alias("source_name"), F.col("p_brand").alias("package_name"), F.lit("raw").alias("schema"))
    entries = F.transform(F.array_distinct(F.flatten("suppliers")), lambda k: F.struct(source_id(k).alias("key"), source(k).alias("value")))
    per = per.withColumn("sources", F.map_from_entries(entries))
    body = F.struct(F.struct(F.col("p_brand").alias("project_name")).alias("metadata"), F.map_concat("models", "tests").alias("nodes"), "sources", "disabled", F.map_concat("parents", "test_parents").alias("parent_map"))
    return write_lines(per, body, "gzip")


def _catalog(spark: SparkSession, sf_dir: str) -> str:
    kind = F.when(F.col("p_size") < 25, F.col("p_type")).otherwise("")
    columns = F.create_map(F.lit("KEY"), F.struct(F.lit("KEY").alias("name"), F.lit("number").alias("type"), F.lit(None).cast("string").alias("comment")), F.lower("p_type"), F.struct(F.col("p_name").alias("name"), kind.alias("type"), F.lit("c").alias("comment")))
    per = parts(spark, sf_dir).groupBy("p_brand").agg(_map(model_id(), F.struct(columns.alias("columns")), F.lit(True)).alias("nodes"))
    return write(per, "p_brand", F.struct(F.struct(F.col("p_brand").alias("project_name")).alias("metadata"), "nodes"))


def _cache(spark: SparkSession, sf_dir: str, version: int, status: str) -> str:
    """Column edges of the suppliers' columns to the parts', by order lines of one status."""
    flag = F.col("l_returnflag")
    role = F.when(flag == "A", "filter").when(flag == "R", "join_key").otherwise("passthrough").alias("kind")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status).join(parts(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    edge = F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from"), F.lit("id").alias("from_col"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to"), F.lower("l_returnflag").alias("to_col"), role)
    rows = lines.select("p_brand", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice").alias("at"), edge.alias("edge"))
    per = rows.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edge"))), lambda x: x["edge"]).alias("edges"))
    return write_lines(per, F.struct(F.lit(version).alias("version"), F.lit("dev").alias("target"), F.lit("reader").alias("producer"), "edges"))


def _results(spark: SparkSession, sf_dir: str) -> str:
    """A run for each user: an event is a result."""
    raw = F.when(F.col("event_type") == "view", "Success").when(F.col("event_type") == "click", "runtime_error").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "purchase", "warn").otherwise("fail")
    result = F.struct(F.concat(F.lit("model.p.e"), F.col("event_id").cast("string")).alias("unique_id"), raw.alias("status"), F.col("value").alias("execution_time"), F.col("props").alias("message"))
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("user")).agg(F.array_sort(F.collect_list(result)).alias("results"), F.sum("value").alias("elapsed_time"))
    return write_lines(per, F.struct(F.struct(F.col("user").alias("invocation_id")).alias("metadata"), "results", F.struct(F.lit("build").alias("which")).alias("args")))


@once
def artifact(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The folder of a kind of artifacts."""
    if kind.startswith("cache"):
        _, version, status = kind.split(":")
        return _cache(spark, sf_dir, int(version), status)
    if kind.startswith("report"):
        return _report(spark, sf_dir, int(kind[-1]))
    return {"manifest": _manifest, "catalog": _catalog, "results": _results}[kind](spark, sf_dir)


def _report(spark: SparkSession, sf_dir: str, version: int) -> str:
    """A report a line, for each 200 parts; what is said of a part goes by its size, and in the second version by the next size."""
    part = table(spark, sf_dir, "part").withColumn("s", F.col("p_size") if version == 1 else F.col("p_size") % 50 + 1)
    s = F.col("s")
    given = lambda c, v: F.when(c, v)
    told = lambda t: F.lit(t)
    key = F.col("p_partkey").cast("string")
    end = lambda reason, via: F.struct(F.lit(reason).alias("reason"), F.lit(via).cast("string").alias("via"))
    loose = given(s % 19 == 0, F.concat(told('["x", 5, "'), "p_type", told('"]'))).otherwise(given(s % 17 == 0, told('"just text"')))
    model = F.struct(
        F.concat(told("model.m"), key).alias("unique_id"), F.when(s % 12 == 0, "inferred").when(s % 10 == 2, "unresolved").otherwise("parsed").alias("provenance"),
        given(s % 10 == 1, F.concat(told("no compiled_code for "), "p_name")).otherwise(given(s % 10 == 2, F.concat(told("syntax error in "), "p_type"))).alias("parse_error"),
        F.concat(told("target/"), key, told(".sql")).alias("sql_file"), given(s % 7 == 0, F.lit(True)).alias("sql_file_set_aside"),
        given(s % 3 == 0, F.array("p_brand", "p_type", "p_brand")).alias("missing_columns"), given(s % 25 == 12, F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(told("c"), i.cast("string")))).alias("unexpected_columns"),
        given(s % 11 == 0, F.lit(True)).alias("yaml_stale"), given(s % 13 == 0, F.struct(s.alias("computed"), (2 * s).alias("declared"))).alias("thin"),
        given(s % 5 == 0, F.array("p_name", "p_type")).alias("undeclared_relations"), F.parse_json(loose).alias("unknown_relations"),
        given(s % 4 == 0, F.array(*(F.struct(c.alias("column"), told(t).alias("cte"), F.transform(F.sequence(F.lit(1), s), lambda i: F.concat(told("o"), i.cast("string"))).alias("owners")) for c, t in ((F.upper("p_type"), "a"), (F.upper("p_type"), "b"), (told("x"), ""))))).alias("unbacked"),
        given(s % 6 == 0, F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.col("p_name").alias("name")))).alias("merged_scopes"),
        given(s % 14 == 0, F.array(F.struct(F.col("p_brand").alias("column"), told("cat").alias("against")))).alias("read_downstream_but_absent"),
        given(s % 8 == 0, F.array(F.struct(F.col("p_type").alias("column"), told("every").alias("by")), F.struct(told("z").alias("column"), told("compile").alias("by")))).alias("ambiguous_inferred"),
        given(s % 9 == 0, F.array(
            F.struct(told("k").alias("column"), F.array(end("phantom", "cte1"), end("names_unreached", None), end("other", None)).alias("ends")), F.struct(told("n").alias("column"), F.array().cast("array<struct<reason:string,via:string>>").alias("ends")),
            F.struct(told("k2").alias("column"), F.array(end("phantom", "cte1"), end("phantom", "cte0")).alias("ends")),
        )).alias("lost_columns"),
        given(s % 2 == 1, F.array(F.struct(F.concat(told("E"), s.cast("string")).alias("code"), F.lit(False).alias("self_reference")), F.struct(told("S").alias("code"), F.lit(True).alias("self_reference")))).alias("issues"),
    )
    elsewhere = given(s == 20, F.struct(F.concat(told("model.m"), key).alias("unique_id"), F.col("p_name").alias("catalog_relation")))
    collided = given(s == 30, F.struct(F.concat(told("db."), key).alias("relation"), F.array(F.concat(told("model.m"), key), told("model.other")).alias("nodes")))
    worded = given(s == 40, F.struct(told("catalog").alias("category"), told("inputs").alias("owner"), F.concat(told("read "), "p_name").alias("title"), s.alias("columns"), F.array(F.struct(F.concat(told("model.m"), key).alias("unique_id"))).alias("models")))
    # objects as texts, for variants can't be ordered
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("p_partkey", F.to_json(c).alias("x"))))), lambda r: r["x"])
    listed = lambda c, name: F.concat(F.lit(f'"{name}":['), F.array_join(ordered(c), ","), F.lit("]")).alias(name)
    project = F.concat(told("p"), F.expr("p_partkey div 200").cast("string")).alias("project")
    per = part.groupBy(project).agg(  # 200 parts
        listed(model, "models"), listed(elsewhere, "catalog_elsewhere"), listed(collided, "relation_collisions"), listed(worded, "findings"), F.count("*").alias("n"), F.count(F.when(~(s % 10).isin(1, 2), 1)).alias("read"), F.sum("p_size").alias("sizes"),
    )
    totals = F.struct(F.col("n").alias("models"), F.col("read").alias("parsed"), F.col("sizes").alias("sql_from_files"), told("many").alias("odd"), F.lit(0.5).alias("share"))
    head = F.to_json(F.struct("project", told("now").alias("generated_at"), totals.alias("totals")))
    body = F.concat(F.regexp_replace(head, "}$", ","), F.concat_ws(",", "models", "catalog_elsewhere", "relation_collisions", "findings"), told("}"))
    out = Scratch(spark).path()
    per.select(body.alias("value")).write.text(out)
    return out
