"""Queries over parts read as models: scalars, the methods of selections, and what is kept of selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import jinja, text
from quillgraph.operators import selection
from quillgraph.plans import project
from quillgraph.plans.project import node_id, table
from quillgraph.plans.registry import query

KIND = "CASE p_type WHEN 'LARGE' THEN 'source' WHEN 'SMALL' THEN 'exposure' WHEN 'PROMO' THEN 'test' ELSE 'model' END"
META = f"""meta AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, {KIND} AS kind, p_brand AS package, 'models/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.sql' AS path,
p_size > 45 AS disabled, CASE WHEN p_size > 20 THEN CAST(p_size AS VARCHAR) END AS version, CASE WHEN p_size < 10 THEN 'view' WHEN p_size < 30 THEN 'incremental' ELSE 'table' END AS materialized, lower(p_type) AS folder, split_part(p_name, ' ', 1) AS word, p_size FROM part)"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    size = F.col("p_size")
    fqn = F.array(F.col("p_brand"), F.lower("p_type"), name)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.expr(KIND).alias("kind"), F.col("p_brand").alias("package"), F.concat(F.lit("models/"), F.lower("p_type"), F.lit("/"), name, F.lit(".sql")).alias("path"),
        (size > 45).alias("disabled"), F.when(size > 20, size.cast("string")).alias("version"), F.lit("30").alias("latest"), F.when(size < 10, "view").when(size < 30, "incremental").otherwise("table").alias("materialized"),
        F.when(size > 20, F.concat(fqn, F.array(F.concat(F.lit("v"), size.cast("string"))))).otherwise(fqn).alias("fqn"), F.lower("p_type").alias("folder"), F.substring_index("p_name", " ", 1).alias("word"), "p_size",
    )


# --- methods -----------------------------------------------------------------------------------

V = "version IS NOT NULL"


@query(f"""WITH {META} SELECT id, name = 'small_ring' AS by_leaf, name = 'small_ring' AND coalesce(version = '30', false) AS by_version, package = 'Brand#2' AND folder = 'economy' AS by_folder, package = 'Brand#2' AS by_star,
folder = 'economy' AND name LIKE 'small%' AS without_package, false AS too_long FROM meta""")
def methods_fqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v = meta(spark, sf_dir), F.col("version")
    by = lambda pattern: selection.fqn_matches(F.col("fqn"), pattern, v)
    return m.select(
        "id", by("small_ring").alias("by_leaf"), by("small_ring_v30").alias("by_version"), by("Brand#2.economy").alias("by_folder"), by("Brand#2.*").alias("by_star"), by("economy.small*").alias("without_package"), by("Brand#2.*.*.*.x").alias("too_long")
    )


@query(f"""WITH {META} SELECT id, name LIKE 'small%' AS by_stem, name = 'red_bolt' AS by_file, folder = 'economy' AS by_path, package LIKE 'Brand#1%' AS by_package, kind = 'test' AS by_kind,
kind = 'source' AND package = 'Brand#2' AND folder = 'large' AND name LIKE '%ring' AS by_source, kind = 'exposure' AND package = 'Brand#3' AS by_exposure, materialized LIKE 'incr%' AS by_config, p_size > 5 AS by_entry FROM meta""")
def methods_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keys = F.when(c("p_size") > 5, F.array(F.lit("a_id"), c("name")))
    return meta(spark, sf_dir).select(
        "id", selection.file_matches(c("path"), "small*").alias("by_stem"), selection.file_matches(c("path"), "red_bolt.sql").alias("by_file"), selection.path_matches(c("path"), "models/eco*").alias("by_path"),
        selection.matches("package", "Brand#1*").alias("by_package"), selection.kind_matches(c("kind"), "unit_test").alias("by_kind"), selection.source_matches(c("kind"), c("package"), c("folder"), c("name"), "Brand#2.large.*ring").alias("by_source"),
        selection.exposure_matches(c("kind"), c("package"), c("name"), "Brand#3.*").alias("by_exposure"), selection.config_matches(c("materialized"), "incr*").alias("by_config"), selection.config_matches(keys, "*_id", True).alias("by_entry"),
    )


@query(f"""WITH {META} SELECT id, CASE WHEN version = '30' THEN 'latest' WHEN {V} AND p_size > 30 THEN 'prerelease' WHEN {V} THEN 'old' ELSE 'none' END AS state, kind = 'model' AND version IS NULL AS unversioned FROM meta""")
def methods_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return meta(spark, sf_dir).select("id", text.version_state(c("version"), c("latest")).alias("state"), selection.version_matches(c("kind"), c("version"), c("latest"), "none").alias("unversioned"))


@query(f"""WITH {META}, v AS (SELECT id, unnest([path, replace(path, '/', chr(92)), name, name || '.SQL', name || '.csv', package || '.' || name, name || '.py.txt', '']) AS value, unnest(['path', 'path', 'fqn', 'file', 'file', 'fqn', 'fqn', 'fqn']) AS method FROM meta) SELECT * FROM v""")
def methods_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of each model's path, name and files, as a criterion that names none."""
    c = F.col
    values = F.array(c("path"), F.replace("path", F.lit("/"), F.lit("\\")), c("name"), F.concat("name", F.lit(".SQL")), F.concat("name", F.lit(".csv")), F.concat_ws(".", "package", "name"), F.concat("name", F.lit(".py.txt")), F.lit(""))
    rows = meta(spark, sf_dir).select("id", F.explode(values).alias("value"))
    return rows.withColumn("method", selection.default_method_of(c("value")))


#: What criteria match, and what they match as full names.
EMPTY = (("p_size > 45", "false"), ("kind = 'test' AND NOT disabled", "false"), ("false", "p_size < 20"), ("name = 'no_such'", "name = 'no_such'"), ("p_size > 47 OR kind = 'test'", "true"))
WHY = " UNION ALL ".join(
    f"SELECT {i} AS asked, CASE WHEN bool_or(({m}) AND disabled) THEN 'disabled' WHEN bool_or(({m}) AND NOT disabled AND kind = 'test') THEN 'tests' WHEN bool_or(({f}) AND NOT disabled AND kind = 'source') THEN 'sources' ELSE 'nothing' END AS why FROM meta"
    for i, (m, f) in enumerate(EMPTY)
)


@query(f"WITH {META} {WHY}")
def methods_why_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta(spark, sf_dir)
    out = [selection.why_empty(m, F.expr(a), F.expr(b), False).select(F.lit(i).alias("asked"), "why") for i, (a, b) in enumerate(EMPTY)]
    return reduce(DataFrame.unionByName, out)


# --- what is kept of selections ------------------------------------------------------------------

PARTS_E = project.edges_sql("order").replace("e AS", "pe AS")
TREE = f"{project.nodes_sql()}, {PARTS_E}, {project.TESTS_SQL}, u AS (SELECT * FROM n WHERE kind <> 'order'), ue AS (SELECT src, dst FROM pe WHERE src IN (SELECT id FROM u) AND dst IN (SELECT id FROM u))"
BIG = "SELECT 'part.' || p_partkey AS id FROM part WHERE p_size >= 40"


@project.once
def universe(spark: SparkSession, sf_dir: str) -> selection.Universe:
    nodes = project.nodes(spark, sf_dir).where("kind <> 'order'")
    size = table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id"), F.col("p_size").alias("size"))
    return selection.Universe(nodes.join(size, "id", "left"), project.edges(spark, sf_dir, "order"), project.tests(spark, sf_dir), mode="empty")


@query(f"WITH {TREE}, d AS (SELECT id FROM u WHERE id = 'nation.3' UNION SELECT dst FROM ue WHERE src = 'nation.3') SELECT id FROM (SELECT 'supplier.3' AS id UNION SELECT 'nation.3') WHERE id IN (SELECT id FROM d UNION SELECT 'supplier.3') AND id NOT IN ({BIG})")
def select_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was matched itself, of a union without another selection."""
    u = universe(spark, sf_dir)
    return ((u.pick(F.col("id") == "nation.3", down=1) | u.pick(F.col("id") == "supplier.3")) - u.pick(F.col("size") >= 40)).starts


NEAR = "near AS (SELECT 'supplier.3' AS id UNION SELECT dst FROM ue WHERE src = 'supplier.3')"


@query(f"""WITH {TREE}, {NEAR}, big AS ({BIG}), two AS (SELECT id FROM near INTERSECT SELECT id FROM big), asked AS (SELECT 'part.' || p_partkey AS id FROM part)
SELECT 'near' AS selector, id FROM near WHERE id IN (SELECT id FROM asked) UNION ALL SELECT 'big', id FROM big UNION ALL SELECT 'both', id FROM two""")
def selectors_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored selections, one of which leans on two others, and the parts that each holds."""
    u = universe(spark, sf_dir)
    named = selection.Named(u, {"near": lambda _: u.pick(F.col("id") == "supplier.3", down=1), "big": lambda _: u.pick(F.col("size") >= 40), "both": lambda n: n["near"] & n["big"]})
    return named.holding(table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id")))


@query(f"""WITH {project.TESTS_SQL}, picked AS (SELECT DISTINCT test AS id FROM t WHERE id = 'part.7' UNION SELECT 'supplier.1')
SELECT 'supplier.1' AS id, false AS context UNION ALL SELECT DISTINCT id, true FROM t WHERE test IN (SELECT id FROM picked)""")
def canvas_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = project.tests(spark, sf_dir)
    picked = tests.where("id = 'part.7'").select(F.col("test").alias("id")).union(spark.createDataFrame([("supplier.1",)], "id string"))
    return selection.shown(picked, tests, False)


# --- scalars -----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, lower(p_name) AS identifier, 3 AS parts, p_size < 40 AS valid, CASE WHEN p_size < 10 THEN '0 0 * * *' WHEN p_size < 20 THEN '@Daily' ELSE '5 4 * * *' END AS cron,
p_size < 12 AS before, CASE p_type WHEN 'LARGE' THEN 'models' WHEN 'SMALL' THEN '' ELSE 'a/b' END AS folder FROM part""")
def scalars_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, size = F.col, F.col("p_size")
    relation = F.concat(F.lit("db."), F.lit('"a.b".'), F.when(size < 40, c("p_name")).otherwise(F.repeat(c("p_name"), 100)))
    cron = F.when(size < 10, " @daily ").when(size < 20, "@Daily").otherwise("5  4 *  * *")
    path = F.when(c("p_type") == "LARGE", "models/x.sql").when(c("p_type") == "SMALL", "x.sql").otherwise("a/b/x.sql")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.identifier(F.concat(F.lit(' "'), F.upper("p_name"), F.lit('" '))).alias("identifier"), F.size(text.relation_parts(relation)).alias("parts"), text.valid_relation(relation).alias("valid"),
        text.normal_cron(cron).alias("cron"), text.semver_before(F.concat(F.lit("reader 0."), size.cast("string"), F.lit(".9")), F.lit("0.12.0")).alias("before"), text.folder(path).alias("folder"),
    )


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size > 25 THEN 'where=x > 1' END, CASE WHEN p_size % 10 = 0 THEN 'warn_if=> 10' END) AS moved, p_size < 10 OR p_size BETWEEN 20 AND 29 AS ignored,
CASE WHEN p_size < 10 THEN 'yes' WHEN p_size < 20 THEN 'no' ELSE 'none' END AS fresh, p_type IN ('LARGE', 'SMALL', 'PROMO') AS hidden FROM part""")
def scalars_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, size, null = F.col, F.col("p_size"), F.lit(None).cast("string")
    config = F.struct(F.lit("false").alias("store_failures"), null.alias("store_failures_as"), F.when(size > 25, "x > 1").alias("where"), null.alias("limit"), F.lit("count( * )").alias("fail_calc"), F.when(size % 10 == 0, "> 10").otherwise("!= 0").alias("warn_if"), F.lit("").alias("error_if"))
    strategy = F.when(size < 10, "Append").when(size < 20, "merge").when(size < 30, "microbatch").otherwise("delete+insert")
    limit = lambda k: F.struct(F.when(size < k, 12).alias("count"), F.lit("hour").alias("period"))
    name = F.when(c("p_type") == "LARGE", "DB_PASS").when(c("p_type") == "SMALL", "MY_API_KEY").when(c("p_type") == "PROMO", "HOME").when(c("p_type") == "MEDIUM", "UNIQUE_KEY").otherwise("PASS_RATE")
    value = F.when(c("p_type") == "PROMO", "postgres://me:pw@host/db").otherwise("https://example.com:80/a:b@c")
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.array_join(text.settings_diff(config), ",").alias("moved"),
        text.key_ignored(strategy, "snowflake").alias("ignored"), text.freshness(limit(10), limit(5), size < 20).alias("fresh"), (text.withheld(name, value) == "(withheld)").alias("hidden"),
    )


@query("""SELECT p_partkey AS id, 'db_' || lower(p_type) || ' x local' AS filled, 'P_' || upper(split_part(p_name, ' ', 1)) AS unset, 'env_var DB,env_var P_' || upper(split_part(p_name, ' ', 1)) || ',is_incremental,target.schema' AS reads,
split_part(p_name, ' ', 2) || '_m' AS calls, 'a,' || split_part(p_name, ' ', 1) AS args FROM part""")
def scalars_jinja(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.get(F.split("p_name", " "), F.lit(k)) for k in (0, 1))
    part = jinja.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    kind = F.lower("p_type")
    given = F.concat(F.lit("{{ env_var('DB', 'd') }}_"), kind, F.lit(" x {{ env_var('HOST','local') }}"))
    sql = F.concat(F.lit("{# env_var('NOT') #}{{ target.schema }} {{ env_var('P_"), F.upper(a), F.lit("') }} {{ env_var('DB') }} {% if is_incremental() %}"))
    calls = F.concat(F.lit("{# hidden() #} select f(x) from {{ "), b, F.lit("_m(1) }}"))
    body = F.concat(F.lit("{% macro other(z) %}{% endmacro %}{%- macro mine(a, "), a, F.lit("='x') -%}{% endmacro %}"))
    return part.select(
        F.col("p_partkey").alias("id"), text.substituted(given, {"DB": "db"}).alias("filled"), F.array_join(text.unset_variables(sql, ["DB"]), ",").alias("unset"), F.array_join(jinja.environment_reads(sql), ",").alias("reads"),
        F.array_join(jinja.jinja_calls(calls), ",").alias("calls"), F.array_join(text.macro_arguments(body, F.lit("mine")), ",").alias("args"),
    )


FIRST, SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


@query(f"""WITH k AS (SELECT unnest(['call', 'env_var', 'call', 'target', 'target', 'warehouse', 'call', 'incremental', 'call', 'call']) AS kind, unnest([1, 1, 3, 4, 4, 5, 5, 6, 6, 4]) AS line, unnest(range(10)) AS i)
SELECT p_partkey AS id, CAST(line + CASE WHEN i > 1 THEN p_size % 3 ELSE 0 END AS BIGINT) AS line, kind, CASE i WHEN 0 THEN 'env_var' WHEN 1 THEN CASE WHEN p_type = 'LARGE' THEN '' ELSE 'P_' || {FIRST} END WHEN 2 THEN {SECOND} || '_m' WHEN 3 THEN 'schema' WHEN 4 THEN {FIRST} WHEN 5 THEN 'run_query' WHEN 6 THEN 'run_query' WHEN 7 THEN '' WHEN 8 THEN 'is_incremental' ELSE 'target.get' END AS name FROM part, k""")
def template_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and reads of invented templates, with strings, comments, raw blocks, tests, filters and plain text that hold none."""
    a, b = (F.get(F.split("p_name", " "), F.lit(k)) for k in (0, 1))
    variable = F.when(F.col("p_type") == "LARGE", "DB_PASSWORD").otherwise(F.concat(F.lit("P_"), a))
    code = F.concat(
        F.lit("select target.schema from t -- env_var('A') {{ env_var('"), variable, F.lit("') }}"), F.repeat(F.lit("\n"), F.col("p_size") % 3),
        F.lit("{# hidden(1) \n #}{% raw %} {{ f(x) }} {% endraw %}\n{{ "), b, F.lit('_m("say g(x)") | h(2) }} {{ x.y.z(1) }}{% if 3 is odd(1) and 4 is not even(2) %}\n{%- set x = target.schema ~ target.type ~ target.get("'), a,
        F.lit('") ~ target["threads"] %}\n{{ run_query(  "select k(1)") }}\n{% if is_incremental () and y.target.name %} z() { p() } {{ unclosed(1)'),
    )
    return jinja.table(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code.alias("code"))).withColumn("line", F.col("line").cast("long"))
