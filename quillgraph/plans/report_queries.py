"""Queries over the reports that a column reader leaves, beside what the tables they are written from say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import reports, settings
from quillgraph.plans.fixture import artifact
from quillgraph.plans.project import once
from quillgraph.plans.registry import query
from quillgraph.sources.reports import KINDS, Report, documents, report


@once
def scanned(spark: SparkSession, sf_dir: str, version: int) -> Report:
    return report(documents(spark, artifact(spark, sf_dir, f"report:{version}"), lines=True))


P = "p AS (SELECT *, 'p' || (p_partkey // 200) AS document, 'model.m' || p_partkey AS id, p_partkey % 200 AS k, {s} AS s FROM part)"
PART, NEXT = P.format(s="p_size"), P.format(s="p_size % 50 + 1")
ERROR = "CASE s % 10 WHEN 1 THEN 'no compiled_code for ' || p_name WHEN 2 THEN 'syntax error in ' || p_type ELSE '' END"

#: kind, where, detail, items
SAID = (
    ("no_compiled_sql", "s % 10 = 1", ERROR, "[]"), ("parse_failed", "s % 10 = 2", ERROR, "[]"), ("compiled_elsewhere", "s % 7 = 0", "'target/' || p_partkey || '.sql'", "[]"),
    ("columns_missing", "s % 3 = 0 AND s % 10 NOT IN (1, 2)", "''", "[p_brand, p_type, p_brand]"), ("columns_unexpected", "s % 25 = 12 AND s % 10 NOT IN (1, 2)", "''", "list_transform(range(1, 26), lambda i: 'c' || i)"),
    ("yaml_stale", "s % 11 = 0", "''", "[]"), ("thin", "s % 13 = 0", "s || ' of ' || 2 * s", "[]"), ("undeclared_relation", "s % 5 = 0", "''", "[p_name, p_type]"), ("unknown_parent", "s % 19 = 0", "''", "['x', p_type]"),
    ("unbacked_read", "s % 4 = 0", "'a, b'", "[upper(p_type), 'x']"), ("merged_scope", "s % 6 = 0 AND (s % 12 = 0 OR s % 10 = 2)", "''", "[p_name]"), ("short_upstream", "s % 14 = 0", "''", "[p_brand]"), ("ambiguous", "s % 8 = 0", "''", "[p_type]"),
    ("phantom", "s % 9 = 0", "'cte1, cte0'", "['k', 'k2']"), ("lost_in_expression", "s % 9 = 0", "''", "['k']"), ("lost_unresolved", "s % 9 = 0", "''", "['k', 'n']"),
)


def found_sql(name: str, p: str) -> str:
    """The findings of p as a table."""
    each = " UNION ALL ".join(f"SELECT document, '{kind}' AS kind, id, {detail} AS detail, CAST({items} AS VARCHAR[]) AS items FROM {p} WHERE {where}" for kind, where, detail, items in SAID)
    return f"""{name}0 AS ({each}), {name} AS (SELECT * FROM {name}0 UNION ALL SELECT document, 'engine_issue', id, '', ['E' || s] FROM {p} WHERE s % 2 = 1 AND id NOT IN (SELECT id FROM {name}0)
UNION ALL SELECT document, 'catalog_elsewhere', id, p_name, [] FROM {p} WHERE s = 20 UNION ALL SELECT document, 'relation_collision', 'db.' || p_partkey, '', [id, 'model.other'] FROM {p} WHERE s = 30)"""


TURN = f"CAST(list_position({list(KINDS)}, kind) - 1 AS INTEGER)"


@query(f"WITH {PART} SELECT document, id, CASE WHEN s % 12 = 0 THEN 'inferred' WHEN s % 10 = 2 THEN 'unresolved' ELSE 'parsed' END AS provenance, {ERROR} AS parse_error, CASE WHEN s % 2 = 1 THEN 2 ELSE 0 END AS issues, 'target/' || p_partkey || '.sql' AS sql_file, s % 7 = 0 AS set_aside FROM p")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir, 1).models.drop("place")


@query(f"WITH {PART}, {found_sql('f', 'p')} SELECT document, {TURN} AS turn, kind, id, detail, array_to_string(items[1:20], ',') AS items, CASE WHEN len(items) > 20 THEN len(items) ELSE 0 END AS \"of\" FROM f")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir, 1).findings.drop("place").withColumn("items", F.array_join("items", ","))


@query(f"""WITH {PART}, n AS (SELECT document, id, lower(c) AS "column", kind, detail, names FROM p, (SELECT unnest(['missing', 'missing', 'missing', 'unbacked', 'unbacked', 'unbacked', 'read_downstream', 'ambiguous', 'ambiguous', 'lost', 'lost', 'lost', 'lost', 'lost', 'lost']) AS kind, unnest(range(15)) AS i) x,
LATERAL (SELECT CASE i WHEN 1 THEN p_type WHEN 3 THEN p_type WHEN 4 THEN p_type WHEN 5 THEN 'x' WHEN 7 THEN p_type WHEN 8 THEN 'z' WHEN 9 THEN 'k' WHEN 10 THEN 'k' WHEN 11 THEN 'k' WHEN 12 THEN 'n' WHEN 13 THEN 'k2' WHEN 14 THEN 'k2' ELSE p_brand END AS c,
CASE i WHEN 3 THEN 'a' WHEN 4 THEN 'b' WHEN 6 THEN 'cat' WHEN 7 THEN 'every' WHEN 8 THEN 'compile' WHEN 9 THEN 'phantom' WHEN 10 THEN 'names_unreached' WHEN 11 THEN 'other' WHEN 13 THEN 'phantom' WHEN 14 THEN 'phantom' ELSE '' END AS detail,
CASE WHEN i IN (3, 4, 5) THEN list_transform(range(1, s + 1), lambda j: 'o' || j) WHEN i IN (9, 13) THEN ['cte1'] WHEN i = 14 THEN ['cte0'] ELSE [] END AS names,
CASE WHEN i < 3 THEN s % 3 = 0 WHEN i < 6 THEN s % 4 = 0 WHEN i = 6 THEN s % 14 = 0 WHEN i < 9 THEN s % 8 = 0 ELSE s % 9 = 0 END AS given) WHERE given
UNION ALL SELECT document, id, 'c' || unnest(range(1, 26)), 'unexpected', '', [] FROM p WHERE s % 25 = 12)
SELECT document, id, "column", kind, detail, array_to_string(names[1:5], ',') AS names, CASE WHEN len(names) > 5 THEN len(names) ELSE 0 END AS "of" FROM n""")
def report_column_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir, 1).notes.drop("place", "ord").withColumn("names", F.array_join("names", ","))


@query(f"""WITH {PART}, {found_sql('f', 'p')}, r AS (SELECT document, {ERROR} AS why, count(*) AS n FROM p WHERE s % 10 IN (1, 2) GROUP BY 1, 2),
k AS (SELECT document, string_agg(why || ' x' || n, '; ' ORDER BY n DESC, why) AS reasons FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY document ORDER BY n DESC, why) <= 3) GROUP BY 1),
w AS (SELECT document, count(*) AS n FROM p WHERE s = 40 GROUP BY 1), d AS (SELECT document, count(DISTINCT id) AS n FROM f GROUP BY 1),
t AS (SELECT document, count(*) AS models, count(*) FILTER (s % 10 NOT IN (1, 2)) AS parsed, CAST(sum(p_size) AS BIGINT) AS from_files FROM p GROUP BY 1)
SELECT document, models, parsed, from_files, 0 AS set_aside, coalesce(reasons, '') AS reasons, coalesce(w.n, d.n, 0) AS to_investigate FROM t LEFT JOIN k USING (document) LEFT JOIN w USING (document) LEFT JOIN d USING (document)""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_summary(scanned(spark, sf_dir, 1))


@query(f"WITH {PART} SELECT document, 'catalog' AS category, 'inputs' AS owner, 'read ' || p_name AS title, s AS columns, id FROM p WHERE s = 40")
def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir, 1).written.select("document", "category", "owner", "title", "columns", "id")


def _sides(p: str) -> str:
    return f"""SELECT document, 'totals' AS part, 'models' AS key, count(*) AS n FROM {p} GROUP BY 1 UNION ALL SELECT document, 'totals', 'parsed', count(*) FILTER (s % 10 NOT IN (1, 2)) FROM {p} GROUP BY 1
UNION ALL SELECT document, 'totals', 'sql_from_files', CAST(sum(p_size) AS BIGINT) FROM {p} GROUP BY 1"""


@query(f"""WITH {PART}, {NEXT.replace("p AS", "q AS", 1)}, {found_sql('f', 'p')}, {found_sql('g', 'q')}, a AS ({_sides('p')} UNION ALL SELECT document, 'findings', kind, count(*) FROM f GROUP BY ALL), b AS ({_sides('q')} UNION ALL SELECT document, 'findings', kind, count(*) FROM g GROUP BY ALL)
SELECT document, part, key, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (document, part, key)""")
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compare_reports(scanned(spark, sf_dir, 1), scanned(spark, sf_dir, 2))


READ = "CASE WHEN s % 12 = 0 THEN 'inferred' WHEN s % 10 = 2 THEN 'unresolved' ELSE 'parsed' END"
SIDE = "SELECT 'model.m' || l_partkey AS dst, l_suppkey AS src, max(l_returnflag) AS role FROM lineitem WHERE l_linestatus = '{}' GROUP BY 1, 2"


@query(f"""WITH {PART}, x AS ({SIDE.format('F')}), y AS ({SIDE.format('O')}), e AS (SELECT coalesce(x.dst, y.dst) AS id, CASE WHEN x.dst IS NULL THEN 'gained' WHEN y.dst IS NULL THEN 'lost' ELSE 'changed' END AS change FROM x FULL JOIN y ON x.dst = y.dst AND x.src = y.src WHERE x.role IS DISTINCT FROM y.role),
m AS (SELECT id, count(*) FILTER (change = 'gained') AS gained, count(*) FILTER (change = 'lost') AS lost, count(*) FILTER (change = 'changed') AS changed FROM e GROUP BY 1)
SELECT document, id, coalesce(gained, 0) AS gained, coalesce(lost, 0) AS lost, coalesce(changed, 0) AS changed, {READ} AS read_a, {READ.replace('s %', '(s % 50 + 1) %')} AS read_b FROM p LEFT JOIN m USING (id) WHERE gained IS NOT NULL OR read_a <> read_b""")
def report_moved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' columns read by parts in order lines of either status, as two versions of a cache, beside the two reports."""
    from quillgraph.operators import merging
    from quillgraph.plans.project import table

    key = F.concat(F.lit("model.m"), F.col("l_partkey").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(key.alias("dst"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_returnflag").alias("role"), "l_linestatus", F.expr("'p' || (l_partkey div 200)").alias("document"))
    side = lambda s: lines.where(F.col("l_linestatus") == s).groupBy("src", "dst").agg(F.max("role").alias("role"))
    changes = merging.compare_edges(side("F"), side("O")).join(lines.select("dst", "document").distinct(), "dst")
    return reports.moved_models(scanned(spark, sf_dir, 1), scanned(spark, sf_dir, 2), changes)


BODY = "CASE WHEN m > 45 THEN '{\"+tags\":[\"a\"]}' WHEN m > 40 THEN '{\"deep\":{\"materialized\":\"view\",\"meta\":{\"owner\":\"me\"}}}' ELSE '{}' END"
FOLDERS = "f AS (SELECT p_brand AS project, p_type, split_part(p_name, ' ', 1) AS first, max(p_size) AS m FROM part GROUP BY ALL)"
PATHS = f"""{FOLDERS}, t AS (SELECT project, 'models' AS block, project AS path FROM f UNION SELECT project, 'models', project || '.' || p_type FROM f WHERE p_type = 'LARGE' UNION SELECT project, 'models', project || '.' || p_type || '.' || first FROM f WHERE m > 45
UNION SELECT project, 'models', project || '.' || p_type || '.' || first || unnest(['.deep', '.deep.meta']) FROM f WHERE m BETWEEN 41 AND 45 UNION SELECT project, 'data_tests', '' FROM f UNION SELECT project, 'data_tests', 'none' FROM f)"""


def settings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, v) of invented projects, a brand each: settings of folders by type and the first word of a name, three levels and more."""
    from quillgraph.plans.project import table

    part = table(spark, sf_dir, "part").withColumn("first", F.get(F.split("p_name", " "), F.lit(0)))
    per = part.groupBy("p_brand", "p_type", "first").agg(F.max("p_size").alias("m"))
    entry = lambda key, value: F.concat(F.lit('"'), key, F.lit('":'), value)
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    types = per.groupBy("p_brand", "p_type").agg(joined(entry(F.col("first"), F.expr(BODY))).alias("b"))
    more = F.when(F.col("p_type") == "LARGE", ',"+enabled":true').otherwise("")
    brands = types.groupBy("p_brand").agg(joined(entry(F.col("p_type"), F.concat(F.lit("{"), "b", more, F.lit("}")))).alias("b"))
    doc = F.concat(F.lit('{"seeds":5,"tests":{"+severity":"warn","none":{"x":1}},"models":{"'), "p_brand", F.lit('":{"+schema":"x",'), "b", F.lit("}}}"))
    return brands.select(F.col("p_brand").alias("project"), F.parse_json(doc).alias("v"))


def tree_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.tree(settings.blocks(settings_of(spark, sf_dir), ["models", "seeds", "data_tests"], {"tests": "data_tests"}))


@query(f"WITH {PATHS} SELECT * FROM t")
def config_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_of(spark, sf_dir).select("project", "block", F.array_join("parts", ".").alias("path"))


@query(f"WITH {PATHS} SELECT * FROM t WHERE path LIKE '%.deep%' OR path = 'none'")
def config_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that begin no part's full name: what is deeper than the folders, and a folder that no test has."""
    from quillgraph.plans.project import table

    part = table(spark, sf_dir, "part")
    fqn = F.array("p_brand", "p_type", F.get(F.split("p_name", " "), F.lit(0)), "p_name")
    own = part.select(F.col("p_brand").alias("project"), F.explode(F.array(F.lit("models"), F.lit("data_tests"))).alias("block"), fqn.alias("fqn"))
    return settings.unused(tree_of(spark, sf_dir), own)


@query("""WITH p AS (SELECT p_partkey // 200 AS k, count(*) AS n FROM part GROUP BY 1) SELECT 'project=' || k AS name, CASE k % 4 WHEN 2 THEN 'failing' WHEN 3 THEN 'gave up' ELSE 'good' END AS state, CASE k % 4 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 1 END AS tries,
CASE WHEN k % 4 <> 3 THEN n END AS models, k % 4 IN (1, 3) AS dead FROM p""")
def stream_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of projects that arrive whole, or broken and then whole, or whole and then broken, or broken for good, polled six times."""
    from quillgraph.functions.scratch import Scratch
    from quillgraph.plans.project import table
    from quillgraph.streaming.artifacts import Artifacts

    scratch = Scratch(spark)
    folder = scratch.path()
    k = F.expr("p_partkey div 200")
    per = table(spark, sf_dir, "part").groupBy(k.alias("project")).agg(F.to_json(F.struct(F.count("*").alias("models"))).alias("text"))
    left = F.col("project") % 4
    broken = F.when(left.isin(1, 3), F.lit('{"models": ')).otherwise(F.col("text"))
    later = F.when(left == 1, F.col("text")).otherwise(F.lit('{"mod'))
    put = lambda rows, text: rows.select("project", text.alias("value")).repartition("project").write.mode("append").partitionBy("project").text(folder)
    name = lambda path: F.element_at(F.split(path, "/"), -2)
    made = Artifacts(spark, folder, scratch.path(), name, pattern="*.txt")
    put(per, broken)
    for _ in range(4):  # the last of them has nothing to do
        made.poll()
    put(per.where(left.isin(1, 2)), later)
    made.poll()
    good = made.good().select("name", F.get_json_object("text", "$.models").cast("long").alias("models"))
    dead = made.letters().select("name", F.lit(True).alias("dead")).distinct()
    rows = made.state().join(good, "name", "left").join(dead, "name", "left")
    return rows.select("name", "state", "tries", "models", F.coalesce("dead", F.lit(False)).alias("dead"))
