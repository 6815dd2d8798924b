"""The registry of queries over the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import aggregates, checks, components, jobs, lineage, merging, ranking, selection, traverse
from quillgraph.plans import project
from quillgraph.plans.registry import ORACLES, QUERIES, longs, one, query
from quillgraph.plans.project import ROLES_SQL, TESTS_SQL, edges_sql, node_id, nodes_sql, table
from quillgraph.streaming.refresh import daily_counts

N, E = nodes_sql(), edges_sql()


# --- traversals --------------------------------------------------------------------------------

WALK = """up(id, d) AS (SELECT 'nation.3', 0 UNION SELECT e.src, d + 1 FROM up JOIN e ON e.dst = up.id WHERE d < 2),
down(id, d) AS (SELECT 'nation.3', 0 UNION SELECT e.dst, d + 1 FROM down JOIN e ON e.src = down.id WHERE d < 2),
walk AS (SELECT id, CAST(-min(d) AS BIGINT) AS distance FROM up GROUP BY id UNION ALL
SELECT id, CAST(min(d) AS BIGINT) FROM down WHERE id NOT IN (SELECT id FROM up) GROUP BY id)"""


@query(f"WITH RECURSIVE {E}, {WALK} SELECT id, distance FROM walk")
def graph_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(lineage.lineage(project.graph(spark, sf_dir), one(spark, "nation.3"), 2, 2), "distance")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_lineage(spark, sf_dir)


@query(f"WITH RECURSIVE {E}, {WALK} SELECT src, dst FROM e WHERE src IN (SELECT id FROM walk) AND dst IN (SELECT id FROM walk)")
def graph_drawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = project.graph(spark, sf_dir)
    return lineage.drawn_edges(e, lineage.lineage(e, one(spark, "nation.3"), 2, 2))


@query(f"""WITH RECURSIVE {E}, {WALK}, w AS (SELECT id FROM walk)
SELECT w.id, (SELECT count(*) FROM e WHERE e.dst = w.id AND e.src NOT IN (SELECT id FROM w)) AS hidden_up,
(SELECT count(*) FROM e WHERE e.src = w.id AND e.dst NOT IN (SELECT id FROM w)) AS hidden_down FROM w""")
def graph_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = project.graph(spark, sf_dir)
    return lineage.hidden(e, lineage.lineage(e, one(spark, "nation.3"), 2, 2))


@query(f"""WITH RECURSIVE {N}, {E}, down(id, d) AS (SELECT 'region.1', 0 UNION SELECT e.dst, d + 1 FROM down JOIN e ON e.src = down.id WHERE d < 20),
w AS (SELECT id, min(d) AS d FROM down GROUP BY id)
SELECT CAST(d AS BIGINT) AS depth, kind AS label, count(*) AS n, CASE WHEN count(*) = 1 THEN min(name) END AS name FROM w JOIN n USING (id) WHERE d > 0 GROUP BY 1, 2""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = traverse.bfs(project.graph(spark, sf_dir), one(spark, "region.1"), 20)
    nodes = project.nodes(spark, sf_dir).withColumnRenamed("kind", "label")
    return longs(lineage.levels(nodes, walk), "depth")


@query(f"""WITH RECURSIVE {E}, r(seed, id) AS (SELECT 'nation.' || n_nationkey, e.dst FROM nation JOIN e ON e.src = 'nation.' || n_nationkey
UNION SELECT seed, e.dst FROM r JOIN e ON e.src = r.id) SELECT 'nation.' || n_nationkey AS seed, count(r.id) AS n FROM nation LEFT JOIN r ON seed = 'nation.' || n_nationkey GROUP BY 1""")
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").select(node_id("nation", "n_nationkey").alias("seed"), node_id("nation", "n_nationkey").alias("id"))
    return lineage.reach_counts(project.graph(spark, sf_dir), seeds)


@query(f"""WITH {N}, {E} SELECT n.id, coalesce(i.k, 0) AS n_in, coalesce(o.k, 0) AS n_out FROM n
LEFT JOIN (SELECT dst, count(*) AS k FROM e GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) o ON o.src = n.id""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.degree(project.graph(spark, sf_dir).edges, project.nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {N}, {E}, p(id, d) AS (SELECT id, 0 FROM n UNION SELECT e.dst, d + 1 FROM p JOIN e ON e.src = p.id)
SELECT id, CAST(max(d) AS BIGINT) AS depth FROM p GROUP BY id""")
def graph_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(lineage.layering(project.nodes(spark, sf_dir), project.graph(spark, sf_dir)), "depth")


STEPS_SQL = """s AS (SELECT user_id || '.' || event_type AS src, user_id || '.' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
x AS (SELECT DISTINCT src, dst FROM s WHERE dst IS NOT NULL)"""


CLOSED = f"{STEPS_SQL}, r(a, b) AS (SELECT src, dst FROM x UNION SELECT r.a, x.dst FROM r JOIN x ON x.src = r.b)"


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): from what a user did to what the same user did next."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", after.alias("next")).where("next is not null")
    return rows.select(F.concat_ws(".", "user_id", "event_type").alias("src"), F.concat_ws(".", "user_id", "next").alias("dst"))


@query(f"WITH RECURSIVE {CLOSED} SELECT p.a AS id, min(p.b) AS component FROM r p JOIN r q ON q.a = p.b AND q.b = p.a GROUP BY 1")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.cycles(next_steps(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSED}, i AS (SELECT src AS id FROM x UNION SELECT dst FROM x), k AS (SELECT a AS id, b FROM r UNION SELECT id, id FROM i)
SELECT p.id, min(p.b) AS component FROM k p JOIN k q ON q.id = p.b AND q.b = p.id GROUP BY 1""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.strong_components(next_steps(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSED}, i AS (SELECT src AS id FROM x UNION SELECT dst FROM x) SELECT i.id, count(r.b) FILTER (r.b <> i.id) AS n FROM i LEFT JOIN r ON r.a = i.id GROUP BY 1")
def reach_all_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.reach_all(next_steps(spark, sf_dir))


@query(f"""WITH RECURSIVE {E}, i AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT i.id, count(r.b) AS n FROM i LEFT JOIN r ON r.a = i.id GROUP BY 1""")
def reach_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes every node of the project reaches."""
    return components.reach_all(project.graph(spark, sf_dir))


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.nodes(spark, sf_dir).select("id", F.col("kind").isin("order", "nation").alias("passes"))


@query(f"""WITH RECURSIVE {N}, {E}, w(id) AS (SELECT src FROM e WHERE dst = 'part.7' UNION SELECT e.src FROM w JOIN e ON e.dst = w.id JOIN n ON n.id = w.id WHERE kind IN ('order', 'nation'))
SELECT w.id FROM w JOIN n ON n.id = w.id WHERE kind NOT IN ('order', 'nation')""")
def graph_clone_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.clone_plan(project.graph(spark, sf_dir), _passing(spark, sf_dir), one(spark, "part.7"))


@query(f"""WITH RECURSIVE {N}, {E}, w(id, top) AS (SELECT e.dst, e.src FROM e JOIN n ON n.id = e.dst WHERE kind NOT IN ('order', 'nation')
UNION SELECT w.id, e.src FROM w JOIN e ON e.dst = w.top JOIN n ON n.id = w.top WHERE kind IN ('order', 'nation'))
SELECT DISTINCT w.id, w.top AS parent FROM w JOIN n ON n.id = w.top WHERE kind NOT IN ('order', 'nation')""")
def graph_unbuilt_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.unbuilt_upstream(project.graph(spark, sf_dir), _passing(spark, sf_dir))


@query(f"""WITH RECURSIVE {E}, w(id, class) AS (SELECT 'region.' || r_regionkey, 0 FROM region UNION
SELECT e.dst, greatest(class, CASE WHEN e.dst LIKE 'supplier.%' THEN 1 WHEN e.dst LIKE 'order.%' THEN 2 ELSE 0 END) FROM w JOIN e ON e.src = w.id)
SELECT id, CAST(min(class) AS BIGINT) AS class FROM w GROUP BY id""")
def graph_best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least class of any path from a root, the largest of a path's edges being its class: a fixpoint of max and min."""
    edges = project.graph(spark, sf_dir).edges
    edges = edges.withColumn("class", F.when(F.col("dst").startswith("supplier."), 1).when(F.col("dst").startswith("order."), 2).otherwise(0))
    start = table(spark, sf_dir, "region").select(node_id("region", "r_regionkey").alias("id"), F.lit(0).alias("class"))

    def step(changed: DataFrame) -> DataFrame:
        now = changed.select(F.col("id").alias("src"), F.col("class").alias("held"))
        return edges.join(now, "src").select(F.col("dst").alias("id"), F.greatest("held", "class").alias("class"))

    return longs(traverse.fixpoint(start, step, ["id"], {"class": F.min("class")}), "class")


@query(f"""WITH RECURSIVE {ROLES_SQL}, x AS (SELECT 'nation.' || s_nationkey AS src, 'supplier.' || s_suppkey AS dst, s_acctbal < 0 AS cut FROM supplier
UNION ALL SELECT src, dst, bool_and(role <> 'passthrough') FROM r GROUP BY src, dst),
o(id, d) AS (SELECT 'nation.3', 0 UNION SELECT x.dst, d + 1 FROM o JOIN x ON x.src = o.id WHERE NOT cut AND d < 2),
s AS (SELECT x.dst AS id, min(d) + 1 AS d FROM o JOIN x ON x.src = o.id WHERE cut AND d < 2 GROUP BY 1),
f AS (SELECT id, min(d) AS d FROM o GROUP BY id)
SELECT id, CAST(d AS BIGINT) AS depth, false AS stop FROM f UNION ALL SELECT id, CAST(d AS BIGINT), true FROM s WHERE id NOT IN (SELECT id FROM f)""")
def graph_column_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down from a nation, two levels: nodes behind row edges or suppliers in debt are drawn as stops and not walked past."""
    top = table(spark, sf_dir, "supplier").select(node_id("nation", "s_nationkey").alias("src"), node_id("supplier", "s_suppkey").alias("dst"), (F.col("s_acctbal") < 0).alias("cut"))
    low = project.roles(spark, sf_dir).select("src", "dst", (F.col("role") != "passthrough").alias("cut"))
    return longs(traverse.walk_with_cuts(top.unionByName(low), one(spark, "nation.3"), F.col("cut"), 2), "depth")


# --- selections --------------------------------------------------------------------------------

PARTS_E = edges_sql("order").replace("e AS", "pe AS")
TREE = f"""{N}, {PARTS_E}, {TESTS_SQL}, u AS (SELECT * FROM n WHERE kind <> 'order'),
ue AS (SELECT src, dst FROM pe WHERE src IN (SELECT id FROM u) AND dst IN (SELECT id FROM u))"""


@project.once
def universe(spark: SparkSession, sf_dir: str) -> selection.Universe:
    nodes = project.nodes(spark, sf_dir).where("kind <> 'order'")
    part = table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id"), F.array("p_brand", "p_type").alias("tags"))
    nodes = nodes.join(part, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return selection.Universe(nodes, project.links(spark, sf_dir, "order"), project.test_rows(spark, sf_dir), nodes.where("kind = 'region'").select("id"))


def mode_sql(name: str, ids: str, mode: str) -> str:
    """ids with the tests that the mode lets join."""
    if mode == "eager":
        more = f"SELECT test FROM t WHERE id IN (SELECT id FROM {ids})"
    elif mode == "cautious":
        more = f"SELECT test FROM t GROUP BY test HAVING bool_and(id IN (SELECT id FROM {ids}))"
    else:
        more = f"SELECT test FROM t GROUP BY test HAVING bool_or(id IN (SELECT id FROM {ids})) AND bool_and(id IN (SELECT id FROM {ids}) OR id IN (SELECT id FROM {ids}_up) OR id LIKE 'region.%')"
    return f"{name} AS (SELECT id FROM {ids} UNION {more})"


@query(f"""WITH {TREE}, a AS (SELECT id FROM u WHERE kind = 'part' AND name LIKE 'small %'), b AS (SELECT 'supplier.3' AS id UNION SELECT dst FROM ue WHERE src = 'supplier.3'),
{mode_sql('am', 'a', 'eager')}, {mode_sql('bm', 'b', 'eager')} SELECT id FROM am UNION SELECT id FROM bm""")
def select_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    a = u.pick((F.col("kind") == "part") & selection.matches("name", "small *"))
    return (a | u.pick(F.col("id") == "supplier.3", down=1)).ids


@query(f"""WITH RECURSIVE {TREE}, a AS (SELECT 'part.' || p_partkey AS id FROM part WHERE p_brand LIKE 'Brand#1%'),
b(id) AS (SELECT 'nation.3' UNION SELECT dst FROM b JOIN ue ON ue.src = b.id), {mode_sql('am', 'a', 'cautious')}, {mode_sql('bm', 'b', 'cautious')} SELECT id FROM am INTERSECT SELECT id FROM bm""")
def select_intersection_cautious(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    a = u.pick(selection.tag_matches(F.col("tags"), "Brand#1*"), mode="cautious")
    return (a & u.pick(F.col("id") == "nation.3", down=None, mode="cautious")).ids


@query(f"""WITH RECURSIVE {TREE}, a(id) AS (SELECT 'nation.3' UNION SELECT dst FROM a JOIN ue ON ue.src = a.id),
a_up(id) AS (SELECT src FROM a JOIN ue ON ue.dst = a.id UNION SELECT src FROM a_up JOIN ue ON ue.dst = a_up.id),
b AS (SELECT 'part.' || p_partkey AS id FROM part WHERE p_type = 'LARGE'), {mode_sql('am', 'a', 'buildable')}, {mode_sql('bm', 'b', 'eager')} SELECT id FROM am EXCEPT SELECT id FROM bm""")
def select_except_buildable(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    a = u.pick(F.col("id") == "nation.3", down=None, mode="buildable")
    return (a - u.pick(selection.tag_matches(F.col("tags"), "LARGE"))).ids


@query(f"""WITH RECURSIVE {TREE}, d(id) AS (SELECT 'supplier.3' UNION SELECT dst FROM d JOIN ue ON ue.src = d.id),
a(id) AS (SELECT id FROM d UNION SELECT src FROM a JOIN ue ON ue.dst = a.id) SELECT id, name FROM a JOIN u USING (id)""")
def select_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    picked = u.pick(F.col("id") == "supplier.3", at=True, mode="empty")
    return u.nodes.join(picked.ids, "id", "left_semi").select("id", "name")


PAGE_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), path.alias("path"))


@query(f"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS id, {PAGE_PATH} AS path FROM pages) SELECT id,
regexp_matches(path, '^[^/]*\\.example\\.com(/|$)') AS by_path, regexp_matches(split_part(path, '/', -1), '^7.*$') AS by_file,
list_contains(string_split(path, '/')[2:2], 'en') AS by_name FROM p""")
def select_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("path", "/")
    return pages(spark, sf_dir).select(
        "id", selection.path_matches(F.col("path"), "*.example.com").alias("by_path"), selection.matches(F.element_at(parts, -1), "7*").alias("by_file"), F.exists(F.slice(parts, 2, 1), lambda x: selection.matches(x, "en")).alias("by_name")
    )


@query(f"""WITH {N}, c AS (SELECT name, count(*) AS k FROM n GROUP BY name) SELECT n.name, n.id, CASE WHEN k > 1 THEN id ELSE n.name END AS shown FROM n JOIN c ON c.name = n.name WHERE kind IN ('part', 'nation')""")
def sink_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = project.nodes(spark, sf_dir)
    return selection.listing(nodes, nodes.where("kind in ('part', 'nation')"))


# --- aggregations ------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(trim(c_mktsegment), ''), 'unset') AS key, count(*) AS n FROM customer GROUP BY 1")
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(table(spark, sf_dir, "customer"), F.col("c_mktsegment"))


@query("SELECT tag AS key, count(*) AS n FROM (SELECT unnest(list_distinct([p_brand, p_type] || string_split(p_name, ' '))) AS tag FROM part) GROUP BY 1")
def count_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by_tag(table(spark, sf_dir, "part"), F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")))


@query(f"""WITH p AS (SELECT string_split({PAGE_PATH}, '/') AS parts FROM pages), x AS (SELECT parts, unnest(range(1, least(len(parts), 4))) AS depth FROM p)
SELECT array_to_string(parts[1:depth], '/') AS folder, depth, count(*) AS n FROM x GROUP BY 1, 2""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.folder_rollup(pages(spark, sf_dir), "path", 3)


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'disabled' ELSE o_orderpriority END AS kind, count(*) AS n FROM orders GROUP BY 1")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.kind_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("disabled")))


@query("SELECT o_orderstatus, n, total FROM (SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY 1) WHERE n >= total * 0.3 AND total >= 20")
def sandbox_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sandbox(table(spark, sf_dir, "orders"), ["o_orderstatus"], 0.3)


@query(f"WITH {ROLES_SQL} SELECT role, count(*) AS n FROM r GROUP BY role")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.role_counts(project.roles(spark, sf_dir))


RANK = {"filter": 1, "join_key": 2, "dedup_key": 3}


@query(f"""WITH {ROLES_SQL}, k AS (SELECT *, CASE role WHEN 'filter' THEN 1 WHEN 'join_key' THEN 2 ELSE 0 END AS k FROM r)
SELECT src, model, CAST(max(k) AS BIGINT) AS rank FROM k WHERE k > 0 AND src_model <> model GROUP BY 1, 2""")
def row_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.strongest_roles(project.roles(spark, sf_dir), RANK)


@query(f"""WITH {ROLES_SQL}, d AS (SELECT DISTINCT src AS id, dst AS name FROM r WHERE role <> 'passthrough'), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS k FROM d)
SELECT id, string_agg(name, ',' ORDER BY name) FILTER (k <= 8) AS names, count(*) FILTER (k > 8) AS more FROM k GROUP BY id""")
def rows_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_names(project.roles(spark, sf_dir).where("role <> 'passthrough'").select(F.col("src").alias("id"), F.col("dst").alias("name")))


EVENT_STATUS = "CASE event_type WHEN 'view' THEN 'Success' WHEN 'purchase' THEN 'PASS' WHEN 'click' THEN 'runtime_error' WHEN 'signup' THEN 'no-op' ELSE event_type END"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(EVENT_STATUS).alias("status"), F.col("value").alias("seconds"))


@query("SELECT CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'error' WHEN 'signup' THEN 'noop' ELSE event_type END AS status, count(*) AS n, round(sum(value), 2) AS seconds FROM events GROUP BY 1")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.status_histogram(results(spark, sf_dir))


@query("SELECT event_id AS id, value AS seconds FROM events ORDER BY value DESC, event_id LIMIT 25")
def run_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.slowest(results(spark, sf_dir))


@query("""WITH s AS (SELECT o_custkey AS id, max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS m FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN m IS NULL THEN 'never' WHEN m = 0 THEN 'unscheduled' ELSE 'unread' END AS reason FROM customer LEFT JOIN s ON s.id = c_custkey WHERE m IS NULL OR m < 2""")
def job_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), start.alias("start"))
    return aggregates.coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), steps)


DECLARED = "d AS (SELECT l_orderkey AS owner, p_brand AS col FROM lineitem JOIN part ON p_partkey = l_partkey)"


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("column"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("owner")).join(part, "l_partkey").select("owner", "column")


@query(f"WITH {DECLARED}, k AS (SELECT array_to_string(list_sort(list_distinct(list(lower(trim(col))))), ',') AS key FROM d GROUP BY owner) SELECT key, count(*) AS n FROM k GROUP BY key")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.key_sets(declared(spark, sf_dir))


@query(f"WITH {DECLARED} SELECT owner, count(DISTINCT col) AS open FROM d WHERE owner NOT IN (SELECT owner FROM d d2 WHERE d2.owner = d.owner AND d2.col = d.col AND col IN ('Brand#1', 'Brand#2')) AND col NOT IN ('Brand#1', 'Brand#2') GROUP BY 1")
def nullable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declared(spark, sf_dir)
    return aggregates.nullable_keys(d, d.where(F.col("column").isin("Brand#1", "Brand#2")))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS n_null,
count(*) FILTER (n > 1 AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) AS n_repeated FROM k""")
def key_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.key_health(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH k AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS run FROM documents)
SELECT source, run, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM k GROUP BY 1, 2""")
def bucketed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bucketed_runs(table(spark, sf_dir, "documents"), "source", "doc_id", 100)


@query("""WITH a AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.key = b.key""")
def report_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lambda s: aggregates.count_by(table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s), F.col("o_orderpriority"))
    return aggregates.deltas(per("F"), per("P"))


@query("""SELECT 'untested' AS rule, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'undescribed', doc_id FROM documents WHERE trim(coalesce(source, '')) = ''
UNION ALL SELECT 'repeated', doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'unknown', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)""")
def project_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("description"))
    return checks.findings(nodes, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


# --- merges ------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_brand AS node, p_name AS name, lower(p_name) AS lc, CASE WHEN p_size < 25 THEN p_type ELSE '' END AS type, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part WHERE p_retailprice < 1500),
c AS (SELECT p_brand AS node, upper(p_name) AS name, lower(p_name) AS lc, p_type AS type, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part WHERE p_size >= 10)
SELECT coalesce(a.node, b.node) AS node, coalesce(a.name, b.name) AS name, coalesce(nullif(a.type, ''), b.type, '') AS type, a.name IS NULL AS undeclared
FROM (SELECT * FROM d WHERE k = 1) a FULL JOIN (SELECT * FROM c WHERE k = 1) b ON a.node = b.node AND a.lc = b.lc""")
def merge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"node": F.col("p_brand"), "ord": F.col("p_partkey")})
    d = part.where("p_retailprice < 1500").select("node", F.col("p_name").alias("name"), F.when(F.col("p_size") < 25, F.col("p_type")).otherwise("").alias("type"), "ord")
    return merging.merge_catalog(d, part.where("p_size >= 10").select("node", F.upper("p_name").alias("name"), F.col("p_type").alias("type"), "ord"))


@query(f"WITH {ROLES_SQL} SELECT src, dst, arg_min(role, ord) AS role FROM r WHERE dst IN (SELECT 'part.' || p_partkey FROM part WHERE p_size > 5) AND src IN (SELECT 'supplier.' || s_suppkey FROM supplier) GROUP BY 1, 2")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size > 5").select(node_id("part", "p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").select(node_id("supplier", "s_suppkey")))
    return merging.merge_edges(project.roles(spark, sf_dir), known)


@query(f"""WITH {ROLES_SQL}, a AS (SELECT src, dst, arg_min(role, ord) AS role FROM r WHERE status = 'F' GROUP BY 1, 2), b AS (SELECT src, dst, arg_min(role, ord) AS role FROM r WHERE status = 'O' GROUP BY 1, 2)
SELECT src, dst, role FROM a UNION ALL SELECT src, dst, role FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = b.src AND a.dst = b.dst)""")
def add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = project.roles(spark, sf_dir)
    first = lambda s: r.where(F.col("status") == s).groupBy("src", "dst").agg(F.min_by("role", "ord").alias("role"))
    return merging.add_edges(first("F"), first("O"))


@query(f"""WITH {ROLES_SQL}, a AS (SELECT src, dst, arg_min(role, ord) AS role_a FROM r WHERE status = 'F' GROUP BY 1, 2), b AS (SELECT src, dst, arg_min(role, ord) AS role_b FROM r WHERE status = 'O' GROUP BY 1, 2)
SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN role_a IS NULL THEN 'gained' WHEN role_b IS NULL THEN 'lost' ELSE 'changed' END AS change, role_a, role_b
FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst WHERE role_a IS DISTINCT FROM role_b""")
def compare_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = project.roles(spark, sf_dir)
    first = lambda s: r.where(F.col("status") == s).groupBy("src", "dst").agg(F.min_by("role", "ord").alias("role"))
    return merging.compare_edges(first("F"), first("O"))


@query("""WITH k AS (SELECT lower(p_name) AS key, p_size > 10 AS enabled, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1, 2), b AS (SELECT key, arg_max(n, enabled) AS n, arg_max(id, enabled) AS id FROM k GROUP BY 1),
o AS (SELECT DISTINCT upper(p_name) AS object FROM part UNION SELECT 'nothing') SELECT object, CASE WHEN n = 1 THEN id END AS id FROM o LEFT JOIN b ON key = lower(object)""")
def unique_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    objects = part.select(F.upper("p_name").alias("object")).distinct().union(spark.createDataFrame([("nothing",)], "object string"))
    return merging.unique_objects(objects, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 10).alias("enabled")))


@query(f"""WITH f AS (SELECT string_split({PAGE_PATH}, '/') AS fqn FROM pages), p AS (SELECT DISTINCT fqn[1:1] || ['en'] AS parts FROM f)
SELECT array_to_string(parts, '/') AS path, EXISTS (SELECT 1 FROM f WHERE fqn[1:2] = parts) AS used FROM p""")
def used_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pages(spark, sf_dir).select(F.split("path", "/").alias("fqn"))
    return merging.used_prefixes(names.select(F.array(F.get("fqn", F.lit(0)), F.lit("en")).alias("parts")).distinct(), names)


STEP = "SELECT l_partkey FROM lineitem WHERE l_quantity >= 50"


@query(f"SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN ({STEP})")
def never_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("id"))
    return jobs.never_executed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), steps)


@query(f"SELECT p_partkey AS id FROM part WHERE p_partkey IN ({STEP})")
def run_by_a_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("id"))
    return jobs.executed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), steps)


@query("""WITH s AS (SELECT DISTINCT 'supplier.' || l_suppkey AS owner, l_partkey AS item FROM lineitem), m AS (SELECT item FROM s WHERE owner = 'supplier.1'), z AS (SELECT owner, count(*) AS size FROM s GROUP BY 1)
SELECT h.owner, h.shares, z.size + (SELECT count(*) FROM m) - h.shares AS total FROM (SELECT owner, count(*) AS shares FROM s WHERE item IN (SELECT item FROM m) AND owner <> 'supplier.1' GROUP BY 1) h JOIN z ON z.owner = h.owner""")
def against_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.overlaps(table(spark, sf_dir, "lineitem").select(node_id("supplier", "l_suppkey").alias("owner"), F.col("l_partkey").alias("item")), "supplier.1")


RULE = "SELECT o_orderkey AS rule, o_orderpriority AS clause, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = '{}' GROUP BY 1, 2"


@query(f"""WITH a AS (SELECT DISTINCT clause, array_to_string(s, ',') AS sources FROM ({RULE.format('F')})), b AS (SELECT DISTINCT clause, array_to_string(s, ',') AS sources FROM ({RULE.format('P')}))
SELECT coalesce(a.clause, b.clause) AS clause, coalesce(a.sources, b.sources) AS sources, CASE WHEN a.clause IS NULL THEN 'b' WHEN b.clause IS NULL THEN 'a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.clause = b.clause AND a.sources = b.sources""")
def compare_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("rule"), F.col("o_orderpriority").alias("clause"), F.concat("l_returnflag", "l_linestatus").alias("source"), "o_orderstatus"
    )
    return merging.compare_rules(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"))


# --- rankings ----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, p_name AS name, CAST(CASE WHEN lower(p_name) = 'small ring' THEN 0 WHEN lower(p_name) LIKE 'small ring%' THEN 10 WHEN lower(p_name) LIKE '%small ring%' THEN 20 ELSE 30 END * 1000000 + least(strlen(p_name), 999) * 1000 AS BIGINT) AS score
FROM part WHERE lower(p_name) LIKE '%small ring%' OR lower(p_brand) LIKE '%small ring%' ORDER BY score, name, id LIMIT 200""")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path")), "small ring")


@query(f"""WITH p AS (SELECT {PAGE_PATH} AS path FROM pages), s AS (SELECT path, CASE WHEN split_part(path, '/', -1) = '77' THEN 0 WHEN split_part(path, '/', -1) LIKE '77%' THEN 10
WHEN split_part(path, '/', -1) LIKE '%77%' THEN 20 WHEN path LIKE '%77%' THEN 30 END AS score FROM p) SELECT path, CAST(score AS BIGINT) AS score FROM s WHERE score IS NOT NULL ORDER BY score, strlen(path), path LIMIT 50""")
def search_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search_paths(pages(spark, sf_dir), "77", 50)


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS text FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM x WHERE contains(lower(text), 'hant')) SELECT doc_id, line, text FROM k WHERE k <= 3 ORDER BY doc_id, line LIMIT 500""")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.grep(table(spark, sf_dir, "documents"), "Hant", 3, 500)


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k, max(CASE WHEN value >= 10 THEN ts END) OVER (PARTITION BY user_id, event_type) AS last_success FROM events)
SELECT user_id, event_type, event_id, ts, last_success FROM w WHERE k = 1""")
def last_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.last_rows(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", F.col("value") >= 10)
    return found.select("user_id", "event_type", "event_id", "ts", "last_success")


@query("SELECT event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 101")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = (F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 0)
    return ranking.page(table(spark, sf_dir, "events"), "ts", "event_id", before, 100).select("event_id", "ts", "user_id")


@query("SELECT c_custkey AS id, c_acctbal AS balance, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS of FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 50")
def capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return ranking.capped(rows, ["balance", "id"], 50)


@query(f"""WITH {TESTS_SQL}, k AS (SELECT id AS node, test, row_number() OVER (PARTITION BY id ORDER BY test) AS turn FROM t) SELECT node, test, turn FROM k ORDER BY turn, node, test LIMIT 300""")
def test_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project.tests(spark, sf_dir).select(F.col("id").alias("node"), "test", F.col("test").alias("name"))
    return longs(lineage.round_robin(rows, 300), "turn")


# --- scalars -----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, lower(translate('"' || p_brand || '".[' || p_name || ']', '"`[]', '')) AS relation,
CASE WHEN length(p_name || p_type) > 12 THEN substr(p_name || p_type, 1, 12) || '…' ELSE p_name || p_type END AS short,
p_size < p_partkey % 50 AS older, strftime(make_timestamp(p_partkey * 86400 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at,
CASE WHEN p_type = 'LARGE' THEN '(withheld)' ELSE p_name END AS shown FROM part""")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    quoted = F.concat(F.lit('"'), "p_brand", F.lit('".['), "p_name", F.lit("]"))
    name = F.when(F.col("p_type") == "LARGE", "DB_PASSWORD").otherwise("HOST")
    return part.select(
        F.col("p_partkey").alias("id"), text.relation_key(quoted).alias("relation"), text.cut(F.concat("p_name", "p_type"), 12).alias("short"), text.version_before(F.col("p_size"), F.col("p_partkey") % 50).alias("older"),
        text.iso_utc(F.col("p_partkey") * 86400).alias("at"), text.withheld(name, F.col("p_name")).alias("shown"),
    )


# --- streams -----------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_counts(spark, f"{sf_dir}/events.parquet")


from quillgraph.plans import artifact_queries, graph_queries, model_queries, report_queries, walk_queries  # noqa: E402, F401  they register too

__all__ = ["ORACLES", "QUERIES", "flagship"]
