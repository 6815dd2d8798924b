"""Queries over the star schema read as columns, jobs, macros and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import against, cards, columns, jobs, lineage, macros, merging, ranking, reports, resolve
from quillgraph.operators.traverse import Graph
from quillgraph.plans import project
from quillgraph.plans.model_queries import META, meta
from quillgraph.plans.project import ROLES_SQL, node_id, table
from quillgraph.plans.registry import longs, one, query

# --- names -------------------------------------------------------------------------------------

ASKED = ["small_ring", "SMALL_RING.V30", "7", "nothing", "red_bolt.v30", "blue_bolt"]
SHOWN = "name || CASE WHEN version IS NOT NULL THEN '.v' || version ELSE '' END"


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta(spark, sf_dir).withColumn("base", F.col("name"))
    return m.withColumn("name", F.when(F.col("version").isNotNull(), F.concat("base", F.lit(".v"), "version")).otherwise(F.col("base"))).withColumn("enabled", ~F.col("disabled"))


@query(f"""WITH {META}, m AS (SELECT id, {SHOWN} AS shown, name AS base, package, version, NOT disabled AS enabled FROM meta), a AS (SELECT unnest({ASKED}) AS asked),
b AS (SELECT *, row_number() OVER (PARTITION BY package, base ORDER BY CAST(version AS DOUBLE) DESC, version DESC) AS k FROM m WHERE version IS NOT NULL),
f AS (SELECT asked, id, enabled, 0 AS turn FROM a JOIN m ON CAST(id AS VARCHAR) = asked UNION ALL SELECT asked, id, enabled, 1 FROM a JOIN m ON shown = asked UNION ALL SELECT asked, id, enabled, 2 FROM a JOIN m ON lower(shown) = lower(asked)
UNION ALL SELECT asked, id, enabled, 3 FROM a JOIN b ON base = asked WHERE k = 1), t AS (SELECT asked, min(turn * 2 + CASE WHEN enabled THEN 0 ELSE 1 END) AS best FROM f GROUP BY 1),
p AS (SELECT f.asked, count(DISTINCT id) AS n, min(id) AS id FROM f JOIN t ON t.asked = f.asked AND best = turn * 2 + CASE WHEN enabled THEN 0 ELSE 1 END GROUP BY 1)
SELECT a.asked, CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0) AS n FROM a LEFT JOIN p ON p.asked = a.asked""")
def node_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = shown(spark, sf_dir)
    m = m.withColumn("rank", F.col("id"))  # ids break ties of equal versions
    asked = spark.createDataFrame([(a,) for a in ASKED], "asked string")
    return resolve.node_by_name(m, asked)


@query(f"""WITH {META}, r AS (SELECT name, arg_min(id, row(-(CASE WHEN disabled THEN 0 ELSE 2 END + CASE WHEN kind = 'model' THEN 1 ELSE 0 END), id)) AS id FROM meta GROUP BY name),
a AS (SELECT DISTINCT name AS asked FROM meta UNION SELECT 'nothing') SELECT asked, id FROM a LEFT JOIN r ON r.name = asked""")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta(spark, sf_dir).withColumn("enabled", ~F.col("disabled"))
    return resolve.references(m, m.select(F.col("name").alias("asked")).union(spark.createDataFrame([("nothing",)], "asked string")))


@query(f"""WITH {META}, a AS (SELECT unnest(['Ring', 'small', 'zz', 'economy', 'd_box']) AS asked), h AS (SELECT asked, id, name, kind <> 'test' AS written, CASE WHEN lower(name) = lower(asked) THEN 0 WHEN starts_with(lower(name), lower(asked)) THEN 1 WHEN contains(lower(name), lower(asked)) THEN 2 ELSE 3 END AS score
FROM a JOIN meta ON contains(lower(name), lower(asked)) OR contains(lower(path), lower(asked))), k AS (SELECT *, row_number() OVER (PARTITION BY asked, written ORDER BY score, strlen(name), name, id) AS turn FROM h),
w AS (SELECT *, max(written) OVER (PARTITION BY asked) AS best FROM k WHERE turn <= 5) SELECT asked, id, name, turn FROM w WHERE written = best QUALIFY row_number() OVER (PARTITION BY asked, name ORDER BY turn) = 1""")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(resolve.suggestions(meta(spark, sf_dir).select("id", "name", "kind", "path"), ["Ring", "small", "zz", "economy", "d_box"]), "turn")


@query("SELECT a.p_partkey AS id_a, b.p_partkey AS id_b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name = b.p_name WHERE a.p_size < 3 AND b.p_size > 45")
def same_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.where("p_size < 3").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("schema"), F.concat(F.lit('"'), F.upper("p_name"), F.lit('"')).alias("name"))
    return resolve.same_places(a, part.where("p_size > 45").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("schema"), F.col("p_name").alias("name")))


MACROS = "mac AS (SELECT DISTINCT p_brand AS package, split_part(p_name, ' ', 1) AS name, p_brand || '.' || split_part(p_name, ' ', 1) AS id FROM part WHERE p_size < 3 OR (p_brand = 'Brand#1' AND p_size < 30))"


def named_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring_index("p_name", " ", 1)
    return table(spark, sf_dir, "part").where("p_size < 3 or (p_brand = 'Brand#1' and p_size < 30)").select(F.col("p_brand").alias("package"), word.alias("name"), F.concat_ws(".", "p_brand", word).alias("id")).distinct()


@query(f"""WITH {MACROS}, c AS (SELECT p_partkey AS caller, p_brand AS package, split_part(p_name, ' ', 1) AS m, CASE WHEN p_size > 40 THEN 'Brand#2.' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) END AS call FROM part)
SELECT caller, call, CASE WHEN call LIKE '%.%' THEN x.id ELSE coalesce(o.id, r.id) END AS macro FROM c LEFT JOIN mac o ON o.package = c.package AND o.name = m LEFT JOIN mac r ON r.package = 'Brand#1' AND r.name = m LEFT JOIN mac x ON x.id = call""")
def macro_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring_index("p_name", " ", 1)
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("caller"), F.col("p_brand").alias("package"), F.when(F.col("p_size") > 40, F.concat(F.lit("Brand#2."), word)).otherwise(word).alias("call"))
    return resolve.macro_calls(calls, named_macros(spark, sf_dir), "Brand#1")


@query(f"""WITH {MACROS} SELECT id, CAST(CASE WHEN name = 're' THEN 0 WHEN name LIKE 're%' THEN 1 ELSE 2 END AS BIGINT) AS step FROM mac WHERE name LIKE '%re%' ORDER BY step, package <> 'Brand#1', strlen(name), name, package, id LIMIT 20""")
def macro_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macros.search(named_macros(spark, sf_dir), " RE ", "Brand#1", 20)


# --- columns -----------------------------------------------------------------------------------

TOP = "SELECT 'nation.' || s_nationkey AS src, 'supplier.' || s_suppkey AS dst, 'rename' AS role FROM supplier"
CE = f"{ROLES_SQL}, ce AS ({TOP} UNION ALL SELECT src, dst, role FROM r)"


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "supplier").select(node_id("nation", "s_nationkey").alias("src"), node_id("supplier", "s_suppkey").alias("dst"), F.lit("rename").alias("role"), F.lit(-1).cast("long").alias("src_model"), (F.col("s_suppkey") % 50).alias("model"))
    return top.unionByName(project.roles(spark, sf_dir).select("src", "dst", "role", "src_model", "model"))


@query(f"""WITH {CE}, d AS (SELECT dst AS id, bool_and(role <> 'passthrough') AS stop FROM r WHERE src = 'supplier.3' GROUP BY 1)
SELECT 'supplier.3' AS id, 0::BIGINT AS distance, false AS stop UNION ALL SELECT 'nation.' || s_nationkey, -1, false FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT id, 1, stop FROM d""")
def column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(columns.column_lineage(column_edges(spark, sf_dir), one(spark, "supplier.3"), 2, 2), "distance")


@query(f"""WITH {CE} SELECT 'supplier.3' AS id, 0::BIGINT AS distance, false AS stop UNION ALL SELECT 'nation.' || s_nationkey, -1, false FROM supplier WHERE s_suppkey = 3
UNION ALL SELECT DISTINCT CASE WHEN role = 'passthrough' THEN dst ELSE 'model ' || model END, 1, role <> 'passthrough' FROM r WHERE src = 'supplier.3'""")
def column_lineage_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(columns.column_lineage(column_edges(spark, sf_dir), one(spark, "supplier.3"), 1, 1, "models"), "distance")


@query(f"""WITH {CE}, s AS (SELECT dst AS id FROM ce WHERE src = 'nation.3'), p AS (SELECT DISTINCT dst AS id FROM r WHERE src IN (SELECT id FROM s)) SELECT 1::BIGINT AS distance, (SELECT count(*) FROM s) AS n, false AS more UNION ALL SELECT 2, count(*), true FROM p""")
def column_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = columns.column_lineage(column_edges(spark, sf_dir), one(spark, "nation.3"), 2, 2)
    return columns.column_levels(walk, 1)


@query("""SELECT DISTINCT l_suppkey AS node, 'KEY' AS "column", l_orderkey AS rule, o_orderpriority AS clause FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'""")
def column_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_suppkey").alias("node"), F.lit("Key").alias("column"))).alias("columns"))
    rules = lines.join(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("rule"), F.col("o_orderpriority").alias("clause"), "columns")
    return columns.rules_of(rules, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.lit("KEY").alias("column")))


@query(f"""WITH {CE}, e AS (SELECT DISTINCT src, dst FROM ce), s AS (SELECT 'supplier.' || s_suppkey AS id FROM supplier WHERE s_nationkey < 5)
SELECT s.id, (SELECT count(*) FROM e WHERE e.dst = s.id) AS up, (SELECT count(*) FROM e WHERE e.src = s.id) AS down FROM s""")
def column_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(node_id("supplier", "s_suppkey").alias("id"))
    return columns.reach_table(column_edges(spark, sf_dir).select("src", "dst"), own)


@query(f"""WITH {ROLES_SQL} SELECT src_model AS other, 'above' AS side, count(*) AS n, count(*) FILTER (role <> 'passthrough') AS rows FROM r WHERE model = 7 AND src_model <> 7 GROUP BY 1
UNION ALL SELECT model, 'below', count(*), count(*) FILTER (role <> 'passthrough') FROM r WHERE src_model = 7 AND model <> 7 GROUP BY 1""")
def model_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.model_box(project.roles(spark, sf_dir), 7).select("other", "side", "n", "rows")


@query(f"""WITH {ROLES_SQL}, c AS (SELECT DISTINCT model, dst AS col FROM r WHERE src = 'supplier.3') SELECT model, '{{"depth":1,"columns":["' || string_agg(col, '","' ORDER BY col) || '"]}}' AS answer FROM c GROUP BY model""")
def column_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = project.roles(spark, sf_dir).where("src = 'supplier.3'")
    return columns.by_model(r.select("model", F.col("dst").alias("column"), F.lit(1).alias("depth")))


@query("""SELECT DISTINCT l_suppkey AS node, CASE WHEN s_nationkey < 9 THEN -1 ELSE 2 END AS distance, o_orderpriority AS clause, l_returnflag AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey""")
def rules_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("node"), F.col("o_orderpriority").alias("clause"), F.col("l_returnflag").alias("text"))
    far = F.when(F.col("s_nationkey") < 9, F.array(F.lit(-1), F.lit(4))).otherwise(F.array(F.lit(2), F.lit(-3)))
    return cards.rules_answer(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.explode(far).alias("distance")), rules)


# --- what columns are built from -----------------------------------------------------------------


@query(f"""WITH {CE}, h AS (SELECT DISTINCT dst AS seed, src AS mid, role <> 'passthrough' AS row FROM r), w AS (SELECT seed, e.src AS id, row FROM h JOIN ({TOP}) e ON e.dst = mid),
f AS (SELECT seed, id, bool_and(row) AS row FROM w GROUP BY 1, 2) SELECT seed, id, CASE WHEN NOT row THEN 'copy' END AS class, row FROM f WHERE NOT row OR id NOT IN (SELECT 'nation.' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0)
UNION ALL SELECT DISTINCT seed, 'region.' || n_regionkey, NULL, true FROM w JOIN nation ON id = 'nation.' || n_nationkey WHERE n_nationkey % 5 = 0""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all parts' columns; regions decide the rows of every fifth nation, which then is no source of rows itself."""
    nation = table(spark, sf_dir, "nation")
    kept = nation.where("n_nationkey % 5 = 0").select(node_id("region", "n_regionkey").alias("src"), node_id("nation", "n_nationkey").alias("dst"), F.lit("filter").alias("role"))
    edges = column_edges(spark, sf_dir).select("src", "dst", "role").unionByName(kept)
    sources = nation.select(node_id("nation", "n_nationkey").alias("id")).union(table(spark, sf_dir, "region").select(node_id("region", "r_regionkey")))
    return against.fingerprints(edges, table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id")), sources)


SOURCES = f"""{CE}, p AS (SELECT 'part.' || p_partkey AS id FROM part), w AS (SELECT DISTINCT p.id, e.src FROM p JOIN r ON r.dst = p.id JOIN ({TOP}) e ON e.dst = r.src WHERE r.role = 'passthrough')"""


@query(f"WITH {SOURCES} SELECT id, count(*) AS n, string_agg(src, ',' ORDER BY src) AS sources FROM w GROUP BY id")
def value_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id"))
    return against.value_sources(column_edges(spark, sf_dir), seeds, table(spark, sf_dir, "nation").select(node_id("nation", "n_nationkey").alias("id")))


@query(f"WITH {SOURCES} SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.id = p.id AND src IN ('nation.3', 'nation.4')) THEN 2 ELSE 0 END AS depth FROM p")
def fingerprint_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").select(node_id("part", "p_partkey").alias("id"))
    return against.depth_to(column_edges(spark, sf_dir), seeds, one(spark, "nation.3", "nation.4"))


@query(f"""WITH {CE}, v AS (SELECT DISTINCT src, dst FROM ce WHERE role IN ('rename', 'passthrough')), d AS (SELECT src AS seed, dst AS id, 1 AS h FROM v WHERE src IN ('nation.3', 'nation.4', 'nation.5') UNION ALL
SELECT a.src, b.dst, 2 FROM v a JOIN v b ON b.src = a.dst WHERE a.src IN ('nation.3', 'nation.4', 'nation.5')) SELECT id, count(DISTINCT seed) AS hits, min(h) AS hops FROM d GROUP BY id ORDER BY hits DESC, hops, id LIMIT 20""")
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against.candidates(column_edges(spark, sf_dir), one(spark, "nation.3", "nation.4", "nation.5"))


@query("""WITH f AS (SELECT l_partkey AS seed, l_suppkey AS id, max(CASE l_returnflag WHEN 'A' THEN 'copy' ELSE 'hashed' END) AS class FROM lineitem GROUP BY 1, 2), a AS (SELECT f.* FROM f JOIN part ON p_partkey = seed WHERE p_size = 7), b AS (SELECT f.* FROM f JOIN part ON p_partkey = seed WHERE p_size = 8)
SELECT a.seed AS seed_a, b.seed AS seed_b, count(*) AS shares, count(*) FILTER (a.class = b.class) AS agree FROM a JOIN b ON a.id = b.id GROUP BY 1, 2""")
def class_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "copy").otherwise("hashed")
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("seed"), F.col("l_suppkey").alias("id")).agg(F.max(kind).alias("class"))
    of = lambda k: f.join(table(spark, sf_dir, "part").where(F.col("p_size") == k).select(F.col("p_partkey").alias("seed")), "seed", "left_semi")
    return against.same_classes(of(7), of(8))


# --- jobs --------------------------------------------------------------------------------------

JOBS = """jobs AS (SELECT s_suppkey AS job, CASE WHEN s_acctbal > 8000 THEN 2 WHEN s_acctbal > 7000 THEN 1 ELSE 0 END AS own, CASE WHEN s_nationkey < 12 AND s_suppkey > 0 THEN s_suppkey // 2 WHEN s_nationkey = 12 THEN -1 END AS after, s_nationkey AS k FROM supplier),
flow AS (SELECT after AS src, job AS dst FROM jobs WHERE after >= 0 UNION ALL SELECT p.job, w.job FROM jobs w JOIN jobs p ON p.k = w.k - 12 WHERE w.k > 12),
st(job, start) AS (SELECT job, greatest(own, CASE WHEN after = -1 THEN 1 WHEN k > 12 AND NOT EXISTS (SELECT 1 FROM jobs p WHERE p.k = jobs.k - 12) THEN 1 ELSE 0 END) FROM jobs UNION SELECT dst, start FROM st JOIN flow ON src = job),
starts AS (SELECT job, max(start) AS start FROM st GROUP BY job)"""


def job_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey")
    own = F.when(F.col("s_acctbal") > 8000, 2).when(F.col("s_acctbal") > 7000, 1).otherwise(0)
    after = F.when((k < 12) & (F.col("s_suppkey") > 0), F.floor(F.col("s_suppkey") / 2)).when(k == 12, F.lit(-1))
    defined = s.select(F.col("s_suppkey").alias("job"), own.alias("own"), after.alias("after"), F.lit(False).alias("hidden"))
    waits = s.where("s_nationkey > 12").select(F.col("s_suppkey").alias("job"), (k - 12).alias("asset"))
    return jobs.starts(defined, waits, s.select(F.col("s_suppkey").alias("job"), k.alias("asset")))


@query(f"WITH RECURSIVE {JOBS} SELECT job, CAST(start AS BIGINT) AS start FROM starts")
def job_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(job_starts(spark, sf_dir), "start")


STEPS = "steps AS (SELECT l_suppkey || '.' || l_linenumber AS step, l_suppkey AS job, CASE WHEN l_quantity >= 49 THEN 'p' || l_partkey END AS id, l_tax > 0.079 AND l_quantity > 40 AS wants FROM lineitem)"
NODES = "nodes AS (SELECT 'p' || p_partkey AS id, CASE p_type WHEN 'LARGE' THEN 'seed' WHEN 'SMALL' THEN 'snapshot' WHEN 'PROMO' THEN 'test' ELSE 'model' END AS kind, p_size < 5 AS ephemeral, p_brand AS package FROM part)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(".", "l_suppkey", "l_linenumber").alias("step"), c("l_suppkey").alias("job"), F.when(c("l_quantity") >= 49, F.concat(F.lit("p"), c("l_partkey").cast("string"))).alias("id"), ((c("l_tax") > 0.079) & (c("l_quantity") > 40)).alias("wants")
    )


def job_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "LARGE", "seed").when(F.col("p_type") == "SMALL", "snapshot").when(F.col("p_type") == "PROMO", "test").otherwise("model")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), kind.alias("kind"), (F.col("p_size") < 5).alias("ephemeral"), F.col("p_brand").alias("package"))


@query(f"""WITH RECURSIVE {JOBS}, {STEPS}, {NODES}, b AS (SELECT id, max(start) AS start FROM steps JOIN starts USING (job) WHERE id IS NOT NULL GROUP BY id), o AS (SELECT step, count(id) AS n, bool_or(wants) AS wants FROM steps GROUP BY 1)
SELECT nodes.id, CASE WHEN kind = 'model' AND ephemeral THEN 'ephemeral' WHEN start IS NULL THEN 'never' WHEN start = 0 THEN 'unscheduled' ELSE 'unread' END AS list FROM nodes LEFT JOIN b ON b.id = nodes.id WHERE kind <> 'test' AND ((kind = 'model' AND ephemeral) OR coalesce(start, 0) < 2)
UNION ALL SELECT step, CASE WHEN wants THEN 'unresolved' ELSE 'empty' END FROM o WHERE wants OR n = 0""")
def job_coverage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.coverage(job_nodes(spark, sf_dir), steps(spark, sf_dir), job_starts(spark, sf_dir))


@query(f"""WITH RECURSIVE {JOBS}, {STEPS}, {NODES}, b AS (SELECT id, max(start) AS start FROM steps JOIN starts USING (job) WHERE id IS NOT NULL GROUP BY id), o AS (SELECT step, count(id) AS n, bool_or(wants) AS wants FROM steps GROUP BY 1),
d AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size > 40) SELECT nodes.id, CASE WHEN kind = 'model' AND ephemeral THEN 'ephemeral' WHEN start IS NULL THEN 'never' WHEN start = 0 THEN 'unscheduled' ELSE 'unread' END AS list FROM nodes LEFT JOIN b ON b.id = nodes.id WHERE kind <> 'test' AND ((kind = 'model' AND ephemeral) OR coalesce(start, 0) < 2)
AND package = 'Brand#2' AND nodes.id NOT IN (SELECT id FROM d) UNION ALL SELECT step, CASE WHEN wants THEN 'unresolved' ELSE 'empty' END FROM o WHERE wants OR n = 0""")
def job_coverage_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one package's nodes, without those of large parts, which are disabled."""
    off = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") > 40).alias("disabled"))
    return jobs.coverage(job_nodes(spark, sf_dir).join(off, "id"), steps(spark, sf_dir), job_starts(spark, sf_dir), "Brand#2")


@query(f"""WITH {STEPS}, {NODES}, x AS (SELECT DISTINCT job, id FROM steps WHERE id IS NOT NULL) SELECT job, count(*) FILTER (kind = 'model') AS models, count(*) FILTER (kind = 'seed') AS seeds, count(*) FILTER (kind = 'snapshot') AS snapshots, count(DISTINCT package) AS packages FROM x JOIN nodes USING (id) GROUP BY job""")
def models_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.models_by_job(steps(spark, sf_dir), job_nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {JOBS}, {STEPS} SELECT id, steps.job, CAST(start AS BIGINT) AS start, count(DISTINCT step) AS steps FROM steps JOIN starts USING (job) WHERE id IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 9) GROUP BY ALL""")
def jobs_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").where("p_size = 9").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return longs(jobs.jobs_of(steps(spark, sf_dir), job_starts(spark, sf_dir), ids), "start")


@query(f"""WITH {STEPS}, w AS (SELECT l_suppkey AS job, list_sort(list_distinct(list(l_returnflag)))[1:2] AS a FROM lineitem WHERE l_quantity < 3 GROUP BY 1)
SELECT steps.job, count(DISTINCT step) AS steps, count(DISTINCT id) AS nodes, min(id) AS first, coalesce(array_to_string(any_value(a), ','), '') AS waits FROM steps LEFT JOIN w ON w.job = steps.job GROUP BY 1""")
def job_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_suppkey").alias("job"), F.col("l_returnflag").alias("asset"))
    return jobs.job_answer(steps(spark, sf_dir), waits, 2)


@query("""WITH RECURSIVE o AS (SELECT s_suppkey // 2 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 0), c(a, b) AS (SELECT a, b FROM o UNION SELECT c.a, o.b FROM c JOIN o ON o.a = c.b), s AS (SELECT DISTINCT l_suppkey AS step, l_partkey AS id FROM lineitem),
n AS (SELECT p_partkey AS id, p_partkey // 2 AS need FROM part WHERE p_partkey > 1), x AS (SELECT n.id, need, m.step AS mine, t.step AS theirs FROM n JOIN s m ON m.id = n.id JOIN s t ON t.id = need WHERE m.step <> t.step)
SELECT id, need, CASE WHEN bool_or(EXISTS (SELECT 1 FROM c WHERE c.a = theirs AND c.b = mine)) THEN 'ordered' WHEN bool_or(EXISTS (SELECT 1 FROM c WHERE c.a = mine AND c.b = theirs)) THEN 'reversed' ELSE 'unordered' END AS verdict FROM x GROUP BY 1, 2""")
def job_order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("step"), F.col("l_partkey").alias("id")).distinct()
    half = lambda c: F.floor(F.col(c) / 2)
    needs = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("id"), half("p_partkey").alias("need"))
    order = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(half("s_suppkey").alias("before"), F.col("s_suppkey").alias("after"))
    return jobs.order_pairs(own, needs, order)


@query("""WITH RECURSIVE o AS (SELECT s_suppkey // 2 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 0), c(a, b) AS (SELECT a, b FROM o UNION SELECT c.a, o.b FROM c JOIN o ON o.a = c.b),
g AS (SELECT 1000000 + n_nationkey AS dst, s_suppkey AS src FROM nation JOIN supplier ON s_nationkey = n_nationkey), up AS (SELECT dst, src, src AS before FROM g UNION SELECT dst, src, c.a FROM g JOIN c ON c.b = src),
m AS (SELECT dst, before FROM up GROUP BY 1, 2 HAVING count(DISTINCT src) = (SELECT count(*) FROM g WHERE g.dst = up.dst)) SELECT b AS point, a AS before FROM c UNION SELECT dst, before FROM m""")
def job_order_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surely ends before each supplier's job, and before a point of each nation that waits on any of its suppliers."""
    s = table(spark, sf_dir, "supplier")
    points = s.where("s_suppkey > 0").select(F.floor(F.col("s_suppkey") / 2).alias("src"), F.col("s_suppkey").alias("dst"))
    groups = s.select((F.col("s_nationkey") + 1_000_000).cast("long").alias("dst"), F.lit("a").alias("asset"), F.col("s_suppkey").alias("src"))
    return jobs.ancestors_all(points, groups)


@query("""WITH b AS (SELECT event_id, user_id, ts, value, 'a' AS origin FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id, ts, NULL, 'b' FROM events WHERE event_type = 'click'), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
max(CASE WHEN value >= 10 THEN ts END) OVER (PARTITION BY user_id) AS last_success FROM b) SELECT user_id, event_id, origin, last_success FROM k WHERE k = 1""")
def builds_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value", F.lit("a").alias("origin"))
    both = jobs.union_of_builds(a, e.where("event_type = 'click'").select("event_id", "user_id", "ts", F.lit("b").alias("origin")))
    return ranking.last_rows(both, ["user_id"], "ts", "event_id", F.coalesce(F.col("value") >= 10, F.lit(False))).select("user_id", "event_id", "origin", "last_success")


# --- macros ------------------------------------------------------------------------------------

MAC = """calls AS (SELECT s_suppkey AS caller, s_suppkey // 2 AS callee FROM supplier WHERE s_suppkey // 2 <> s_suppkey AND s_nationkey > 4), users AS (SELECT DISTINCT l_suppkey AS macro, l_partkey AS node FROM lineitem WHERE l_quantity > 25),
written AS (SELECT DISTINCT l_suppkey AS macro, l_partkey AS node FROM lineitem WHERE l_quantity <= 25 EXCEPT SELECT macro, node FROM users)"""
MWALK = f"""{MAC}, up(macro, caller, d) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_nationkey < 6 UNION SELECT macro, calls.caller, d + 1 FROM up JOIN calls ON callee = up.caller), nearest AS (SELECT macro, caller, min(d) AS d FROM up GROUP BY 1, 2),
rows AS (SELECT n.macro, node, CASE WHEN d = 0 THEN 0 ELSE 1 END AS how, d FROM nearest n JOIN users u ON u.macro = caller UNION ALL SELECT n.macro, node, 2, d FROM nearest n JOIN written w ON w.macro = caller),
usage AS (SELECT macro, node, min(row(how, d)) AS x FROM rows GROUP BY 1, 2)"""


def macro_graph(spark: SparkSession, sf_dir: str) -> macros.MacroGraph:
    s, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("macro"), F.col("l_partkey").alias("node"), "l_quantity")
    calls = s.where("s_nationkey > 4").select(F.col("s_suppkey").alias("caller"), F.floor(F.col("s_suppkey") / 2).alias("callee"))
    return macros.build(s.select(F.col("s_suppkey").alias("id")), lines.where("l_quantity > 25").drop("l_quantity"), lines.where("l_quantity <= 25").drop("l_quantity"), calls)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_nationkey < 6").select(F.col("s_suppkey").alias("macro"))


@query(f"WITH RECURSIVE {MWALK} SELECT macro, node, CASE struct_extract(x, 1) WHEN 0 THEN 'listed' WHEN 1 THEN 'through' ELSE 'written' END AS how, CAST(struct_extract(x, 2) AS BIGINT) AS depth FROM usage")
def macro_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(macros.walk(macro_graph(spark, sf_dir), _asked(spark, sf_dir)), "depth")


@query(f"""WITH RECURSIVE {MWALK} SELECT macro, p_type AS kind, count(*) AS n, count(*) FILTER (struct_extract(x, 1) = 1) AS through, count(*) FILTER (struct_extract(x, 1) = 2) AS written FROM usage JOIN part ON p_partkey = node GROUP BY 1, 2""")
def macro_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    return macros.tally(macros.walk(macro_graph(spark, sf_dir), _asked(spark, sf_dir)), nodes)


FEW = """calls AS (SELECT s_suppkey AS caller, s_suppkey // 2 AS callee FROM supplier WHERE s_suppkey // 2 <> s_suppkey), reached(id) AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9500 UNION SELECT callee FROM reached JOIN calls ON caller = id),
mn AS (SELECT s_suppkey AS id, 'p' || s_nationkey % 3 AS package, CASE s_nationkey WHEN 1 THEN 'materialization_x_default' WHEN 2 THEN 'test_y' WHEN 3 THEN 'other__m4' WHEN 5 THEN 'materialization_x_mysql' ELSE 'm' || s_nationkey END AS name FROM supplier),
tool(id) AS (SELECT id FROM mn WHERE name = 'm7' UNION SELECT callee FROM tool JOIN calls ON caller = id),
why AS (SELECT id, CASE WHEN id IN (SELECT id FROM tool) THEN 'tool' WHEN name = 'materialization_x_default' THEN 'run' WHEN name LIKE 'materialization_%' THEN 'dispatch' WHEN id IN (SELECT callee FROM calls) THEN 'macros' WHEN name LIKE 'test_%' THEN 'test' WHEN name = 'other__m4' THEN 'dispatch' ELSE 'none' END AS why FROM mn WHERE id NOT IN (SELECT id FROM reached))"""


def few_macros(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, macros.MacroGraph, DataFrame]:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey")
    name = F.when(k == 1, "materialization_x_default").when(k == 2, "test_y").when(k == 3, "other__m4").when(k == 5, "materialization_x_mysql").otherwise(F.concat(F.lit("m"), k.cast("string")))
    all_of = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("package"), name.alias("name"))
    listed = s.where("s_acctbal > 9500").select(F.lit("n").alias("node"), F.col("s_suppkey").alias("macro"))
    graph = macros.build(all_of, listed, listed.limit(0), s.select(F.col("s_suppkey").alias("caller"), F.floor(F.col("s_suppkey") / 2).alias("callee")))
    return all_of, graph, macros.why(all_of, graph, F.col("name") == "m7", macros.winners(all_of, "snowflake", {}, "p1", []))


@query(f"WITH RECURSIVE {FEW} SELECT id, why FROM why")
def macro_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_macros(spark, sf_dir)[2]


@query(f"WITH RECURSIVE {FEW} SELECT why, package || '.' || name AS call, id FROM why JOIN mn USING (id) WHERE package = 'p1'")
def macro_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_of, _, reasons = few_macros(spark, sf_dir)
    return macros.report(reasons, all_of, "p1")


@query(f"""WITH RECURSIVE {FEW}, c AS (SELECT callee AS id, name, row_number() OVER (PARTITION BY callee ORDER BY name) AS k FROM calls JOIN mn ON mn.id = caller), cc AS (SELECT id, string_agg(name, ',' ORDER BY name) AS callers, count(*) AS n FROM c GROUP BY 1)
SELECT mn.id, CASE WHEN mn.id IN (SELECT id FROM reached) THEN 1 ELSE 0 END::BIGINT AS users, coalesce(callers, '') AS callers, coalesce(n, 0) AS callers_of, why FROM mn LEFT JOIN cc ON cc.id = mn.id LEFT JOIN why ON why.id = mn.id""")
def macro_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_of, graph, reasons = few_macros(spark, sf_dir)
    usage = macros.walk(graph, all_of.select(F.col("id").alias("macro")))
    return macros.card(all_of, usage, reasons, graph.calls)


@query("""WITH x AS (SELECT s_suppkey AS id, s_nationkey % 5 AS m, CASE WHEN s_nationkey < 8 THEN 2 WHEN s_nationkey < 16 THEN 0 END AS near, CASE WHEN s_nationkey % 4 = 0 THEN 2 WHEN s_nationkey % 4 = 1 THEN 0 ELSE 1 END AS loc FROM supplier),
y AS (SELECT *, max(row(near, loc)) OVER (PARTITION BY m) AS top, bool_or(loc = 0) OVER (PARTITION BY m) AS b FROM x WHERE near IS NOT NULL), z AS (SELECT * FROM y WHERE NOT (struct_extract(top, 2) = 1 AND b AND loc = 1)), w AS (SELECT *, max(row(near, loc)) OVER (PARTITION BY m) AS best FROM z)
SELECT 'm' || m AS materialization, id FROM w WHERE row(near, loc) = best""")
def materialization_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey")
    on = F.when(k < 8, "duck").when(k < 16, "default").otherwise("other")
    package = F.when(k % 4 == 0, "root").when(k % 4 == 1, "tool").otherwise("pkg")
    return macros.winners(s.select(F.col("s_suppkey").alias("id"), package.alias("package"), F.concat(F.lit("materialization_m"), (k % 5).cast("string"), F.lit("_"), on).alias("name")), "duck", {}, "root", ["tool"])


@query(f"""WITH RECURSIVE {MAC}, down(node, macro) AS (SELECT node, macro FROM users UNION SELECT node, callee FROM down JOIN calls ON caller = macro) SELECT DISTINCT node, 'v' || s_nationkey AS read FROM down JOIN supplier ON s_suppkey = macro WHERE s_acctbal < 0""")
def environment_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("macro"), F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("read"))
    return macros.node_reads(macro_graph(spark, sf_dir), reads)


# --- reports -----------------------------------------------------------------------------------


@query(f"""WITH {META}, f AS (SELECT 'kind' AS facet, kind AS key FROM meta UNION ALL SELECT 'materialized', materialized FROM meta UNION ALL SELECT 'version', coalesce(version, 'unset') FROM meta UNION ALL SELECT 'folder', 'models' FROM meta UNION ALL SELECT 'folder', 'models/' || folder FROM meta) SELECT facet, key, count(*) AS n FROM f GROUP BY 1, 2""")
def project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return reports.overview(meta(spark, sf_dir), {"kind": c("kind"), "materialized": c("materialized"), "version": c("version")}, "path", 3)


@query(f"WITH {META} SELECT folder, count(*) AS n, count(*) FILTER (kind = 'model') AS model, count(*) FILTER (kind = 'source') AS source, count(*) FILTER (materialized = 'view') AS view FROM meta GROUP BY 1")
def folder_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.folder_tally(meta(spark, sf_dir), F.col("folder"), ["model", "source"], ["view"])


@query(f"WITH {META}, k AS (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS k FROM meta WHERE p_size > 40) SELECT kind, count(*) AS n, string_agg(name, ',' ORDER BY name) FILTER (k <= 3) AS names FROM k GROUP BY 1")
def selection_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta(spark, sf_dir)
    return reports.selection_tally(m, m.where("p_size > 40").select("id"), 3)


RUN = "res AS (SELECT CASE WHEN event_id < 100 THEN 'model' WHEN event_type = 'view' THEN 'test' ELSE 'seed' END || '.' || event_id AS id, event_type, CASE event_type WHEN 'view' THEN 'Success' WHEN 'purchase' THEN 'warn' WHEN 'click' THEN 'runtime_error' WHEN 'signup' THEN 'skipped' ELSE 'fail' END AS status, user_id FROM events)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    of = F.when(F.col("event_id") < 100, "model").when(kind == "view", "test").otherwise("seed")
    raw = F.when(kind == "view", "Success").when(kind == "purchase", "warn").when(kind == "click", "runtime_error").when(kind == "signup", "skipped").otherwise("fail")
    return e.select(F.concat_ws(".", of, F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), raw.alias("status"), of.alias("kind"), "event_type")


@query(f"WITH {RUN}, k AS (SELECT *, split_part(id, '.', 1) AS kind FROM res WHERE event_type <> 'error') SELECT kind, count(*) AS ran, count(*) AS of, count(*) FILTER (status = 'Success') AS ok, count(*) FILTER (status = 'runtime_error') AS bad FROM k GROUP BY 1")
def run_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return reports.run_kinds(r.select("id", "status"), r.where("event_type <> 'error'").select("id", "kind", F.lit(True).alias("runs")))


@query(f"""WITH {RUN}, l AS (SELECT CASE WHEN event_type IN ('click', 'error') THEN 'problem' WHEN event_type = 'purchase' THEN 'warned' ELSE 'skipped' END AS list, id, 'u' || user_id AS name, CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'warn' ELSE 'skipped' END AS status FROM res WHERE event_type <> 'view'),
k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY status <> 'error', name, id) AS turn, count(*) OVER (PARTITION BY list) AS of FROM l) SELECT list, turn, id, status, of FROM k WHERE turn <= CASE list WHEN 'problem' THEN 50 ELSE 20 END""")
def run_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(reports.run_lists(results(spark, sf_dir), {"problem": 50, "warned": 20, "skipped": 20}), "turn")


@query(f"WITH {RUN} SELECT DISTINCT id FROM res WHERE event_type = 'error'")
def run_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return reports.gone(r.select("id"), r.where("event_type <> 'error'").select("id"))


@query(f"""WITH {META}, m AS (SELECT *, CASE WHEN p_size < 15 THEN 'no' ELSE 'none' END AS fresh, folder || '_id' AS key FROM meta WHERE NOT disabled), t AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50), u AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 49),
md AS (SELECT * FROM m WHERE kind = 'model'), k AS (SELECT id, key, p_size % 2 = 0 AS conf, p_size % 3 = 0 AS tested, materialized = 'incremental' AS inc, p_size > 25 AND materialized = 'incremental' AS ign FROM md WHERE p_size > 3)
SELECT 'sources_without_freshness' AS rule, id, '' AS detail FROM m WHERE kind = 'source' AND fresh = 'no' UNION ALL SELECT 'sources_not_read', id, '' FROM m WHERE kind = 'source' AND id NOT IN (SELECT id FROM u)
UNION ALL SELECT 'models_without_test', id, '' FROM md WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT 'models_without_description', id, '' FROM md WHERE p_size < 8
UNION ALL SELECT 'keys_maybe_null', id, 'key ' || key || ': no not_null on ' || key FROM k WHERE NOT (ign AND conf AND NOT tested) AND id NOT IN (SELECT id FROM t)
UNION ALL SELECT 'unique_keys_untested', id, 'unique_key ' || key FROM k WHERE inc AND NOT ign AND conf AND NOT tested UNION ALL SELECT 'models_without_key', id, '' FROM md WHERE id NOT IN (SELECT id FROM k WHERE tested)""")
def project_seven_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, size = table(spark, sf_dir, "lineitem"), F.col("p_size")
    inc = F.col("materialized") == "incremental"
    m = meta(spark, sf_dir).where("not disabled").withColumns({"fresh": F.when(size < 15, "no").otherwise("none"), "description": F.when(size < 8, " ").otherwise("about"), "incremental": inc, "ignored": inc & (size > 25)})
    keys = m.where("p_size > 3").select("id", F.concat("folder", F.lit("_id")).alias("key"), F.array(F.concat("folder", F.lit("_id"))).alias("columns"), (size % 2 == 0).alias("in_config"), (size % 3 == 0).alias("tested"))
    tested = lines.where("l_quantity = 50").select(F.col("l_partkey").alias("id")).distinct()
    covered = tested.join(m.select("id", F.concat("folder", F.lit("_id")).alias("column")), "id")
    return reports.checks(m, tested, lines.where("l_quantity = 49").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), keys, covered)


@query(f"WITH {META} SELECT folder, path AS file, name, id, materialized AS detail FROM meta ORDER BY folder, file, name, id, detail LIMIT 100")
def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ordered(meta(spark, sf_dir).select("folder", F.col("path").alias("file"), "name", "id", F.col("materialized").alias("detail")), 100)


@query(f"WITH {ROLES_SQL} SELECT count(*) AS edges, count(*) FILTER (dst NOT IN (SELECT 'part.' || p_partkey FROM part WHERE p_size > 5)) AS dropped, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity = 50) AS partial FROM r")
def cache_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size > 5").select(node_id("part", "p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").select(node_id("supplier", "s_suppkey")))
    return reports.provenance(project.roles(spark, sf_dir), nodes, table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("node"), F.lit("c").alias("column")))


@query("WITH c AS (SELECT user_id AS project, min(ts) AS at FROM events GROUP BY 1), m AS (SELECT user_id AS project, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c.project, coalesce(c.at < m.at, false) AS stale FROM c LEFT JOIN m USING (project)")
def stale_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return reports.stale(e.groupBy(F.col("user_id").alias("project")).agg(F.min("ts").alias("at")), e.where("event_type = 'view'").groupBy(F.col("user_id").alias("project")).agg(F.max("ts").alias("at")))


@query("WITH r AS (SELECT p_brand AS reason, count(*) AS n FROM part WHERE p_size < 30 GROUP BY 1 ORDER BY n DESC, reason LIMIT 3) SELECT (SELECT count(*) FROM part) AS models, (SELECT count(*) FROM part WHERE p_size >= 30) AS parsed, string_agg(reason, ',' ORDER BY n DESC, reason) AS reasons FROM r")
def producer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.producer_summary(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 30, F.col("p_brand")).alias("reason")))


@query("SELECT count(*) AS total, count(*) FILTER (p_size < 30) AS agree FROM part")
def env_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.substituted(F.concat(F.lit("{{ env_var('A') }}"), F.col("p_brand")), {"A": "x"})
    return reports.agreement(table(spark, sf_dir, "part").select(found.alias("found"), F.when(F.col("p_size") < 30, F.concat(F.lit("x"), "p_brand")).otherwise("other").alias("parsed")))


@query("SELECT 'large' AS report, count(*) AS n, count(*) > 0 AS filled FROM part WHERE p_type = 'LARGE' UNION ALL SELECT 'huge', 0, false")
def reports_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return reports.index({"large": part.where("p_type = 'LARGE'"), "huge": part.where("p_size > 1000")})


# --- cards -------------------------------------------------------------------------------------

LINKS = "l AS (SELECT DISTINCT l_suppkey AS src, 100000000 + l_partkey AS dst FROM lineitem)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


CARD = "l AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta(spark, sf_dir)
    return m.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "name", "kind", "path", "disabled", (~F.col("disabled")).alias("enabled"), "p_size")


@query(f"""WITH {META}, {CARD}, pa AS (SELECT dst, string_agg(src, ',' ORDER BY src) AS parents FROM l GROUP BY 1) SELECT 'p' || id AS id, name, kind, path, coalesce(parents, '') AS parents, '' AS children, CASE WHEN p_size > 10 THEN 2 ELSE 1 END::BIGINT AS columns,
CASE WHEN p_size > 20 THEN 1 ELSE 0 END::BIGINT AS tested, CASE WHEN p_size > 20 THEN 1 ELSE 0 END::BIGINT AS tests FROM meta LEFT JOIN pa ON dst = 'p' || id""")
def node_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    own = b.select("id", F.explode(F.when(F.col("p_size") > 10, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("column"))
    return cards.node_card(b, _links(spark, sf_dir), own, b.where("p_size > 20").select("id", F.lit("b").alias("column")))


@query(f"""WITH {META}, {CARD}, b AS (SELECT 'p' || id AS id, name, kind, disabled FROM meta) SELECT b.id, name AS label, kind, disabled AS faded, (SELECT count(*) FROM l WHERE dst = b.id) AS n_in, 0::BIGINT AS n_out, (SELECT count(*) FROM l WHERE dst = b.id) AS hidden_up, 0::BIGINT AS hidden_down FROM b""")
def box_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, links = _boxes(spark, sf_dir), Graph.of(_links(spark, sf_dir))
    return cards.box_facts(b, lineage.degree(links.edges, b), lineage.hidden(links, b))


@query(f"""WITH {META}, {CARD}, pa AS (SELECT dst, string_agg('"' || src || '"', ',' ORDER BY src) AS parents FROM l GROUP BY 1) SELECT 'p' || id AS id, '{{"name":"' || name || '","resource_type":"' || kind || '","original_file_path":"' || path || '","unique_id":"p' || id || '","depends_on":{{"nodes":[' || coalesce(parents, '') || ']}}}}' AS line
FROM meta LEFT JOIN pa ON dst = 'p' || id""")
def sink_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.json_lines(_boxes(spark, sf_dir), _links(spark, sf_dir))


@query(f"""WITH {META}, {CARD}, c AS (SELECT name, count(*) AS k FROM meta WHERE NOT disabled GROUP BY 1), n AS (SELECT dst, count(*) AS k FROM l GROUP BY 1)
SELECT 0 AS turn, 'name' || chr(9) || 'kind' || chr(9) || 'path' || chr(9) || 'parents' || chr(9) || 'children' AS line UNION ALL SELECT 1, CASE WHEN c.k > 1 THEN 'p' || id ELSE meta.name END || chr(9) || kind || chr(9) || path || chr(9) || coalesce(n.k, 0) || chr(9) || '0' FROM meta LEFT JOIN c ON c.name = meta.name LEFT JOIN n ON n.dst = 'p' || id""")
def sink_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.compact(_boxes(spark, sf_dir), _links(spark, sf_dir))


@query("SELECT DISTINCT o_orderpriority AS project, o_orderstatus AS key FROM orders WHERE o_totalprice > 400000")
def config_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose settings name a key: a map of settings by path, exploded."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"), F.create_map(F.lit("x"), F.lit(1), F.when(F.col("o_totalprice") > 400000, F.col("o_orderstatus")).otherwise("y"), F.lit(2)).alias("settings"))
    return merging.setting_paths(rows).where("key not in ('x', 'y')").select(F.col("path").alias("project"), "key").distinct()


# --- more answers ------------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION SELECT 'x' || s_suppkey, 'y' || (s_suppkey // 2) FROM supplier UNION SELECT 'c' || n_nationkey, 'c' || (n_nationkey + 1) % 25 FROM nation UNION SELECT 'd' || n_nationkey, 'd' || (24 - n_nationkey) FROM nation),
b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), a0 AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM (SELECT DISTINCT 'n' || s_nationkey AS id FROM supplier WHERE s_suppkey IN (3, 5))),
a1 AS (SELECT id, row_number() OVER (ORDER BY via, id) - 1 + (SELECT count(*) FROM a0) AS rank FROM (SELECT dst AS id, min(rank) AS via FROM b JOIN a0 ON a0.id = src WHERE dst NOT IN (SELECT id FROM a0) GROUP BY 1)), a AS (SELECT *, 0 AS depth FROM a0 UNION ALL SELECT *, 1 FROM a1),
r0 AS (SELECT id, row_number() OVER (ORDER BY id) - 1 + (SELECT count(*) FROM a) AS rank FROM n WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT dst FROM e WHERE src <> dst)),
r1 AS (SELECT id, row_number() OVER (ORDER BY via, id) - 1 + (SELECT count(*) FROM a) + (SELECT count(*) FROM r0) AS rank FROM (SELECT dst AS id, min(rank) AS via FROM b JOIN r0 ON r0.id = src WHERE dst NOT IN (SELECT id FROM r0) GROUP BY 1)),
f AS (SELECT id, rank, 0 AS turn, depth FROM a UNION ALL SELECT *, 1, 0 FROM r0 UNION ALL SELECT *, 1, 1 FROM r1), k AS (SELECT 'd' || n_nationkey AS id, 'd' || (24 - n_nationkey) AS q FROM nation WHERE n_nationkey <> 12),
c AS (SELECT 'c' || n_nationkey AS id, least(n_nationkey, 25 - n_nationkey) AS depth FROM nation), z AS (SELECT id, depth, row_number() OVER (ORDER BY depth, k) - 1 AS rank FROM (SELECT *, CASE WHEN depth = 1 THEN id WHEN CAST(substr(id, 2) AS BIGINT) < 13 THEN '1' ELSE '2' END AS k FROM c))
SELECT id, rank, CAST(turn AS BIGINT) AS turn, CAST(depth AS BIGINT) AS depth FROM f
UNION ALL SELECT id, rank + (SELECT count(*) FROM f), 2, depth FROM z
UNION ALL SELECT id, (SELECT count(*) FROM f) + 25 + row_number() OVER (ORDER BY least(id, q), id) - 1, 2, CASE WHEN id < q THEN 0 ELSE 1 END FROM k""")
def nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers from two starts, one of which is named by a supplier's test; pairs of other things from their roots; a ring and pairs
    that only feed each other."""
    s, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = lambda c, x: F.concat(F.lit(c), (F.col(x) if isinstance(x, str) else x).cast("string"))
    n = F.col("n_nationkey")
    e = s.select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst")).union(s.select(key("x", "s_suppkey"), key("y", F.expr("s_suppkey div 2"))))
    e = e.union(nation.select(key("c", n), key("c", (n + 1) % 25))).union(nation.select(key("d", n), key("d", 24 - n)))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("name", F.col("id"))
    starts = s.where("s_suppkey = 3").select(key("n", "s_nationkey").alias("id")).union(s.where("s_suppkey = 5").select(key("t", "s_suppkey")))
    hosts = s.select(key("t", "s_suppkey").alias("test"), key("n", "s_nationkey").alias("id"))
    return longs(lineage.nearest_first(nodes, e, starts, hosts), "rank", "depth", "turn")


PASSING = "kind IN ('order', 'nation')"
ABOVE = f"""{project.nodes_sql()}, {project.edges_sql()}, w(id) AS (SELECT src FROM e WHERE dst = 'part.7' UNION SELECT e.src FROM w JOIN e ON e.dst = w.id JOIN n ON n.id = w.id WHERE {PASSING})"""


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = project.nodes(spark, sf_dir)
    return n.withColumns({"passes": F.col("kind").isin("order", "nation"), "relation": F.when(F.col("kind") == "supplier", F.col("name"))})


@query(f"WITH RECURSIVE {ABOVE} SELECT w.id, name AS relation FROM w JOIN n ON n.id = w.id WHERE kind = 'supplier'")
def upstream_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.upstream_relations(project.graph(spark, sf_dir), _passing(spark, sf_dir), one(spark, "part.7"))


@query(f"WITH RECURSIVE {ABOVE} SELECT w.id, name, kind, 'clone' AS how FROM w JOIN n ON n.id = w.id WHERE NOT {PASSING}")
def clone_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.clone_answer(project.graph(spark, sf_dir), _passing(spark, sf_dir), one(spark, "part.7"))


@query("SELECT doc_id AS id, substr(text, 1, 100) AS sql, coalesce(length(text) > 100, false) AS cut FROM documents")
def attached_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cards.attach_sql(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("path")), docs.select(F.col("doc_id").alias("path"), "text"), 100)


@query("""WITH p AS (SELECT l_suppkey AS node, 'c' || l_linenumber AS col, CASE WHEN l_returnflag = 'A' THEN 'star' ELSE 'name lost_' || lower(l_returnflag) END AS note FROM lineitem WHERE l_quantity = 50 UNION SELECT s_suppkey, 'c1', 'begins here' FROM supplier WHERE s_acctbal < 0),
x AS (SELECT DISTINCT node, col, note FROM p) SELECT node, upper(col) AS "column", string_agg(note, '; ' ORDER BY note) AS notes FROM x GROUP BY 1, 2""")
def column_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, flag = table(spark, sf_dir, "lineitem"), F.col("l_returnflag")
    col = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))
    partial = lines.where("l_quantity = 50").select(F.col("l_suppkey").alias("node"), col.alias("column"), F.when(flag == "A", "star").otherwise("name").alias("reason"), F.when(flag != "A", F.concat(F.lit("lost_"), F.lower(flag))).alias("name"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.explode(F.array(*[F.lit(f"C{k}") for k in range(1, 8)])).alias("column"))
    return cards.column_notes(own, partial, table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"), F.lit("C1").alias("column")))


@query("SELECT l_suppkey AS id, 'o' || l_orderkey || '.' || l_linenumber AS \"column\", row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, 'o' || l_orderkey || '.' || l_linenumber) AS turn FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def column_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("column"), F.col("l_orderkey").alias("ord"))
    return longs(cards.selected_columns(table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("id")), own), "turn")


@query("""WITH a AS (SELECT DISTINCT p_brand AS package, p_type AS name FROM part), v AS (SELECT 'line' AS scope, NULL AS package, 'LARGE' AS name, 'l' AS value UNION ALL SELECT DISTINCT 'package', p_brand, 'SMALL', 'of ' || p_brand FROM part WHERE p_brand < 'Brand#2' UNION ALL SELECT 'project', NULL, unnest(['SMALL', 'LARGE', 'PROMO']), 'p')
SELECT a.package, a.name, x.value, x.scope FROM a LEFT JOIN (SELECT a.package, a.name, v.value, v.scope, row_number() OVER (PARTITION BY a.package, a.name ORDER BY CASE scope WHEN 'line' THEN 0 WHEN 'package' THEN 1 ELSE 2 END) AS k FROM a JOIN v ON v.name = a.name AND (scope <> 'package' OR v.package = a.package)) x ON x.package = a.package AND x.name = a.name AND k = 1""")
def resolved_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    values = spark.createDataFrame([("line", None, "LARGE", "l"), *(("project", None, n, "p") for n in ("SMALL", "LARGE", "PROMO"))], "scope string, package string, name string, value string")
    own = part.where("p_brand < 'Brand#2'").select(F.lit("package").alias("scope"), F.col("p_brand").alias("package"), F.lit("SMALL").alias("name"), F.concat(F.lit("of "), "p_brand").alias("value")).distinct()
    return cards.resolved_variables(part.select(F.col("p_brand").alias("package"), F.col("p_type").alias("name")), values.union(own))


@query(f"""WITH {META} SELECT id, CASE WHEN package = 'Brand#3' AND folder = 'large' THEN 'Brand#3/large' ELSE package END AS path, CASE WHEN package = 'Brand#3' AND folder = 'large' THEN 'deep' ELSE 'top' END AS value FROM meta WHERE package IN ('Brand#3', 'Brand#4')""")
def setting_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([(["Brand#3"], "top"), (["Brand#4"], "top"), (["Brand#3", "large"], "deep"), (["Brand#3", "lar"], "no")], "parts array<string>, value string")
    return cards.setting_folders(meta(spark, sf_dir), settings)


@query("SELECT p_partkey AS id, CASE p_type WHEN 'LARGE' THEN 'append' WHEN 'SMALL' THEN 'merge' WHEN 'PROMO' THEN 'odd' ELSE 'merge' END AS strategy, p_type <> 'PROMO' AS known FROM part")
def incremental_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    macros_of = spark.createDataFrame([("get_incremental_default_sql", "{{ return(get_incremental_merge_sql(x)) }}"), ("get_incremental_merge_sql", "merge"), ("get_incremental_append_sql", "insert")], "name string, body string")
    strategy = F.when(F.col("p_type") == "LARGE", " Append ").when(F.col("p_type") == "SMALL", "merge").when(F.col("p_type") == "PROMO", "odd").when(F.col("p_type") == "MEDIUM", "")
    return cards.strategies(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), strategy.alias("strategy")), macros_of)


@query("""WITH f AS (SELECT o_orderpriority AS project, o_orderkey AS path, o_orderdate AS changed, o_orderstatus = 'P' AS held FROM orders WHERE o_totalprice > 50000), n AS (SELECT o_orderpriority AS project, count(*) FILTER (o_totalprice <= 50000) AS gone FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
c AS (SELECT project, count(*) FILTER (held) AS edited, count(*) FILTER (NOT held) AS committed FROM f WHERE changed > TIMESTAMP '1999-06-01' GROUP BY 1)
SELECT n.project, coalesce(edited, 0) AS edited, coalesce(committed, 0) AS committed, gone, CASE WHEN coalesce(committed, 0) + gone > 0 THEN 'stale' WHEN coalesce(edited, 0) > 0 THEN 'edited' ELSE 'fresh' END AS state FROM n LEFT JOIN c ON c.project = n.project""")
def folder_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("changed"), "o_orderstatus", "o_totalprice")
    files = o.where("o_totalprice > 50000").select("project", "path", "changed")
    return cards.folder_freshness(o.where("o_orderstatus <> 'F'"), files, F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"), o.where("o_orderstatus = 'P'").select("project", "path"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS item FROM lineitem), m AS (SELECT item FROM s WHERE owner = 1), z AS (SELECT owner, count(*) AS size FROM s GROUP BY 1), h AS (SELECT owner, count(*) AS shares FROM s WHERE item IN (SELECT item FROM m) AND owner <> 1 GROUP BY 1),
o AS (SELECT h.owner, h.shares, z.size + (SELECT count(*) FROM m) - h.shares AS total FROM h JOIN z ON z.owner = h.owner), k AS (SELECT *, row_number() OVER (ORDER BY shares::DOUBLE / total DESC, owner) AS turn FROM o) SELECT owner, shares, total, turn FROM k WHERE turn <= 20""")
def against_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item"))
    return longs(against.ranked(merging.overlaps(sets, 1)), "turn")
