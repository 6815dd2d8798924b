"""The star schema read as a project: tables as kinds of nodes, foreign keys as edges, orders as tests of parts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.traverse import Graph

_MADE: dict[tuple, object] = {}


def once(fn: Callable) -> Callable:
    """fn(spark, sf_dir, …), made once in a Spark application for as long as the folder's files stay as they are."""

    @wraps(fn)
    def made(spark: SparkSession, sf_dir: str, *args):
        path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        stamp = tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found))
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, sf_dir, stamp, *args)
        if key not in _MADE:
            _MADE[key] = fn(spark, sf_dir, *args)
        return _MADE[key]

    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}."), F.col(key).cast("string"))


#: kind, table, key, name
KINDS = (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("order", "orders", "o_orderkey", None))
#: parent kind, its key, child kind, its key, table
LINKS = (("region", "n_regionkey", "nation", "n_nationkey", "nation"), ("nation", "c_nationkey", "customer", "c_custkey", "customer"), ("nation", "s_nationkey", "supplier", "s_suppkey", "supplier"), ("customer", "o_custkey", "order", "o_orderkey", "orders"), ("supplier", "l_suppkey", "part", "l_partkey", "lineitem"), ("order", "l_orderkey", "part", "l_partkey", "lineitem"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind)"""
    each = [
        table(spark, sf_dir, t).select(node_id(kind, key).alias("id"), (F.col(name) if name else node_id(kind, key)).alias("name"), F.lit(kind).alias("kind"))
        for kind, t, key, name in KINDS
    ]
    return reduce(DataFrame.unionByName, each)


def links(spark: SparkSession, sf_dir: str, but: str = "") -> DataFrame:
    """(src, dst), as often as rows say so; but: a kind to leave out."""
    each = [
        table(spark, sf_dir, t).select(node_id(a, ka).alias("src"), node_id(b, kb).alias("dst"))
        for a, ka, b, kb, t in LINKS
        if but not in (a, b)
    ]
    return reduce(DataFrame.unionByName, each)


def edges(spark: SparkSession, sf_dir: str, but: str = "") -> DataFrame:
    """The same, each once."""
    return links(spark, sf_dir, but).distinct()


@once
def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The project's edges, prepared for all walks over it."""
    return Graph.of(links(spark, sf_dir))


def nodes_sql() -> str:
    each = [f"SELECT '{k}.' || {key} AS id, {name or f"'{k}.' || {key}"} AS name, '{k}' AS kind FROM {t}" for k, t, key, name in KINDS]
    return f"n AS ({' UNION ALL '.join(each)})"


def edges_sql(but: str = "") -> str:
    each = [f"SELECT '{a}.' || {ka} AS src, '{b}.' || {kb} AS dst FROM {t}" for a, ka, b, kb, t in LINKS if but not in (a, b)]
    return f"e AS ({' UNION '.join(each)})"


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, test): an order tests the parts it holds, as often as its lines say so."""
    return table(spark, sf_dir, "lineitem").select(node_id("part", "l_partkey").alias("id"), node_id("order", "l_orderkey").alias("test"))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each once."""
    return test_rows(spark, sf_dir).distinct()


TESTS_SQL = "t AS (SELECT DISTINCT 'part.' || l_partkey AS id, 'order.' || l_orderkey AS test FROM lineitem)"


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, role, src_model, model, ord, status): supplier to part, as columns of lineage with roles."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        node_id("supplier", "l_suppkey").alias("src"), node_id("part", "l_partkey").alias("dst"), F.when(flag == "A", "filter").when(flag == "R", "join_key").otherwise("passthrough").alias("role"),
        (F.col("l_suppkey") % 50).alias("src_model"), (F.col("l_partkey") % 50).alias("model"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice").alias("ord"), F.col("l_linestatus").alias("status"),
    )


ROLES_SQL = """r AS (SELECT 'supplier.' || l_suppkey AS src, 'part.' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'filter' WHEN 'R'
THEN 'join_key' ELSE 'passthrough' END AS role, l_suppkey % 50 AS src_model, l_partkey % 50 AS model,
row(l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS ord, l_linestatus AS status FROM lineitem)"""
