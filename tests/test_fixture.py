"""Artifacts that are kept as lines."""

from __future__ import annotations

import json

from quillgraph.operators import building
from quillgraph.plans.fixture import artifact
from quillgraph.sources import artifacts

DATA = "/root/testdata/sf0.001"


def test_files_do_not_grow_with_runs_and_projects(spark):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind in ("results", "cache:1:F"):
        files = artifacts.file_index(spark, artifact(spark, DATA, kind)).count()
        assert 0 < files <= most


def test_a_document_a_line_gives_the_rows_of_a_document_a_file(spark, tmp_path):
    runs = ['{"metadata": {"invocation_id": "%s"}, "results": [{"unique_id": "a\\nb%s", "execution_time": 1.5}, {"unique_id": "c"}]}' % (k, k) for k in range(5)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "files").mkdir()
    (tmp_path / "lines" / "all.json").write_text("\n".join(runs))
    for k, run in enumerate(runs):
        (tmp_path / "files" / f"{k}.json").write_text(run)
    rows = lambda where, lines: sorted(artifacts.run_results(spark, str(tmp_path / where), lines).collect(), key=repr)
    assert rows("lines", True) == rows("files", False) and len(rows("lines", True)) == 10


def test_manifests_are_lines_that_do_not_grow_with_projects(spark):
    """Many projects to a file, packed, each still a document of its own."""
    path = artifact(spark, DATA, "manifest")
    assert 0 < artifacts.file_index(spark, path).count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    projects = spark.read.text(path).selectExpr("get_json_object(value, '$.metadata.project_name') AS p")
    assert projects.count() == projects.distinct().count() == 25
    assert artifacts.manifest(spark, path, lines=True).nodes.select("project").distinct().count() == 25


def test_a_manifest_in_lines_gives_what_its_file_gives(spark, tmp_path):
    node = lambda name, parents: {"name": name, "resource_type": "model", "depends_on": {"nodes": parents}}
    docs = [{"metadata": {"project_name": p}, "nodes": {"m.a": node("a", ["s.x"]), "m.b": node("b", ["m.a", "m.a"])}, "sources": {"s.x": {"name": "x"}, "m.b": {"name": "again"}}} for p in "pq"]
    (tmp_path / "files").mkdir()
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, docs)))
    for i, doc in enumerate(docs):
        (tmp_path / "files" / f"{i}.json").write_text(json.dumps(doc))
    for path, lines in ((tmp_path / "files", False), (tmp_path / "lines.json", True)):
        m = artifacts.manifest(spark, str(path), lines)
        known = building.nodes(m)
        assert sorted((r.project, r.id, r.shown) for r in known.collect()) == sorted((p, i, s) for p in "pq" for i, s in (("m.a", "a"), ("m.b", "b"), ("s.x", "x")))
        assert sorted((r.project, r.src, r.dst) for r in building.edges(m, known).collect()) == sorted((p, *e) for p in "pq" for e in (("m.a", "m.b"), ("s.x", "m.a")))
