"""The scan of a column reader's report: loose shapes cost only what they would have said."""

from __future__ import annotations

import json

from quillgraph.operators import reports
from quillgraph.sources.reports import KINDS, report


def scan(spark, *docs):
    return report(spark.createDataFrame([(d if isinstance(d, str) or d is None else json.dumps(d),) for d in docs], "value string"))


def filed(r) -> dict:
    return {(f.id, f.kind): (f.detail, f.items, f.of) for f in r.findings.collect()}


def test_documents_that_are_no_reports_give_nothing(spark):
    r = scan(spark, "no json", None, "", "[1, 2]", "5", {"project": 7, "models": {"a": 1}, "totals": [1], "findings": "x", "catalog_elsewhere": 3})
    assert r.findings.count() == r.models.count() == r.notes.count() == r.totals.count() == r.written.count() == 0
    assert [h.project for h in r.head.collect()] == [""]


def test_a_reshaped_list_costs_its_kind_alone(spark):
    models = [
        3, None, {"unique_id": "a", "missing_columns": "x", "unexpected_columns": ["y", 4, None, ""], "thin": [1], "yaml_stale": "true", "unbacked": [5, {"column": 3, "cte": "k"}], "issues": {"code": "E"}},
        {"unique_id": 9, "yaml_stale": True}, {"yaml_stale": True}, {"unique_id": "b", "parse_error": ["no compiled_code"], "sql_file_set_aside": 1, "lost_columns": [{"column": "c", "ends": "none"}, {"ends": [7, {"reason": "phantom"}]}]},
        {"unique_id": "c", "thin": {"computed": -1, "declared": 2.5}, "merged_scopes": [{}], "provenance": "unresolved"}, {"unique_id": "d", "merged_scopes": [{"name": "s"}], "provenance": "parsed"},
    ]
    r = scan(spark, {"project": "p", "models": models, "totals": {"n": 1, "x": 2.5, "s": "3", "b": True}})
    assert filed(r) == {
        ("a", "columns_unexpected"): ("", ["y", ""], 0), ("a", "unbacked_read"): ("k", [], 0), ("b", "lost_unresolved"): ("", ["c"], 0), ("b", "phantom"): ("", [], 0),
        ("c", "thin"): ("0 of 0", [], 0), ("c", "merged_scope"): ("", [], 0),
    }
    assert {(t.counter, t.value) for t in r.totals.collect()} == {("n", 1.0), ("x", 2.5)}
    assert {(n.id, n.column, n.kind) for n in r.notes.collect()} == {("a", "y", "unexpected"), ("b", "c", "lost")}


def test_issues_only_where_nothing_else_is_said(spark):
    issue = [{"code": "E1"}, {"code": "E1"}, {"code": "E0"}, {"code": "S", "self_reference": True}]
    models = [{"unique_id": "a", "issues": issue}, {"unique_id": "b", "issues": issue, "yaml_stale": True}, {"unique_id": "c", "issues": issue[3:]}, {"unique_id": "a", "yaml_stale": True}]
    r = scan(spark, {"project": "p", "models": models})
    assert filed(r) == {("a", "engine_issue"): ("", ["E1", "E0"], 0), ("b", "yaml_stale"): ("", [], 0), ("a", "yaml_stale"): ("", [], 0)}
    assert [n.n for n in reports.to_investigate(r).collect()] == [2]


def test_long_lists_are_cut_and_counted(spark):
    names = [f"c{i}" for i in range(25)] + ["c0"]
    models = [{"unique_id": "a", "missing_columns": names, "ambiguous_inferred": [{"column": n, "by": "every", "chosen": names} for n in names], "parse_error": ""}]
    r = scan(spark, {"project": "p", "models": models})
    assert filed(r) == {("a", "columns_missing"): ("", names[:20], 26), ("a", "ambiguous"): ("", names[:20], 25)}
    assert all(n.of == 26 and n.names == names[:5] for n in r.notes.where("kind = 'ambiguous'").collect())


def test_worded_findings_are_what_is_to_investigate(spark):
    own = [{"title": "t", "models": [{"unique_id": "x"}, {"unique_id": ""}, 4]}, {"title": "", "models": [{"unique_id": "y"}]}, {"title": "u", "models": []}]
    docs = [{"project": "p", "models": [{"unique_id": "a", "yaml_stale": True}, {"unique_id": "b", "yaml_stale": True}], "findings": own}, {"project": "q", "models": [{"unique_id": "a", "yaml_stale": True, "parse_error": "e"}]}, {"project": "r"}]
    r = scan(spark, *docs)
    assert {(s.document, s.to_investigate, s.reasons) for s in reports.report_summary(r).collect()} == {("p", 1, ""), ("q", 1, "e x1"), ("r", 0, "")}
    assert [(w.id, w.title) for w in r.written.collect()] == [("x", "t")]
    assert len(KINDS) == 19


def test_models_move_by_edges_or_by_how_they_were_read(spark):
    a = scan(spark, {"project": "p", "models": [{"unique_id": "x", "provenance": "inferred"}, {"unique_id": "y", "provenance": "parsed"}]})
    b = scan(spark, {"project": "p", "models": [{"unique_id": "y", "provenance": "parsed"}, {"unique_id": "z", "provenance": "unresolved"}]})
    edges = spark.createDataFrame([("p", "y", "gained"), ("p", "w", "lost"), ("p", "w", "changed")], "document string, dst string, change string")
    got = {r.id: (r.gained, r.lost, r.changed, r.read_a, r.read_b) for r in reports.moved_models(a, b, edges).collect()}
    assert got == {"x": (0, 0, 0, "inferred", "parsed"), "z": (0, 0, 0, "parsed", "unresolved"), "y": (1, 0, 0, "parsed", "parsed"), "w": (0, 1, 1, "parsed", "parsed")}
