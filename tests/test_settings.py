"""Nested settings, and artifacts that are read again as they change."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import functions as F
from quillgraph.operators import settings
from quillgraph.streaming.artifacts import Artifacts


def paths_of(mapping, chain=()) -> set:
    out = set()
    for key, value in mapping.items():
        out |= paths_of(value, (*chain, key)) if isinstance(value, dict) and not key.startswith("+") else {chain}
    return out


def test_paths_of_any_depth(spark):
    deep = {"+top": 1, "a": {"b": {"c": {"+x": {"y": {"z": 1}}, "d": {"e": {"f": {"g": None}}}}, "empty": {}}, "list": [{"n": 1}], "s": "t"}, "+m": {"k": {"j": 1}}, "only": {"folders": {"h": {}}}}
    docs = {"p": {"models": deep, "tests": {"old": 1}, "data_tests": {"new": {"x": 1}}}, "q": {"models": {"a": {"+z": 1}}, "tests": {"t": {"x": []}}}, "r": {"models": [1], "seeds": "x"}, "s": {}}
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("t", None), ("u", "nonsense")]
    df = spark.createDataFrame(rows, "project string, text string").select("project", F.try_parse_json("text").alias("v"))
    got = {(r.project, r.block, tuple(r.parts)) for r in settings.tree(settings.blocks(df, ["models", "seeds", "data_tests"], {"tests": "data_tests"})).collect()}
    want = {("p", "models", p) for p in paths_of(deep)} | {("p", "data_tests", ("new",)), ("q", "models", ("a",)), ("q", "data_tests", ("t",))}
    assert got == want
    nodes = spark.createDataFrame([("p", "models", ["a", "b", "c", "m"]), ("q", "models", ["ab"]), ("q", "data_tests", ["t", "x"])], "project string, block string, fqn array<string>")
    paths = spark.createDataFrame([(p, b, list(c)) for p, b, c in got], "project string, block string, parts array<string>")
    assert {(r.project, r.block, r.path) for r in settings.unused(paths, nodes).collect()} == {("p", "models", "a.b.c.d.e.f"), ("p", "data_tests", "new"), ("q", "models", "a")}


def test_broken_files_are_tried_and_then_left_alone(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = [1_700_000_000]

    def put(name: str, text: str) -> None:
        at[0] += 10
        (folder / name).write_text(text)
        os.utime(folder / name, (at[0], at[0]))

    made = Artifacts(spark, str(folder), f"{tmp_path}/state", lambda p: F.substring_index(p, "/", -1), pattern="*.json", retries=1, buckets=2)
    state = lambda: {r.name: (r.tries, r.state) for r in made.state().collect()}
    good = lambda: {r.name: r.text for r in made.good().collect()}
    put("a.json", "{}")
    put("b.json", "{")
    put("ignored.txt", "{")
    assert made.poll() == 2 and state() == {"a.json": (1, "good"), "b.json": (1, "failing")} and good() == {"a.json": "{}"}
    assert made.poll() == 1 and state()["b.json"] == (2, "gave up") and [(r.name, r.start) for r in made.letters().collect()] == [("b.json", "{")]
    assert made.poll() == 0
    put("b.json", "[1")  # moved, so it is tried anew
    assert made.poll() == 1 and state()["b.json"] == (1, "failing")
    put("b.json", "[1]")
    put("a.json", "{{")
    assert made.poll() == 2 and state() == {"a.json": (1, "failing"), "b.json": (1, "good")} and good() == {"a.json": "{}", "b.json": "[1]"}  # the last good one stays
    Path(folder / "b.json").unlink()
    assert made.poll() == 1 and good()["b.json"] == "[1]" and len(made.letters().collect()) == 2


def test_a_poll_that_stops_halfway_is_repeated(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("{}")
    made = Artifacts(spark, str(folder), f"{tmp_path}/state", buckets=2)
    with monkeypatch.context() as m:
        m.setattr(type(made.states), "merge", lambda self, *a, **k: (_ for _ in ()).throw(KeyboardInterrupt) if self.root.endswith("states") else 0)
        try:
            made.poll()
        except KeyboardInterrupt:
            pass
    assert made.state().count() == 0 and made.poll() == 1 and made.poll() == 0 and made.good().count() == 1
