"""Published tables: merges, versions, and what a crash or another writer leaves."""

from __future__ import annotations

import pytest
from quillgraph.sources.published import Overtaken, Published

SCHEMA = "src string, dst string, role string"


def rows(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=repr)


def test_merges_keep_or_replace_by_key(spark, tmp_path):
    t = Published(spark, f"{tmp_path}/t", ("src", "dst"), 4)
    with pytest.raises(FileNotFoundError):
        t.read()
    df = lambda *r: spark.createDataFrame([*r], SCHEMA)
    assert t.merge(df(("a", "x", "1"), ("A", "X", "0"), (None, "x", "n"))) == 2
    assert rows(t) == [("A", "X", "0"), (None, "x", "n")]
    assert t.merge(df(("a", "x", "2"), ("b", "y", "2"), (None, "X", "m"))) == 1
    assert rows(t) == [("A", "X", "0"), ("b", "y", "2"), (None, "x", "n")]
    assert t.merge(df(("b", "Y", "3"), ("c", "z", "3")), replace=True) == 2
    assert rows(t) == [("A", "X", "0"), ("b", "Y", "3"), ("c", "z", "3"), (None, "x", "n")]
    assert rows(t, 2) == [("A", "X", "0"), ("b", "y", "2"), (None, "x", "n")]  # an older version is still whole
    assert t.merge(df()) == 0 and t.version() == 3
    t.tidy(1)
    assert len(rows(t)) == 4 and t.merge(df(("d", "d", "4"))) == 1


def test_what_stops_before_the_last_step_changes_nothing(spark, tmp_path, monkeypatch):
    t = Published(spark, f"{tmp_path}/t", ("src", "dst"), 4)
    df = lambda *r: spark.createDataFrame([*r], SCHEMA)
    t.merge(df(("a", "x", "1")))
    for step in ("_publish", "_name"):
        with monkeypatch.context() as m:
            m.setattr(Published, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                t.merge(df(("b", "y", "2")))
        assert t.version() == 1 and rows(t) == [("a", "x", "1")]
    assert t.merge(df(("b", "y", "2"))) == 1 and rows(t) == [("a", "x", "1"), ("b", "y", "2")]
    t.tidy()
    assert rows(t) == [("a", "x", "1"), ("b", "y", "2")] and not t._names("_staged")


def test_a_writer_that_was_overtaken_starts_again(spark, tmp_path, monkeypatch):
    t = Published(spark, f"{tmp_path}/t", ("src", "dst"), 4)
    df = lambda *r: spark.createDataFrame([*r], SCHEMA)
    t.merge(df(("a", "x", "1")))
    stage, others = Published._stage, iter([df(("b", "y", "other")), df(("c", "z", "other"))])

    def staged(self, *a):
        out = stage(self, *a)
        monkeypatch.setattr(Published, "_stage", stage)
        if (more := next(others, None)) is not None:
            self.merge(more)
            monkeypatch.setattr(Published, "_stage", staged)
        return out

    monkeypatch.setattr(Published, "_stage", staged)
    assert t.merge(df(("b", "y", "mine"), ("d", "d", "mine"))) == 1
    assert rows(t) == [("a", "x", "1"), ("b", "y", "other"), ("c", "z", "other"), ("d", "d", "mine")]
    with monkeypatch.context() as m:
        m.setattr(Published, "_name", lambda *a: False)
        with pytest.raises(Overtaken):
            t.merge(df(("e", "e", "1")), tries=2)
