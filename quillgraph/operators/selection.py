"""The selection algebra: criteria over nodes, graph growth, tests by mode, and set operations.

Selections are composed in Python and stay DataFrames of ids, so Spark plans them: union, intersection and difference are those of
the *grown* sets, tests join by the mask before any of them has joined, and what is taken away is always grown eagerly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.functions.text import version_state
from quillgraph.operators.traverse import Graph, ancestors, descendants, prepared
from quillgraph.operators.walks import CHILDREN_AND_TESTS, OPEN, labelled, walk

MODES = ("eager", "cautious", "buildable", "empty")


def glob(pattern: str) -> str:
    """A regular expression for a whole string: * is any text, ? any character, the rest itself."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches(column: Column | str, pattern: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike(glob(pattern)) if re.search(r"[*?]", pattern) else column == pattern


def default_method(value: str) -> str:
    """The method of a criterion that names none."""
    if "/" in value or "\\" in value:
        return "path"
    return "file" if value.lower().endswith((".sql", ".py", ".csv")) else "fqn"


def default_method_of(value: Column) -> Column:
    """The same of each value of a column."""
    return F.when(value.contains("/") | value.contains("\\"), "path").when(F.lower(value).rlike(r"\.(sql|py|csv)$"), "file").otherwise("fqn")


def fqn_matches(fqn: Column, pattern: str, version: Column | None = None) -> Column:
    """Its last part, or a dotted prefix in which the first part with a wildcard globs all the rest; with the package or without.
    A name has as many parts as the pattern at least. With a version, a last part name.vN also goes by name_vN and by name."""
    parts = pattern.split(".")
    wild = next((i for i, p in enumerate(parts) if re.search(r"[*?]", p)), len(parts))

    def prefix(parts_of: Column) -> Column:
        fixed = F.array_join(F.slice(parts_of, 1, wild), ".") == ".".join(parts[:wild]) if wild else F.lit(True)
        if wild == len(parts):
            return (F.size(parts_of) >= wild) & fixed
        return (F.size(parts_of) >= len(parts)) & fixed & matches(F.array_join(F.slice(parts_of, wild + 1, 1_000), "."), ".".join(parts[wild:]))

    last = F.element_at(fqn, -1)
    found = matches(last, pattern) | prefix(fqn) | prefix(F.slice(fqn, 2, 1_000))
    if version is None:
        return found
    tag, base = F.concat(F.lit("v"), version), F.element_at(fqn, -2)
    versioned = version.isNotNull() & (last == tag) & (F.size(fqn) > 1)
    by_name = matches(base, pattern) | matches(F.concat_ws("_", base, tag), pattern) | matches(F.concat_ws(".", base, tag), pattern)
    return F.when(versioned, by_name | prefix(fqn) | prefix(F.slice(fqn, 2, 1_000))).otherwise(found)


def path_matches(path: Column, pattern: str) -> Column:
    """A file or a folder above it; a pattern with a wildcard may match the file or any folder above."""
    pattern = pattern.replace("\\", "/").rstrip("/")
    if not re.search(r"[*?]", pattern):
        return (path == pattern) | path.startswith(pattern + "/")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.exists(above, lambda a: a.rlike(glob(pattern)))


def file_matches(path: Column, pattern: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return matches(name, pattern) | matches(F.regexp_replace(name, r"\.[^.]*$", ""), pattern)


def tag_matches(tags: Column, pattern: str) -> Column:
    return F.exists(tags, lambda t: matches(t, pattern))


def kind_matches(kind: Column, name: str) -> Column:
    return kind == ("test" if name == "unit_test" else name)


def source_matches(kind: Column, package: Column, group: Column, name: Column, pattern: str) -> Column:
    """group, group.table or package.group.table, each part a glob; sources only."""
    parts = pattern.split(".")
    against = {1: [group], 2: [group, name], 3: [package, group, name]}.get(len(parts))
    if against is None:
        return F.lit(False)
    out = kind == "source"
    for column, part in zip(against, parts, strict=True):
        out = out & matches(column, part)
    return out


def exposure_matches(kind: Column, package: Column, name: Column, pattern: str) -> Column:
    """name or package.name as a glob; exposures only."""
    return (kind == "exposure") & (matches(name, pattern) | matches(F.concat_ws(".", package, name), pattern))


def version_matches(kind: Column, own: Column, latest: Column, which: str) -> Column:
    """latest, prerelease, old or none, of models."""
    return (kind == "model") & (version_state(own, latest) == which)


def config_matches(value: Column, pattern: str, many: bool = False) -> Column:
    """A setting by a glob; of a list, any entry."""
    return F.coalesce(F.exists(value, lambda x: matches(x, pattern)) if many else matches(value, pattern), F.lit(False))


def why_empty(nodes: DataFrame, match: Column, fqn_match: Column, with_tests: bool) -> DataFrame:
    """(why) of a criterion over nodes (kind, disabled): what alone it matches, in one pass: disabled, tests, sources or nothing."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    live = ~F.col("disabled")
    row = nodes.agg(
        any_of(match & F.col("disabled")).alias("off"), any_of(match & live & (F.col("kind") == "test")).alias("test"), any_of(fqn_match & live & (F.col("kind") == "source")).alias("source")
    )
    return row.select(F.when(F.col("off"), "disabled").when(F.col("test") & F.lit(not with_tests), "tests").when(F.col("source"), "sources").otherwise("nothing").alias("why"))


def shown(ids: DataFrame, tests: DataFrame, with_tests: bool) -> DataFrame:
    """(id, context) of a selection on the canvas: without tests, the nodes that selected tests (id, test) belong to stand for them
    as context."""
    picked = ids.select("id").distinct()
    if with_tests:
        return picked.withColumn("context", F.lit(False))
    test_ids = tests.select(F.col("test").alias("id")).distinct()
    own = picked.join(test_ids, "id", "left_anti")
    hosts = tests.join(picked.withColumnRenamed("id", "test"), "test", "left_semi").select("id").distinct().join(own, "id", "left_anti")
    return own.withColumn("context", F.lit(False)).unionByName(hosts.withColumn("context", F.lit(True)))


@dataclass
class Universe:
    """nodes: (id, …) that may be entered or crossed. edges: (src, dst). test_edges: (id, test) of tests' parents.
    sources: (id) that a buildable test may lean on."""

    nodes: DataFrame
    edges: DataFrame
    test_edges: DataFrame | None = None
    sources: DataFrame | None = None
    mode: str = "eager"
    inner: Graph = field(init=False)

    def __post_init__(self) -> None:
        ids = self.nodes.select("id").distinct()
        inner = self.edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        inner = inner.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        self.inner = Graph.of(inner, self.edges.count())  # written once for all terms

    @cached_property
    def with_test_hops(self) -> Graph:
        """Edges (src, dst, label) to children and to the tests of nodes, written once for all terms that walk to tests."""
        hops, most = labelled(self.inner.edges, "child"), self.inner.edges.count()
        if self.test_edges is not None:
            known = self.test_edges.join(self.nodes.select("id").distinct(), "id", "left_semi")
            hops = hops.unionByName(labelled(known.select(F.col("id").alias("src"), F.col("test").alias("dst")), "test"))
            most += self.test_edges.count()
        return Graph(prepared(hops, most))

    def pick(self, match: Column, up: int | None = 0, down: int | None = 0, at: bool = False, mode: str | None = None, walk_tests: bool = False) -> Selection:
        """The nodes that match, grown by `up` and `down` levels (None: all); at: with all descendants and all their ancestors. walk_tests:
        tests are children of what they test, so growth reaches them, and from them, upward, what else they test."""
        direct = self.nodes.where(match).select("id").distinct()
        if walk_tests:
            out = Scratch(self.nodes.sparkSession).save(self._grown_with_tests(direct, up, down, at))
            return Selection(self, self.with_tests(out, mode or self.mode), out, direct)
        out = direct
        if at:
            below = descendants(self.inner, direct)
            out = out.union(below).union(ancestors(self.inner, direct.union(below).distinct()))
        if up != 0:
            out = out.union(ancestors(self.inner, direct, up))
        if down != 0:
            out = out.union(descendants(self.inner, direct, down))
        out = Scratch(self.nodes.sparkSession).save(out.distinct())
        return Selection(self, self.with_tests(out, mode or self.mode), out, direct)

    def _grown_with_tests(self, direct: DataFrame, up: int | None, down: int | None, at: bool) -> DataFrame:
        """(id) of direct and what is grown around it, tests being ends of a walk downward."""
        hops = self.with_test_hops
        back = Graph(hops.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("up").alias("label")))
        below = lambda seeds, depth: walk(hops, seeds, CHILDREN_AND_TESTS, depth).select("id")
        above = lambda seeds, depth: walk(back, seeds, {(OPEN, "up"): OPEN}, depth).select("id")
        out = direct
        if at:
            out = out.union(above(below(direct, None).distinct(), None))
        if up != 0:
            out = out.union(above(direct, up))
        if down != 0:
            out = out.union(below(direct, down))
        return out.distinct()

    def with_tests(self, ids: DataFrame, mode: str) -> DataFrame:
        """ids with the tests that the mode lets join: one parent selected, all of them, or all of them buildable."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if self.test_edges is None or mode == "empty":
            return ids
        if mode == "eager":
            return ids.union(self.test_edges.join(ids, "id", "left_semi").select(F.col("test").alias("id"))).distinct()
        good = ids
        if mode == "buildable":
            good = ids.union(ancestors(self.inner, ids))
            good = (good if self.sources is None else good.union(self.sources.select("id"))).distinct()
        hit = ids.withColumn("hit", F.lit(True))
        rows = self.test_edges.join(hit, "id", "left").join(good.withColumn("good", F.lit(True)), "id", "left")
        per = rows.groupBy("test").agg(F.count("hit").alias("hits"), F.count("good").alias("goods"), F.count("*").alias("n"))
        ok = {"cautious": F.col("hits") == F.col("n"), "buildable": (F.col("hits") > 0) & (F.col("goods") == F.col("n"))}[mode]
        return ids.union(per.where(ok).select(F.col("test").alias("id"))).distinct()


@dataclass
class Selection:
    """ids with tests, bare without, and starts: what was matched itself, outside of what is taken away."""

    universe: Universe
    ids: DataFrame
    bare: DataFrame
    starts: DataFrame

    def _of(self, ids: DataFrame, bare: DataFrame, starts: DataFrame) -> Selection:
        return Selection(self.universe, ids, bare, starts)

    def __or__(self, other: Selection) -> Selection:
        return self._of(self.ids.union(other.ids).distinct(), self.bare.union(other.bare).distinct(), self.starts.union(other.starts).distinct())

    def __and__(self, other: Selection) -> Selection:
        ids = self.ids.intersect(other.ids)
        return self._of(ids, self.bare.intersect(other.bare), self.starts.union(other.starts).distinct().join(ids, "id", "left_semi"))

    def __sub__(self, other: Selection) -> Selection:
        gone = other.universe.with_tests(other.bare, "eager")
        return self._of(self.ids.join(gone, "id", "left_anti"), self.bare.join(other.bare, "id", "left_anti"), self.starts.join(gone, "id", "left_anti"))


class Named:
    """Selections by name, each resolved once, when it is first asked for; one may lean on others, but not on itself."""

    def __init__(self, universe: Universe, made: dict[str, Callable[[Named], Selection]]):
        self.universe, self.made = universe, made
        self.known: dict[str, Selection] = {}
        self.open: list[str] = []

    def __getitem__(self, name: str) -> Selection:
        if name not in self.known:
            if name in self.open:
                raise ValueError(f"selectors lean on each other: {' -> '.join([*self.open, name])}")
            self.open.append(name)
            self.known[name] = self.made[name](self)
            self.open.pop()
        return self.known[name]

    def holding(self, ids: DataFrame) -> DataFrame:
        """(selector, id) of ids (id): the selectors that hold each."""
        each = [self[n].ids.join(ids, "id", "left_semi").select(F.lit(n).alias("selector"), "id") for n in self.made]
        return reduce(DataFrame.unionByName, each)


def listing(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(name, id) of ids, in order of both; a name that several nodes share stands as the id."""
    shared = nodes.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("shared"))
    rows = nodes.join(ids.select("id").distinct(), "id", "left_semi").join(shared, "name", "left")
    return rows.select("name", "id", F.when(F.col("shared"), F.col("id")).otherwise(F.col("name")).alias("shown")).orderBy("name", "id")
