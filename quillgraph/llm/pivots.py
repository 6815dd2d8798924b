"""Near-duplicate vectors by an exact metric range join over pivots.

Vectors are normalised, so that a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Pivots are drawn by
a hash from each label's vectors; a vector's home is the cell of its nearest pivot. If y is within r of x, whose home is i, then
d(y, pivot i) <= d(x, pivot i) + r <= d(x, home of y) + r <= d(y, home of y) + 2r, by the triangle inequality; so y is copied to
every cell i with d(y, pivot i) <= d(y, its home's pivot) + 2r, and each cell joins its home vectors with all of its vectors,
apart from other cells. A little slack covers rounding; the link itself is the cosine in double precision, of vectors scaled by powers
of two, so that squares of very large or small components neither overflow nor vanish.

How many pivots a label gets grows with its vectors, to their square root at most, and is what costs least by a sample of them: where
vectors lie in clusters, many cells; where all lie about as far from each other, so that a pivot separates nothing, few. Labels with
fewer vectors than a chunk need none, and so do those beyond the largest `groups`: they join by chunks alone, with the same links.

Equal vectors are one class with a count, so copies are compared once. Cells above `cell` vectors are dealt into units of chunk
pairs, so a task holds two chunks whatever the cell's size. Links are counted and never listed: each unit gives a count for each
vector, and the edges of a forest that spans its links. Components are found from those edges, distributed.

Null labels or ids, null or zero vectors, and vectors with null or non-finite components link with nothing: no links, a component of
their own. Vectors of unlike lengths aren't compared. Ties go to the smaller vec_id; an empty table gives no rows; other columns
are ignored; rows of one vec_id count as one vector each and share the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, components, map_arrow, n_parts, table


@dataclass(frozen=True)
class Near:
    """cosine: of a link at least. cell: vectors of a chunk. groups: labels (with lengths) that get pivots, the largest first.
    sample_mb: of vectors that the driver draws pivots from, for all labels. row_cost: of a vector sent to a chunk, in
    comparisons of two vectors."""

    cosine: float = 0.98
    cell: int = 2000
    groups: int = 1000
    sample_mb: float = 32.0
    row_cost: float = 200.0


def usable(column: str) -> Column:
    """Whether a vector has components, all finite, and not all zero."""
    x = F.col(column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return x.isNotNull() & F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False))) & F.exists(x, lambda v: v != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that the largest component of each is between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row of x, and whether it goes to each cell."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    home = d.argmin(axis=1)
    return home, d <= d[np.arange(len(x)), home][:, None] + 2 * radius + 1e-6


def chosen(sample: np.ndarray, n: int, p: Near, radius: float) -> np.ndarray:
    """The pivots of a label of n vectors: of the sample's first 1, 2, 4 and so on, those by which its joins cost least."""
    best, cost = sample[:1], np.inf
    k = 1
    while k <= min(len(sample) // 2 or 1, int(np.sqrt(n))):
        rest = sample[k:] if len(sample) > k else sample
        home, goes = spread(rest, sample[:k], radius)
        here, there = np.bincount(home, minlength=k) * (n / len(rest)), goes.sum(axis=0) * (n / len(rest))
        rows = here @ np.ceil(np.maximum(there, 1) / p.cell) + there @ np.ceil(np.maximum(here, 1) / p.cell)
        if (now := float(here @ there + p.row_cost * rows)) < cost:
            best, cost = sample[:k], now
        k *= 2
    return best


def _homes(pivots: dict[tuple[int, int], np.ndarray], radius: float):
    """Rows (label, v, id, size, m) go to their own cell and to those that they might link into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            order = np.lexsort((size, label))
            new = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            for mine in np.split(order, new) if len(order) else []:
                key = int(label[mine[0]]), int(size[mine[0]])
                for i in range(0, len(mine), 4096):
                    some = batch.take(pa.array(mine[i : i + 4096]))
                    if key in pivots:
                        home, goes = spread(unit(matrix(some.column(1))), pivots[key], radius)
                        row, cell = np.nonzero(goes)
                    else:  # one cell
                        home = np.zeros(some.num_rows, dtype=np.int64)
                        row, cell = np.arange(some.num_rows), home
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(at), some.column(3).take(at), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), some.column(2).take(at), some.column(4).take(at), some.column(1).take(at)],
                        names=[f.split()[0] for f in CELL.split(", ")],
                    )

    return run


CELL = "label long, size int, cell int, home boolean, id long, m long, v array<double>"


def linked(cosine: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the cosines of the rows of x and y, in double precision, are large enough."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    return (x @ y.T) / (nx[:, None] * ny[None, :]) >= cosine


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the links near[i, j] between ids a[i] and b[j]."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label, out = np.arange(len(ids)), []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        mine = right[near[i]]
        labels, first = np.unique(label[mine], return_index=True)
        if new := [(t, j) for t, j in zip(labels.tolist(), mine[first].tolist(), strict=True) if t != label[left[i]]]:
            out += [(int(a[i]), int(ids[j])) for _, j in new]
            label[np.isin(label, [t for t, _ in new])] = label[left[i]]
    return out


def _join(cosine: float, step: int = 2048):
    """Of rows sorted by unit, home first: for each home vector the links it has, with multiplicity; and a forest's edges."""

    def unit_links(rows: pa.Table) -> pa.RecordBatch:
        home, ids, m = rows["left"].to_numpy(), rows["id"].to_numpy(), rows["m"].to_numpy()
        v = matrix(rows["v"].combine_chunks())
        left, right = np.flatnonzero(home), np.flatnonzero(rows["right"].to_numpy())
        out_id, out_n, edges = [], [], []
        for i in range(0, len(left), step):
            some, n = left[i : i + step], np.zeros(min(step, len(left) - i), dtype=np.int64)
            for j in range(0, len(right), step):
                more = right[j : j + step]
                near = linked(cosine, v[some], v[more]) & (ids[some][:, None] != ids[more][None, :])
                n += near @ m[more]
                edges += _forest(near, ids[some], ids[more])
            out_id += ids[some].tolist()
            out_n += n.tolist()
        k = len(edges)
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in edges] + out_id, pa.int64()), pa.array([e[1] for e in edges] + [None] * len(out_id), pa.int64()), pa.array([0] * k + out_n, pa.int64())], names=["a", "b", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            key = np.column_stack([rows[c].to_numpy() for c in ("label", "size", "cell", "i", "j")])
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                part = rows.slice(x, y - x)
                if held and k == 0 and [held[-1][c][0].as_py() for c in ("label", "size", "cell", "i", "j")] != key[0].tolist():
                    yield unit_links(pa.concat_tables(held))
                    held = []
                elif held and k:
                    yield unit_links(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield unit_links(pa.concat_tables(held))

    return run


def drawn(classes: DataFrame, p: Near) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """Of the largest (label, size) that need more than a chunk, the number of vectors and a sample in the order of a hash. The
    samples have p.sample_mb together, or 32 vectors each where that is more."""
    many = classes.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > p.cell)
    found = many.orderBy(F.desc("n"), "label", "size").limit(p.groups).collect()
    if not found:
        return {}
    share = p.sample_mb * 1e6 / (8 * len(found))  # bytes of vectors of one label
    want = classes.sparkSession.createDataFrame([(r.label, r.size, max(32.0, share // r.size) / r.n) for r in found], "label long, size int, share double")
    u = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) / float(1 << 30)
    rows = classes.join(F.broadcast(want), ["label", "size"]).withColumn("u", u).where(F.col("u") < F.col("share"))  # p.groups rows at most
    samples: dict[tuple[int, int], list] = {}
    for r in sorted(rows.select("label", "size", "u", "id", "v").collect(), key=lambda r: (r.u, r.id)):
        samples.setdefault((r.label, r.size), []).append(r.v)
    return {(r.label, r.size): (r.n, unit(np.array(samples[r.label, r.size], dtype=float))) for r in found if (r.label, r.size) in samples}


def range_join(spark: SparkSession, vectors: DataFrame, p: Near = Near()) -> DataFrame:  # noqa: B008
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding, label)."""
    scratch, parts = Scratch(spark), n_parts(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    good = rows.where(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("v", F.col("embedding").cast("array<double>"))
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    members = scratch.save(good.withColumn("hash", F.sha2(F.to_json(F.struct("label", "v")), 256)).select("vec_id", "label", "hash", "v"), "members")
    classes = scratch.save(members.groupBy("hash").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.min("label").alias("label"), F.any_value("v").alias("v")), "classes")
    classes = classes.select("label", "v", "id", F.size("v").alias("size"), "m")

    radius = float(np.sqrt(2 - 2 * p.cosine))
    ready = {k: chosen(v, n, p, radius) for k, (n, v) in drawn(classes, p).items()}
    cells = scratch.save(map_arrow(classes, _homes(ready, radius), CELL), "cells")
    chunks = cells.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / p.cell).cast("int").alias("k"))
    dealt = (
        cells.join(chunks, ["label", "size", "cell"])
        .withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .where("side = 1 or home")
        .select("label", "size", "cell", F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("o")).alias("i"), F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("c")).alias("j"), (F.col("side") == 0).alias("left"), (F.col("side") == 1).alias("right"), "id", "m", "v")
        .repartition(parts, "label", "size", "cell", "i", "j")
        .sortWithinPartitions("label", "size", "cell", "i", "j")
    )
    found = scratch.save(map_arrow(dealt, _join(p.cosine), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(spark, found.where("b is not null").select("a", "b"), scratch, "cc")
    per_class = (
        classes.select("id", "m")
        .join(counts, F.col("id") == F.col("a"), "left")
        .select("id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
        .join(comp, "id", "left")
        .select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    )
    first = members.groupBy("hash").agg(F.min("vec_id").alias("id"))
    by_vector = members.select("vec_id", "hash").join(first, "hash").join(per_class, "id").select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"])
    out = rows.select("vec_id").join(by_vector, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept")
    )


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(spark, table(spark, sf_dir, "embeddings"))
