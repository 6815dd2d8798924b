"""Centroid clustering with block-norm screening: exact integer k-means in which few distances are computed.

Vectors become integers, floor(256 * x). Each is written once beside a compressed one, x', a few bits a component times a power of
two of its own, and the squared norms of the blocks of what the compression leaves, r = x - x'. For a centroid c,
<x, c> = <x', c> + <r, c> <= <x', c> + sum over blocks of |r_b| |c_b|, by the Cauchy-Schwarz inequality, which bounds
|x - c|**2 = |x|**2 + |c|**2 - 2 <x, c> from below without the vector itself. A vector's distance to the centroid of the smallest bound is
computed first; of the others only those whose bound doesn't exceed the best distance so far get an exact distance in integers. A
little slack covers the rounding of the bounds, ties stay, and a tie goes to the smaller centroid, so clusters are those of a full comparison.

A round is one pass without a shuffle of vectors: every task adds up its own vectors for each centroid, and what is
shuffled is a row for each task and centroid. Sums are kept in two halves of 32 bits, so no number of rows makes them overflow. The
centroids, k times the dimension, are all that the driver holds.

Kept are vectors with exactly `dim` components, none null or not finite. A vector's squared length, in integers, has to be below 2**56
(components below about a million), so that distances are longs; longer ones are left out like the others. Rows of one id are kept
each; of those, ties for a starting centroid go to the vector that is smaller component by component. Rows without an id are kept but
start no centroid. A sum of distances that no long holds is null. With fewer vectors than k there are as many centroids as vectors with
an id; without any, and for an empty table, there are no rows. Empty clusters stay where they are. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, map_arrow, table

#: Squared lengths stay below, so that a distance is below 2**58.
LONGEST = float(1 << 56)


@dataclass(frozen=True)
class Means:
    """k centroids, moved `rounds` times; bits: of a compressed component; blocks: parts of a vector whose norms are kept;
    seed: of the hash that draws the first centroids."""

    dim: int = 64
    k: int = 40
    rounds: int = 5
    bits: int = 5
    blocks: int = 8
    seed: str = "2:"
    scale: int = 256


def integers(column: str, scale: int) -> Column:
    """floor(scale * x) of each component, as ints; null unless all are finite and short enough together for exact products."""
    x = F.col(column).cast("array<double>")
    y = F.transform(x, lambda v: F.call_function("floor", v * F.lit(float(scale))).cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < 2.0**40), F.lit(False)))
    short = F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v) < LONGEST
    return F.when(x.isNotNull() & fine, F.when(short, F.transform(y, lambda v: v.cast("int"))))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def block_norms(x: np.ndarray, blocks: int) -> np.ndarray:
    """Squared norms of the blocks of each row."""
    starts = np.linspace(0, x.shape[1], blocks, endpoint=False).astype(int)
    return np.add.reduceat(x * x, np.unique(starts), axis=1)


class Compressed:
    """Vectors without their last bits: codes times a power of two, the squared norm, and those of the blocks of what is left."""

    TYPE = "codes binary, shift int, norm long, rest array<long>"

    def __init__(self, codes: np.ndarray, shift: np.ndarray, norm: np.ndarray, rest: np.ndarray):
        self.codes, self.shift, self.norm, self.rest = codes, shift, norm, rest

    @staticmethod
    def of(x: np.ndarray, p: Means) -> Compressed:
        most = 2 ** (p.bits - 1) - 1
        shift = np.maximum(0, np.ceil(np.log2(np.maximum(1, np.abs(x).max(axis=1)) / most))).astype(np.int64)
        codes = np.clip((x + (1 << shift >> 1)[:, None]) >> shift[:, None], -most, most)
        return Compressed(codes.astype(np.int8), shift, (x * x).sum(axis=1), block_norms(x - (codes << shift[:, None]), p.blocks))

    def columns(self) -> list[pa.Array]:
        n, width = self.codes.shape
        codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(self.codes.tobytes())]).cast(pa.binary())
        return [codes, pa.array(self.shift.astype(np.int32)), pa.array(self.norm), lists(self.rest)]

    @staticmethod
    def read(columns: list[pa.Array], dim: int) -> Compressed:
        codes = np.frombuffer(b"".join(columns[0].to_pylist()), dtype=np.int8).reshape(-1, dim)
        return Compressed(codes, columns[1].to_numpy(), columns[2].to_numpy(), rows_of(columns[3], len(columns[3].flatten()) // len(codes)))

    def bounds(self, centroids: np.ndarray, blocks: int) -> np.ndarray:
        """Of each row's squared distance to each centroid, from below, whatever was rounded."""
        c = centroids.astype(float)
        whole = self.norm.astype(float)[:, None] + (c * c).sum(axis=1)[None, :]
        inner = np.ldexp(self.codes.astype(float) @ c.T, self.shift[:, None].astype(int)) + np.sqrt(self.rest.astype(float)) @ np.sqrt(block_norms(centroids, blocks).astype(float)).T
        return whole - 2 * inner - 1e-9 * whole - 1.0


def lists(x: np.ndarray) -> pa.Array:
    """Rows as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def nearest(x: np.ndarray, small: Compressed, centroids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the squared distance, and how many distances were computed for it."""
    low = small.bounds(centroids, blocks)
    first = low.argmin(axis=1)
    best = ((x - centroids[first]) ** 2).sum(axis=1)
    cluster, n = first.astype(np.int32), np.ones(len(x), dtype=np.int32)
    for j in range(len(centroids)):
        ask = np.flatnonzero((low[:, j] <= best) & (first != j))
        d = ((x[ask] - centroids[j]) ** 2).sum(axis=1)
        better = (d < best[ask]) | ((d == best[ask]) & (j < cluster[ask]))
        best[ask[better]], cluster[ask[better]] = d[better], j
        n[ask] += 1
    return cluster, best, n


def _prepare(p: Means):
    """Rows (vec_id, y) with their compressed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                small = Compressed.of(rows_of(batch.column(1), p.dim), p)
                yield pa.RecordBatch.from_arrays([*batch.columns, *small.columns()], names=["vec_id", "y", "codes", "shift", "norm", "rest"])

    return run


def _batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, p: Means):
    for batch in batches:
        if batch.num_rows:
            x = rows_of(batch.column(1), p.dim)
            yield batch.column(0), x, *nearest(x, Compressed.read(batch.columns[2:], p.dim), centroids, p.blocks)


def _sums(centroids: np.ndarray, p: Means):
    """A row (cluster, n, low, high) for each task and cluster: counts, and sums of components in halves of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), dtype=np.int64)
        low, high = np.zeros_like(centroids), np.zeros_like(centroids)
        for _, x, cluster, _, _ in _batches(batches, centroids, p):
            n += np.bincount(cluster, minlength=len(centroids))
            order = np.argsort(cluster, kind="stable")
            start = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            sums, at = np.add.reduceat(x[order], start, axis=0), cluster[order][start]
            low[at] += sums & 0xFFFFFFFF
            high[at] += sums >> 32
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), lists(low[at]), lists(high[at])], names=["cluster", "n", "low", "high"])

    return run


def _assigned(centroids: np.ndarray, p: Means):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance, n in _batches(batches, centroids, p):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance), pa.array(n)], names=["vec_id", "cluster", "distance", "n_exact"])

    return run


def starting(kept: DataFrame, p: Means) -> np.ndarray:
    """The first centroids: k rows at most, of the smallest hashes."""
    drawn = F.sha2(F.concat(F.lit(p.seed), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").orderBy(drawn, "y").limit(p.k).select("y").collect()
    return np.array([r.y for r in rows], dtype=np.int64).reshape(len(rows), p.dim)


def moved(kept: DataFrame, centroids: np.ndarray, p: Means) -> np.ndarray:
    """The centroids after a round; a row of sums for each of them comes to the driver."""
    per_task = map_arrow(kept, _sums(centroids, p), "cluster int, n long, low array<long>, high array<long>")
    add = lambda c: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(p.dim))).alias(c)
    out = centroids.copy()
    for r in per_task.groupBy("cluster").agg(F.sum("n").alias("n"), add("low"), add("high")).collect():
        out[r.cluster] = [((h << 32) + w) // r.n for w, h in zip(r.low, r.high, strict=True)]
    return out


def clusters(spark: SparkSession, vectors: DataFrame, p: Means = Means()) -> DataFrame:  # noqa: B008
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact, centroid), a row for each kept one of vectors
    (vec_id, embedding); n_exact: distances computed in the last assignment."""
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size("embedding") == p.dim)
    rows = rows.select("vec_id", integers("embedding", p.scale).alias("y")).where("y is not null")
    kept = scratch.save(map_arrow(rows, _prepare(p), f"vec_id long, y array<int>, {Compressed.TYPE}"), "kept")
    centroids = starting(kept, p)
    if not len(centroids):  # no vector with an id
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int, centroid array<long>"
        return spark.createDataFrame([], none)
    for _ in range(p.rounds):
        centroids = moved(kept, centroids, p)
    found = scratch.save(map_arrow(kept, _assigned(centroids, p), "vec_id long, cluster int, distance long, n_exact int"), "found")
    own = {r.cluster: int(r.own) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # k rows at most
    long = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(j, long(own[j]), long(sum(own.values())), digest(c), c) for j, c in enumerate(centroids.tolist()) if j in own]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact", "centroid")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(spark, table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(p: Means) -> str:
    """The same in DuckDB: every distance of every round."""
    gap = "CAST(list_sum(list_transform(list_zip(v.y, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    best = f"SELECT r, least % {p.k} AS cluster, least // {p.k} AS distance FROM (SELECT r, min({gap} * {p.k} + j) AS least FROM v, {{c}} c GROUP BY r)"
    rounds = []
    for i in range(p.rounds):
        rounds.append(f"a{i} AS MATERIALIZED ({best.format(c=f'c{i}')})")
        mean = f"SELECT cluster AS j, list(m ORDER BY pos) AS y FROM (SELECT cluster, pos, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT cluster, unnest(y) AS x, unnest(range(1, {p.dim + 1})) AS pos FROM a{i} JOIN v USING (r)) GROUP BY 1, 2) GROUP BY 1"
        rounds.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(n.y, o.y) AS y FROM c{i} o LEFT JOIN ({mean}) n USING (j))")
    last = f"c{p.rounds}"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({p.scale} * x::DOUBLE) AS BIGINT)) AS y FROM embeddings
WHERE len(embedding) = {p.dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {p.dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}' || vec_id)) - 1 AS j, y FROM v QUALIFY j < {p.k}), {', '.join(rounds)}, z AS MATERIALIZED ({best.format(c=last)})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string({last}.y, ',')) AS centroid_sha256 FROM z JOIN v USING (r) JOIN {last} ON j = cluster"""


SQL = _sql(Means())
