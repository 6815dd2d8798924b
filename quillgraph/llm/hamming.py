"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Vectors are given one more component so that all have the largest norm; the largest inner product is then the nearest
neighbour. Rotations learnt on a bounded sample (principal directions, then alternating between signs and the rotation that
best fits them; as many as the code needs) turn each vector into a code of 256 bits. Vectors are dealt into shards by a hash; each
shard indexes its codes under each of 16 substrings. If a code is within radius r of a query's, one of its substrings is within r/16
of the query's (pigeonhole), so probing the near values of every substring retrieves all codes within the radius. The radius grows
until it holds k codes and, beyond the k-th one's distance, the margin that nearly all true neighbours of the sample need; where
that takes more probes than the shard has codes, all of its codes are compared. What is within is reranked by the inner product in
double precision, and n_candidates tells how many rows that were. Every row is indexed; queries meet all shards, in blocks; the best
of each shard, k rows a query, are merged.

Null or zero vectors, rows without an id, and vectors with null or non-finite components, take no part, as queries or as candidates.
Vectors of unlike lengths aren't compared; the `lengths` most frequent ones have codes, vectors of others are compared with all of
their length. Ties go to the smaller vec_id; rows of one id are candidates each, but never of that id's queries; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, map_arrow, n_parts, table
from quillgraph.llm.pivots import matrix, usable

BITS, PARTS = 256, 16
#: What turns a substring of 16 bits into those within a distance of 0 and of 1.
_FLIPS = np.append(0, 1 << np.arange(16)).astype(np.uint16)


@dataclass(frozen=True)
class Search:
    """k: neighbours of a query. every: queries are the vec_ids divisible by it. sample: vectors that the rotations and the
    margin are learnt from. probes: of them, whose neighbours are looked at. keep: share of the sample's true neighbours within the
    margin. shard_mb: vectors of a shard. least: vectors of a shard, where there are more. lengths: of vectors, that have codes."""

    k: int = 20
    every: int = 20
    sample: int = 10_000
    probes: int = 300
    keep: float = 0.98
    shard_mb: float = 8.0
    least: int = 4096
    lengths: int = 64
    rounds: int = 15
    seed: int = 5


class Codes:
    """The rotations of one vector length, and the margin."""

    def __init__(self, x: np.ndarray, largest: float, p: Search):
        rng = np.random.default_rng(p.seed)
        self.largest = largest or 1.0
        full = self.lift(x, False)
        self.mean = full.mean(axis=0)
        centred = full - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :BITS]
        z, width = centred @ axes, axes.shape[1]
        turns = []
        for _ in range(-(-BITS // width)):
            turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
            for _ in range(p.rounds):
                u, _, v = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.project = np.hstack(turns)[:, :BITS]
        ask = x[: p.probes]
        inner = ask @ x.T
        inner[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
        k = min(p.k, len(x) - 1)
        self.margin = BITS
        if k > 0:
            far = distances(self.encode(ask, True), self.encode(x, False))
            far[np.arange(len(ask)), np.arange(len(ask))] = BITS
            edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            best = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            self.margin = max(0, int(np.quantile(np.take_along_axis(far, best, axis=1) - edge, p.keep)))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = (x * x).sum(axis=1)
        if query:
            return np.column_stack([x / np.sqrt(norm)[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(0, self.largest**2 - norm))]) / self.largest

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        return np.packbits((self.lift(x, query) - self.mean) @ self.project >= 0, axis=1).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of a to all of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


class Shard:
    """The substrings' tables of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None):
        self.ids, self.x, self.codes = ids, x, codes
        if codes is not None:
            parts = codes.view(np.uint16)
            self.order = np.argsort(parts, axis=0, kind="stable")
            self.parts = np.take_along_axis(parts, self.order, axis=0)

    def probed(self, code: np.ndarray, near: int) -> np.ndarray:
        """Rows one of whose substrings is within `near` (0 or 1) of the query's."""
        found = []
        for j, value in enumerate(code.view(np.uint16)):
            probe = value ^ _FLIPS[: 1 + 16 * near]
            lo, hi = (np.searchsorted(self.parts[:, j], probe, side=side) for side in ("left", "right"))
            found += [self.order[a:b, j] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def within(self, query: int, code: np.ndarray, margin: int, k: int) -> np.ndarray:
        """Rows, but the query's own, whose codes are no farther than the k-th one's distance and the margin."""
        for near in (0, 1, None):
            rows = np.arange(len(self.ids)) if near is None else self.probed(code, near)
            rows = rows[self.ids[rows] != query]
            far = distances(code[None, :], self.codes[rows])[0]
            if len(far) >= k:
                edge = int(np.partition(far, k - 1)[k - 1]) + margin
                if near is None or edge < PARTS * (near + 1):  # all codes within the edge have been probed
                    return rows[far <= edge]
        return rows

    def search(self, query: int, q: np.ndarray, code: np.ndarray | None, margin: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        rows = np.flatnonzero(self.ids != query) if code is None else self.within(query, code, margin, k)
        n, score = len(rows), self.x[rows] @ q
        if len(rows) > 4 * k:  # those that reach the k-th score
            edge = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= edge], score[score >= edge]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best], n


RESULT = "query_id long, vec_id long, score double, n_candidates long"


def _search(codes: dict[int, Codes], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (size, shard, query, id, v) sorted so that a shard's vectors come before its queries. The number of candidates stands
        in the first row of a query and shard."""
        key, held, shard = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            place = np.column_stack([rows[c].to_numpy().astype(np.int64) for c in ("size", "shard", "query")])
            cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for x, y in zip(cut, cut[1:], strict=False):
                size, number, query = place[x].tolist()
                part = rows.slice(x, y - x)
                if (size, number) != key:
                    key, held, shard = (size, number), [], None
                v, ids = matrix(part["v"].combine_chunks()), part["id"].to_numpy()
                if not query:
                    held.append((ids, v))
                    continue
                if not held:
                    continue
                own = codes.get(size)
                if shard is None:
                    ids0, v0 = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    shard = Shard(ids0, v0, own and own.encode(v0, False))
                asked = own.encode(v, True) if own else [None] * len(ids)
                out = [shard.search(int(i), q, c, own.margin if own else 0, k) for i, q, c in zip(ids, v, asked, strict=True)]
                size_of = np.array([len(o[0]) for o in out])
                many = np.zeros(size_of.sum(), dtype=np.int64)
                many[(np.cumsum(size_of) - size_of)[size_of > 0]] = [o[2] for o in out if len(o[0])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, size_of)), pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array(many)],
                    names=[f.split()[0] for f in RESULT.split(", ")],
                )

    return run


def fit(vectors: DataFrame, lengths: DataFrame, p: Search) -> dict[int, Codes]:
    """Codes of the most frequent vector lengths, each from a sample by the order of a hash; lengths: (size, n, m), with the
    largest norm of all rows. The samples share p.sample vectors beyond 100 of each length."""
    out: dict[int, Codes] = {}
    found = lengths.where("n > 1").orderBy(F.desc("n"), "size").limit(p.lengths).collect()
    for r in found:
        share = max(100, p.sample * r.n // max(1, sum(x.n for x in found)))
        rows = vectors.where(F.col("size") == r.size).orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(share).select("v").collect()
        out[r.size] = Codes(np.array([x.v for x in rows], dtype=float), min(float(r.m), 1e150), p)  # squares of larger norms are infinite
    return out


def nearest(spark: SparkSession, vectors: DataFrame, p: Search = Search()) -> DataFrame:  # noqa: B008
    """(query_id, rank, vec_id, score, n_candidates): of each query among vectors (vec_id, embedding) its k nearest found."""
    scratch = Scratch(spark)
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = scratch.save(rows.withColumn("size", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    lengths = scratch.save(rows.groupBy("size").agg(F.count("*").alias("n"), F.max(norm).alias("m")), "lengths")
    codes = fit(rows, lengths, p)
    # vectors of a shard: as many as the memory holds, fewer where that keeps all tasks busy
    most = F.least(F.ceil(F.lit(p.shard_mb * 1e6) / (8 * F.col("size"))), F.ceil(F.col("n") / n_parts(spark)))
    shards = lengths.select("size", F.ceil(F.col("n") / F.greatest(F.lit(p.least), most)).cast("int").alias("shards"))
    sharded = rows.join(shards, "size")
    placed = sharded.select("size", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("query"), "id", "v")
    asked = sharded.where(F.col("id") % p.every == 0).select("size", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("query"), "id", "v")
    dealt = placed.unionByName(asked).repartition(n_parts(spark), "size", "shard").sortWithinPartitions("size", "shard", "query", "id")
    found = scratch.save(map_arrow(dealt, _search(codes, p.k), RESULT), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
    many = found.groupBy("query_id").agg(F.sum("n_candidates").alias("n_candidates"))
    return best.join(many, "query_id").select("query_id", "rank", "vec_id", "score", "n_candidates")


def op7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"))
