"""Hard negatives by a vector-approximation file.

Vectors become integers, floor(256 * x). Each dimension is cut into cells of about equal numbers of components, whose edges are
approximate percentiles and the exact extremes of all rows; a vector's approximation is a byte a dimension, its cell. For an anchor, a table for
each dimension holds the least and the greatest product of its component with what a cell may hold, so that sums of looked-up entries
bound every row's inner product with it. Only rows that might enter an answer are scored exactly, in 64-bit integers:

- positives are an anchor's best rows of its own label: a row is scored if its upper bound reaches the k-th largest lower bound;
- negatives are, for each positive, the best rows of other labels whose score is between `low` and `high` percent of the positive's: a row is
  scored if its bounds may lie in that window and reach the k-th largest lower bound of those that surely lie in it.

Equal vectors of one label are one class with the smallest ids it needs, so copies are compared once and an anchor's
answer is found once for all anchors of its class. Rows are dealt into chunks by a hash (for positives within a label), anchors likewise, and
a task holds one chunk of rows while the anchors of one chunk pass by; it answers with the best few rows of each anchor, and those of all
chunks are merged by partial top-k. Every anchor meets all rows, in blocks; nothing is broadcast but the edges of at most `dims` dimensions, those
of the most frequent lengths; vectors of other lengths are their own approximation.

Rows with a null id, label or vector, or with any null or non-finite component, take no part, and neither do those whose squared
length, in integers, is 2**56 or more (components of about a million), for scores have to be longs. Zero and empty vectors take part. Vectors of
unlike lengths aren't compared. Of rows of one id the one with the smallest label, then the smallest vector, stands. Ties go to the smaller id.
A positive whose window is empty gives no rows, and so does an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.centroids import integers
from quillgraph.llm.common import Scratch, map_arrow, n_parts, table


@dataclass(frozen=True)
class Mining:
    """every: anchors are the ids divisible by it. positives, negatives: of an anchor, and of one of its positives. low, high: percent of
    a positive's score that a negative's may be. relabelled: ids divisible by it have the next label of `labels`. cells: of a dimension.
    dims: that are cut into cells. chunk: rows of a unit at most, least: where there are more. asked: anchors of a unit."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    relabelled: int = 7
    labels: int = 10
    scale: int = 256
    cells: int = 64
    dims: int = 4096
    chunk: int = 16384
    least: int = 2048
    asked: int = 16384


class Cells:
    """The cells of vectors of one length: the least and the greatest integer of each, dimension by dimension."""

    def __init__(self, edges: list[tuple[int, int, list[int]]], cells: int):
        """edges: of each dimension the least and the greatest component and where cells begin."""
        self.starts = [np.unique(np.clip([lo, *some], lo, hi)).astype(np.int64) for lo, hi, some in edges]
        self.low, self.high = np.zeros((2, len(edges), cells), dtype=np.int64)
        for d, ((_, hi, _), start) in enumerate(zip(edges, self.starts, strict=True)):
            self.low[d, : len(start)], self.high[d, : len(start)] = start, [*(start[1:] - 1), hi]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(s, x[:, d], side="right") - 1 for d, s in enumerate(self.starts)]).astype(np.uint8)

    def bounds(self, codes: np.ndarray, asked: np.ndarray, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product of each row of codes with each row of asked."""
        a, b = self.low[:, :, None] * asked.T[:, None, :], self.high[:, :, None] * asked.T[:, None, :]
        tables = np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2)  # dimension, cell, anchor twice
        out = np.zeros((len(codes), tables.shape[2]), dtype=np.int64)
        for i in range(0, len(codes), tile):
            acc, some = out[i : i + tile], codes[i : i + tile]
            for d in range(len(tables)):
                acc += tables[d].take(some[:, d], axis=0)
        return out[:, : len(asked)], out[:, len(asked) :]


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest; none if there are fewer."""
    return None if len(values) < k else int(np.partition(values, len(values) - k)[len(values) - k])


def window(positive: int, p: Mining) -> tuple[int, int]:
    """The least and the greatest score of a negative."""
    return -(-p.low * positive // 100), p.high * positive // 100


def possible(lo: np.ndarray, hi: np.ndarray, k: int, least: int | None = None, most: int | None = None) -> np.ndarray:
    """Rows that may be among the k best of those whose score is between least and most, by their bounds."""
    may, sure = np.ones(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
    if least is not None:
        may, sure = (hi >= least) & (lo <= most), (lo >= least) & (hi <= most)
    edge = kth(lo[sure], k)
    return may if edge is None else may & (hi >= edge)


class Unit:
    """A chunk of classes."""

    def __init__(self, rows: pa.Table, size: int, cells: Cells | None):
        self.x = rows["y"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, size)
        self.label, self.cells = rows["label"].to_numpy(), cells
        ids = rows["ids"].combine_chunks()
        self.ids, self.first = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, size) if cells else None

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.cells:
            return self.cells.bounds(self.codes, asked)
        exact = self.x @ asked.T
        return exact, exact

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids of classes with their scores."""
        if (edge := kth(score, k)) is not None:
            rows, score = rows[score >= edge], score[score >= edge]
        many = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        ids, score = self.ids[at], np.repeat(score, many)
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]

    def positives(self, asked: np.ndarray, k: int) -> Iterator[tuple[int, None, np.ndarray, np.ndarray]]:
        lo, hi = self.bounds(asked)
        for a in range(len(asked)):
            rows = np.flatnonzero(possible(lo[:, a], hi[:, a], k))
            yield a, None, *self.best(rows, self.x[rows] @ asked[a], k)

    def negatives(self, asked: np.ndarray, labels: np.ndarray, scores: list[list[int]], p: Mining) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        lo, hi = self.bounds(asked)
        for a in range(len(asked)):
            others = np.flatnonzero(self.label != labels[a])
            low, high = lo[others, a], hi[others, a]
            ranges = {s: r for s in scores[a] if (r := window(s, p))[0] <= r[1]}
            some = np.zeros(len(others), dtype=bool)
            for r in ranges.values():
                some |= possible(low, high, p.negatives, *r)
            rows = others[some]
            exact = self.x[rows] @ asked[a]
            for s, (least, most) in ranges.items():
                inside = (exact >= least) & (exact <= most)
                yield a, s, *self.best(rows[inside], exact[inside], p.negatives)


FOUND = "q long, positive long, id long, score long"


def _scan(cells: dict[int, Cells], p: Mining, step: int = 32):
    """Rows of units, sorted so that a unit's classes come before the anchors' classes that ask it. Those that ask for negatives bring the
    scores of their positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, unit = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            place = np.column_stack([rows[c].to_numpy().astype(np.int64) for c in ("size", "part", "i", "j", "asks")])
            cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for x, y in zip(cut, cut[1:], strict=False):
                *now, asks = place[x].tolist()
                some = rows.slice(x, y - x)
                if now != key:
                    key, held, unit = now, [], None
                if not asks:
                    held.append(some)
                    continue
                if not held:
                    continue
                size = key[0]
                unit = unit or Unit(pa.concat_tables(held), size, cells.get(size))
                for i in range(0, some.num_rows, step):
                    part = some.slice(i, step)
                    asked = part["y"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, size)
                    q, scores = part["cid"].to_numpy(), part["scores"].to_pylist()
                    answers = unit.positives(asked, p.positives + 1) if scores[0] is None else unit.negatives(asked, part["label"].to_numpy(), scores, p)
                    out = [(a, s, ids, got) for a, s, ids, got in answers if len(ids)]
                    if out:
                        many = [len(o[2]) for o in out]
                        positive = pa.array(np.repeat([o[1] for o in out], many), pa.int64()) if out[0][1] is not None else pa.nulls(sum(many), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(q[[o[0] for o in out]], many)), positive, pa.array(np.concatenate([o[2] for o in out])), pa.array(np.concatenate([o[3] for o in out]))], names=[f.split()[0] for f in FOUND.split(", ")]
                        )

    return run


def _encode(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, y = batch.column(0).to_numpy(), batch.column(4)
            codes: list[bytes | None] = [None] * batch.num_rows
            for s in set(size.tolist()) & cells.keys():
                at = np.flatnonzero(size == s)
                x = y.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), s)
                for i, c in zip(at.tolist(), cells[s].encode(x), strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "codes"])

    return run


def edges(classes: DataFrame, p: Mining) -> dict[int, Cells]:
    """Cells of the most frequent lengths with p.dims dimensions together, from all classes; their edges come to the driver."""
    taken, left = [], p.dims
    for r in classes.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(64).collect():
        if r.size <= left:
            taken.append(r.size)
            left -= r.size
    if not taken:
        return {}
    some = classes.where(F.col("size").isin(taken)).select("size", F.posexplode("y").alias("pos", "v"))
    at = F.array(*(F.lit(i / p.cells) for i in range(1, p.cells)))
    per = some.groupBy("size", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", at, F.lit(8 * p.cells)).alias("starts"))
    found: dict[int, list] = {s: [None] * s for s in taken}
    for r in per.collect():
        found[r.size][r.pos] = (r.lo, r.hi, r.starts)
    return {s: Cells(e, p.cells) for s, e in found.items()}


def _asked(classes: DataFrame, queries: DataFrame, part: Column, p: Mining) -> DataFrame:
    """Units of classes (size, cid, label, y, ids, codes) and queries (size, cid, label, y, scores), those of one length and part."""
    parts = n_parts(classes.sparkSession)
    rows = classes.withColumn("part", part)
    asks = queries.withColumn("part", part)
    many = F.greatest(F.lit(p.least), F.least(F.lit(p.chunk), F.ceil(F.count("*") / parts)))
    n_i = rows.groupBy("size", "part").agg(F.ceil(F.count("*") / many).cast("int").alias("n_i"))
    n_j = asks.groupBy("size", "part").agg(F.ceil(F.count("*") / p.asked).cast("int").alias("n_j"))
    counts = n_i.join(n_j, ["size", "part"])
    dealt = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(counts, ["size", "part"]).withColumn("i", dealt("n_i")).withColumn("j", every("n_j"))
    right = asks.join(counts, ["size", "part"]).withColumn("j", dealt("n_j")).withColumn("i", every("n_i"))
    left = left.select("size", "part", "i", "j", F.lit(0).alias("asks"), "cid", "label", "y", "ids", "codes", F.lit(None).cast("array<long>").alias("scores"))
    right = right.select("size", "part", "i", "j", F.lit(1).alias("asks"), "cid", "label", "y", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("codes"), "scores")
    return left.unionByName(right).repartition(parts, "size", "part", "i", "j").sortWithinPartitions("size", "part", "i", "j", "asks", "cid")


def labelled(vectors: DataFrame, p: Mining) -> DataFrame:
    """(id, label, y) of the rows that take part, one for each id."""
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    rows = vectors.where("vec_id is not null and label is not null").select(
        vec_id.alias("id"), F.when(vec_id % p.relabelled == 0, (label + 1) % p.labels).otherwise(label).alias("label"), integers("embedding", p.scale).alias("y")
    )
    return rows.where("y is not null").groupBy("id").agg(F.min(F.struct("label", "y")).alias("x")).select("id", "x.label", "x.y")


def mine(spark: SparkSession, vectors: DataFrame, p: Mining = Mining()) -> DataFrame:  # noqa: B008
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label)."""
    scratch = Scratch(spark)
    rows = scratch.save(labelled(vectors, p), "rows")
    keep = max(p.positives + 1, p.negatives)  # no answer holds more ids of one class
    turn = F.row_number().over(Window.partitionBy("label", "y").orderBy("id"))
    classes = rows.withColumn("turn", turn).where(F.col("turn") <= keep).groupBy("label", "y").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = scratch.save(classes.select(F.size("y").alias("size"), F.get("ids", F.lit(0)).alias("cid"), "label", "ids", "y"), "classes")
    cells = edges(classes, p)
    coded = scratch.save(map_arrow(classes, _encode(cells), "size int, cid long, label long, ids array<long>, y array<int>, codes binary"), "coded")
    anchors = rows.where(F.col("id") % p.every == 0).join(classes.select("label", "y", "cid"), ["label", "y"]).select(F.col("id").alias("anchor_id"), "cid")
    anchors = scratch.save(anchors, "anchors")
    queries = classes.join(anchors.select("cid").distinct(), "cid", "left_semi").select("size", "cid", "label", "y")

    found = scratch.save(map_arrow(_asked(coded, queries.withColumn("scores", F.lit(None).cast("array<long>")), F.col("label"), p), _scan(cells, p), FOUND), "positives")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= p.positives + 1)
    near = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "score"))).alias("near"))  # positives and one more
    near = scratch.save(near, "near")

    scored = queries.join(near.select(F.col("q").alias("cid"), F.array_distinct(F.transform("near", lambda x: x["score"])).alias("scores")), "cid")
    found = scratch.save(map_arrow(_asked(coded, scored, F.lit(0), p), _scan(cells, p), FOUND), "negatives")
    best = Window.partitionBy("q", "positive").orderBy(F.desc("score"), "id")
    hard = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.negatives)

    own = anchors.join(near, anchors["cid"] == near["q"]).withColumn("near", F.filter("near", lambda x: x["id"] != F.col("anchor_id")))
    own = own.select("anchor_id", F.col("q").alias("cid"), F.explode(F.slice("near", 1, p.positives)).alias("x")).select("anchor_id", "cid", "x.id", "x.score").toDF("anchor_id", "cid", "positive_id", "positive_score")
    pairs = own.join(hard.select("q", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), (F.col("cid") == F.col("q")) & (F.col("positive_score") == F.col("positive")))
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark, table(spark, sf_dir, "embeddings"))


def _sql(p: Mining) -> str:
    """The same in DuckDB: every score."""
    return f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, CAST(CASE WHEN vec_id % {p.relabelled} = 0 THEN (label + 1) % {p.labels} ELSE label END AS BIGINT) AS label,
list_transform(embedding, lambda x: CAST(floor({p.scale} * x::DOUBLE) AS BIGINT)) AS y FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.y, b.y), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM v a JOIN v b ON a.id <> b.id WHERE a.id % {p.every} = 0 AND len(a.y) = len(b.y)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {p.positives}),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {p.low} * p.score <= 100 * s.score AND 100 * s.score <= {p.high} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {p.negatives}"""


SQL = _sql(Mining())
