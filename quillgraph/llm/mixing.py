"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of whole documents or of parts of long ones, and permuted by a hash. Its target, in words,
fixes how many permuted blocks it gives: a whole epoch if the target is above its size, then a prefix of a second
permutation. The drawn blocks of all sources are then dealt to output shards by a binary tree: a node that holds a
multiset of block counts by source gives half of its blocks to the left, drawn from the multivariate hypergeometric
distribution, so that shards have equal numbers of blocks, the quotas of every source are met exactly, and no block is
dealt twice. A block finds its shard by its rank in the source's permutation, walking down the tree; draws are seeded by
the node, so each task sees the same tree and reruns agree. Shards are shuffled locally by a hash of the block.

Ranks and running words come from two levels (hash buckets, then rows in a bucket), so a source with a third of all rows
is spread over many tasks.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Documents without words are taken 0
times; very long ones are many blocks. Repeated rows are documents of their own. Ties of the permutation's hash go to the smaller
id, then to the first row. An empty table gives no rows. Other columns, whatever their names, are ignored by mix_documents and passed
on by mixed_texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, Scratch, n_parts, ship, table, whole_row


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code-point order, repeating. share: of all words, that the mix takes. most: epochs.
    block_words: of a block. shards, shard_words: output shards, a power of two, or more of so many words. buckets, bucket_blocks: into so many buckets a source's blocks
    are dealt to be ranked, or into more of so many blocks. few_sources: sources whose table is broadcast. most_sources: sources
    whose sizes the driver may hold."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block_words: int = 2048
    shards: int = 64
    shard_words: int = 10_000_000
    buckets: int = 256
    bucket_blocks: int = 1_000_000
    few_sources: int = 10_000
    most_sources: int = 1_000_000
    seed: int = 7


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Water filling: what is above most times a size is shared again by weight, until nothing is above."""
    out = [0.0] * len(sizes)
    weight = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    open_, left = list(range(len(sizes))), mix.share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > mix.most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = mix.most * sizes[i]
            left -= out[i]
        closed = set(over)
        open_ = [i for i in open_ if i not in closed]
    return out


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


class SplittingTree:
    """Block counts by source, split down to shards; nodes are drawn when they are first visited."""

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.counts, self.depth, self.seed = np.array(counts, dtype=np.int64), shards.bit_length() - 1, seed
        self.left: dict[tuple[int, int], np.ndarray] = {}
        self.nodes: dict[tuple[int, int], np.ndarray] = {(0, 0): self.counts}

    def split(self, level: int, k: int) -> np.ndarray:
        """What node k of a level gives to its left child, by source."""
        if (level, k) not in self.left:
            here = self.nodes[level, k]
            rng = np.random.Generator(np.random.Philox(key=[self.seed, (level << 40) | k]))
            half, rest = int(here.sum()) // 2, int(here.sum())
            out = np.zeros_like(here)
            for i, n in enumerate(here.tolist()):  # one source after the other, each given what is still to draw
                rest -= n
                out[i] = _hypergeometric(rng, n, rest, half)
                half -= int(out[i])
            self.left[level, k] = out
            self.nodes[level + 1, 2 * k], self.nodes[level + 1, 2 * k + 1] = out, here - out
        return self.left[level, k]

    def shard(self, source: int, rank: np.ndarray) -> np.ndarray:
        """The shard of each rank in a source's permutation."""
        k, r = np.zeros(len(rank), dtype=np.int64), rank.astype(np.int64).copy()
        for level in range(self.depth):
            give = np.zeros(len(k), dtype=np.int64)
            for node in np.unique(k).tolist():
                give[k == node] = self.split(level, node)[source]
            right = r >= give
            r -= np.where(right, give, 0)
            k = 2 * k + right
        return k


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    if not good or not draw:
        return 0
    if not bad:
        return draw
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draw))
    return _log_concave(rng, good, bad, draw)  # numpy draws below 1e9


def _log_concave(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """An exact hypergeometric draw by rejection: a log-concave distribution with p at its mode m is at most
    p * min(1, exp(1 - p * |x - m|)) everywhere."""
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    lo, hi = max(0, draw - bad), min(good, draw)
    mode = min(max((draw + 1) * (good + 1) // (good + bad + 2), lo), hi)
    term = lambda x: choose(good, x) + choose(bad, draw - x)
    top = term(mode)
    p = exp(min(0.0, top - choose(good + bad, draw)))
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() <= w / (1 + w) else (w + rng.exponential()) / p
        x = mode + int(rng.choice((-1, 1))) * round(y)
        if lo <= x <= hi and log(max(rng.random(), 1e-300)) + min(0.0, w - p * y) <= term(x) - top:
            return x


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): one pass over the texts."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_table(spark: SparkSession, sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, s, source_size, target): a row for each source, s its place in code-point order, null last."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(mix.most_sources + 1).collect()
    if len(rows) > mix.most_sources:
        raise ValueError(f"more than {mix.most_sources} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.n for r in rows], mix)
    out = spark.createDataFrame(
        [(r.source, i, r.n, t) for i, (r, t) in enumerate(zip(rows, goal, strict=True))], "source string, s int, source_size long, target double"
    )
    return F.broadcast(out) if len(rows) <= mix.few_sources else out


def draw(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(sizes, sources, drawn). drawn: (doc_id, row_key, s, epoch, start, words, shard, position): disjoint blocks of each
    epoch; start and words count words of the document; position orders a shard."""
    scratch = Scratch(spark)
    # repeated rows stay apart by a key made of what they are and a number that a rerun reads back rather than makes again
    sizes = scratch.save(sized(docs).withColumn("row_key", F.monotonically_increasing_id()), "sizes")
    sources = source_table(spark, sizes, mix)
    same = sizes["source"].eqNullSafe(sources["source"])
    longest = sizes.groupBy("source").agg(F.sum(F.ceil(F.col("size") / mix.block_words)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(mix.buckets, -(-longest // mix.bucket_blocks))
    blocks = (
        sizes.join(sources, same)
        .where("size > 0")
        .select("doc_id", "row_key", "s", "size", "source_size", "target", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"))
        .withColumn("quota", F.greatest(F.lit(0), F.least(F.col("source_size"), F.round("target").cast("long") - (F.col("epoch") - 1) * F.col("source_size"))))
        .where("quota > 0")
        .withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(mix.block_words).cast("long"))))
        .withColumn("words", F.least(F.lit(mix.block_words).cast("long"), F.col("size") - F.col("start")))
        .withColumn("h", _hash(mix.seed, F.col("epoch"), F.col("doc_id"), F.col("start")))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)).cast("int"))
    )
    key = ["s", "epoch", "bucket"]
    heads = blocks.groupBy(*key).agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    before = Window.partitionBy("s", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*key, F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy(*key).orderBy("h", "doc_id", "row_key", "start").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        blocks.withColumn("w1", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(heads, key)
        .withColumn("words", F.least(F.col("words"), F.col("quota") - F.col("w0") - F.col("w1")))
        .where("words > 0")
        .select("doc_id", "row_key", "s", "epoch", "bucket", "h", "start", "words")
    )
    taken = scratch.save(taken, "taken")
    counts = taken.groupBy(*key).agg(F.count("*").alias("n"))
    order = Window.partitionBy("s").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*key).orderBy("h", "doc_id", "row_key", "start")
    ranked = taken.withColumn("r", F.row_number().over(inside) - 1).join(offsets, key).withColumn("rank", F.col("n0") + F.col("r"))
    per_source = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # bounded by most_sources
    quotas = [per_source.get(i, 0) for i in range(max(per_source, default=-1) + 1)]
    words = sizes.agg(F.sum("size")).first()[0] or 0
    shards, seed = max(mix.shards, 1 << max(0, int(mix.share * words / mix.shard_words)).bit_length()), mix.seed

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = SplittingTree(quotas, shards, seed)
        for f in frames:
            shard = np.zeros(len(f), dtype=np.int64)
            for s in f["s"].unique().tolist():
                at = (f["s"] == s).to_numpy()
                shard[at] = tree.shard(int(s), f["rank"].to_numpy()[at])
            yield f.assign(shard=shard)[["doc_id", "row_key", "s", "epoch", "start", "words", "shard", "position"]]

    ship(spark)
    drawn = ranked.withColumn("position", _hash(mix.seed + 1, "doc_id", "epoch", "start")).mapInPandas(
        deal, "doc_id long, row_key long, s int, epoch int, start long, words long, shard long, position long"
    )
    return sizes, sources, drawn


def local_shuffle(drawn: DataFrame, parts: int) -> DataFrame:
    """drawn, each shard in one partition in the order of its own shuffle."""
    return drawn.repartition(parts, "shard").sortWithinPartitions("shard", "position", "doc_id", "row_key", "epoch", "start")


def mix_documents(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """(doc_id, size, source_size, target, taken, shards), a row for each row of docs."""
    sizes, sources, drawn = draw(spark, docs, mix)
    taken = drawn.groupBy("row_key").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return (
        sizes.join(sources, sizes["source"].eqNullSafe(sources["source"]))
        .join(taken, "row_key", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")
    )


def mixed_texts(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The rows of docs, each once for every epoch in which the mix takes words of it, with its columns as they are, dealt to
    shards and shuffled in each.

    A document whose blocks are taken in part is kept whole in that epoch, in the place of its first block taken, so texts
    aren't cut."""
    scratch = Scratch(spark)
    keyed = scratch.save(docs.select(F.monotonically_increasing_id().alias("key"), whole_row(docs).alias("row")), "keyed")
    _, _, drawn = draw(spark, keyed.select(F.col("key").alias("doc_id"), "row.text", "row.source"), mix)
    whole = drawn.groupBy("doc_id", "epoch").agg(F.min(F.struct("start", "shard", "position", "row_key")).alias("first")).select("doc_id", "epoch", "first.*")
    rows = keyed.select(F.col("key").alias("doc_id"), "row")
    return local_shuffle(rows.join(whole, "doc_id"), n_parts(spark)).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark, table(spark, sf_dir, "documents"))


__all__ = ["Mix", "draw", "local_shuffle", "mix_documents", "mixed_texts", "op10_mixing", "targets"]
