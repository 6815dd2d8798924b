"""Quality scores from preference pairs: a Bradley-Terry model of documents, cut at a quantile of its scores.

Each document has a few shape features (letters, symbols, repetition, lines). Every feature is cut into steps at quantiles
of the training sample. Pairs of a preferred (label 1) and a rejected (label 0) document are drawn, and logistic loss on the
differences of their features learns the weights; a document's strength is the weighted sum of its own features. The cut is
the quantile of the strengths that separates the sample best, and maps to a score of 0.3.

Null and empty texts have the features of a text without words, and a score. Very long texts are read whole, one at a time. Without
labels, or with one class only, all scores are that class's share (0.5 without any). Repeated rows are scored each, and equal texts
alike; a score at the cut is kept. Of rows of one id the sample takes the one with the least features. An empty table gives no rows. Other
columns, whatever their names, are ignored, or passed on by keep_good. The text is read once for the sample (a broadcast join of at
most train_docs ids) and once for the scores, with no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import map_arrow, table, whole_row
from quillgraph.llm.fitting import CUT, Calibrated, in_fold, labelled_sample, logistic

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:!?'-"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in STOPS)
HIGH = bytes(range(128, 256))


@dataclass(frozen=True)
class Quality:
    """train_docs: labelled rows in the sample. pairs: preference pairs drawn from it. steps: of a feature. folds, held_out:
    rows whose crc32(doc_id) mod folds is held_out are never learnt from."""

    train_docs: int = 20_000
    pairs: int = 40_000
    steps: int = 8
    l2: float = 0.5
    folds: int = 5
    held_out: int = 0
    seed: int = 11


def features(text: str | None) -> list[float]:
    b = (text or "").encode()
    n = len(b)
    words = b.split()
    k = len(words)
    if not k:
        return [0.0] * 14
    without = lambda chars: (n - len(b.translate(None, chars))) / n
    lines = b.split(b"\n")
    seen = Counter(words)
    top = max(seen.values())
    return [
        log1p(k),
        without(UPPER),
        without(SYMBOLS),
        without(STOPS),
        without(DIGITS),
        without(HIGH),
        log1p(len(seen)) / log1p(k),
        sum(map(eq, words, words[1:])) / k,
        top / k,
        len(set(lines)) / len(lines),
        (n - k) / k,
        b.count(b"!") / k,
        sum(len(w) == 1 and not w.isalnum() for w in words) / k if seen.keys() & ONE else 0.0,
        b.count(b".") / k,
    ]


ONE = {bytes([c]) for c in SYMBOLS + STOPS}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))],
            names=["doc_id", "y", "x"],
        )


class BradleyTerry:
    def __init__(self, x: np.ndarray, y: np.ndarray, p: Quality):
        self.edges: list[np.ndarray] = []
        self.weights = np.zeros(0)
        self.known = len(y) > 0 and 0 < y.sum() < len(y)
        if self.known:
            q = (np.arange(p.steps - 1) + 1) / p.steps
            tails = np.array([0.005, 0.02, 0.05, 0.95, 0.98, 0.995])
            self.edges = [np.unique(np.quantile(x[:, j], np.concatenate([q, tails]))) for j in range(x.shape[1])]
            z = self._steps(x)
            rng = np.random.default_rng(p.seed)
            win, lose = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            a, b = rng.choice(win, p.pairs), rng.choice(lose, p.pairs)
            flip = rng.random(p.pairs) < 0.5  # either side first, so that the loss is balanced
            d = np.where(flip[:, None], z[b] - z[a], z[a] - z[b])
            self.weights = logistic(d, (~flip).astype(float), p.l2, False)
        self.calibrated = Calibrated(self.strength(x) if self.known else np.zeros(len(y)), y)

    def _steps(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[:, j : j + 1] > e[None, :]).astype(float) for j, e in enumerate(self.edges)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._steps(x) @ self.weights if self.known else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.strength(x))


def fit(docs: DataFrame, labels: DataFrame, p: Quality = Quality()) -> BradleyTerry:  # noqa: B008
    sample = labelled_sample(labels, "quality", p.folds, p.held_out, p.train_docs)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")  # train_docs ids at most
    found = map_arrow(known, _features, "doc_id long, y int, x array<double>")
    rows = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()  # a row for each document of the bounded sample
    rows.sort(key=lambda r: r.doc_id)
    return BradleyTerry(np.array([r.x for r in rows], dtype=float).reshape(len(rows), 14), np.array([r.y for r in rows], dtype=int), p)


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """docs with the score of each text; other columns pass as they are, but one of that name."""
    rows = docs.select(whole_row(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(0)))], names=["row", "score"])

    names = [c for c in docs.columns if c != "score"]
    return map_arrow(rows, run, rows.withColumn("score", F.lit(0.0)).schema).select(*(F.col("row").getField(c).alias(c) for c in names), "score")


def _scores(model: BradleyTerry, rows: pa.StructArray) -> np.ndarray:
    texts = rows.field("text").to_pylist()
    return model.score(np.array([features(t) for t in texts], dtype=float).reshape(len(texts), 14))


def op9_quality(spark: SparkSession, sf_dir: str, p: Quality = Quality()) -> DataFrame:  # noqa: B008
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), p)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold(p.folds, p.held_out).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, p: Quality = Quality()) -> DataFrame:  # noqa: B008
    """docs without those that the model rejects; its columns as they are."""
    model, names = fit(docs, table(spark, sf_dir, "labels"), p), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.filter(pa.array(_scores(model, batch.column(0)) >= CUT))
            yield pa.RecordBatch.from_arrays(good.column(0).flatten(), names=names)

    return map_arrow(docs.select(whole_row(docs).alias("row")), run, docs.schema)
