"""Toxic passages by maximum-scoring segments.

Words and their first letters (stems of inflected words) get log-odds, of the toxic documents against the clean ones that hold
them in the training sample, under an informative Dirichlet prior. A word scores as it is or else as its longest known
beginning; where the odds are within noise it scores a small negative drift. In each text one linear scan finds all maximal segments of
tokens. Segment scores of clean documents follow an extreme-value law with parameters lambda (from the token distribution)
and K (by maximum likelihood); each segment's score is normalised by it, so long texts aren't favoured, and the significant
ones are summed. The sum is then calibrated to 0..1, with the best-separating quantile at 0.3.

Null and empty texts have no segment and the lowest evidence. Very long texts are scanned whole, in time linear in their tokens. Of
segments with equal scores the shortest and then the first is meant; equal documents get equal scores. Without labels, or with one
class only, all scores are that class's share (0.5 without any). Repeated rows are scored each; an empty table gives no rows; other
columns, whatever their names, are ignored. No shuffle of texts: the sample is a broadcast join of at most train_docs ids, written
once, and the token table (of that sample) is the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, map_arrow, table
from quillgraph.llm.fitting import CUT, Calibrated, in_fold, labelled_sample

#: ASCII punctuation ends a token; other bytes stay.
SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


@dataclass(frozen=True)
class Toxicity:
    """train_docs: labelled rows in the sample. prior: pseudo-tokens of the Dirichlet prior. z: standard deviations from 0
    that a token's log-odds need. drift: the score of any other token. significance: of a segment, as a probability.
    stems: letters of the beginnings that count as tokens."""

    train_docs: int = 40_000
    prior: float = 500.0
    z: float = 4.5
    stems: tuple[int, ...] = (4, 5, 6, 7)
    drift: float = -0.02
    significance: float = 0.05
    folds: int = 4
    held_out: int = 2


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().encode().translate(SPLIT).decode().split()


def with_stems(word: str, stems: tuple[int, ...]) -> list[str]:
    """A word, then its beginnings from the longest; a beginning is marked by a star."""
    return [word, *(word[:k] + "*" for k in reversed(stems) if len(word) > k)]


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text in which position i scores s for (i, s) in hits, and
    any other position drift (below 0). Linear: each segment keeps a link to the nearest earlier one with a lower sum before
    it, so a search skips what it can't join to, and what one search has skipped no later one meets."""
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum through it, link
    total, at = 0.0, -1
    for i, s in hits:
        total += drift * (i - at - 1)
        at = i
        before, total = total, total + s
        if s <= 0:
            continue
        first, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, _, before, _, link = found[j]
            del found[j:]
            j = link
        found.append((first, i, before, total, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


class SegmentModel:
    """Token scores with the extreme-value law of clean texts' segments."""

    def __init__(self, scores: dict[str, float], clean: dict[str, float], p: Toxicity):
        self.scores, self.drift, self.significance, self.stems = scores, p.drift, p.significance, p.stems
        self.memory: dict[str, float | None] = {}
        self.lam, self.k = self._lambda([(s, clean[t]) for t, s in scores.items()]), 1.0
        self.calibrated: Calibrated | None = None

    def _lambda(self, dist: list[tuple[float, float]]) -> float:
        """The positive root of E[exp(lambda s)] = 1 over the tokens of clean texts."""
        s, q = np.array([x for x, _ in dist] + [self.drift]), np.array([x for _, x in dist] + [0.0])
        q[-1] = max(0.0, 1 - q.sum())
        if not (s > 0).any() or s @ q >= 0:
            return 1.0
        lo, hi = 1e-6, 1.0
        while q @ np.exp(np.minimum(hi * s, 500)) < 1 and hi < 64:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if q @ np.exp(np.minimum(mid * s, 500)) < 1 else (lo, mid)
        return lo

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        memory = self.memory
        if len(memory) > 500_000:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = next((s for x in with_stems(w, self.stems) if (s := self.scores.get(x)) is not None), None)
        hits = [(i, s) for i, w in enumerate(words) if (s := memory[w]) is not None]
        return len(words), maximal_segments(hits, self.drift)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Normalised scores of the significant segments, summed; else the best one's, at most 0."""
        if not found:
            return -log(max(self.k * max(n, 1), 1e-9) + 1) - 1
        level = -log(self.significance)
        norm = [self.lam * s - log(max(self.k * n, 1e-9)) for _, _, s in found]
        over = [x - level for x in norm if x > level]
        return sum(over) if over else min(0.0, max(norm) - level)

    def significant(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first token, last token, expected number of such segments in a clean text) of every significant passage."""
        n, found = self.segments(text)
        out = [(a, b, self.k * n * exp(-min(self.lam * s, 700))) for a, b, s in found]
        return [x for x in out if x[2] < self.significance]


def _count(stems: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens with the documents of either label that hold them, summed over what a task reads (flushed at a million)."""
        n: list[Counter] = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            words = list(n[0] | n[1])
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in n)], names=["token", "clean", "toxic"])
            for c in n:
                c.clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[int(y > 0)].update({x for w in set(tokens(text)) for x in with_stems(w, stems)})
            if len(n[0]) + len(n[1]) > 1_000_000:
                yield flush()
        yield flush()

    return run


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> SegmentModel:  # noqa: B008
    sample = labelled_sample(labels, "toxic", p.folds, p.held_out, p.train_docs)
    scratch = Scratch(docs.sparkSession)
    known = scratch.save(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text"), "sample")  # train_docs ids at most
    counts = scratch.save(
        map_arrow(known, _count(p.stems), "token string, clean long, toxic long")
        .groupBy("token")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "counts",
    )
    sums = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n0, n1, a0 = float(sums.clean), float(sums.toxic), p.prior
    scores: dict[str, float] = {}
    clean: dict[str, float] = {}
    if n0 and n1:
        a = 1 + F.lit(a0) * (F.col("clean") + F.col("toxic")) / F.lit(n0 + n1)  # in proportion to the corpus, one at least
        odds = lambda c, n: F.log((c + a) / (F.lit(n + a0) - c - a))
        rows = (
            counts.select("token", "clean", (odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)).alias("d"), (1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)).alias("v"))
            .where(F.abs("d") >= p.z * F.sqrt("v"))
            .collect()  # tokens of the bounded sample only
        )
        scores = {r.token: r.d for r in rows}
        clean = {r.token: (r.clean + 0.5) / (n0 + 1) for r in rows}
    model = SegmentModel(scores, clean, p)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.segments(t) for t in batch.column(1).to_pylist()]
            top = [max((s for *_, s in x), default=0.0) for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(top, pa.float64())], names=["y", "n", "s"])

    def evident(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ev = [model.evidence(*model.segments(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ev, pa.float64())], names=["y", "ev"])

    # a row for each document of the bounded sample; K comes first, for the evidence depends on it
    if quiet := sorted((r.n, r.s) for r in map_arrow(known.where("y = 0"), best, "y int, n long, s double").collect() if r.n):
        model.k = len(quiet) / sum(n * exp(-min(model.lam * s, 700)) for n, s in quiet)
    rows = sorted(map_arrow(known, evident, "y int, ev double").collect())
    model.calibrated = Calibrated(np.array([r.ev for r in rows], dtype=float), np.array([int(r.y > 0) for r in rows], dtype=int))
    scratch.drop("sample")
    return model


def score(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """(doc_id, score, n_passages) of all docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.segments(t) for t in batch.column(1).to_pylist()]
            ev = np.array([model.evidence(n, x) for n, x in found], dtype=float)
            level = -log(model.significance)
            many = [sum(model.lam * s - log(max(model.k * n, 1e-9)) > level for *_, s in x) for n, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.calibrated(ev)), pa.array(many, pa.int64())], names=["doc_id", "score", "n_passages"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, n_passages long")


def op1_toxicity(spark: SparkSession, sf_dir: str, p: Toxicity = Toxicity()) -> DataFrame:  # noqa: B008
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), p)
    return score(docs, model).select(
        "doc_id", in_fold(p.folds, p.held_out).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_passages"
    )
