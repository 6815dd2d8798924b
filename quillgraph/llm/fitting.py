"""Small models fitted on bounded, documented samples of labelled rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import shingles_key

#: The cut of the contracts: a score at or above it predicts label 1.
CUT = 0.3


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y) of at most `most` labelled rows whose crc32(doc_id) mod folds isn't held_out, by the order of a hash.

    A doc_id that is labelled more than once counts once, with its largest label; null labels don't count."""
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (shingles_key() % folds != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def in_fold(folds: int, k: int) -> Column:
    return F.coalesce(shingles_key() % folds == k, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, intercept: bool) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the intercept, if any, comes last and isn't shrunk."""
    if intercept:
        x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], l2)
    if intercept:
        shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def quantile_cut(s: np.ndarray, y: np.ndarray) -> float:
    """The quantile of s, at the midpoint to the next, that best separates the labels (sensitivity plus specificity)."""
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    below0, below1 = np.cumsum(y == 0), np.cumsum(y == 1)
    gain = np.where(np.append(s[1:] > s[:-1], True), below0 / max(1, below0[-1]) - below1 / max(1, below1[-1]), -2.0)
    i = int(np.argmax(gain))
    return float(s[i] + (s[i + 1] - s[i]) / 2) if i + 1 < len(s) else float(s[i]) + 1.0


class Calibrated:
    """Turns a raw score into 0 to 1: increasing, and at CUT where the raw score is at the chosen quantile."""

    def __init__(self, s: np.ndarray, y: np.ndarray):
        self.scale, self.cut = 1.0, 0.0
        self.known = len(y) > 0 and 0 < y.sum() < len(y)
        self.share = float(y.mean()) if len(y) else 0.5
        if self.known:
            self.cut = quantile_cut(s, y)
            spread = float(np.std(s)) or 1.0
            self.scale = max(float(logistic(((s - self.cut) / spread)[:, None], y, 1.0, True)[0]), 0.05) / spread

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not self.known:  # no labels, or of one class only: what is known of all documents
            return np.full(len(s), self.share)
        return 1 / (1 + np.exp(-np.clip(self.scale * (s - self.cut) + math.log(CUT / (1 - CUT)), -35, 35)))
