"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def fold(doc_id, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def smallest(ids, links) -> dict:
    """The smallest id that each id reaches."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text: str | None, width: int) -> set:
    w = lower(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_duplicates(docs: dict, width: int, percent: int) -> dict:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    ids, links = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    comp = smallest(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def repeats(docs: dict, length: int) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what stays)."""
    data = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def usable(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine_links(rows: list, cosine: float) -> dict:
    """vec_id -> (n_links, component_id, kept) of rows (vec_id, embedding, label)."""
    good = [(i, np.array(v, dtype=float), y) for i, v, y in rows if y is not None and usable(v)]
    n, links = Counter(), []
    for k, (a, x, y) in enumerate(good):
        for b, z, w in good[k + 1 :]:
            if y == w and len(x) == len(z) and (x @ z) / (np.sqrt(x @ x) * np.sqrt(z @ z)) >= cosine:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    comp = smallest([r[0] for r in rows], links)
    return {i: (n[i], comp[i], comp[i] == i) for i, *_ in rows}


def nearest(rows: list, k: int, every: int) -> dict:
    """query -> its k nearest (vec_id, score) of rows (vec_id, embedding)."""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if usable(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            score = x @ v
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def base_scores(docs: dict, folds: int = 5, out_of: int = 1) -> dict:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    toks = {i: [*lower(t), None] for i, t in docs.items()}
    c = Counter(w for i, ws in toks.items() if fold(i, folds) != out_of for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return {i: (fold(i, folds) == out_of, len(ws), sum(c[w] > 0 for w in ws), n, sum(map(base, ws))) for i, ws in toks.items()}
