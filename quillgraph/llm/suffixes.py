"""Content-chosen suffixes of texts, many documents at a time.

Of each window of `length` bytes the k-gram with the least hash (the last among equal ones) is its anchor. Equal windows have
equal anchors at equal places, so a repeated window shows as a repeated anchor. Neighbouring windows mostly share one: a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quillgraph.llm.common import prefix_hash, span_hash, splitmix

_BITS = 22
_MASK = np.uint64((1 << _BITS) - 1)
#: Windows that are worked on together; places in them fit _BITS.
STEP = 1 << 20


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: prefix and suffix minima of blocks of w."""
    n = len(key)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    padded = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(padded, axis=1).reshape(-1)
    m = n - w + 1
    return np.minimum(ahead[:m], behind[w - 1 : w - 1 + m])


def valid_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of `length` bytes from each place stays in one document."""
    n = int(offsets[-1])
    step = np.zeros(n + 1, dtype=np.int64)
    long = offsets[1:] - offsets[:-1] >= length
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - length + 1, -1)
    return np.cumsum(step[:-1]) > 0


def runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first start, last start, anchor, hash of the anchor, two hashes of all bytes of the run) of all runs.

    Places count from a document's start; runs of a very long text end at every STEP windows."""
    total = len(data)
    ok = valid_starts(offsets, length)
    w = length - k + 1
    for base in range(0, max(0, total - length + 1), STEP):
        part = data[base : base + STEP + length - 1]
        good = ok[base : base + min(STEP, len(part) - length + 1)]
        if not good.any():
            continue
        h = prefix_hash(part)
        at = np.arange(len(part) - k + 1)
        gram = splitmix(span_hash(h, at, at + k))
        key = (gram & ~_MASK) | (_MASK - at.astype(np.uint64))
        anchor = (_MASK - (_window_min(key, w) & _MASK)).astype(np.int64)[: len(good)]
        cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])))
        doc_head = offsets[(offsets > base) & (offsets < base + len(good))] - base
        cut = np.union1d(cut, doc_head)
        last = np.append(cut[1:], len(good)) - 1
        lo, hi = cut[good[cut]], last[good[cut]]
        a = anchor[lo]
        place = splitmix(((a - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64))
        f1 = splitmix(span_hash(h, lo, hi + length) ^ place)
        f2 = splitmix(span_hash(prefix_hash(part, 1), lo, hi + length, 1) + place)
        doc = np.searchsorted(offsets, lo + base, side="right") - 1
        shift = base - offsets[doc]
        yield doc, lo + shift, hi + shift, a + shift, gram[a], f1, f2


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of a text from some places, in their order."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for base in range(0, len(data), STEP):
        mine = np.flatnonzero((starts >= base) & (starts < base + STEP))
        if len(mine):
            at = starts[mine] - base
            out[mine] = splitmix(span_hash(prefix_hash(data[base : base + STEP + length - 1]), at, at + length))
    return out
