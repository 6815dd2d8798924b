"""Word and shingle hashes of Arrow text columns, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillgraph.llm.common import prefix_hash, span_hash, splitmix


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some documents, A-Z as a-z, and each document's range of them."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~blank
    first, last = word.copy(), word.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    head, tail = offsets[:-1], offsets[1:] - 1
    full = offsets[1:] > offsets[:-1]
    first[head[full]] = word[head[full]]
    last[tail[full]] = word[tail[full]]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hash(prefix_hash(data, 0, lower=True), start, stop)
    return splitmix(h ^ (stop - start).astype(np.uint64)), np.searchsorted(start, offsets)


_FACTORS = splitmix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 4) -> Iterator[np.ndarray]:
    """Of each document the sorted distinct hashes of its shingles of `width` words; of fewer words, one hash of all."""
    words, at = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        m = max(0, len(words) - width + 1)
        joined = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            joined += words[k : k + m] * _FACTORS[k]
        joined = splitmix(joined)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                yield splitmix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)
