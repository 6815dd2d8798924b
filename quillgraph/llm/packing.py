"""Vector bin packing of token sequences by the dot-product heuristic.

Every example is a vector (tokens, segments, loss-bearing tokens); a bin has a capacity in each. A bin is opened, and the
example whose vector has the largest dot product with the bin's residual capacity is put into it until none fits; then a
piece is cut from the best-fitting example so that the bin is full. Examples wait in a pool of bounded size inside each
task, so packing needs no shuffle: one pass over the input, in proportion to its tokens. Tasks are independent and give
the same rows when they run again; sequence ids carry the partition's number.

Nulls and empty texts: such a document is the end id alone. Repeated rows are packed each time. An empty table gives no
rows. Texts longer than a sequence are cut into full sequences first. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import held_between_tasks, map_arrow, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """tokens: of a sequence. segments: pieces in a sequence. loss_tokens: loss-bearing tokens in a sequence.
    pool_tokens: tokens that wait in a task. cut: whether pieces may be cut to fill a bin."""

    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096
    pool_tokens: int = 4_000_000
    cut: bool = True


class WordTokenizer:
    """Token ids of texts, word by word: the vocabulary drops white space, so no token spans two words.

    Words are kept with their ids, up to a number of words; then the memory starts anew. A word that ends in full stops
    or commas is its stem's ids and theirs, for punctuation is a piece of its own. Words of letters alone are one piece
    each, whose last id is of a kind that ends pieces; they are encoded many at a time and divided there. A word is learnt so only if its
    ids spell as many bytes as it has, from where it begins. Of ASCII letters in small ones, nothing is normalised, so such
    words go by a tokenizer with the same merges alone. ASCII capitals are made small before words are told apart, but not in words with
    other characters: the tokenizer composes letters and marks first, and there are marks that only a capital or only a small letter takes."""

    MOST = 2_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.sizes = np.zeros(len(self.ends), dtype=np.int64)  # bytes that a token spells, a character for each
        self.sizes[list(vocab.values())] = [len(t.removesuffix("</w>")) for t in vocab]
        self.known: dict[bytes, bytes] = {}

    def _letters(self, tokenizer, words: list[bytes]) -> list[bytes]:
        """Learns words of one piece each; returns those that turn out otherwise."""
        known, others = self.known, []
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                others += part
                continue
            # where words should end, and do
            want = np.cumsum([len(w) if w.isascii() else len(normalize("NFC", w.decode()).lower().encode()) for w in part])
            here = np.cumsum(self.sizes[ids])[cut - 1] == want
            fine = here & np.append(True, here[:-1])
            flat, cut = ids.tobytes(), (cut * 4).tolist()
            if fine.all():
                known.update(zip(part, map(flat.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
                continue
            for w, x, y, ok in zip(part, [0, *cut[:-1]], cut, fine.tolist(), strict=True):
                if ok:
                    known[w] = flat[x:y]
                else:
                    others.append(w)
        return others

    def _learn(self, words: set[bytes]) -> None:
        known, stems, fresh = self.known, [], set()
        for w in words:
            stem = w.rstrip(b".,")
            if stem and stem != w and (stem[-1:].isalnum() or stem[-1] >= 128 and stem.decode()[-1].lower()[-1].isalpha()):
                tail = w[len(stem) :]
                stems.append((w, stem, tail))
                fresh.add(stem)
                fresh.add(tail)
            else:
                fresh.add(w)
        fresh = fresh.difference(known)
        ascii_, letters, others = [], [], []
        for w in fresh:
            (ascii_ if w.isalpha() and w.islower() else letters if w.decode().lower().isalpha() else others).append(w)
        others += self._letters(self.plain, ascii_) + self._letters(self.tokenizer, letters)
        for i in range(0, len(others), 8192):
            part = others[i : i + 8192]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, stem, tail in stems:
            known[w] = known[stem] + known[tail]

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """The words of a text. Names of special tokens keep their case, and so do words with marks: U+0300 to U+037F are the characters that
        begin with these two bytes, and no others go together with an ASCII letter."""
        if b"<|" in text:
            return text.split()
        if b"\xcc" in text or b"\xcd" in text:
            return [w.lower() if w.isascii() else w for w in text.split()]
        return text.lower().split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = [(t or "").encode() for t in texts]
        split = [self._words(b) for b in raw]
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        missing: set[bytes] = set()
        for words in split:
            missing.update(filterfalse(known.__contains__, words))
        if missing:
            self._learn(missing)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}
held_between_tasks(_TOKENIZERS)


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its tasks share what it has learnt."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """The pool of one task: add() takes examples, and yields pieces as their places are known."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.waiting: dict[tuple[int, int], list[tuple]] = {}
        self.tokens = 0
        self.done: list[tuple] = []

    def add(self, doc: int, ids: bytes, loss_from: int = 0) -> None:
        """An example whose ids from position loss_from on bear loss."""
        full, total = self.limits.tokens, len(ids) // 4
        start = 0
        while total - start >= full and full - max(0, loss_from - start) <= self.limits.loss_tokens:
            self._emit([(doc, ids, start, full, total, loss_from)])
            start += full
        while start < total:
            n = min(total - start, full)
            n = min(n, max(0, loss_from - start) + self.limits.loss_tokens)
            self._wait((doc, ids[4 * start : 4 * (start + n)], start, n, total, loss_from))
            start += n
        if self.tokens >= self.limits.pool_tokens:
            self.pack(self.limits.pool_tokens // 8)

    @staticmethod
    def _loss(piece: tuple) -> int:
        _, _, start, n, _, loss_from = piece
        return min(n, max(0, start + n - max(start, loss_from)))

    def _wait(self, piece: tuple) -> None:
        self.waiting.setdefault((piece[3], self._loss(piece)), []).append(piece)
        self.tokens += piece[3]

    def _take(self, key: tuple[int, int]) -> tuple:
        bucket = self.waiting[key]
        piece = bucket.pop()
        if not bucket:
            del self.waiting[key]
        self.tokens -= piece[3]
        return piece

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            doc, ids, start, n, total, _ = p
            own = ids if len(ids) == 4 * n else ids[4 * start : 4 * (start + n)]
            self.done.append((doc, start, n, zlib.crc32(own), total, self._loss(p), self.next_id, at))
            at += n
        self.next_id += 1

    def pack(self, keep: int) -> None:
        """Fills bins until no more than keep tokens wait."""
        lim = self.limits
        cap = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=float)
        keys = np.array(sorted(self.waiting), dtype=np.int64).reshape(-1, 2)
        count = np.array([len(self.waiting[tuple(k)]) for k in keys.tolist()], dtype=np.int64)
        unit = np.column_stack([keys[:, 0], np.ones(len(keys)), keys[:, 1]]) / cap
        while self.tokens > keep and self.tokens >= lim.tokens:
            left, pieces = cap.copy(), []
            live = count > 0
            while left[0] > 0 and left[1] > 0:
                score = np.where(live & (keys[:, 0] <= left[0]) & (keys[:, 1] <= left[2]), unit @ (left / cap), -1.0)
                best = int(np.argmax(score)) if len(score) else -1
                if best < 0 or score[best] < 0:
                    break
                p = self._take(tuple(keys[best].tolist()))
                count[best] -= 1
                live[best] = count[best] > 0
                pieces.append(p)
                left -= (p[3], 1, self._loss(p))
            gap = int(left[0])
            if gap and left[1] > 0 and lim.cut and (fit := self._cut(gap, int(left[2]), keys, count)):
                pieces.append(fit[0])
                self._wait(fit[1])
                key = np.array([[fit[1][3], self._loss(fit[1])]])
                hit = np.flatnonzero((keys == key).all(axis=1))
                if len(hit):
                    count[hit[0]] += 1
                else:
                    keys, count = np.vstack([keys, key]), np.append(count, 1)
                    unit = np.vstack([unit, np.array([[key[0, 0], 1, key[0, 1]]]) / cap])
            self._emit(pieces)

    def _cut(self, gap: int, loss_left: int, keys: np.ndarray, count: np.ndarray) -> tuple | None:
        """A piece of gap tokens from the longest example that has one, and the rest of it."""
        order = np.flatnonzero((count > 0) & (keys[:, 0] > gap))
        for i in order[np.argsort(-keys[order, 0], kind="stable")][:8].tolist():
            doc, ids, start, n, total, loss_from = self.waiting[tuple(keys[i].tolist())][-1]
            if self._loss(head := (doc, ids[: 4 * gap], start, gap, total, loss_from)) <= loss_left:
                self._take(tuple(keys[i].tolist()))
                count[i] -= 1
                return head, (doc, ids[4 * gap :], start + gap, n - gap, total, loss_from)
        return None

    def finish(self) -> None:
        """Packs all that waits. What is left at the end is cut at powers of two, which need no padding."""
        self.pack(0)
        rest = [p for key in sorted(self.waiting, reverse=True) for p in self.waiting[key]]
        self.waiting, self.tokens = {}, 0
        while rest:
            total = sum(p[3] for p in rest)
            room = (1 << min(total.bit_length() - 1, self.limits.tokens.bit_length() - 1)) if self.limits.cut else self.limits.tokens
            loss, pieces = self.limits.loss_tokens, []
            while rest and room and len(pieces) < self.limits.segments:
                doc, ids, start, n, of, loss_from = rest[0]
                take = min(n, room) if self.limits.cut or n <= room else 0
                head = (doc, ids[: 4 * take], start, take, of, loss_from)
                if not take or self._loss(head) > loss:
                    break
                pieces.append(head)
                room, loss = room - take, loss - self._loss(head)
                rest[:1] = [(doc, ids[4 * take :], start + take, n - take, of, loss_from)] if take < n else []
            self._emit(pieces)

    def drain(self) -> pa.RecordBatch | None:
        if not self.done:
            return None
        cols = [pa.array(c, pa.int64()) for c in zip(*self.done, strict=True)]
        self.done = []
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 2) -> DataFrame:  # noqa: B008
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset) of all docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
            if (out := packer.drain()) is not None:
                yield out
        packer.finish()
        if (out := packer.drain()) is not None:
            yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA, keeps=True)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
