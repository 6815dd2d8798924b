"""Language-model scores from a probabilistic suffix tree over tokens.

Tokens are words (A-Z as a-z), then one end. The model's symbols are the distinct training tokens and one symbol for any
unknown token, like those of the base. The root's distribution has the counts of all training tokens, less a discount that
depends on the count (estimated from the numbers of tokens seen once to four times); what is taken off is the unknown token's.
A context is some tokens that occur `least` times before others in training texts, a fixed number whatever the corpus. It is
retained if its next-token distribution diverges from its parent's (the longest retained suffix) by more than chance, by a G
test over all its successors. Its distribution is interpolated with the parent's, the more so the more distinct successors it
has (Witten and Bell). All contexts of one and two tokens are tested; longer ones are where they extend a retained one, and
this goes on until a depth retains none. A context with a single successor isn't extended, for its extensions can't diverge
from it. A token is scored in the longest retained suffix of what stands before it.

All counts are exact and unbounded, so none is held whole: the scan cuts the corpus into blocks of neighbouring texts, which are
written once, dealt by block; only counts travel. A block sends each bucket of tokens its own ones with their counts, and gets their
numbers and counts in the order it named them. So do contexts, depth by depth: a block sends each bucket of contexts the pairs of
a context and a next token it has, in training texts or not, with the context's share of the divergence from the parent's probabilities,
which the block knows; the bucket adds up and tests; and back come the pairs' counts in the same order, and what the test says of the
contexts. A block goes through the depths so far again, so little but these answers is kept; after depths 3, 6, 12 and so on it writes the
places that go on, with their probabilities, and the sums of the others, and starts from there. The pairs of a context that occurs very
often are dealt to many buckets, and their sums added. Contexts of two tokens and more are named by 64-bit hashes. A task holds one
block's tokens and pairs, or one bucket's pairs; numbers travel as compressed bytes.

Null and empty texts are the end alone. Repeated rows are counted and scored each. Null ids are training rows (their fold is
not the held-out one). Without training tokens, N and V are 0 and every token is unknown for certain. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, map_arrow, n_parts, powers, prefix_hash, span_hash, splitmix, table, trim
from quillgraph.llm.fitting import in_fold

END = b""


@dataclass(frozen=True)
class Tree:
    """least: occurrences that a context needs, 2 at least. sigma: standard deviations above chance of the divergence. tokens: of a block, about; a text stays whole. slice: occurrences of a context for each bucket that its pairs are dealt to. folds, held_out: rows whose crc32(doc_id) mod folds is held_out aren't learnt from."""

    least: float = 2
    sigma: float = 6.0
    tokens: int = 1 << 21
    slice: int = 1 << 20
    folds: int = 5
    held_out: int = 1


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, as tokens() has them but for the ends, and each text's number of tokens."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(text.fill_null("")))
    lists = pc.ascii_split_whitespace(bare)
    words, empty = lists.flatten(), pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, lists.value_lengths().to_numpy().astype(np.int64) - empty + 1


def _named(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each token."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    stop = np.cumsum(size)
    h = prefix_hash(np.frombuffer(b"".join(words), dtype=np.uint8))
    return splitmix(span_hash(h, stop - size, stop) ^ splitmix(size.astype(np.uint64)))


def _spans(tok: np.ndarray):
    """A function of (places, depth): hashes of the `depth` tokens before each place, of one token after another."""
    with np.errstate(over="ignore"):
        h = np.append(np.uint64(0), np.cumsum(tok * powers(0, len(tok))[0][: len(tok)], dtype=np.uint64))

    def name(at: np.ndarray, depth: int) -> np.ndarray:
        return splitmix(span_hash(h, at - depth, at) + np.uint64(depth))

    return name


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes, all second ones and so on; whole ones, none below zero, in as few as the largest needs."""
    if x.dtype.kind != "f":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.dtype.char.encode() + x.nbytes.to_bytes(8, "little") + (pa.compress(_by_place(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def _by_place(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)


def _unpacked(b: bytes) -> np.ndarray:
    kind, size = np.dtype(b[:1].decode()), int.from_bytes(b[1:9], "little")
    if not size:
        return np.zeros(0, dtype=kind)
    flat = np.frombuffer(pa.decompress(b[9:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _joined(packed: list[bytes], kind) -> np.ndarray:
    return np.concatenate([_unpacked(b).astype(kind) for b in packed]) if packed else np.zeros(0, dtype=kind)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, a place of each, and which of them stands at each place; faster than np.unique, which wants first places."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def _stably(bucket: np.ndarray) -> np.ndarray:
    """np.argsort in order of places, by counting where numbers are small."""
    return np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max(initial=0)))), kind="stable")


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(sorted_keys)
    return np.concatenate([np.zeros(1, np.int64), np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)


def _rows(columns: list[list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


#: A block's own row (bucket -1; a: each text's number of tokens, b: which are held out, c: tokens by number, docs: ids) or
#: its tokens of one bucket (a: tokens, b: their number of bytes, c: counts in training texts).
BLOCKS = "block long, bucket int, a binary, b binary, c binary, docs array<long>"
TOKEN_BUCKETS = 256


def _blocks(most: int):
    """BLOCKS of rows (doc_id, held_out, text). A block numbers its distinct tokens in the order of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        docs, held, sizes, flat, n = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, n
            coded, block = pa.chunked_array(flat).combine_chunks().dictionary_encode(), (task << 32) + made
            words, size = [*coded.dictionary.cast(pa.binary()).to_pylist(), END], np.concatenate(sizes)
            at, ends = np.full(size.sum(), len(words) - 1), np.zeros(size.sum(), dtype=bool)
            ends[np.cumsum(size) - 1] = True
            at[~ends] = coded.indices.to_numpy()
            bucket = (_named(words) % np.uint64(TOKEN_BUCKETS)).astype(np.int64)
            order = _stably(bucket)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            train = np.repeat(~np.array(held), size)
            count = np.bincount(at[train], minlength=len(words))[order]
            out = [[block], [-1], [_packed(size)], [_packed(np.array(held).astype(np.uint8))], [_packed(rank[at])], [docs[:]]]
            cut = _cuts(bucket[order])
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine = [words[i] for i in order[x:y].tolist()]
                row = (block, int(bucket[order[x]]), b"".join(mine), _packed(np.array([len(w) for w in mine])), _packed(count[x:y]), None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            made, n = made + 1, 0
            for had in (docs, held, sizes, flat):
                had.clear()
            yield from _rows(out, BLOCKS).to_batches()

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                doc, out, text = (batch.column(j).slice(i, 512) for j in range(3))
                words, size = _words(text)
                stop, a = np.append(0, np.cumsum(size)), 0
                while a < len(size):
                    b = min(int(np.searchsorted(stop, stop[a] + most - n)), len(size))  # the text that fills the block is its last
                    docs += doc.slice(a, b - a).to_pylist()
                    held += out.slice(a, b - a).to_pylist()
                    sizes.append(size[a:b])
                    flat.append(words.slice(stop[a] - a, stop[b] - b - stop[a] + a))
                    n += stop[b] - stop[a]
                    a = b
                    if n >= most:
                        yield from flush()
        if docs:
            yield from flush()

    return run


#: The numbers of a block's tokens of a bucket and their counts; one row of a bucket has its numbers of training tokens,
#: distinct ones and those seen once to four times, the others have zeros.
NAMES = "block long, bucket int, number binary, count binary, n long, v long, n1 long, n2 long, n3 long, n4 long"


def _number(part: pa.Table) -> pa.Table:
    """NAMES of the tokens of one bucket of all blocks."""
    rows = sorted(part.select(["block", "bucket", "a", "b", "c"]).to_pylist(), key=lambda r: r["block"])
    sizes = [_unpacked(r["b"]).astype(np.int64) for r in rows]
    offsets = np.append(0, np.cumsum(np.concatenate(sizes)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(r["a"] for r in rows))])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    own = _joined([r["c"] for r in rows], np.int64)
    c = np.bincount(code, weights=own).astype(np.int64)
    number = code * TOKEN_BUCKETS + rows[0]["bucket"]
    stop = np.cumsum([len(s) for s in sizes])
    cut = [(e - len(s), e) for e, s in zip(stop.tolist(), sizes, strict=True)]
    told = [int(c.sum()), int((c > 0).sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]
    first = lambda x: [x] + [0] * (len(rows) - 1)
    return _rows([[r["block"] for r in rows], [r["bucket"] for r in rows], [_packed(number[a:b]) for a, b in cut], [_packed(c[code[a:b]]) for a, b in cut], *map(first, told)], NAMES)


@dataclass
class Model:
    """n, v: training tokens and distinct ones. seen: distinct tokens by their count, 1 to 4. frequent: tokens of the
    contexts, with their numbers. Each level has the retained contexts' codes with the log10 factor of other tokens, and
    (context, token) codes with log10 probabilities."""

    n: int
    v: int
    seen: tuple[int, ...]
    frequent: dict[bytes, int] = field(default_factory=dict)
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def discounts(self) -> np.ndarray:
        """What is taken off the counts 1, 2, and 3 or more."""
        n1, n2, n3, n4 = self.seen
        share = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * share * b / a if a else share for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return np.clip(raw, 0.05, [0.95, 1.9, 2.8])

    def root(self, c: np.ndarray) -> np.ndarray:
        """log10 of the root's probabilities of tokens with some counts; 0 stands for the unknown token."""
        if not self.n:
            return np.zeros(len(c))
        off = self.discounts()
        n1, n2 = self.seen[:2]
        unknown = (off[0] * n1 + off[1] * n2 + off[2] * (self.v - n1 - n2)) / self.n
        level = np.clip(c, 1, 3).astype(np.int64) - 1
        return np.log10(np.where(c > 0, (c - off[level]) / self.n, unknown))

    @property
    def width(self) -> int:
        return max(1, len(self.frequent))


def _retain(model: Model, context: np.ndarray, token: np.ndarray, n: np.ndarray, unigram: np.ndarray, depth: int, p: Tree) -> tuple:
    """The retained contexts of a depth, of sorted successor counts of all candidates: as tested() does, of a small model in
    memory whose tokens are numbered (-1 for others)."""
    keys, factors, pairs, values = [], [], [], []
    cut = [0, *(np.flatnonzero(np.diff(context)) + 1).tolist(), len(context)]
    for a, b in zip(cut, cut[1:], strict=False):
        if a == b:
            continue
        ids, c, total = token[a:b], n[a:b].astype(float), float(n[a:b].sum())
        known = ids >= 0
        w, cw = ids[known], c[known]
        parent = _parent(model, int(context[a]), w, unigram, depth)
        rest_c, rest_p = total - cw.sum(), max(1 - parent.sum(), 1e-12)
        g = 2 * ((cw * np.log(cw / total / parent)).sum() + (rest_c * np.log(rest_c / total / rest_p) if rest_c else 0.0))
        df = len(w) + (rest_c > 0) - 1
        if df < 1 and g < 20 or g <= df + p.sigma * np.sqrt(2 * max(df, 1)):
            continue
        lam = len(c) / (total + len(c))
        own = (1 - lam) * cw / total + lam * parent
        keys.append(int(context[a]))
        factors.append(np.log10(max(1 - own.sum(), 1e-12) / rest_p))
        pairs.append(w + (len(keys) - 1) * model.width)
        values.append(np.log10(own))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
    return np.array(keys, dtype=np.int64), np.array(factors), cat(pairs, np.int64), cat(values, float)


def _parent(model: Model, context: int, w: np.ndarray, unigram: np.ndarray, depth: int) -> np.ndarray:
    """Probabilities of frequent tokens w in the longest retained proper suffix of a context."""
    out = np.log10(unigram[w])
    for d, (keys, factor, pairs, value) in enumerate(model.levels[: depth - 1], 1):
        code = context % model.width**d
        at = int(np.searchsorted(keys, code))
        if at < len(keys) and keys[at] == code:
            out = out + factor[at]
            if len(pairs):
                j = np.minimum(np.searchsorted(pairs, at * model.width + w), len(pairs) - 1)
                hit = pairs[j] == at * model.width + w
                out[hit] = value[j[hit]]
    return 10**out


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


#: A block's pairs of one bucket: its contexts (sorted, by their differences), whether they are dealt to many buckets, their numbers of pairs
#: and sums of n * -ln(the parent's probability) as whole numbers of 1 / FINE, and the pairs' next tokens and counts n in training texts.
#: So blocks may be added in any order, and a block's part of a divergence is off by 4e-6 at most, where tests ask for 9 and more.
FINE = 1 << 18
ASKED = "block long, bucket int, context binary, spread binary, pairs binary, parent binary, token binary, n binary"
#: The pairs' counts in all training texts, and of the contexts whether they are retained (1) and may be extended (2), and total
#: and number of successors where they are retained. One row of a bucket has the sums of its spread contexts.
TOLD = "block long, depth int, bucket int, n binary, says binary, total binary, k binary, spread array<long>, sums array<long>, kinds array<long>, parts binary"

#: A block with what it knows of itself after a depth: its tokens' numbers and counts, and the places that go on with the counts of their next
#: contexts and their probabilities, and each text's sum of the others' log10 probabilities.
STATE = "block long, a binary, b binary, c binary, docs array<long>, depth int, number binary, count binary, places binary, seen binary, p binary, sums binary"


def _judged(total: np.ndarray, k: np.ndarray, x: np.ndarray, depth: int, p: Tree) -> np.ndarray:
    """1 for retained contexts, plus 2 for those that may be extended; x: the sum of n * ln(n / the parent's probability)."""
    some = np.maximum(total, 1)
    g, df = 2 * (x - some * np.log(some)), k - 1
    chance = ((df < 1) & (g < 20)) | (g <= df + p.sigma * np.sqrt(2 * np.maximum(df, 1)))
    frequent = total >= max(2, p.least)
    retained = frequent & ~chance
    return retained + 2 * (frequent & (k > 1) & (retained | (depth == 1)))


class _Block:
    """A block's texts with what it was told so far. p: each token's probability in its longest retained context; extends: whether
    the context of the last depth before a place may be extended; seen: count of the tokens before a place that are the
    next depth's context, -1 if it isn't known."""

    def __init__(self, model: Model, p: Tree, row: dict, told: list[dict]):
        self.model, self.tree = model, p
        self.size, self.held, self.at = _unpacked(row["a"]).astype(np.int64), _unpacked(row["b"]).astype(bool), _unpacked(row["c"]).astype(np.int64)
        written = row.get("depth") is not None
        names = [row] if written else sorted((r for r in told if r["depth"] == 0), key=lambda r: r["bucket"])
        self.number = _joined([r["number"] for r in names], np.uint64)
        self.count = _joined([r["count"] for r in names], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.before = np.arange(len(self.at)) - np.repeat(self.start, self.size)
        self.train = np.repeat(~self.held, self.size)
        self.name = _spans(splitmix(self.number)[self.at])
        self.pair_at, self.first = None, None
        if written:
            at = np.cumsum(_unpacked(row["places"]).astype(np.int64))
            self.depth, self.sums = row["depth"], _unpacked(row["sums"])
            self.p, self.extends, self.seen = np.ones(len(self.at)), np.zeros(len(self.at), dtype=bool), np.full(len(self.at) + 1, -1)
            self.p[at], self.extends[at], self.seen[at] = _unpacked(row["p"]), True, _unpacked(row["seen"]).astype(np.int64) - 1
        else:
            self.depth, self.sums = 0, np.zeros(len(self.size))
            self.p, self.extends, self.seen = 10 ** model.root(self.count.astype(float))[self.at], np.ones(len(self.at), dtype=bool), np.append(0, self.count[self.at])

    def going_on(self) -> np.ndarray:
        """Places whose contexts of the next depth are asked for."""
        self.rare = (self.seen >= 0) & (self.seen < max(2, self.tree.least))
        return np.flatnonzero((self.before > self.depth) & self.extends & ~self.rare[:-1])

    def state(self, row: dict) -> pa.Table:
        at = self.going_on()
        p = self.p.copy()
        p[at] = 1
        sums = self.sums + np.add.reduceat(np.log10(p), self.start)
        known = [row[c] for c in ("block", "a", "b", "c", "docs")]
        new = [self.depth, *map(_packed, (self.number, self.count, np.diff(at, prepend=0), self.seen[at] + 1, self.p[at], sums))]
        return _rows([[x] for x in known + new], STATE)

    def _contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The names of the contexts of this depth, each once, and which of them stands before each of the places. Where they all were pairs of the depth
        before, one token back, these tell; else hashes are compared."""
        if self.depth == 1:
            mine, names = self.at[self.places - 1], self.number
        else:
            mine = None if self.pair_at is None else self.pair_at[self.places - 1]
            if mine is None or mine.min(initial=0) < 0:
                contexts, _, mine = _distinct(self.name(self.places, self.depth))
                return contexts, mine
            names = None
        used = np.zeros(len(self.number if names is not None else self.first), dtype=bool)
        used[mine] = True
        ids, rank = np.flatnonzero(used), np.cumsum(used) - 1
        return names[ids] if names is not None else self.name(self.first[ids] + 1, self.depth), rank[mine]

    def ask(self, buckets: int) -> None:
        """The distinct pairs of the next depth, in order of bucket, context and token."""
        self.places = self.going_on()
        self.depth += 1
        contexts, mine = self._contexts()
        home = lambda names, part: (splitmix(names + splitmix(part)) % np.uint64(buckets)).astype(np.int64)
        bucket = home(contexts, np.zeros(1, dtype=np.uint64))
        order = np.argsort(contexts)
        order = order[_stably(bucket[order])]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        contexts, bucket = contexts[order], bucket[order]
        bits = max(1, len(self.number)).bit_length()
        pairs, first, self.pair = _distinct((rank[mine] << bits) | self.at[self.places])
        which, token, self.first = pairs >> bits, self.number[pairs & ((1 << bits) - 1)], self.places[first]
        bucket, seen = bucket[which], self.seen[self.first]
        self.spread = seen >= self.tree.slice
        if self.spread.any():
            far = np.flatnonzero(self.spread)
            slices = (1 + seen[far] // self.tree.slice).astype(np.uint64)
            bucket[far] = home(contexts[which[far]], splitmix(token[far]) % slices)
            order = _stably(bucket)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            self.pair = rank[self.pair]
            bucket, which, token, self.spread, self.first = (x[order] for x in (bucket, which, token, self.spread, self.first))
        self.bucket, self.context, self.token = bucket, contexts[which], token
        new = np.ones(len(which), dtype=bool)
        new[1:] = (which[1:] != which[:-1]) | (bucket[1:] != bucket[:-1])
        self.run = np.append(np.flatnonzero(new), len(which))
        self.pair_at = np.full(len(self.at), -1)
        self.pair_at[self.places] = self.pair

    def asked(self, block: int) -> pa.Table:
        n = np.bincount(self.pair[self.train[self.places]], minlength=len(self.first))
        head = self.run[:-1]
        some = np.flatnonzero(n)  # most pairs' logs, if not all
        x = np.zeros(len(n))
        x[some] = n[some] * -np.log(self.p[self.first[some]])
        parent = np.rint(np.add.reduceat(x, head).clip(0) * FINE).astype(np.uint64) if len(head) else np.zeros(0, dtype=np.uint64)
        cut, out = _cuts(self.bucket), [[] for _ in range(8)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, j = np.searchsorted(head, [a, b])
            runs = head[i:j]
            context = np.diff(self.context[runs], prepend=np.uint64(0))
            row = (block, int(self.bucket[a]), _packed(context), _packed(self.spread[runs].astype(np.uint8)), _packed(np.diff(self.run[i : j + 1])), _packed(parent[i:j]), _packed(self.token[a:b]), _packed(n[a:b]))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return _rows(out, ASKED)

    def hear(self, told: list[dict], spread: tuple) -> None:
        """Takes in the answers to ask(), and the tests of the contexts that were dealt to many buckets (sorted names, says, total, k)."""
        told = sorted(told, key=lambda r: r["bucket"])
        n, says, total, k = (_joined([r[c] for r in told], np.int64) for c in ("n", "says", "total", "k"))
        head = self.run[:-1]
        far = np.flatnonzero(self.spread[head])
        j = np.searchsorted(spread[0], self.context[head[far]])
        says[far], total[far], k[far] = (s[j] for s in spread[1:])
        run = np.repeat(np.arange(len(head)), np.diff(self.run))[self.pair]
        n, goes = n[self.pair], says[run]
        kept = np.flatnonzero(goes & 1)
        at, run = self.places[kept], run[kept]
        total, k = total[run], k[run]
        self.p[at] = (total * (n[kept] / total) + k * self.p[at]) / (total + k)
        self.extends = np.zeros(len(self.at), dtype=bool)
        self.extends[self.places] = (goes & 2) > 0
        self.seen = np.full(len(self.at) + 1, -1)
        self.seen[1:][self.rare[:-1]] = 0
        self.seen[self.places + 1] = n


def _told(model: Model, p: Tree, buckets: int, spread: list[tuple], schema: str):
    """What a block, having gone through the depths so far, asks of the next (ASKED), its STATE, or at last its scores."""

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        row, told = blocks.to_pylist()[0], told.to_pylist()
        block = _Block(model, p, row, told)
        for far in spread[block.depth :]:
            block.ask(buckets)
            block.hear([r for r in told if r["depth"] == block.depth], far)
        if schema == SCORE:
            out = _scores(block, row["docs"])
        elif schema == STATE:
            out = block.state(row)
        else:
            block.ask(buckets)
            out = block.asked(row["block"])
        del block
        trim()
        return out

    return run


def _tested(depth: int, p: Tree):
    """TOLD of ASKED of one bucket."""

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["block"])
        each = [np.cumsum(_unpacked(r["context"]).astype(np.uint64), dtype=np.uint64) for r in rows]
        runs = [_unpacked(r["pairs"]).astype(np.int64) for r in rows]
        contexts, _, mine = _distinct(np.concatenate(each))
        words, _, token = _distinct(_joined([r["token"] for r in rows], np.uint64))
        pairs, _, back = _distinct(np.repeat(mine, np.concatenate(runs)) * len(words) + token)
        n = np.bincount(back, weights=_joined([r["n"] for r in rows], np.float64))
        which = pairs // len(words)
        summed = lambda at, x: np.bincount(at, weights=x, minlength=len(contexts))
        total, k = summed(which, n).astype(np.int64), summed(which, n > 0).astype(np.int64)
        x = summed(which, n * np.log(np.maximum(n, 1))) + summed(mine, _joined([r["parent"] for r in rows], np.float64)) / FINE
        far = summed(mine, _joined([r["spread"] for r in rows], np.int64)) > 0
        says = np.where(far, 0, _judged(total, k, x, depth, p))
        kept = (says & 1) > 0
        answers = n.astype(np.int64)[back], says[mine], np.where(kept, total, 0)[mine], np.where(kept, k, 0)[mine]
        pair_stop, run_stop = np.cumsum([r.sum() for r in runs]).tolist(), np.cumsum([len(r) for r in runs]).tolist()
        cut = lambda x, stop: [_packed(x[a:b]) for a, b in zip([0, *stop], stop, strict=False)]
        first = lambda x: [x] + [None] * (len(rows) - 1)
        spread = [contexts[far].view(np.int64).tolist(), total[far].tolist(), k[far].tolist()]
        names = [[r["block"] for r in rows], [depth] * len(rows), [r["bucket"] for r in rows]]
        return _rows([*names, cut(answers[0], pair_stop), *(cut(x, run_stop) for x in answers[1:]), *map(first, spread), first(x[far].tobytes())], TOLD)

    return run


def _spread(told: DataFrame, depth: int, p: Tree) -> tuple:
    """The tests of contexts that were dealt to many buckets: one for each Tree.slice training tokens at most, so all tasks may have them."""
    found: dict[int, list] = {}
    for r in told.where("size(spread) > 0").select("spread", "sums", "kinds", "parts").toLocalIterator():
        for context, total, k, x in zip(r.spread, r.sums, r.kinds, np.frombuffer(r.parts).tolist(), strict=True):
            had = found.setdefault(context, [0, 0, 0.0])
            found[context] = [had[0] + total, had[1] + k, had[2] + x]
    context = np.array(list(found), dtype=np.int64).view(np.uint64)
    total, k, x = (np.array([v[i] for v in found.values()], dtype=kind) for i, kind in enumerate((np.int64, np.int64, float)))
    order = np.argsort(context)
    return tuple(v[order] for v in (context, _judged(total, k, x, depth, p), total, k))


def _scores(block: _Block, docs: list) -> pa.Table:
    m, c = block.model, block.count.astype(float)
    base = np.log10((c + 0.5) / (m.n + 0.5 * (m.v + 1)))
    add = lambda v: np.add.reduceat(v, block.start)
    known = add((c > 0).astype(np.int64)[block.at])
    return _rows([docs, block.held, block.size, known, np.full(len(docs), m.n), add(base[block.at]), block.sums + add(np.log10(block.p))], SCORE)


def score_documents(spark: SparkSession, docs: DataFrame, p: Tree = Tree()) -> DataFrame:  # noqa: B008
    """Scores of docs (doc_id, text), a row each."""
    scratch, parts = Scratch(spark), n_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(p.folds, p.held_out).alias("held_out"), "text")
    first = scratch.save(map_arrow(rows, _blocks(p.tokens), BLOCKS), "first", block_mb=16)
    blocks = scratch.save_by(first.where("bucket < 0").drop("bucket"), "state0", parts, "block", block_mb=16)
    names = scratch.save(first.where("bucket >= 0").groupBy("bucket").applyInArrow(_number, NAMES), "names", block_mb=16)
    scratch.drop("first")
    total = names.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2", "n3", "n4"))).first()
    model = Model(total.n, total.v, (total.n1, total.n2, total.n3, total.n4))

    buckets = max(parts, -(-total.n // 800_000))
    named = names.select("block", F.lit(0).alias("depth"), "bucket", "number", "count", *(F.lit(None).cast("binary").alias(c) for c in ("n", "says", "total", "k")))
    told, written, spread = named, 0, []  # told: since the depth that was written

    def meet(schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_told(model, p, buckets, list(spread), schema), schema)

    while True:
        depth = len(spread) + 1
        answers = scratch.save(meet(ASKED).groupBy("bucket").applyInArrow(_tested(depth, p), TOLD), f"told{depth}", block_mb=16)
        if answers.isEmpty():
            return meet(SCORE)
        spread.append(_spread(answers, depth, p))
        told = told.unionByName(answers.select("block", "depth", "bucket", "n", "says", "total", "k"), allowMissingColumns=True)
        if depth == (2 * written or 2):
            # from here on a block has its own state, and is told no more than later depths
            blocks, old = scratch.save_by(meet(STATE), f"state{depth}", parts, "block", block_mb=16), f"state{written}"
            told = told.limit(0)
            for name in (old, "names", *(f"told{d}" for d in range(written + 1, depth + 1))):
                scratch.drop(name)
            written = depth


def op8_suffix_tree(spark: SparkSession, sf_dir: str, p: Tree = Tree()) -> DataFrame:  # noqa: B008
    return score_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), p)
