"""Near-duplicate documents by n-gram Jaccard similarity: a join of parity sketches.

A document's set of word shingles is hashed into blocks, and each block keeps the XOR of its shingles' hashes: a sketch of
bits. Two sets that differ in d shingles differ in d blocks at most, so the sketches' distance is a lower bound of the sets'
symmetric difference. A similarity threshold bounds d for the sizes in a band; with more blocks than that bound, some block
of two similar sets must be equal (pigeonhole), and an equi-join on (band, block, XOR) finds every similar pair. Bands are so
wide that similar sets are in the same or in neighbouring ones. Blocks without shingles carry no information: there are spare
blocks for them, and the few sets with more empty blocks than spare ones join on those too, so no pair is lost.

Candidates first pass a sketch of the whole set (bits in proportion to the difference allowed at its size; of unlike lengths the
longer is folded; their distance is a lower bound too), then are verified on the full sets, in three steps that never list all pairs of a group: each document with the candidate it shares most blocks with;
then pairs with a group's first document that are still in different components; then, in groups of three at least whose members are
not all in the first one's component, pairs across components: a few partners for each document, then, in the groups where any were left
out, more, in components as they are by then. Equal sets within a task are linked at once and joined once.
Components are found by alternating stars, distributed.

Null, empty and blank texts have an empty set and link with nothing; so do rows without an id, whose component is null. Ties go to the smaller id. Repeated rows link as equal
texts do. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, components, map_arrow, n_parts, splitmix, table, whole_row
from quillgraph.llm.words import pieces, shingle_sets, utf8

MEMBER, EQUAL, INFO, PAIR = 0, 1, 2, 3


@dataclass(frozen=True)
class Similar:
    """width: words of a shingle. percent: of the union that the intersection has at least. chunk: members of a group that
    one unit of the last verification compares. partners: of a document in its first round. most_sets: sets of a task that wait
    to be told equal."""

    width: int = 4
    percent: int = 85
    chunk: int = 1000
    partners: int = 4
    most_sets: int = 1_000_000


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower size of each band; blocks of the pairs whose smaller set is in it; spare blocks among them.

    A set that is similar to one of at most u shingles has at most u * 100 / percent; sets differ by at most
    (100 - percent) / (100 + percent) of their summed sizes."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    blocks, spare = [], []
    for j in range(len(low) - 2):
        small = low[j + 1] - 1
        large = min(low[j + 2] - 1, small * 100 // percent)
        differ = (small + large) * (100 - percent) // (100 + percent)
        extra = 0 if differ == 0 else 1 if differ <= 3 else 2 + differ // 25
        blocks.append(differ + 1 + extra)
        spare.append(extra)
    return np.array(low), np.array(blocks), np.array(spare)


@lru_cache(maxsize=4096)
def _edges(n: int) -> np.ndarray:
    """The first hash of each of n blocks that divide the range of hashes evenly."""
    return np.array([(i << 64) // n + (1 if (i << 64) % n else 0) for i in range(n)], dtype=np.uint64)


def signatures(s: np.ndarray, p: Similar) -> np.ndarray:
    """The join keys of a set: for its own band and the one below, of each block."""
    low, blocks, spare = bands(p.percent)
    own = int(np.searchsorted(low, len(s), side="right")) - 1
    mixed, out = splitmix(s), []
    for j in (own, own - 1):
        if j < 0:
            continue
        n = int(blocks[j])
        start = np.searchsorted(s, _edges(n))
        full = np.append(start[1:], len(s)) > start
        key = np.zeros(n, dtype=np.uint64)
        key[full] = np.bitwise_xor.reduceat(mixed, start[full])
        key = splitmix(splitmix(key) + np.arange(n, dtype=np.uint64) + np.uint64(j << 40))
        out.append(key if n - int(full.sum()) > spare[j] else key[full])
    return np.concatenate(out)


SIG = "kind byte, sig long, doc long, n int, rep long, sketch binary"
_NAMES = ["kind", "sig", "doc", "n", "rep", "sketch"]


def _rows(kind, sig, doc, n, rep, sketch=None) -> pa.RecordBatch:
    size = max(np.size(x) for x in (kind, sig, doc, n, rep))
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x).astype(t), (size,)))
    bits = pa.nulls(size, pa.binary()) if sketch is None else pa.array(sketch, pa.binary())
    return pa.RecordBatch.from_arrays([full(kind, np.int8), full(sig, np.int64), full(doc, np.int64), full(n, np.int32), full(rep, np.int64), bits], names=_NAMES)


def parity(mixed: np.ndarray, percent: int) -> bytes:
    """A sketch of a whole set: each bit is the parity of the shingles that fall on it. It has at least eight times as many
    bits as two such sets may differ in, and 1024, so unlike sets differ in more; a power of two."""
    differ = 2 * len(mixed) * (100 - percent) // (100 + percent)
    bits = 1 << max(10, (8 * differ - 1).bit_length())
    return np.packbits(np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(k: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as those of fewer bits: halves by parity."""
    while k.shape[1] > words:
        half = k.shape[1] // 2
        k = k[:, :half] ^ k[:, half:]
    return k


def may_be_similar(na, nb, ka: np.ndarray, kb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches (rows of 64-bit words, as many on either side) leave room for the similarity."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    differ = np.bitwise_count(ka ^ kb).sum(axis=-1, dtype=np.int64)
    return (100 * lo >= percent * hi) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def _sketch(p: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            docs = batch.column(0).to_pylist()
            for i, j in pieces(offsets):
                sigs, of, info, bits, equal = [], [], [], [], []
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.width)
                for doc, s in zip(docs[i:j], sets, strict=True):
                    info.append((doc, len(s)))
                    bits.append(parity(splitmix(s), p.percent))
                    if not len(s):
                        continue
                    with np.errstate(over="ignore"):
                        name = np.array([splitmix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(s), len(s)], dtype=np.uint64).tobytes()
                    if name in known:
                        equal.append((known[name], doc, len(s)))
                        continue
                    if len(known) >= p.most_sets:
                        known.clear()
                    known[name] = doc
                    sigs.append(signatures(s, p))
                    of.append((doc, len(s), len(sigs[-1])))
                ids = np.array(info, dtype=np.int64)
                yield _rows(INFO, splitmix(ids[:, 0].astype(np.uint64)).view(np.int64), ids[:, 0], ids[:, 1], -1, bits)
                if equal:
                    e = np.array(equal, dtype=np.int64)
                    yield _rows(EQUAL, splitmix(e[:, 1].astype(np.uint64)).view(np.int64), e[:, 1], e[:, 2], e[:, 0])
                if of:
                    o = np.array(of, dtype=np.int64)
                    yield _rows(MEMBER, np.concatenate(sigs).view(np.int64), np.repeat(o[:, 0], o[:, 2]), np.repeat(o[:, 1], o[:, 2]), -1)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kind, sig, doc): members of groups, with the group's first document; of groups seen to be pairs, the
    second one alone, as PAIR; others as they are. Holds one batch and one row."""
    held: np.ndarray | None = None  # the last member row, with its group's first document, and 1 if it has gone out
    for batch in batches:
        kind = batch.column(0).to_numpy()
        member = kind == MEMBER
        if not member.all():
            yield batch.filter(pa.array(~member))
        if not member.any():
            continue
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[member] for c in (1, 2, 3)])
        rep, gone = np.full(len(x), -1), np.zeros(len(x), dtype=bool)
        if held is not None:
            x = np.vstack([held[:3], x])
            rep, gone = np.append(held[3], rep), np.append(held[4] == 1, gone)
        new = np.append(True, x[1:, 0] != x[:-1, 0])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rep = np.where(rep[head] >= 0, rep[head], x[head, 1])
        many = ~new | np.append(~new[1:], False)
        out = many & ~gone
        group = np.cumsum(new) - 1
        pair = (np.bincount(group)[group] == 2) & (group < group[-1]) & ~gone[head]
        for kind, pick in ((MEMBER, out & ~pair), (PAIR, pair & ~new)):
            if pick.any():
                yield _rows(kind, x[pick, 0], x[pick, 1], x[pick, 2], rep[pick])
        held = np.array([*x[-1], rep[-1], int(gone[-1] or many[-1])])


def _set_column(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "members"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (a, b): the pairs that are similar. Holds one set between batches."""
        held: tuple | None = None
        for batch in batches:
            good = []
            for a, b, s in zip(*(batch.column(i) for i in range(3)), strict=True):
                key, members = (a.as_py(), b.as_py()), np.frombuffer(s.as_buffer(), dtype=np.uint64)
                if held is not None and held[0] == key:
                    both = len(np.intersect1d(held[1], members, assume_unique=True))
                    if 100 * both >= percent * (len(held[1]) + len(members) - both):
                        good.append(key)
                    held = None
                else:
                    held = (key, members)
            if held is not None:
                held = (held[0], held[1].copy())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _words(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1)


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (a, b, c, doc, na, nb, ka, kb): those whose sizes and sketches leave room for the similarity."""
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5))
            ka, kb = (batch.column(i).to_pylist() for i in (6, 7))
            length = np.array([(len(a), len(b)) for a, b in zip(ka, kb, strict=True)], dtype=np.int64).reshape(-1, 2)
            ok = np.zeros(len(na), dtype=bool)
            for la, lb in np.unique(length, axis=0).tolist():
                at = np.flatnonzero((length == (la, lb)).all(axis=1))
                words = min(la, lb) // 8
                a, b = (folded(_words([k[i] for i in at.tolist()]), words) for k in (ka, kb))
                ok[at] = may_be_similar(na[at], nb[at], a, b, percent)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))

    return run


def _cross(percent: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sig, a, b, more): pairs across components within units of rows sorted by (sig, i, j), at most so many for each row, and
        whether there are more. A unit has two chunks at most."""

        def pairs(x: np.ndarray, sketches: list[bytes]) -> pa.RecordBatch:
            least = min(map(len, sketches)) // 8
            k = np.concatenate([folded(_words([b]), least) for b in sketches])
            doc, comp, n, chunk = x[:, 3], x[:, 4], x[:, 5], x[:, 6]
            same = x[0, 1] == x[0, 2]
            found, more = [np.zeros((2, 0), dtype=np.int64)], []
            for i in range(len(x) - 1):
                j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (same | (chunk[i + 1 :] != chunk[i]))) + i + 1
                j = j[may_be_similar(n[i], n[j], k[i], k[j], percent)]
                more += [len(j) > most] * min(len(j), most)
                j = j[:most]
                found.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]))
            a, b = np.concatenate(found, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), x[0, 0])), pa.array(a), pa.array(b), pa.array(more, pa.bool_())], names=["sig", "a", "b", "more"])

        held, bits = np.zeros((0, 7), dtype=np.int64), []
        for batch in batches:
            x = np.vstack([held, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(7)])])
            k = bits + batch.column(7).to_pylist()
            cut = [0, *(np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(axis=1)) + 1).tolist()]
            for u, v in zip(cut, cut[1:], strict=False):
                if v - u > 1:
                    yield pairs(x[u:v], k[u:v])
            held, bits = x[cut[-1] :], k[cut[-1] :]
        if len(held) > 1:
            yield pairs(held, bits)

    return run


def verify(pairs: DataFrame, texts: DataFrame, p: Similar, parts: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar. Each text is made a set once for each pair, under the pair's own key,
    so that no document gathers its partners."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    ids = sides.select("doc_id").distinct()
    sets = map_arrow(texts.join(ids, "doc_id", "left_semi"), _set_column(p.width), "doc_id long, members binary").dropDuplicates(["doc_id"])
    rows = sides.join(sets, "doc_id").select("a", "b", "members").repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    return map_arrow(rows, _verify(p.percent), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, p: Similar = Similar()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id, text)."""
    scratch, parts = Scratch(spark), n_parts(spark)
    everything = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = everything.where("doc_id is not null")
    sigs = map_arrow(texts, _sketch(p), SIG).repartition(parts, "sig").sortWithinPartitions("kind", "sig", "doc")
    found = scratch.save(map_arrow(sigs, _groups, SIG), "groups")
    info = found.where(F.col("kind") == INFO).select("doc", "n", "sketch")
    wide = found.where(F.col("kind") == MEMBER).select("sig", "doc", "n", "rep")
    equal = found.where(F.col("kind") == EQUAL).select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    one = scratch.save(info.dropDuplicates(["doc"]), "sets")  # a row for each id, joined many times

    paired = found.where(F.col("kind").isin(MEMBER, PAIR) & (F.col("doc") != F.col("rep")))
    paired = scratch.save(paired.groupBy("rep", "doc").agg(F.count("*").alias("c")), "paired")
    starred = paired.join(one.select(F.col("doc").alias("rep"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "rep")
    starred = starred.join(one.select("doc", F.col("n").alias("nb"), F.col("sketch").alias("kb")), "doc")
    starred = starred.select(F.least("rep", "doc").alias("a"), F.greatest("rep", "doc").alias("b"), "c", "doc", "na", "nb", "ka", "kb")
    starred = scratch.save(map_arrow(starred, _plausible(p.percent), "a long, b long, c long, doc long"), "starred")

    best = starred.groupBy("doc").agg(F.expr("max_by(struct(a, b), struct(c, -a, -b))").alias("x")).select("x.a", "x.b").distinct()
    links = scratch.save(verify(best, texts, p, parts).unionByName(equal), "links1")
    comp = scratch.save(components(spark, links, scratch, "cc1"), "comp1")

    def labelled(df: DataFrame, key: str, out: str) -> DataFrame:
        c = comp.select(F.col("id").alias(key), F.col("component_id").alias("__c"))
        return df.join(c, key, "left").withColumn(out, F.coalesce("__c", key)).drop("__c")

    tried = starred.select("a", "b").distinct()
    apart = labelled(labelled(tried, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti")
    apart = scratch.save(apart, "apart")
    if apart.take(1):
        links = scratch.save(links.unionByName(verify(apart, texts, p, parts)), "links2")
        comp = scratch.save(components(spark, links, scratch, "cc2"), "comp2")

    split = labelled(labelled(paired.select("rep", "doc"), "rep", "ca"), "doc", "cb").where("ca <> cb").select("rep", "doc")
    spans, most = wide.join(split, ["rep", "doc"], "left_semi").select("sig").distinct(), p.partners
    while True:
        inside = scratch.save(labelled(wide.join(spans, "sig", "left_semi"), "doc", "comp"), f"inside{most}")
        sizes = inside.groupBy("sig").agg(F.ceil(F.count("*") / p.chunk).cast("int").alias("k"))
        units = (
            inside.join(sizes, "sig")
            .join(one.select("doc", "sketch"), "doc")
            .withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .select("sig", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "doc", "comp", "n", "chunk", "sketch")
            .repartition(parts, "sig", "i", "j")
            .sortWithinPartitions("sig", "i", "j")
        )
        crossed = scratch.save(map_arrow(units, _cross(p.percent, most), "sig long, a long, b long, more boolean"), f"crossed{most}")
        fresh = scratch.save(crossed.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), f"fresh{most}")
        if fresh.take(1):
            links = scratch.save(links.unionByName(verify(fresh, texts, p, parts)), f"links{most}")
            comp = scratch.save(components(spark, links, scratch, f"cc{most}"), f"comp{most}")
        if not crossed.where("more").take(1):
            break
        spans = crossed.where("more").select("sig").distinct()  # the pairs of other groups are all told
        tried, most = tried.unionByName(fresh), most * 8
    out = labelled(info, "doc", "component_id").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
    nameless = map_arrow(everything.where("doc_id is null"), _set_column(p.width), "doc_id long, members binary")
    return out.unionByName(nameless.select("doc_id", F.floor(F.octet_length("members") / 8).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def keep_first(spark: SparkSession, docs: DataFrame, p: Similar) -> DataFrame:
    """docs without those that are similar to another of a smaller id, along links; its columns as they are. Of rows with
    one id, the one with the least text stays, null first, and of those any."""
    scratch = Scratch(spark)
    found = near_duplicates(spark, docs.select("doc_id", "text"), p)
    later = scratch.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "later")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_row(docs).alias("row"))
    rows = rows.join(later, "id", "left_anti")
    named = rows.where("id is not null")
    twice = named.groupBy("id").count().where("count > 1").select("id")  # texts move only where an id is repeated
    first = named.join(twice, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.struct("row.text")).alias("row"))
    return named.join(twice, "id", "left_anti").unionByName(first).unionByName(rows.where("id is null")).select("row.*")
