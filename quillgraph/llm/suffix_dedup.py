"""Removal of long repeated byte strings with a logarithmic family of suffix indexes.

A suffix array of every byte is out of reach at corpus scale (figures in the README), so hashed anchors stand for suffixes: of
each window of `length` bytes one k-gram, chosen by its content (see suffixes.py), is the anchor, and the index holds the anchors'
hashes in order. Any order of the first k bytes finds equal ones, and equal windows have equal anchors, so no repeated window is
missed.

New batches get an index of their anchors (SuffixIndex.add). Each is merge-scanned, by a sort-merge join of bucketed tables, against
itself and against the existing levels for suffixes that agree in k bytes; two levels of equal rank merge into one of the
next rank, so an anchor is rewritten a logarithmic number of times.

The suffixes that agree are then settled exactly. Runs of windows whose whole byte strings are equal are repeated in every
window. Of the other runs, and one run for each whole string that shares their anchor, each window's hash is compared
within the anchor's group: in one task where the group is small, else by counting each hash with partial aggregates and joining the
counts to the windows, so no task gathers a group, not even of one passage in many surroundings. At last each text meets its own
repeated ranges and loses their bytes.

A row is known by its id and a hash of its text (two hashes, if it has no id), so rows of one id are compared like any others. Rows that
agree in both are copies of each other and share their ranges, which is the same for either.

Null and empty texts have no bytes and lose none. Texts shorter than `length` stay whole. Very long texts are hashed piece by piece.
Repeated rows, with other ids, the same one or none, are repeats of each other and lose all windows. Ties don't arise: equal windows are
all removed. An empty table gives no rows. Other columns, whatever their names, are ignored, or passed on by without_repeats. Hashes of
windows have 128 bits, or 64 within one anchor's group, whose anchors have 64 bits more.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, map_arrow, n_parts, table, whole_row
from quillgraph.llm.suffixes import runs, window_hashes
from quillgraph.llm.words import pieces, utf8


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeated string. k: bytes of an anchor. batches: of the index. shard: runs of an anchor's group that
    are compared in one task."""

    length: int = 400
    k: int = 240
    batches: int = 4
    shard: int = 2000


def _own(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(own, own_sub): what a row is known by."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.lit("no id"), text)).alias("own"), F.xxhash64(text).alias("own_sub")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, sub) of docs (doc_id, text)."""
    return docs.select(*_own(F.col("doc_id"), F.col("text")), "text").select(F.col("own").alias("doc"), "text", F.col("own_sub").alias("sub"))


RUN = "h long, doc long, sub long, lo long, hi long, pos long, f1 long, f2 long"


def _runs(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            subs = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(len(ids), dtype=np.int64)
            for i, j in pieces(offsets, 1 << 21):
                for doc, lo, hi, pos, h, f1, f2 in runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.length, p.k):
                    cols = [h.view(np.int64), ids[doc + i], subs[doc + i], lo, hi, pos, f1.view(np.int64), f2.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in RUN.split(", ")])

    return run


class SuffixIndex:
    """Levels of sorted suffixes: (h, n, doc, pos), with n suffixes that begin alike and the first one's place."""

    def __init__(self, spark: SparkSession, p: Repeats = Repeats()):  # noqa: B008
        self.spark, self.p, self.scratch = spark, p, Scratch(spark)
        self.levels: list[tuple[int, str]] = []
        self.found: list[DataFrame] = []

    def _write(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(n_parts(self.spark), "h").sortBy("h").option("path", f"{self.scratch.root}/{name}").option("compression", "zstd")
        self.scratch.write(lambda: writer.saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def _merge(self) -> None:
        """Levels of equal rank merge, until all ranks differ."""
        self.levels.sort()
        while pair := next(((a, b) for a, b in zip(self.levels, self.levels[1:], strict=False) if a[0] == b[0]), None):
            both = self.spark.table(pair[0][1]).unionByName(self.spark.table(pair[1][1]))
            merged = both.groupBy("h").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
            new = (pair[0][0] + 1, self._write(merged))
            for x in pair:
                self.levels.remove(x)
                self._drop(x[1])
            self.levels.append(new)
            self.levels.sort()

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch (doc_id, text); returns (h) of suffixes that begin alike in it, or in it and a level."""
        return self.add_suffixes(map_arrow(keyed(docs), _runs(self.p), RUN))

    def add_suffixes(self, suffixes: DataFrame) -> DataFrame:
        """Indexes a batch of suffixes (h, doc, sub, pos)."""
        self._merge()
        suffixes = suffixes.select("h", F.struct("doc", "sub", "pos").alias("at"))
        name = self._write(suffixes.groupBy("h").agg(F.count("*").alias("n"), F.min("at").alias("at")))
        batch = self.spark.table(name)
        repeated = batch.where("n > 1").select("h")
        for _, level in self.levels:
            repeated = repeated.unionByName(self.spark.table(level).select("h").join(batch.select("h"), "h", "left_semi"))
        self.found.append(self.scratch.save(repeated.distinct(), f"{name}_found"))
        self.levels.append((0, name))
        return self.found[-1]

    def repeated(self) -> DataFrame:
        """(h) of all suffixes that have begun alike so far."""
        out = self.found[0]
        for df in self.found[1:]:
            out = out.unionByName(df)
        return out.distinct()

    def close(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []


WINDOWS = "h long, large boolean, doc long, sub long, open boolean, lo long, hash array<long>"


def _windows(p: Repeats, most: int = 200_000):
    """Of texts with runs (h, lo, hi, large, open): the hashes of each run's windows, about so many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            wanted = batch.column(3)
            runs_of = np.append(0, np.cumsum(wanted.value_lengths().to_numpy()))
            h, lo, hi, large, is_open = wanted.flatten().flatten()
            lo, n = lo.to_numpy(), hi.to_numpy() - lo.to_numpy() + 1
            first, held, hashes = 0, 0, []
            for d in range(batch.num_rows):
                i, j = runs_of[d], runs_of[d + 1]
                before = np.cumsum(n[i:j]) - n[i:j]
                starts = np.repeat(lo[i:j] - before, n[i:j]) + np.arange(n[i:j].sum())
                hashes.append(window_hashes(data[offsets[d] : offsets[d + 1]], starts, p.length).view(np.int64))
                held += len(starts)
                if held >= most or d + 1 == batch.num_rows:
                    x, y = runs_of[first], j
                    some = np.repeat(np.arange(first, d + 1), np.diff(runs_of[first : d + 2]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[x:y])).astype(np.int32)), pa.array(np.concatenate(hashes)))
                    own = [batch.column(c).take(pa.array(some)) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([h[x:y], large[x:y], *own, is_open[x:y], pa.array(lo[x:y]), lists], names=[f.split()[0] for f in WINDOWS.split(", ")])
                    first, held, hashes = d + 1, 0, []

    return run


def _settle(length: int):
    """Of windows sorted by h: the ranges of open runs' windows that another run of the group has too."""

    def ranges(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        _, inverse, count = np.unique(np.concatenate([g for *_, g in group]), return_inverse=True, return_counts=True)
        many, out, at = count[inverse] > 1, [], 0
        for doc, sub, is_open, lo, g in group:
            mine = many[at : at + len(g)]
            at += len(g)
            if is_open and mine.any():
                x = lo + np.flatnonzero(mine)
                apart = np.flatnonzero(np.diff(x) > length) + 1  # else windows overlap or touch
                out += [(doc, sub, int(r[0]), int(r[-1]) + length) for r in np.split(x, apart)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            h, doc, sub, is_open, lo = (batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))
            flat, at = batch.column(6).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(6).value_lengths().to_numpy()))
            for i, now in enumerate(h):
                if now != key:
                    if len(group) > 1:
                        out += ranges(group)
                    key, group = now, []
                group.append((doc[i], sub[i], is_open[i], lo[i], flat[at[i] : at[i + 1]]))
            yield _ranges(out)
        if len(group) > 1:
            yield _ranges(ranges(group))

    return run


RANGE = "doc long, sub long, lo long, hi long"


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=[f.split()[0] for f in RANGE.split(", ")])


def _counted(windows: DataFrame, length: int) -> DataFrame:
    """The same of large groups, by counting: a range for each open run with windows that stand elsewhere too. A run's windows all overlap, so
    the first and the last of those tell what they cover."""
    each = windows.select("h", "doc", "sub", "open", "lo", F.posexplode("hash").alias("i", "g"))
    many = each.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    per = each.where("open").join(many, ["h", "g"]).groupBy("h", "doc", "sub", "lo").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return per.select("doc", "sub", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b") + length).alias("hi"))


def repeated_ranges(spark: SparkSession, docs: DataFrame, p: Repeats = Repeats(), scratch: Scratch | None = None) -> DataFrame:  # noqa: B008
    """(doc, sub, spans): of each of keyed(docs) with repeated windows, its ranges [lo, hi) of bytes, not merged."""
    scratch, parts = scratch or Scratch(spark), n_parts(spark)
    texts = keyed(docs)
    places = scratch.save(map_arrow(texts, _runs(p), RUN), "places")  # every text is hashed once
    index = SuffixIndex(spark, p)
    for b in range(p.batches):
        index.add_suffixes(places.where(F.pmod(F.xxhash64("doc"), F.lit(p.batches)) == b))
    # written before it is joined: a join between plain shuffles splits an anchor that very many places share
    repeated = scratch.save(index.repeated(), "repeated")
    index.close()
    found = scratch.save(places.join(repeated, "h", "left_semi").select("h", "doc", "sub", "lo", "hi", "f1", "f2"), "runs")
    scratch.drop("places")
    whole = scratch.save(
        found.groupBy("h", "f1", "f2").agg(F.count("*").alias("m"), F.min(F.struct("doc", "sub", "lo", "hi")).alias("at")), "strings"
    )
    groups = scratch.save(whole.groupBy("h").agg(F.count("*").alias("n"), F.min("m").alias("least")).where("least = 1 and n > 1"), "groups")
    wanted = (
        whole.join(groups, "h")
        .select(F.col("at.doc").alias("of"), F.col("at.sub").alias("of_sub"), F.struct("h", "at.lo", "at.hi", (F.col("n") > p.shard).alias("large"), (F.col("m") == 1).alias("open")).alias("r"))
        .groupBy("of", "of_sub")
        .agg(F.collect_list("r").alias("wanted"))  # within one text
    )
    asked = texts.join(wanted, (F.col("doc") == F.col("of")) & (F.col("sub") == F.col("of_sub"))).select("doc", "text", "sub", "wanted")
    windows = scratch.save(map_arrow(asked, _windows(p), WINDOWS), "windows", block_mb=16)
    small = windows.where("not large").repartition(parts, "h").sortWithinPartitions("h")
    settled = map_arrow(small, _settle(p.length), RANGE)
    many = whole.where("m > 1").select("h", "f1", "f2")
    equal = found.join(many, ["h", "f1", "f2"], "left_semi").select("doc", "sub", "lo", (F.col("hi") + p.length).alias("hi"))
    both = settled.unionByName(_counted(windows.where("large"), p.length)).unionByName(equal).groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # within one text
    return scratch.save(both, "spans")


def union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges, as maximal ranges in order."""
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    apart = lo[1:] > hi[:-1]
    return list(zip(lo[np.append(True, apart)].tolist(), hi[np.append(apart, True)].tolist(), strict=True))


def merged(spans: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """Of each list of ranges their union; few objects, for a text may have thousands."""
    n = np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy()))
    lo, hi = (c.to_numpy() for c in spans.flatten().flatten())
    for a, b in zip(n[:-1].tolist(), n[1:].tolist(), strict=True):
        yield union(lo[a:b], hi[a:b]) if b > a else []


def kept_bytes(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in gone for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def kept_text(text: str | None, gone: list[tuple[int, int]]) -> str | None:
    """What stays of a text; of a character cut in part nothing does."""
    return kept_bytes(text.encode(), gone).decode(errors="ignore") if text and gone else text


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, removed array<struct<start: long, stop: long>>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans_type]
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), merged(batch.column(2)), strict=True):
            text = text.as_py()
            data = (text or "").encode()
            kept = kept_bytes(data, gone)
            rows.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept_text(text, gone), [{"start": a, "stop": b} for a, b in gone]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "removed"])


def digests(spark: SparkSession, docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    """A row for each row of docs (doc_id, text): its bytes, what is removed of them and where, and the text that stays."""
    spans = repeated_ranges(spark, docs, p)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_own(F.col("doc_id"), F.col("text")))
    rows = own.join(spans, (F.col("own") == F.col("doc")) & (F.col("own_sub") == F.col("sub")), "left").select("doc_id", "text", "spans")
    return map_arrow(rows, _digest, DIGEST)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str, p: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    return digests(spark, table(spark, sf_dir, "documents"), p)


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(names, batch.column(0).flatten(), strict=True))
            text = [kept_text(t.as_py(), gone) for t, gone in zip(cols["text"], merged(batch.column(1)), strict=True)]
            cols["text"] = pa.array(text, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in text], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return run


def without_repeats(spark: SparkSession, docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    """docs with every repeated range of bytes cut from its text, and n_chars to match; its other columns as they are."""
    spans = repeated_ranges(spark, docs.select("doc_id", "text"), p)
    rows = docs.select(whole_row(docs).alias("row"), *_own(F.col("doc_id"), F.col("text")))
    rows = rows.join(spans, (F.col("own") == F.col("doc")) & (F.col("own_sub") == F.col("sub")), "left")
    return map_arrow(rows.select("row", "spans"), _cut(docs.columns), docs.schema)
