"""What the operators share: tables, working folders, byte hashing and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scratch

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name clashes with one of ours; dots in names are part of them."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp()) / "quillgraph.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(str(name))
    sc._quillgraph_shipped = True


#: What workers keep from one task to the next.
_HELD: list[dict] = []


def held_between_tasks(memory: dict) -> None:
    _HELD.append(memory)


def release_held() -> None:
    for memory in _HELD:
        memory.clear()


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its memory
        return None


def trim() -> None:
    """Hands back what the C library keeps of freed memory, where it can: workers live on between tasks and would hold it."""
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable, schema, keeps: bool = False) -> DataFrame:
    """df.mapInArrow, whose workers hand back what memory Arrow keeps when a task ends, and, unless it keeps, what tasks of
    other operators have left in them."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release_held()
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim()

    return df.mapInArrow(run, schema)


class Scratch(scratch.Scratch):
    """Tables with names, written to the shared folder to cut lineage; what is still there goes when the driver's JVM ends."""

    def write(self, run: Callable[[], None]) -> None:
        """Runs a write whose shuffle files go when it ends, for what it wrote is read instead."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            run()
        finally:
            conf.set(key, before)

    def save(self, df: DataFrame, name: str, block_mb: int = 128) -> DataFrame:
        """block_mb: what a writer holds of a file before it is written."""
        writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", block_mb << 20)
        self.write(lambda: writer.parquet(f"{self.root}/{name}"))
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def save_by(self, df: DataFrame, name: str, buckets: int, column: str, block_mb: int = 128) -> DataFrame:
        """The same, dealt into buckets by a column, by which it is then met without a shuffle."""
        held = f"scratch_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(buckets, column).option("compression", "zstd").option("parquet.block.size", block_mb << 20)
        self.write(lambda: writer.option("path", f"{self.root}/{name}").saveAsTable(held))
        return self.spark.table(held)

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(f"{self.root}/{name}"), True)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shingles_key(column: str = "doc_id"):
    """crc32 of an id written as text: the fold that the contracts name."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# --- hashing of bytes -------------------------------------------------------------------------


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Odd bases of the two polynomial hashes, with the seeds of their byte tables.
BASES = ((0xD6E8FEB86659FD93, 1 << 20), (0xA3B195354A39B70D, 2 << 20))


@lru_cache(maxsize=4)
def byte_table(which: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if lower."""
    t = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(BASES[which][1]))
    if lower:
        t[65:91] = t[97:123]
    return t


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        base = BASES[which][0]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (both[0], both[1])
    return have


def prefix_hash(data: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """h of length n+1: the hash of data[i:j] is (h[j] - h[i]) * base**-i, modulo 2**64."""
    n = len(data)
    with np.errstate(over="ignore"):
        h = np.empty(n + 1, dtype=np.uint64)
        h[0] = 0
        np.multiply(byte_table(which, lower)[data], powers(which, n)[0][:n], out=h[1:])
        return np.add.accumulate(h, out=h)


def span_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h[stop] - h[start]) * powers(which, len(h))[1][start]


# --- components -------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component_id) for every id in edges (a, b): the smallest id reachable, by alternating large and small stars.

    The edges stay distributed; each round is written to the shared folder, and the loop ends when a round changes
    nothing. Rounds grow with the logarithm of the longest path. Self-edges are ignored.
    """
    cur = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}0"
    )
    seen, i = None, 0
    while True:
        # what is joined is written first: a join between plain shuffles splits an id that very many edges meet
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large, f"{name}large")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}least")
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        i += 1
        nxt = scratch.save(small, f"{name}{i}")
        now = nxt.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        scratch.drop(f"{name}{i - 1}")
        cur = nxt
        if (now["n"], now["x"]) == seen:
            break
        seen = (now["n"], now["x"])
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )
