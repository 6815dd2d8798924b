"""Artifacts that are read again whenever they change: tries by file, given up on after some, the last good rows kept.

Each poll lists the files and looks only at those whose stamp isn't the one that was read, or that failed at their stamp and may be tried
again. What is known of a file (stamp, tries, state) and its last document are published tables, so a poll that stops halfway leaves
the state of the one before, and the next repeats it. A file that stays broken goes to the dead letters, with its stamp and how it
begins, and is left alone until it changes; its last good document stays. Files that are gone keep theirs too.

The state is keyed by a name that is taken from the path, so that a file that is replaced by one of another path goes on as the same
artifact. Of files of one name the newest counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scratch import Scratch
from quillgraph.sources.published import Published

FAILING, GOOD, GAVE_UP = "failing", "good", "gave up"
STATE = "name string, stamp string, tries int, state string"


@dataclass
class Artifacts:
    """folder: of the files, pattern: of their names. root: where the state is kept. name: of an artifact, from its path. whole: whether a text is
    a document. retries: after the first try, at one stamp."""

    spark: SparkSession
    folder: str
    root: str
    name: Callable[[Column], Column] = lambda path: path
    whole: Callable[[Column], Column] = lambda text: F.try_parse_json(text).isNotNull()
    pattern: str = "*"
    retries: int = 2
    buckets: int = 16

    def __post_init__(self) -> None:
        table = lambda what, *keys: Published(self.spark, f"{self.root.rstrip('/')}/{what}", keys, self.buckets)
        self.states, self.documents, self.dead = table("states", "name"), table("documents", "name"), table("dead", "name", "stamp")

    def _read(self, table: Published, schema: str) -> DataFrame:
        return table.read() if table.version() else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        return self._read(self.states, STATE)

    def good(self) -> DataFrame:
        """(name, stamp, text): the last whole document of each artifact."""
        return self._read(self.documents, "name string, stamp string, text string")

    def letters(self) -> DataFrame:
        """(name, stamp, start): what was given up on."""
        return self._read(self.dead, "name string, stamp string, start string")

    def poll(self) -> int:
        """Reads what has changed and what failed before; returns how many files it looked at."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", self.pattern).load(self.folder)
        stamp = F.concat_ws("/", F.col("modificationTime").cast("timestamp").cast("double").cast("string"), F.col("length").cast("string"), F.substring_index("path", "/", -1))
        there = files.select(self.name(F.col("path")).alias("name"), "path", "modificationTime", stamp.alias("stamp"))
        newest = there.groupBy("name").agg(F.max_by(F.struct("path", "stamp"), F.struct("modificationTime", "path")).alias("f")).select("name", "f.*")
        known = self.state().withColumnsRenamed({"stamp": "was"})
        due = newest.join(known, "name", "left").where(~F.col("stamp").eqNullSafe(F.col("was")) | (F.col("state") == FAILING))
        scratch = Scratch(self.spark)
        path, n = scratch.save_counted(due)
        if not n:
            return 0
        due = scratch.read(path, schema=due.schema)
        # only the files that are due are read; their paths are in the plan by a join, not on the driver
        texts = files.select("path", F.col("content").cast("string").alias("text"))
        rows = due.join(texts, "path").withColumn("fine", F.coalesce(self.whole(F.col("text")), F.lit(False)))
        tries = F.when(F.col("stamp").eqNullSafe(F.col("was")), F.col("tries") + 1).otherwise(1)
        state = F.when(F.col("fine"), GOOD).when(tries > self.retries, GAVE_UP).otherwise(FAILING)
        rows = scratch.save(rows.select("name", "stamp", "text", tries.alias("tries"), state.alias("state")))
        # the state goes last: until then the poll hasn't been
        self.documents.merge(rows.where(F.col("state") == GOOD).select("name", "stamp", "text"), replace=True)
        self.dead.merge(rows.where(F.col("state") == GAVE_UP).select("name", "stamp", F.substring("text", 1, 80).alias("start")))
        self.states.merge(rows.select("name", "stamp", F.col("tries").cast("int").alias("tries"), "state"), replace=True)
        return n
