"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own on one machine (as in tests), and an error on a cluster, whose
    executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to cut lineage; what is still there goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{work_dir(spark).rstrip('/')}/{uuid.uuid4().hex}", 0
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self) -> str:
        """A place for one more table."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def save(self, df: DataFrame) -> DataFrame:
        return self.read(self.save_counted(df)[0], schema=df.schema)

    def save_counted(self, df: DataFrame) -> tuple[str, int]:
        """The place of the written table and its number of rows, counted by the write itself."""
        path, seen = self.path(), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return path, seen.get["n"]

    def save_dealt(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """df, dealt into that many partitions by a column before, as a table that Spark knows to be dealt so: joins by the column don't shuffle it."""
        name = f"scratch_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, column).option("path", self.path()).saveAsTable(name)
        return self.spark.table(name)

    def read(self, *paths: str, schema) -> DataFrame:
        """Written tables of one schema as one table."""
        return self.spark.read.schema(schema).parquet(*paths)
