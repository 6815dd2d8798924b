"""Tables that are published: merged by key, whole for every reader, one version after another.

A table is a folder. Its rows lie in buckets by a hash of their key, and a version is a manifest that names the folder of each bucket. A merge
rewrites the buckets that its rows fall into, into a folder of their own, moves that folder to its place by one rename, and then
creates the next version's manifest, which fails if another writer was first; then the merge starts again from what is there now. So readers, who
go by the newest manifest, never see half a merge, and one that stops anywhere before its last step changes nothing. What such a
merge leaves behind, and versions that nobody needs any more, go with `tidy`.

Keys are compared by lower-cased text; null is a key like any. Of new rows of one key the first in order of all columns stays.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Overtaken(RuntimeError):
    """Another writer published first, more often than was to be tried."""


@dataclass(frozen=True)
class Published:
    """root: the folder. keys: of a row. buckets: that rows are dealt into; fixed when the table is first written."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        """The newest version, 0 before the first. A manifest counts when it has its name, which it gets whole."""
        return max((int(n) for n in self._names("_versions") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": self.buckets, "folders": {}, "schema": None}
        stream = self._fs().open(self._path("_versions", f"{version:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        schema = StructType.fromJson(held["schema"])
        return self._folders(held["folders"].values(), schema)

    def _folders(self, folders, schema: StructType) -> DataFrame:
        paths = [f"{self.root.rstrip('/')}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*(F.lower(F.col(k).cast("string")) for k in self.keys)), F.lit(n)).cast("int")

    def merge(self, rows: DataFrame, replace: bool = False, tries: int = 5) -> int:
        """Adds the rows whose key the table lacks; replace: they take the place of those with their key. Returns how many rows were added or
        put in place."""
        for _ in range(tries):
            at = self.version()
            staged, folders, schema, n = self._stage(rows, replace, self.manifest(at))
            if not folders or self._publish(at, staged, folders, schema):
                return n
        raise Overtaken(f"version {at + 1} of {self.root} was published by others, {tries} times")

    def _stage(self, rows: DataFrame, replace: bool, held: dict) -> tuple[str, dict[str, str], dict, int]:
        """Writes the buckets that rows fall into as they are to be; returns the staged folder, what the new version's buckets are, and the number
        of rows that are new."""
        count = held["buckets"]
        schema = held["schema"] or rows.schema.jsonValue()
        columns = [f["name"] for f in schema["fields"]]
        rows = rows.select(*columns)
        key = [F.lower(F.col(k).cast("string")).alias(f"__{k}") for k in self.keys]
        whole = rows.select(self._bucket(count).alias("__bucket"), *key, F.struct(*columns).alias("__row"))
        of_key = ["__bucket", *(f"__{k}" for k in self.keys)]
        fresh = whole.groupBy(*of_key).agg(F.min("__row").alias("__row"))
        touched = {str(r[0]) for r in fresh.select("__bucket").distinct().collect()}  # no more than the buckets
        if not touched:
            return "", {}, schema, 0
        old = self._folders([f for b, f in held["folders"].items() if b in touched], StructType.fromJson(schema))
        old = old.select(self._bucket(count).alias("__bucket"), *key, F.struct(*columns).alias("__row"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in of_key]
        less = lambda a, b: a.alias("a").join(b.alias("b"), same, "left_anti")
        new = fresh if replace else less(fresh, old)
        kept = less(old, fresh) if replace else old
        both = kept.select("__bucket", "__row", F.lit(0).alias("__new")).unionByName(new.select("__bucket", "__row", F.lit(1).alias("__new")))
        seen, staged = Observation(), f"_staged/{uuid.uuid4().hex}"
        out = both.observe(seen, F.sum("__new").alias("n")).repartition("__bucket").select("__bucket", "__row.*")
        out.write.partitionBy("__bucket").parquet(f"{self.root.rstrip('/')}/{staged}")
        name = staged.split("/")[1]
        folders = held["folders"] | {b: f"data/{name}/__bucket={b}" for b in touched}
        return staged, folders, schema, seen.get["n"] or 0

    def _publish(self, at: int, staged: str, folders: dict[str, str], schema: dict) -> bool:
        """Moves what was staged to its place and names it in the next version; false if that version is there already."""
        fs = self._fs()
        fs.mkdirs(self._path("data"))
        if not fs.rename(self._path(staged), self._path("data", staged.split("/")[1])):
            raise OSError(f"{staged} can't be moved")
        return self._name(at + 1, {"buckets": self.manifest(at)["buckets"], "folders": folders, "schema": schema})

    def _name(self, version: int, manifest: dict) -> bool:
        """Writes a manifest under a name of its own, then gives it the version's name, unless there is one."""
        fs, mine = self._fs(), self._path("_versions", f"_{uuid.uuid4().hex}")
        fs.mkdirs(self._path("_versions"))
        stream = fs.create(mine, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(mine.toUri() if mine.toUri().getScheme() else self._path().getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(mine, self._path("_versions", f"{version:020d}"), none)  # refuses to take the place of another
        except Exception as e:  # noqa: BLE001  Py4J has one class for all of Java's
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(mine, False)
            return False
        return True

    def tidy(self, keep: int = 2) -> None:
        """Drops all but the newest versions, folders that none of those names, and what was staged or moved and never named. Not to be run beside
        a merge."""
        fs, versions = self._fs(), [n for n in self._names("_versions") if n.isdigit()]
        for n in self._names("_versions"):
            if n not in versions[-keep:]:
                fs.delete(self._path("_versions", n), True)
        named = {f for n in versions[-keep:] for f in self.manifest(int(n))["folders"].values()}
        for n in self._names("_staged"):
            fs.delete(self._path("_staged", n), True)
        for n in self._names("data"):
            for b in self._names(f"data/{n}"):
                if f"data/{n}/{b}" not in named:
                    fs.delete(self._path("data", n, b), True)
