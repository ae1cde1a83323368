"""Stored tables: versions of partitions, and a manifest that says which of them hold.

A write puts its rows into new version folders and then commits by renaming one small manifest into
place. A reader follows the newest manifest, so a job that is killed before its commit leaves the
table as it was, and one that reads while another commits keeps its own view. Files of versions
that no manifest names any more are left until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, VERSION = "_manifest", "version"
Partition = tuple[str, ...]


class Conflict(RuntimeError):
    """Another writer has committed since the table was read."""


class Store:
    """A table below ``path``, partitioned by columns of its rows."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    # -------------------------------------------------------------- files

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _number(self) -> int:
        """The newest manifest's number, 0 where there is none."""
        files, folder = self._files(), self._path(MANIFESTS)
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def _manifest(self) -> tuple[int, dict]:
        number = self._number()
        if not number:
            return 0, {"schema": None, "partitions": {}}
        text = self.spark.read.text(f"{self.path}/{MANIFESTS}/{number:010}.json", wholetext=True).first()[0]
        return number, json.loads(text)

    def _commit(self, after: int, manifest: dict) -> None:
        files = self._files()
        ready, final = self._path(MANIFESTS, f".{uuid.uuid4().hex}"), self._path(MANIFESTS, f"{after + 1:010}.json")
        out = files.create(ready)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._number() != after or not files.rename(ready, final):
            files.delete(ready, False)
            raise Conflict(f"{self.path} was written by another job")

    # -------------------------------------------------------------- reading

    def partitions(self) -> dict[Partition, list[str]]:
        """The versions that hold the rows of each partition; values are as in folder names."""
        return {tuple(json.loads(k)): v for k, v in self._manifest()[1]["partitions"].items()}

    def read(self, keep: Callable[[Partition], bool] = lambda _: True) -> DataFrame | None:
        """The rows of the partitions to keep; None where nothing was ever stored."""
        manifest = self._manifest()[1]
        if manifest["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [self._folder(tuple(json.loads(k)), v) for k, versions in manifest["partitions"].items() if keep(tuple(json.loads(k))) for v in versions]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).select(*schema.names)

    def _folder(self, partition: Partition, version: str) -> str:
        return "/".join((self.path, *(f"{c}={v}" for c, v in zip(self.by, partition, strict=True)), f"{VERSION}={version}"))

    # -------------------------------------------------------------- writing

    def write(self, rows: DataFrame, replace: Callable[[Partition], bool] = lambda _: False, **options: str) -> set[Partition]:
        """Add ``rows``, in place of what the partitions to replace held; the partitions that got rows.

        Rows may be made from the table itself: its files stay as they are.
        """
        from pyspark.sql import functions as F

        number, manifest = self._manifest()
        version = uuid.uuid4().hex
        rows.withColumn(VERSION, F.lit(version)).write.mode("append").options(**options).partitionBy(*self.by, VERSION).parquet(self.path)
        written = self._written(version)
        kept = {k: v for k, v in manifest["partitions"].items() if not replace(tuple(json.loads(k)))}
        for p in written:
            kept.setdefault(json.dumps(p), []).append(version)
        self._commit(number, {"schema": manifest["schema"] or json.dumps(rows.schema.jsonValue()), "partitions": kept})
        return {tuple(p) for p in written}

    def _written(self, version: str) -> list[list[str]]:
        found = self._files().globStatus(self._path(*(f"{c}=*" for c in self.by), f"{VERSION}={version}"))
        names = [s.getPath().toString().split("/")[-len(self.by) - 1 : -1] for s in found or []]
        return [[n.split("=", 1)[1] for n in own] for own in names]

    def vacuum(self) -> int:
        """Delete versions that the newest manifest doesn't name, and older manifests; how many folders went. Only while nothing else reads or writes."""
        number, manifest = self._manifest()
        files = self._files()
        named = {self._folder(tuple(json.loads(k)), v).split(self.path)[-1] for k, versions in manifest["partitions"].items() for v in versions}
        gone = 0
        for s in files.globStatus(self._path(*(f"{c}=*" for c in self.by), f"{VERSION}=*")) or []:
            if "/" + "/".join(s.getPath().toString().split("/")[-len(self.by) - 1 :]) not in named:
                files.delete(s.getPath(), True)
                gone += 1
        for s in files.listStatus(self._path(MANIFESTS)) if number else []:
            if s.getPath().getName() != f"{number:010}.json":
                files.delete(s.getPath(), False)
        return gone
