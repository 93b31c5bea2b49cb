"""A Parquet table kept in buckets by key, of which each commit writes only those that it changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """``path``/v=N/bucket=B holds bucket B as commit N wrote it; ``path``/_commits/N.json says which version of each bucket the table has.

    A reader sees the newest commit file, which appears at once by a rename, so
    it never sees half of a commit. A commit that is repeated after a
    failure starts from the one before it and writes the same folders
    again. Folders that none of the last ``keep`` commits names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path.rstrip("/"), key, buckets, keep
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[int]:
        folder = self._at("_commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """The version of each bucket after that commit, of the newest by default."""
        number = max(self.commits(), default=None) if number is None else number
        if number is None:
            return {}
        stream = self._fs.open(self._at(f"_commits/{number}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def read(self, schema, manifest: dict[int, int] | None = None) -> DataFrame:
        """The rows of the table, or of the buckets of a manifest."""
        manifest = self.manifest() if manifest is None else manifest
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in manifest.items() if v >= 0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, number: int, changes: DataFrame, schema, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Puts merge(stored, changes) in the place of the buckets that hold a key of ``changes``. Numbers rise; the same one again replaces what it wrote."""
        before = max((n for n in self.commits() if n < number), default=None)
        manifest = self.manifest(before) if before is not None else {}
        touched = [r[0] for r in self.bucket(changes).select("bucket").distinct().collect()]  # no more than there are buckets
        stored = self.read(schema, {b: manifest[b] for b in touched if b in manifest})
        folder = f"{self.path}/v={number}"
        self.bucket(merge(stored, changes)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        held = {int(f.getPath().getName().removeprefix("bucket=")) for f in self._fs.listStatus(self._at(f"v={number}")) if f.getPath().getName().startswith("bucket=")}
        manifest |= {b: number if b in held else -1 for b in touched}
        self._publish(number, manifest)
        self._clean()

    def _publish(self, number: int, manifest: dict[int, int]) -> None:
        draft, place = self._at(f"_commits/.{number}.draft"), self._at(f"_commits/{number}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(place):
            self._fs.delete(place, False)
        if not self._fs.rename(draft, place):
            raise RuntimeError(f"commit {number} of {self.path} could not be published")

    def _clean(self) -> None:
        numbers = self.commits()
        for n in numbers[: -self.keep]:
            self._fs.delete(self._at(f"_commits/{n}.json"), False)
        used = {(v, b) for n in numbers[-self.keep :] for b, v in self.manifest(n).items()}
        for version in self._fs.listStatus(self._at("")):
            name = version.getPath().getName()
            if not name.startswith("v="):
                continue
            own = int(name.removeprefix("v="))
            if own not in {v for v, _ in used} and own <= numbers[-1]:
                self._fs.delete(version.getPath(), True)
                continue
            for part in self._fs.listStatus(version.getPath()):
                part_name = part.getPath().getName()
                if part_name.startswith("bucket=") and (own, int(part_name.removeprefix("bucket="))) not in used:
                    self._fs.delete(part.getPath(), True)
