"""A keyed table in hash buckets, of which a batch rewrites only those that it touches.

A row lies in the bucket of its key's hash. A version of the table is a manifest: a small file that names, for each bucket, the folder
of its rows. A batch reads the buckets of its own keys, merges them, writes them as new folders and puts a manifest beside the old
one; the other buckets' folders are taken over as they are. Readers see a version whole or not at all, since the manifest comes
last and by a rename; writing a version again gives the same version again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]
#: What a merge may say that it did with a row.
ACTIONS = ["inserted", "new", "updated", "unchanged", "deleted", "kept"]


class BucketTable:
    """The table at path (a folder that driver and executors share) of rows with these keys and columns. buckets is fixed by the first
    version: about as many as make a bucket a task's load."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str, buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._fs = spark._jvm.org.apache.hadoop.fs
        #: Rows of the touched buckets by what the last merge did with them, if it tells, counted as they were written.
        self.counts: dict[str, int] = {}
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._fs.Path(path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        with_ = self._files.open(self._at(f"{self.path}/manifests/{version}"))
        try:
            held = json.loads(bytes(with_.readAllBytes()).decode())
        finally:
            with_.close()
        if held["buckets"] != self.buckets:
            raise ValueError(f"the table has {held['buckets']} buckets, not {self.buckets}")
        return held["folders"]

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (the last one, if none is given); only: of these buckets."""
        if version is None:
            version = max(self.versions(), default=-1)
        folders = self.manifest(version) if version >= 0 else {}
        paths = [f"{self.path}/{folder}" for b, folder in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, merge: Merge, version: int | None = None) -> int:
        """Merges a batch into the version before `version` (default: after the last one) and returns the number written. merge(old rows,
        batch rows) gives the new rows; it must judge each key by its own rows alone, so that buckets can be merged apart."""
        version = max(self.versions(), default=-1) + 1 if version is None else version
        before = max((v for v in self.versions() if v < version), default=-1)
        folders = dict(self.manifest(before)) if before >= 0 else {}
        rows = batch.withColumn("_bucket", self.bucket()).persist()
        try:
            touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most `buckets` numbers
            if touched:
                merged, seen = merge(self.read(before, touched), rows.drop("_bucket")), None
                if "action" in merged.columns:
                    seen = Observation()
                    merged = merged.observe(seen, *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
                out = merged.select([f.name for f in self.schema]).withColumn("_bucket", self.bucket())
                # a task writes the buckets that it holds, a file each
                out.repartition(min(len(touched), self.buckets), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{version}")
                self.counts = {a: n for a, n in seen.get.items() if n} if seen else {}
                written = {f.getPath().getName() for f in self._files.listStatus(self._at(f"{self.path}/data/{version}"))}
                for b in touched:
                    folders.pop(str(b), None)
                    if f"_bucket={b}" in written:
                        folders[str(b)] = f"data/{version}/_bucket={b}"
        finally:
            rows.unpersist()
        self._put(version, folders)
        return version

    def _put(self, version: int, folders: dict[str, str]) -> None:
        draft, last = self._at(f"{self.path}/manifests/.{version}"), self._at(f"{self.path}/manifests/{version}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        self._files.delete(last, False)
        if not self._files.rename(draft, last):
            raise OSError(f"the manifest {last} can't be written")

    def forget(self, keep: int = 2) -> None:
        """Deletes all versions but the last `keep`, and the folders that none of those names."""
        gone, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {folder for v in kept for folder in self.manifest(v).values()}
        for v in gone:
            for folder in set(self.manifest(v).values()) - named:
                self._files.delete(self._at(f"{self.path}/{folder}"), True)
            self._files.delete(self._at(f"{self.path}/manifests/{v}"), False)
