"""Sharding by size-tiered compaction over immutable files and a versioned manifest.

Arrivals are appended as small shards, however large their tasks are: a file ends at the number of rows that make a
``fanout``-th of the target at the arrivals' mean row size. Files are grouped in tiers by size (each tier ``fanout`` times the one below);
a tier with ``fanout`` files or more is merged into files of up to the target size, and files that reach half the target
are left alone. Every append and merge ends with a manifest: a new file ``manifest/v<N>.json``, made under another name
and renamed, which fails if another writer has taken the number. Readers go by the newest manifest, so they see all of a
change or nothing; files that no manifest names are leftovers of lost jobs and are never read.

A merge doesn't shuffle: a scan packs whole small files into tasks of at most the target size and each task writes one
file. Data files are Spark's Parquet, in any store that Spark reaches.

Edge cases: rows are kept as they are (nulls, repeats, all columns); an empty arrival commits a version without files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType


#: Names of files, of some 100 bytes each, that a reader ships to its tasks.
MOST_NAMES = 100_000


@dataclass(frozen=True)
class Shard:
    """One immutable file: its path under the store and its size in bytes."""

    path: str
    size: int


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


def row_bytes(df: DataFrame) -> Column:
    """Uncompressed size of a row: its strings' bytes, nested values as JSON, eight bytes for any other."""

    def of(f) -> Column:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        if isinstance(f.dataType, StringType | BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(f.dataType, ArrayType | MapType | StructType):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)

    return sum((of(f).cast("long") for f in df.schema), F.lit(0).cast("long"))


class ShardStore:
    """A versioned set of Parquet shards below ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root.rstrip("/"), target_bytes, fanout, smallest

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path("manifest")
        if not self._fs().exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Version, schema and shards; of the newest version unless one is given."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs().open(self._path(f"manifest/v{version or found[-1]:08d}.json"))
        try:
            got = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return got | {"shards": [Shard(*s) for s in got["shards"]]}

    def commit(self, based_on: int, schema: str, shards: list[Shard]) -> int:
        """Publish ``shards`` as version ``based_on + 1``, or raise CommitConflict."""
        version, fs = based_on + 1, self._fs()
        temporary, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{version:08d}.json")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [[s.path, s.size] for s in shards]}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise CommitConflict(f"version {version} exists")
        return version

    def _write(self, df: DataFrame, most_rows: int = 0) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", most_rows).parquet(f"{self.root}/{folder}")
        files = self._fs().listStatus(self._path(folder))
        return [Shard(f"{folder}/{f.getPath().getName()}", f.getLen()) for f in files if f.getPath().getName().startswith("part-")]

    def append(self, arrivals: DataFrame) -> int:
        """Small shards, one or more for each task of ``arrivals``, which is read twice: for its row size, then to write it."""
        now, size = self.manifest(), arrivals.agg(F.avg(row_bytes(arrivals))).first()[0]
        most_rows = max(1, int(self.target / self.fanout / max(size or 1, 1)))
        return self.commit(now["version"], arrivals.schema.json(), now["shards"] + self._write(arrivals, most_rows))

    def tier(self, size: int) -> int:
        level, top = 0, max(self.smallest, 1)
        while size > top:
            level, top = level + 1, top * self.fanout
        return level

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The files of each tier that is due for a merge, lowest tier first."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        return [files for _, files in sorted(tiers.items()) if len(files) >= self.fanout]

    def compact(self) -> int:
        """Merge until no tier that is due packs any tighter; the version then current.

        A merge is planned and committed on one manifest: if another writer commits in between, CommitConflict is raised
        and nothing is published.
        """
        while self._merged_one(self.manifest()):
            pass
        return self.manifest()["version"]

    def _merged_one(self, now: dict) -> bool:
        for files in self.plan(now["shards"]):
            merged = self._write(self._packed(files, now["schema"]))
            gone = {s.path for s in files}
            if len(merged) < len(files):
                try:
                    self.commit(now["version"], now["schema"], [s for s in now["shards"] if s.path not in gone] + merged)
                except CommitConflict:
                    self._discard(merged)
                    raise
                return True
            self._discard(merged)  # the scan packs no tighter: leave them
        return False

    def _packed(self, files: list[Shard], schema: str) -> DataFrame:
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return session.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{self.root}/{s.path}" for s in files))

    def _discard(self, shards: list[Shard]) -> None:
        for folder in {s.path.rpartition("/")[0] for s in shards}:
            self._fs().delete(self._path(folder), True)

    def vacuum(self, *, grace_seconds: float = 3600) -> int:
        """Delete older manifests and the data folders that the newest one doesn't name; the number of folders.

        Folders younger than ``grace_seconds`` stay, as another writer may be about to name them.
        """
        from time import time

        now, gone = self.manifest(), 0
        live = {s.path.split("/")[1] for s in now["shards"]}
        for v in self.versions()[:-1]:
            self._fs().delete(self._path(f"manifest/v{v:08d}.json"), False)
        if self._fs().exists(self._path("data")):
            for f in self._fs().listStatus(self._path("data")):
                if f.getPath().getName() not in live and f.getModificationTime() <= 1000 * (time() - grace_seconds):
                    gone += bool(self._fs().delete(f.getPath(), True))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard_id (the file's place in the manifest) and row_in_shard."""
        now = self.manifest(version)
        if not now["shards"]:
            schema = StructType.fromJson(json.loads(now["schema"])) if now["schema"] else StructType()
            return self.spark.createDataFrame([], schema).selectExpr("*", "0L AS shard_id", "0L AS row_in_shard")
        files = self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*(f"{self.root}/{s.path}" for s in now["shards"]))
        names = self.spark.createDataFrame([(s.path.rpartition("/")[2], i) for i, s in enumerate(now["shards"])], "__name string, shard_id long")
        named = files.select("*", F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("row_in_shard"))
        # a row a file: shipped to all tasks up to a stated number of files, joined beyond it
        return named.join(F.broadcast(names) if len(now["shards"]) <= MOST_NAMES else names, "__name").drop("__name")
