"""Sharding by size-tiered compaction with a versioned manifest; DataFrame functions only.

Arrivals are appended as small immutable shards (Parquet files). Shards of similar size form a tier; when a
tier has ``FANOUT`` shards or more they are merged into files of about the target size, and what has reached
half the target is never merged again. A version of the store is a manifest that lists its shards; a version
is written aside and renamed into place, which fails if that version exists, so readers see whole versions and
of two writers one must start again from the newer. Shards that no version lists are removed by ``vacuum``, except
those of a writer at work: it leaves a lease beside its folder until it has committed or failed, and a lease counts for
``LEASE_SECONDS``.

Merging reads several files in one task and writes one, without a shuffle; sizes come from the file
system, and the manifest, one line a shard, is all that the driver holds.

Defined results: every arriving row is in exactly one shard, whatever it holds: nulls, repeated rows, long texts
and columns of any name are stored as they are. Arrivals may have different columns: the manifest keeps the union of
their schemas, in which a shard without a column has nulls; one name with two types is an error and adds nothing. An
empty arrival adds no shard and still makes a version; a store without shards reads as no rows.
"""

from __future__ import annotations

import json
import math
import time
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import normalised, read_documents, scratch_path

FANOUT = 4
TARGET_BYTES = 128 << 20
SMALLEST = 1 << 16
#: How long a writer that has not committed keeps its files from being vacuumed.
LEASE_SECONDS = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self._fs_path(self.path).getFileSystem(self._conf)

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_manifest")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "shards": [{"file", "bytes", "tier"}], "schema"} of a version, by default the newest."""
        known = self.versions()
        if not known:
            return {"version": 0, "shards": [], "schema": None}
        version = known[-1] if version is None else version
        stream = self.fs.open(self._fs_path(f"{self.path}/_manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, read: dict, shards: list[dict], schema: StructType | None = None) -> dict:
        known = schema.jsonValue() if schema else read["schema"]
        new = {"version": read["version"] + 1, "shards": sorted(shards, key=lambda s: s["file"]), "schema": known}
        aside = self._fs_path(f"{self.path}/_manifest/.{uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(json.dumps(new).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, self._fs_path(f"{self.path}/_manifest/v{new['version']:08d}.json"), none)
        except Exception as e:
            self.fs.delete(aside, False)
            raise Conflict(f"version {new['version']} exists") from e
        return new

    # ------------------------------------------------------------ shards

    def tier(self, size: int) -> int:
        """Shards whose sizes are within a factor of FANOUT share a tier; -1 for those that are done."""
        return -1 if size >= self.target // 2 else max(0, int(math.log(max(size, 1) / SMALLEST, FANOUT)))

    def _schema(self, manifest: dict, rows: DataFrame | None = None) -> StructType:
        """The manifest's schema, widened by the columns of an arrival."""
        fields = StructType.fromJson(manifest["schema"]).fields if manifest["schema"] else []
        types = {f.name: f.dataType for f in fields}
        for f in rows.schema.fields if rows is not None else ():
            if types.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is stored as {types[f.name].simpleString()} and arrives as {f.dataType.simpleString()}")
        return StructType([StructField(name, kind, True) for name, kind in types.items()])

    @contextmanager
    def _folder(self):
        """A new folder for shards, leased until the block is left."""
        name = uuid4().hex[:12]
        lease = self._fs_path(f"{self.path}/_lease/{name}")
        self.fs.create(lease, False).close()
        try:
            yield name
        finally:
            self.fs.delete(lease, False)

    def _leased(self) -> set[str]:
        folder = self._fs_path(f"{self.path}/_lease")
        oldest = (time.time() - LEASE_SECONDS) * 1000
        return {f.getPath().getName() for f in self.fs.listStatus(folder) if f.getModificationTime() >= oldest} if self.fs.exists(folder) else set()

    def _write(self, rows: DataFrame, name: str) -> list[dict]:
        folder = f"{self.path}/data/{name}"
        rows.write.parquet(folder)
        files = [(f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(self._fs_path(folder)) if f.getPath().getName().startswith("part-")]
        if len(files) == 1 and self.spark.read.schema(rows.schema).parquet(folder).isEmpty():  # Spark writes one file for no rows
            self.fs.delete(self._fs_path(folder), True)
            files = []
        return [{"file": f"{name}/{file}", "bytes": size, "tier": self.tier(size)} for file, size in files]

    def append(self, rows: DataFrame) -> dict:
        """Add an arrival as small shards; returns the new manifest."""
        with self._folder() as name:
            read = self.manifest()
            schema = self._schema(read, rows)
            return self._commit(read, read["shards"] + self._write(rows, name), schema)

    def compact(self) -> dict:
        """Merge tiers until none has FANOUT shards; each merge is a version of its own."""
        while True:
            read = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in read["shards"]:
                tiers.setdefault(s["tier"], []).append(s)
            ready = [t for t in sorted(tiers) if t >= 0 and len(tiers[t]) >= FANOUT]
            if not ready:
                return read
            old = tiers[ready[0]]
            files = max(1, round(sum(s["bytes"] for s in old) / self.target))
            with self._folder() as name:
                merged = self._write(self._files(read, old).coalesce(files), name)
                gone = {s["file"] for s in old}
                for s in merged:
                    s["tier"] = max(s["tier"], ready[0] + 1) if s["tier"] >= 0 else -1
                self._commit(read, [s for s in read["shards"] if s["file"] not in gone] + merged)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the newest ``keep`` and the shards that only they list; returns how many shards went."""
        leased = self._leased()  # before the manifests: what is committed since is listed
        versions = self.versions()
        listed, n = {s["file"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}, 0
        data = self._fs_path(f"{self.path}/data")
        for folder in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if folder.getPath().getName() in leased:
                continue
            for f in self.fs.listStatus(folder.getPath()):
                name = f"{folder.getPath().getName()}/{f.getPath().getName()}"
                if f.getPath().getName().startswith("part-") and name not in listed:
                    self.fs.delete(f.getPath(), False)
                    n += 1
        for v in versions[:-keep]:
            self.fs.delete(self._fs_path(f"{self.path}/_manifest/v{v:08d}.json"), False)
        return n

    def _files(self, manifest: dict, shards: list[dict]) -> DataFrame:
        schema = self._schema(manifest)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the ``shard`` that holds each."""
        manifest = self.manifest(version)
        rows = self._files(manifest, manifest["shards"])
        if not manifest["shards"]:
            return rows.withColumn("shard", F.lit(None).cast("string"))
        return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Take documents in as arrivals, compact and commit, and read the newest version: each document with its shard."""
    docs = read_documents(spark, sf_dir)
    store = ShardStore(spark, scratch_path(spark, "op4-store"))
    arrivals = 3
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(arrivals)) == k))
    version = store.compact()["version"]
    store.vacuum()
    rows = store.read()
    return rows.select("doc_id", "shard", F.lit(version).alias("version"), F.length("text").cast("long").alias("text_chars"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
