"""Shards under size-tiered compaction with a versioned manifest.

A store is a folder with immutable Parquet files (shards) and manifests `manifest-<version>.json`, each of which
lists all live shards with rows, bytes and tier. An arrival is written as small shards and committed as the next
version. Compaction sorts the live shards into tiers by size, cuts each tier into runs of similar sizes whose sum
stays within the target, merges every run of at least `fan_in` shards into one file, and commits the exchange. A
commit checks that its files are there, writes a temporary file and gives it the next version's name without
overwriting (a hard link on local disks; a rename that fails if the name is taken elsewhere, which is atomic on HDFS;
stores without such a rename need a lock around `commit`): readers see the old list or the new one, and of two writers
one must retry. Files that no manifest names, such as those of a task that ran twice, are never read and go with
`vacuum` once they are old.

Merging needs no shuffle: one task reads a run's files and writes one file, and a run is at most the target. The
manifest has a row for each file, never for a document.

Cases: all columns and rows of an arrival are kept as they are, nulls, repeated and empty ones too; arrivals may have
more columns than earlier ones, which then read as null; a column of another type than before and one named `_shard`,
which `read` adds, are errors before anything is written; an empty arrival commits a version without new shards; a
store without shards reads as an empty table.
"""

from __future__ import annotations

import functools
import json
import posixpath
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm import common

#: Runs that one Spark job merges at most.
RUNS_IN_A_JOB = 64
#: Names of so many files are broadcast at most, about 100 bytes each; of more they are shuffled.
BROADCAST_FILES = 100_000


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int


def tier_of(size: int, base: int, fan_in: int) -> int:
    t = 0
    while size > base:
        size, t = size / fan_in, t + 1
    return t


def plan(shards: list[Shard], target: int, fan_in: int) -> list[list[Shard]]:
    """Runs to merge: neighbours by size within a tier, each run within the target and of fan_in shards at least."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < target // 2:
            tiers.setdefault(s.tier, []).append(s)
    runs = []
    for own in tiers.values():
        own.sort(key=lambda s: (s.bytes, s.path))
        run, size = [], 0
        for s in own:
            if run and size + s.bytes > target:
                runs.append(run)
                run, size = [], 0
            run.append(s)
            size += s.bytes
        runs.append(run)
    return [r for r in runs if len(r) >= fan_in]


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 128 << 20, base_bytes: int = 8 << 20, fan_in: int = 4):
        self.spark, self.folder, self.target, self.base, self.fan_in = spark, folder, target_bytes, base_bytes, fan_in
        self.fs, _ = common.hadoop_path(spark, folder)
        self.fs.mkdirs(self._path(folder))

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> int:
        """The latest committed version; 0 for a new store."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[list[Shard], StructType | None]:
        version = self.version() if version is None else version
        if not version:
            return [], None
        stream = self.fs.open(self._path(self._manifest(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return [Shard(**s) for s in found["shards"]], StructType.fromJson(found["schema"])

    def _manifest(self, version: int) -> str:
        return posixpath.join(self.folder, f"manifest-{version:012d}.json")

    def commit(self, base: int, shards: list[Shard], schema: StructType) -> int:
        """Makes `shards` version base + 1, or raises Conflict; a new shard whose file isn't there is an error."""
        old = {s.path for s in self.manifest(base)[0]} if base else set()
        if gone := [s.path for s in shards if s.path not in old and not self.fs.exists(self._path(s.path))]:
            raise RuntimeError(f"shards to commit are gone: {gone[:3]}")
        final, temp = self._path(self._manifest(base + 1)), self._path(posixpath.join(self.folder, f".{uuid.uuid4().hex}.tmp"))
        out = self.fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "schema": json.loads(schema.json()), "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        try:
            self._name(temp, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {base + 1} exists") from None
        finally:
            self.fs.delete(temp, False)
        return base + 1

    def _name(self, temp, final) -> None:
        """Gives a complete file its final name, or fails if that is taken."""
        jvm = self.spark.sparkContext._jvm
        if self.fs.getScheme() == "file":
            paths = (jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (final, temp))
            jvm.java.nio.file.Files.createLink(*paths)
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(temp, final, options)

    def _files(self, folder: str, schema: StructType) -> list[Shard]:
        """The files of one write, in order of their tasks."""
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        rows = self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()  # one row a file
        return [Shard(posixpath.join(folder, r["f"]), r["count"], sizes[r["f"]], tier_of(sizes[r["f"]], self.base, self.fan_in)) for r in sorted(rows, key=lambda r: r["f"])]

    def append(self, arrival: DataFrame, max_records: int = 0) -> int:
        """Writes an arrival as small shards (of max_records rows at most, if given) and commits it."""
        base = self.version()
        shards, schema = self.manifest(base)
        before = {f.name.lower(): f.dataType for f in schema.fields} if schema else {}
        if wrong := [f.name for f in arrival.schema.fields if f.name.lower() == "_shard" or before.get(f.name.lower(), f.dataType) != f.dataType]:
            raise ValueError(f"columns of a reserved name or of another type than before: {wrong}")
        folder = posixpath.join(self.folder, f"data-{uuid.uuid4().hex}")
        arrival.write.option("maxRecordsPerFile", max_records).parquet(folder)
        if schema is not None:
            have = {f.name for f in schema.fields}
            merged = StructType([*schema.fields, *(f for f in arrival.schema.fields if f.name not in have)])
        return self.commit(base, [*shards, *self._files(folder, arrival.schema)], merged if schema is not None else arrival.schema)

    def merge(self) -> bool:
        """One round: merges the runs of all tiers and commits that as a version; False if no tier has a run."""
        base = self.version()
        shards, schema = self.manifest(base)
        runs = plan(shards, self.target, self.fan_in)
        if not runs:
            return False
        new: list[Shard] = []
        for at in range(0, len(runs), RUNS_IN_A_JOB):
            folder = posixpath.join(self.folder, f"data-{uuid.uuid4().hex}")
            each = [self.spark.read.schema(schema).parquet(*(s.path for s in run)).coalesce(1) for run in runs[at : at + RUNS_IN_A_JOB]]
            functools.reduce(DataFrame.unionAll, each).write.parquet(folder)
            new += self._files(folder, schema)
        gone = {s.path for run in runs for s in run}
        if sum(s.rows for s in new) != sum(s.rows for run in runs for s in run):
            raise RuntimeError("merged shards differ in their rows")
        self.commit(base, [s for s in shards if s.path not in gone] + new, schema)
        return True

    def compact(self) -> int:
        """Merges until no tier has a run left, a version for each round; returns the last version. Earlier versions
        and their files stay until the caller's vacuum."""
        while self.merge():
            pass
        return self.version()

    def vacuum(self, keep: int = 2, orphan_age: float = 86_400) -> None:
        """Deletes manifests before the last `keep` versions and shards that only they name. Files that no manifest
        names may belong to a write that isn't committed yet; they go `orphan_age` seconds after they were written."""
        last = self.version()
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        listed = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        named = {s.path for v in listed for s in self.manifest(v)[0]}
        before = (time.time() - orphan_age) * 1000
        versions = range(max(1, last - keep + 1), last + 1)
        live = {s.path for v in versions for s in self.manifest(v)[0]}
        for d in self.fs.listStatus(self._path(self.folder)):
            name = d.getPath().getName()
            if name.startswith("manifest-") and int(name[9:-5]) not in versions:
                self.fs.delete(d.getPath(), False)
            elif name.startswith("data-"):
                folder = posixpath.join(self.folder, name)
                for f in self.fs.listStatus(d.getPath()):
                    path = posixpath.join(folder, f.getPath().getName())
                    if f.getPath().getName().startswith("part-") and path not in live and (path in named or f.getModificationTime() < before):
                        self.fs.delete(f.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version, each with `_shard`, its file's name."""
        shards, schema = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema or StructType()).withColumn("_shard", F.lit("").cast("string"))
        return self.spark.read.schema(schema).parquet(*(s.path for s in shards)).withColumn("_shard", F.col("_metadata.file_name"))


def op9_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_md5, n_chars of every document as read from the compacted store, its shard's number in the
    manifest, the shard's tier and the manifest's version."""
    store = ShardStore(spark, common.scratch_path(spark, "shards"), target_bytes=64 << 20, base_bytes=4 << 20)
    store.append(common.documents(spark, sf_dir), max_records=2000)
    while store.merge():
        store.vacuum(keep=1)  # nobody else reads or writes this store
    version = store.version()
    shards, _ = store.manifest(version)
    rows = [(posixpath.basename(s.path), i, s.tier) for i, s in enumerate(shards)]  # one row a file
    names = spark.createDataFrame(rows, "_shard string, shard int, tier int")
    if len(rows) <= BROADCAST_FILES:
        names = F.broadcast(names)
    # the texts stay where they are read: only their digests meet the files' names
    found = store.read(version).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "n_chars", "_shard").join(names, "_shard")
    return found.select("doc_id", "text_md5", "n_chars", "shard", "tier", F.lit(version).alias("version"))
