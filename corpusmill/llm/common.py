"""What the operators of this subpackage share: scratch tables in the folder that all executors see,
the identity of document rows, and connected components."""

from __future__ import annotations

import itertools
import posixpath
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set and all runs in one process (tests), a temporary one
    is chosen and set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    return posixpath.join(shared_dir(spark), f"corpusmill-{tag}-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: this cuts the lineage, survives lost executors
    and keeps later passes from computing it anew."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    hadoop_delete(df.sparkSession, df._scratch)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done. It does when the driver's JVM has collected its garbage,
    and in the background, so this waits a moment. Then the driver gives back memory that it no longer uses: its JVM's
    threads, some hundred of them, keep what they have freed outside the heap."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        trim_jvm(spark)
        time.sleep(0.4)
    trim()


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def hadoop_delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def open_store(uri: str):
    """pyarrow's file system and path of a URI or local path; executors use it for files in the shared folder."""
    import pyarrow.fs as pafs

    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that tell rows with one doc_id apart by their texts. With doc_id it identifies a document: rows that
    agree in both are one document and share its results."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int | None = None) -> DataFrame:
    """Connected components of an undirected graph given as edges (a, b) of longs.

    Returns (node, component), component being the smallest node of each; only nodes that have an edge occur.
    Alternates large-star and small-star steps until the edges stop changing, which takes a logarithmic number of
    rounds. Each round's edges are written to the shared folder, so nothing is collected and a lost executor costs
    one round at most. If max_rounds is given and not enough, that is an error. A hub's neighbours never meet in a task: minima are aggregates that combine before the
    shuffle, and the edges join them as Spark's skew-splittable joins.
    """
    empty = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = written(empty.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        # large star: every larger neighbour of a node points at the node's least neighbour (or itself)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, point at its least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        n, total = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        trim_jvm(now.sparkSession)
        if (n, total) == last:
            break
        last = (n, total)
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tidy(run):
    """run, after which a worker gives back the memory that it no longer uses: workers live on from task to task, and
    what they keep is missing for the executor's next stage."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    """Gives memory that is no longer used back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trim_jvm(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM no longer uses back to the system: that of the heap and, if this JVM can (on
    Linux, from 17.0.9), what its threads have freed outside it."""
    from py4j.protocol import Py4JError

    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        beans.invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    except Py4JError:  # another JVM, or another C library
        pass


def groups(batches, n_keys: int):
    """Runs of rows with equal values in the first n_keys (integer) columns of record batches that come sorted by
    them: (key, table) for each. Holds one run at a time."""
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(new), batch.num_rows]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = tuple(int(c[a]) for c in cols)
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


class Sets:
    """Union-find over 0..n-1, for what one task holds."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.left = n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.left -= 1
        return True
