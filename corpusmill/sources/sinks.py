"""Writers: delimited text, sparse-matrix files, and the segment index.

Divergences: row ids are always parted from values; matrix files are little-endian both ways; wiping and updating an
index at once is an error.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.matrix import in_order

TOKENS = "doc_num long, pos int, term string, begin int, end int, payload string, type string, field string"
TRIPLET = np.dtype([("i", "<i4"), ("j", "<i4"), ("x", "<f8")])


def dsv_lines(rows: DataFrame, row_id: str, columns: Sequence[str] | None = None, row_head: str = "_term_", sep: str = "@", missing: str = "", sort_rows: str | None = None, header: bool = True, formats: dict[str, Callable] | None = None) -> DataFrame:
    """place, line: the lines of a delimited file. Columns come sorted unless given; rows by sort_rows (or the row id)."""
    columns = list(columns) if columns is not None else sorted(c for c in rows.columns if c not in (row_id, sort_rows))
    formats = formats or {}
    cells = [F.coalesce(formats.get(c, lambda x: x)(F.col(f"`{c}`")).cast("string"), F.lit(missing)) for c in (row_id, *columns)]
    lines = rows.select(F.struct(F.lit(1).alias("part"), F.col(sort_rows or row_id).alias("key")).alias("place"), F.concat_ws(sep, *cells).alias("line"))
    if not header:
        return lines
    kind = rows.schema[sort_rows or row_id].dataType
    head = rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), F.lit(None).cast(kind).alias("key")).alias("place"), F.lit(sep.join([row_head, *columns])).alias("line"))
    return head.union(lines)


def write_dsv(rows: DataFrame, path: str, row_id: str, mode: str = "overwrite", parts: int | None = None, **options) -> None:
    """Writes the lines in order, as files that follow one another by name, one a range of rows. parts: that many at
    most; a single file is written by one task."""
    lines = dsv_lines(rows, row_id, **options)
    lines = lines.orderBy("place") if parts is None else lines.repartitionByRange(parts, "place").sortWithinPartitions("place")
    lines.select("line").write.mode(mode).text(path)


def wide_table(long: DataFrame, row: str, column: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells as a table with a column for each column key; the first value of a cell counts."""
    pivot = long.groupBy(row).pivot(column, list(columns)) if columns else long.groupBy(row).pivot(column)
    return pivot.agg(F.first(value))


def write_lexicon(lex: DataFrame, path: str, **options) -> None:
    write_dsv(lex.select("idx", "term", "df", "tf"), path, "term", sort_rows="idx", columns=["df", "tf"], **options)


def write_matrix(matrix: DataFrame, folder: str, parts: int | None = None) -> None:
    """Sixteen bytes a cell, sorted by (i, j): range-partitioned (unless the cells come so), each task writes one file, names
    in the order of ranges. Tasks write through the session's Hadoop file system, as binary rows of Parquet: a blob a batch of cells."""
    spark = matrix.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = np.empty(batch.num_rows, TRIPLET)
            for k, name in enumerate(("i", "j", "x")):
                rec[name] = batch.column(k).to_numpy()
            yield pa.RecordBatch.from_pydict({"i": pa.array([int(rec["i"][0])], pa.int64()), "j": pa.array([int(rec["j"][0])], pa.int64()), "cells": [rec.tobytes()]})

    rows = matrix.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("x").cast("double"))
    if parts or not in_order(matrix):
        rows = rows.repartitionByRange(n, "i", "j").sortWithinPartitions("i", "j")
    rows.mapInArrow(run, "i long, j long, cells binary").write.mode("overwrite").parquet(folder)


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """i, j, x of write_matrix's files."""
    return _cells(spark.read.parquet(folder).select("cells"))


def read_matrix_file(spark: SparkSession, path: str) -> DataFrame:
    """i, j, x of a plain file of triplets."""
    return _cells(spark.read.format("binaryFile").load(path).select("content"))


def _cells(blobs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rec = np.frombuffer(blob, TRIPLET)
                yield pa.RecordBatch.from_pydict({"i": rec["i"].astype(np.int64), "j": rec["j"].astype(np.int64), "x": rec["x"].copy()})

    return blobs.mapInArrow(run, "i long, j long, x double")


def matrix_bytes(cells: Sequence[tuple[int, int, float]]) -> bytes:
    """A plain file's bytes, for a matrix that a caller holds."""
    return b"".join(struct.pack("<iid", *c) for c in sorted(cells))


class IndexWriter:
    """The segment index: Parquet by token field. update appends; wipe replaces what is there."""

    def __init__(self, folder: str, update: bool = False, wipe: bool = True, parts: int | None = None):
        if update and wipe:
            raise ValueError("an index is either updated or wiped")
        self.folder, self.mode, self.parts = folder, "overwrite" if wipe else "append" if update else "errorifexists", parts

    def write(self, segments: DataFrame, tokens: DataFrame) -> None:
        segments.write.mode(self.mode).parquet(posixpath.join(self.folder, "segments"))
        tokens.write.mode(self.mode).partitionBy("field").parquet(posixpath.join(self.folder, "tokens"))
        if self.parts:
            self.compact(segments.sparkSession, self.parts)

    def compact(self, spark: SparkSession, parts: int) -> None:
        """Rewrites the index into so many files a field. The new files are complete before the old ones are put aside,
        and these go only when the new ones are in place; `recover` mends what a stop in between has left."""
        self.recover(spark)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in ("segments", "tokens"):
            old, new = (posixpath.join(self.folder, x) for x in (name, f".{name}-new"))
            if name == "tokens":
                self._compact_fields(spark, old, new, parts)
            else:
                spark.read.parquet(old).coalesce(parts).write.mode("overwrite").parquet(new)
            fs = hadoop(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            aside = posixpath.join(self.folder, f".{name}-old")
            if not (fs.rename(hadoop(old), hadoop(aside)) and fs.rename(hadoop(new), hadoop(old))):
                raise RuntimeError(f"{old} couldn't be exchanged")
            fs.delete(hadoop(aside), True)

    def _compact_fields(self, spark: SparkSession, old: str, new: str, parts: int) -> None:
        """So many files a field, all fields at once; no task sorts its rows by field."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop(new))
        names = [s.getPath().getName() for s in fs.listStatus(hadoop(old)) if s.isDirectory() and s.getPath().getName().startswith("field=")]
        with ThreadPoolExecutor(max(1, min(8, len(names)))) as pool:
            write = lambda x: spark.read.parquet(posixpath.join(old, x)).repartition(parts, "doc_num").write.mode("overwrite").parquet(posixpath.join(new, x))
            list(pool.map(inheritable_thread_target(spark)(write), names))

    def recover(self, spark: SparkSession) -> None:
        """Puts back what compact() had put aside when it was stopped, or deletes it if the new files are in place."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in ("segments", "tokens"):
            old, new, aside = (hadoop(posixpath.join(self.folder, x)) for x in (name, f".{name}-new", f".{name}-old"))
            fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(aside):
                if fs.exists(old):
                    fs.delete(aside, True)
                else:
                    fs.rename(aside, old)
            fs.delete(new, True)


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """segments and tokens; of an index without a token, an empty table."""
    try:
        tokens = spark.read.parquet(posixpath.join(folder, "tokens"))
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        tokens = spark.createDataFrame([], TOKENS)
    return spark.read.parquet(posixpath.join(folder, "segments")), tokens


def write_documents(docs: DataFrame, annotations: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """The native form of annotated documents: two Parquet tables and their schemas as JSON."""
    for name, rows in (("docs", docs), ("annotations", annotations)):
        rows.write.mode(mode).parquet(posixpath.join(folder, name))
        rows.sparkSession.createDataFrame([(rows.schema.json(),)], "line string").coalesce(1).write.mode("overwrite").text(posixpath.join(folder, f"{name}.schema"))


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(posixpath.join(folder, x)) for x in ("docs", "annotations"))


def file_names(rows: DataFrame, name: str, pattern: str = "%c.%e", ext: str = "data", taken: DataFrame | None = None) -> DataFrame:
    """Adds `file`: the pattern with the row's name (%c) and the extension (%e). If `taken` (a table with file) is given,
    files aren't overwritten: names that recur or are taken get -1, -2, ... before the extension."""
    file = F.replace(F.replace(F.lit(pattern), F.lit("%c"), F.coalesce(F.col(name).cast("string"), F.lit("null"))), F.lit("%e"), F.lit(ext.lstrip(".")))
    rows = rows.withColumn("file", file)
    if taken is None:
        return rows
    stem = lambda c: F.regexp_extract(c, r"^(.*?)(-\d+)?(\.[^.]*)?$", 1)
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64(*rows.columns))) - 1)
    last = F.coalesce(F.regexp_extract("file", r"-(\d+)(\.[^.]*)?$", 1).try_cast("int"), F.lit(0))
    used = taken.select(F.concat(stem(F.col("file")), F.regexp_extract("file", r"(\.[^.]*)?$", 1)).alias("file"), last.alias("_k")).groupBy("file").agg((F.max("_k") + 1).alias("_k"))
    own = own.join(used, "file", "left").withColumn("_n", F.col("_n") + F.coalesce("_k", F.lit(0)))
    fresh = F.concat(F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1), F.lit("-"), F.col("_n").cast("string"), F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 2))
    return own.withColumn("file", F.when(F.col("_n") > 0, fresh).otherwise(F.col("file"))).select(*rows.columns)


def write_files(rows: DataFrame, folder: str, name: str, content: str, pattern: str = "%c.%e", ext: str = "data", overwrite: bool = True) -> DataFrame:
    """A file for each row, written by the tasks through the folder's own file system; returns file and length of each.
    A file appears under its name once it is complete. Rows of one name: the last written stays, or, without
    overwriting, each has its number."""
    from corpusmill.sources.files import list_files

    spark = rows.sparkSession
    taken = None
    if not overwrite:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        taken = list_files(spark, folder).select(F.col("name").alias("file")) if there else spark.createDataFrame([], "file string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        from urllib.parse import urlparse

        import pyarrow.fs as pafs

        local = urlparse(folder).scheme in ("", "file")
        fs, base = (pafs.LocalFileSystem(), urlparse(folder).path) if local else pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                temp = posixpath.join(base, f".{uuid.uuid4().hex}")
                with fs.open_output_stream(temp) as out:
                    out.write(data)
                fs.move(temp, posixpath.join(base, file))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "length"])

    named = file_names(rows, name, pattern, ext, taken).select("file", F.col(content).cast("string").cast("binary").alias("data"))
    from corpusmill.sources.scratch import stored

    return stored(named.mapInArrow(run, "file string, length long"), "files")  # each file is written once


def clear_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> int:
    """Deletes the files of a folder that a glob names; returns how many."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, glob)) or [] if s.isFile()]
    if recursive:
        below = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
        return sum(fs.delete(p, False) for p in found) + sum(clear_files(spark, p.toString(), glob, True) for p in below)
    return sum(fs.delete(p, False) for p in found)


def write_xml(rows: DataFrame, folder: str, row_tag: str = "document", root_tag: str = "documents") -> None:
    rows.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(folder)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).load(path)
