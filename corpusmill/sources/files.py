"""Files as tables: listings, limits and samples on scans, delta overlays.

Divergence: the glob selects files and doesn't keep a recursion from entering folders.
"""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False, suffix: str | None = None) -> DataFrame:
    """path, name, length, modified of a folder's files, by path; suffix: only names that end so, in any case."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder).select("path", F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    return (rows.where(F.lower("name").endswith(suffix.lower())) if suffix else rows).orderBy("path")


#: Inputs of so many bytes at most are dealt anew.
SPREAD_BYTES = 256 << 20


def spread(rows: DataFrame, threads: int = 0) -> DataFrame:
    """Rows of a small input over all cores. A small file is often one row group, which one task reads alone; large
    inputs have row groups enough and stay where they are."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(2 * (threads or rows.sparkSession.sparkContext.defaultParallelism)) if size <= SPREAD_BYTES else rows


#: Bytes of a part of texts that are dealt by document, about: words take many times as much as their text.
DEALT_BYTES = 4 << 20


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Texts dealt by document, into parts that stay as small as they are, whatever comes of them."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 45  # of rows that aren't read from files it isn't
    return rows.repartition(max(n, size // DEALT_BYTES if known else 0), by)


def read_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False, stop_after: int = 0, sample: int = 0, seed: int = 0) -> DataFrame:
    """path and content of files: all, the first stop_after by path, or a random sample. Only the listing is counted
    and sorted; contents are read for the chosen files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if not (stop_after or sample):
        return files.select("path", "content")
    listing = files.select("path")
    if stop_after:
        if stop_after > listing.count():
            raise ValueError(f"there are fewer than {stop_after} files")
        chosen = listing.orderBy("path").limit(stop_after)
    else:
        chosen = listing.orderBy(F.rand(seed)).limit(sample)
    return files.select("path", "content").join(chosen, "path", "left_semi")


def with_deltas(base: DataFrame, deltas: DataFrame, key: str = "doc_id", order: str = "delta_no") -> DataFrame:
    """The rows of base, each as its last delta leaves it. Deltas count from 0 up to the first number missing; deltas of
    unknown documents are left out."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    usable = deltas.withColumn("_n", n).where(F.col("_n") == F.col(order)).drop("_n").join(base.select(key), key, "left_semi")
    both = base.withColumn(order, F.lit(-1)).unionByName(usable, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", order)


def delta_path(path: str, i: int, pattern: str = "../%i/%c.%e") -> str:
    """Where the i-th delta of a file is: %i the number, %c the name, %e the extension."""
    folder, name = posixpath.split(path)
    stem, _, ext = name.rpartition(".")
    stem, ext = (stem, ext) if stem else (ext, "")
    return posixpath.normpath(posixpath.join(folder, pattern.replace("%i", str(i)).replace("%c", stem).replace("%e", ext)))


def read_deltas(spark: SparkSession, base: DataFrame, folder: str, pattern: str = "../%i/%c.%e", path: str = "path", content: str = "content") -> DataFrame:
    """delta_no, path (of the file it belongs to) and content of the delta files that the pattern names for the files in
    `folder`. The folders it can name are listed once, whatever the number of files."""
    place = urlparse(folder)
    top = posixpath.normpath(posixpath.join(place.path, pattern[: pattern.index("%")].rpartition("/")[0] or "."))
    top = place._replace(path=top).geturl() if place.scheme else top
    names = {"%i": r"(?<i>\d+)", "%c": r"(?<c>[^/]*)", "%e": r"(?<e>[^./]*)"}
    steps = [s for s in re.split(r"(%[ice])", pattern[len(pattern[: pattern.index("%")].rpartition("/")[0]) :].lstrip("/"))]
    tail = "/" + "".join(names.get(s, re.escape(s)) for s in steps) + "$"
    order = [s[1] for s in steps if s in names]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top).select(F.col("path").alias("_p"), F.col("content").alias(content))
    part = lambda k: F.regexp_extract("_p", tail, order.index(k) + 1) if k in order else F.lit("")
    found = files.where(F.col("_p").rlike(tail)).select(part("i").cast("int").alias("delta_no"), part("c").alias("_c"), part("e").alias("_e"), content)
    name = F.substring_index(path, "/", -1)
    own = base.select(path, F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("_c"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("_e"))
    return own.join(found, ["_c", "_e"] if "e" in order else ["_c"]).select("delta_no", path, content)


def fields(df: DataFrame) -> list[str]:
    return df.columns


def terms(df: DataFrame, field: str) -> DataFrame:
    """A field's distinct values in order."""
    if field is None or field not in df.columns:
        raise ValueError(f"no field {field!r}")
    return df.where(F.col(field).isNotNull()).select(field).distinct().orderBy(field)
