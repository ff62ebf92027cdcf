"""Folders for what a job writes and reads again, where all executors see them."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"corpusmill-{tag}-{uuid.uuid4().hex}")


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """Rows as a table that several jobs read, instead of computing them each."""
    path = folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
