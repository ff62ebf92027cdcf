"""Indexing what arrives, by Structured Streaming's file source; and counts that are merged as they come."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.tokens import word_tokens


def append_tokens(spark: SparkSession, source: str, schema: str, index: str, doc: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), max_files: int = 1000):
    """Reads the Parquet files of a folder that are new since the last call and appends their tokens to the index. Each
    file counts once, also after a failure; returns the query, which ends when nothing is left."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    tokens = word_tokens(new, doc, text_col, keep).withColumn("field", F.lit("word"))
    out = tokens.writeStream.format("parquet").partitionBy("field").option("path", posixpath.join(index, "tokens"))
    return out.option("checkpointLocation", posixpath.join(index, "progress")).trigger(availableNow=True).outputMode("append").start()


def running_counts(spark: SparkSession, source: str, schema: str, target: str, text_col: str = "text"):
    """Term frequencies over all that has arrived: each batch's counts are a part of the table `target`, written over if
    the batch runs again; read_counts adds the parts up. No state grows with the vocabulary."""

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = word_tokens(batch.withColumn("_d", F.lit(0)), "_d", text_col).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
        counts.write.mode("overwrite").parquet(posixpath.join(target, f"batch={batch_id}"))

    new = spark.readStream.schema(schema).parquet(source)
    return new.writeStream.foreachBatch(add).option("checkpointLocation", target.rstrip("/") + "-progress").trigger(availableNow=True).start()


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("term").agg(F.sum("tf").alias("tf"))


def read_tokens(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(index, "tokens"))
