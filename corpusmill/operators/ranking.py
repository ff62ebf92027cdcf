"""Ranks and row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, count: str = "tf", term: str = "term", name: str = "idx") -> DataFrame:
    """Adds the place of each row by count (descending) and term (ascending, by bytes), from 0."""
    return range_ranked(rows, [F.desc(count), F.asc(term)], name).select(name, *rows.columns)


def range_ranked(rows: DataFrame, by: list, name: str) -> DataFrame:
    """Adds the place of each row in the order `by`, from 0, whatever the rows have in common: ranges of the order are
    sorted each by itself and stored, and what stands before a range is a sum over the ranges."""
    from corpusmill.sources.scratch import stored

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = stored(placed.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a range
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(sizes), "_part").select(*rows.columns, (F.col("_before") + low).cast("long").alias(name))


def row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Adds a number from 0 to n - 1, in no given order."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    marked = marked.withColumn("_part", F.shiftright("_id", 33)).persist()
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + low).drop("_id", "_part", "_before")
