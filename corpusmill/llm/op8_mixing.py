"""Mixing sources to target weights by distributed prefix sums.

Every document gets a random key that is a hash of its doc_id (and of a seed), so reruns agree. Within a source the
documents are range-partitioned by the key's first 16 bits and sorted by the whole key inside a range; prefix sums of
the ranges' sizes (65,536 at most for a source, whatever its documents) and of the documents inside a range give each
document's place in its source. The budget takes whole epochs of the source and then the documents before the cut;
the document at the cut is taken in part, so the words taken are the target itself, rounded down.

Cases: a null or blank text has size 0 and nothing is taken from it; null is a source of its own, after all others;
equal rows are mixed each; rows with one doc_id are ordered by size; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source is repeated so often at most.
MAX_EPOCHS = 3


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, key."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _key(seed).alias("_key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source.

    The shares are the weights times one level, held at max_epochs times the source's size; with the sources in the
    order in which they reach that, the level is the highest of those that each prefix of held sources would leave.
    The windows over all sources run on one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", w).withColumn("_cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("_level", (F.sum("source_size").over(everything) - held) / free)
    by = by.withColumn("_level", F.max("_level").over(everything))
    return by.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def mix_sizes(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """rows (doc_id, source, size, _key and more) with source_size, target and taken."""
    by = targets(rows, weights, max_epochs)
    rows = rows.withColumn("_range", F.substring("_key", 1, 4))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    # prefix sums in two steps of 256: over the beginnings of ranges, and over the ranges of one beginning
    upto = lambda by, order: F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_top", F.substring("_range", 1, 2))
    tops = sums.groupBy("source", "_top").agg(F.sum("_sum").alias("_sum")).select("source", "_top", upto(["source"], "_top").alias("_above"))
    inner = sums.select("source", "_range", "_top", upto(["source", "_top"], "_range").alias("_within"))
    sums = inner.alias("i").join(tops.alias("t"), F.col("i.source").eqNullSafe(F.col("t.source")) & (F.col("i._top") == F.col("t._top")))
    sums = sums.select("i.source", "_range", (F.col("_above") + F.col("_within")).alias("_before"))
    # each range's prefix with its source's budget: at most 65,536 rows a source
    sums = sums.alias("s").join(by.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.*", "b.source_size", "b.target")
    own = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = placed.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._range") == F.col("s._range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_own") - F.col("_before")))
    kept = [F.col(f"r.{c}") for c in rows.columns if not c.startswith("_")]
    return joined.select(*kept, "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with docs' columns: a row for each time that a document is taken; the one at the cut has as many
    of its first words as are taken, and its n_chars, if there is one, counts them anew."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("doc")
    rows = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"), whole)
    sizes = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "source", sizes.alias("size"), _key("mix").alias("_key"), "doc")
    taken = mix_sizes(rows, weights, max_epochs).where("taken > 0")
    each = taken.select("doc", F.col("size"), "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))).alias("_epoch"))
    left = each.select("doc", "size", F.least(F.col("size"), F.col("taken") - F.col("_epoch") * F.col("size")).alias("_n"))
    words = F.regexp_extract_all(F.col("doc.text").cast("string"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("_n") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_n").cast("int")), ""))
    left = left.select("doc", "size", "_n", text.alias("_text"))
    own = {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("_n") == F.col("size"), F.col("doc.n_chars")).otherwise(F.length("_text").cast(kind)).alias("n_chars")
    return left.select(*(own.get(c, F.col("doc")[c].alias(c)) for c in docs.columns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.written(sized(common.documents(spark, sf_dir)), "sized")
    return mix_sizes(rows).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)
      - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT max(level) FROM l) * w) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
