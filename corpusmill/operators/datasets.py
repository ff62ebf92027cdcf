"""Distributional datasets over a lexicon: frequencies by split, part-of-speech counts, co-occurrences.

Rows are lexicon terms by idx; a sample restricts the tokens counted, never the lexicon. Divergences: tags of no class
count as O; without any pair the co-occurrence matrix is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import posclass
from corpusmill.operators import cells
from corpusmill.operators.lexicon import BROADCAST_ROWS, with_idx
from corpusmill.operators.samples import restrict
from corpusmill.operators.tokens import from_lists


def frequencies(tokens: DataFrame, lex: DataFrame, split: str | None = None, sample: DataFrame | None = None) -> DataFrame:
    """idx, split, n (or idx, n). Tokens are counted by term before they meet the lexicon."""
    by = ["term", F.col(split).alias("split")] if split else ["term"]
    counts = restrict(tokens, sample).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return with_idx(counts, lex).select("idx", *(["split"] if split else []), "n")


#: Columns of a table at most; a dense table has a cell for each term and column.
MAX_COLUMNS = 10_000


def column_values(rows: DataFrame, name: str) -> list[str]:
    """The distinct values of a column in byte order, which become a table's columns; too many are an error."""
    found = [r[0] for r in rows.where(F.col(name).isNotNull()).select(name).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{name} has more than {MAX_COLUMNS} values")
    return sorted(found, key=lambda x: x.encode() if isinstance(x, str) else x)


def dense(long: DataFrame, lex: DataFrame, columns: DataFrame, name: str = "split") -> DataFrame:
    """A row for each lexicon term and column value, 0 where nothing was counted. columns: rows with the values of `name`."""
    grid = lex.select("idx", F.explode(F.array(*map(F.lit, column_values(columns, name)))).alias(name))
    return grid.join(long, ["idx", name], "left").select("idx", name, F.coalesce("n", F.lit(0)).alias("n"))


def wide(long: DataFrame, lex: DataFrame, values: list[str], name: str = "split") -> DataFrame:
    """A row for each lexicon term, a column for each value, 0 where nothing was counted."""
    table = long.groupBy("idx").pivot(name, values).agg(F.sum("n"))
    rows = lex.select("idx", "term").join(table, "idx", "left")
    return rows.select("idx", "term", *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values))


def pos_counts(tokens: DataFrame, lex: DataFrame, tag: str = "payload", sample: DataFrame | None = None) -> DataFrame:
    """idx, pos_class, n."""
    counts = restrict(tokens, sample).groupBy("term", posclass.class_of(F.col(tag)).alias("pos_class")).agg(F.count(F.lit(1)).alias("n"))
    return with_idx(counts, lex).select("idx", "pos_class", "n")


#: The lcm of 1..WHOLE, and sums of it, fit into 64 bits.
WHOLE = 22


def _by_distance(pairs: DataFrame, away: Column, before: int, after: int) -> DataFrame:
    """Cells of wide windows: pairs are counted for each distance, and a cell's sum is taken over its distances in
    order, so it doesn't depend on the order of rows. There is no s."""
    both = F.array(
        F.when(away <= after, F.struct(F.col("a").alias("i"), F.col("idx").alias("j"))),
        F.when(away <= before, F.struct(F.col("idx").alias("i"), F.col("a").alias("j"))),
    )
    each = pairs.select(away.alias("d"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("c")).groupBy("c.i", "c.j", "d").agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("_x"))  # a window's distances
    x = F.aggregate("_x", F.lit(0.0), lambda t, e: t + e["n"] / e["d"])
    return found.select("i", "j", F.lit(None).cast("long").alias("s"), x.alias("x"))


def cooccurrence(source: DataFrame, lex: DataFrame, before: int = 10, after: int = 10, sample: DataFrame | None = None, stacked: bool = False, ordered: bool = False) -> DataFrame:
    """i, j, s, x: for each place p that holds term i and each place q != p of its document that holds j, from
    p - before to p + after, 1 / |p - q| is added to x. s is x times lcm(1..width), so sums are exact. source: word lists
    or tokens.

    A document's tokens meet where they are (word lists) or by one window over (document, position); pairs are summed in
    each task, and sums once more by ranges of terms; ordered: the cells come in the order of (i, j). Terms that share a position (stacked)
    count as the greatest of them. In windows wider than WHOLE, s is null and x is a sum in a fixed order.
    """
    width = max(before, after)
    if not width:
        return source.sparkSession.createDataFrame([], cells.CELLS)
    n_terms = lex.count()
    if not cells.fits(n_terms, width):
        return _by_window(from_lists(source) if "terms" in source.columns else source, lex, before, after, sample, stacked)
    source = restrict(source, sample).where("doc_num is not null")
    in_rows = "terms" in source.columns and n_terms <= BROADCAST_ROWS and source.groupBy("doc_num").count().where("count > 1").isEmpty()
    if in_rows:  # a row's tokens stay side by side in a broadcast join
        rows = source.select(F.xxhash64("doc_num").alias("doc"), F.posexplode("terms").alias("pos", "term"))
        rows = with_idx(rows, F.broadcast(lex)).select("doc", "pos", "idx")
    else:
        rows = with_idx((from_lists(source) if "terms" in source.columns else source).select("doc_num", "pos", "term"), lex)
        w = Window.partitionBy("doc_num").orderBy("pos", "term")  # its rows come in this order
        rows = rows.withColumn("_next", F.lead("pos").over(w))
        rows = rows.where("_next is null or _next > pos" if stacked else "_next is null or _next >= pos")
        rows = rows.select(F.xxhash64("doc_num").alias("doc"), "pos", "idx")
    return cells.matrix(rows, lex, before, after, math.lcm(*range(1, width + 1)) if width <= WHOLE else None, ordered)


def _by_window(tokens: DataFrame, lex: DataFrame, before: int, after: int, sample: DataFrame | None, stacked: bool) -> DataFrame:
    """Cells of a lexicon so large, or a window so wide, that a pair doesn't fit into a number: tokens of a document meet by
    one window over (document, position); pairs are summed under the unordered pair of terms, both directions at once."""
    width = max(before, after)
    whole = width <= WHOLE
    scale = math.lcm(*range(1, width + 1)) if width and whole else 1
    rows = with_idx(restrict(tokens, sample).select("doc_num", "pos", "term"), lex)
    if stacked:
        rows = rows.groupBy("doc_num", "pos").agg(F.max_by("idx", "term").alias("idx"))
    if not width:
        return rows.sparkSession.createDataFrame([], "i long, j long, s long, x double")
    w = Window.partitionBy("doc_num").orderBy("pos")
    following = F.array(*(F.struct(F.lead("pos", k).over(w).alias("pos"), F.lead("idx", k).over(w).alias("idx")) for k in range(1, width + 1)))
    rows = rows.select(F.col("pos").alias("p"), F.col("idx").alias("a"), following.alias("_next"))
    pairs = rows.select("p", "a", F.inline("_next")).where(F.col("pos") - F.col("p") <= width)
    away = F.col("pos") - F.col("p")
    if not whole:
        return _by_distance(pairs, away, before, after)
    weight = F.element_at(F.array(*(F.lit(scale // d) for d in range(1, width + 1))), away)
    onward = weight if after == width else F.when(away <= after, weight).otherwise(0)
    back = weight if before == width else F.when(away <= before, weight).otherwise(0)
    straight = F.col("a") <= F.col("idx")
    pairs = pairs.select(F.least("a", "idx").alias("lo"), F.greatest("a", "idx").alias("hi"), F.when(straight, onward).otherwise(back).cast("long").alias("s1"), F.when(straight, back).otherwise(onward).cast("long").alias("s2"))
    sums = pairs.groupBy("lo", "hi").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    cell = lambda i, j, s: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), s.alias("s"))
    one = F.array(cell("lo", "hi", F.col("s1") + F.col("s2")))
    two = F.array(cell("lo", "hi", F.col("s1")), cell("hi", "lo", F.col("s2")))
    found = sums.select(F.inline(F.when(F.col("lo") == F.col("hi"), one).otherwise(two))).where("s > 0")
    return found.select("i", "j", "s", (F.col("s") / F.lit(float(scale))).alias("x"))
