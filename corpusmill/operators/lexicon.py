"""The ranked lexicon: idx, term, tf, df over a whole field, never over a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import ranked

#: A lexicon of so many rows at most is broadcast to its joins; beyond, they shuffle.
BROADCAST_ROWS = 2_000_000


def counts_of_lists(lists: DataFrame) -> DataFrame:
    """term, tf, df from word_lists(): a document's distinct terms are found in its row, so one shuffle of partial
    sums does, with a row for each term and task."""
    both = F.concat(
        F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
    )
    rows = lists.select(F.inline(both))
    return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def counts_of_tokens(tokens: DataFrame) -> DataFrame:
    """term, tf, df from any token stream."""
    by_doc = tokens.groupBy("term", "doc_num").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def _counts(source: DataFrame) -> DataFrame:
    """term, tf, df; a stream that was just made of word lists is counted by these, unless a document may have several."""
    lists = source if "terms" in source.columns else getattr(source, "_lists", None)
    if lists is source or lists is not None and lists.groupBy("doc_num").count().where("count > 1").isEmpty():
        return counts_of_lists(lists)
    return counts_of_tokens(source)


def lexicon(source: DataFrame, min_tf: int = 1) -> DataFrame:
    """idx, term, tf, df of the terms with at least min_tf occurrences; source: word lists or tokens."""
    counts = _counts(source)
    return ranked(counts.where(F.col("tf") >= min_tf))


def coverage(source: DataFrame, min_tf: int) -> DataFrame:
    """u_freq, n_freq (tokens in all, and of kept terms), cover, size; one row."""
    counts = _counts(source)
    kept = F.col("tf") >= min_tf
    sums = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("u_freq"), F.coalesce(F.sum(F.when(kept, F.col("tf"))), F.lit(0)).alias("n_freq"), F.count(F.when(kept, 1)).alias("size"))
    return sums.select("u_freq", "n_freq", (F.col("n_freq") / F.col("u_freq")).alias("cover"), "size")


def joinable(lex: DataFrame) -> DataFrame:
    """The lexicon kept for several joins, and broadcast if it is small."""
    lex = lex.persist()
    return F.broadcast(lex) if lex.count() <= BROADCAST_ROWS else lex


def with_idx(rows: DataFrame, lex: DataFrame) -> DataFrame:
    """Rows whose term is in the lexicon, with its idx."""
    return rows.join(lex.select("idx", "term"), "term")


def members(rows: DataFrame, lex: DataFrame) -> DataFrame:
    return rows.join(lex.select("term"), "term", "left_semi")


def postings(tokens: DataFrame, term: str, sample: DataFrame | None = None) -> DataFrame:
    """A word's tokens, in a sample or in the corpus."""
    found = tokens.where(F.col("term") == term)
    return found if sample is None else found.join(sample, "doc_num", "left_semi")


#: Terms that arrays() brings to the driver at most.
ARRAY_ROWS = 5_000_000


def arrays(lex: DataFrame) -> tuple:
    """term (a list), tf and df (numpy arrays) in the order of idx, for callers outside Spark; a lexicon that is too large
    for that is an error."""
    if lex.count() > ARRAY_ROWS:
        raise ValueError(f"more than {ARRAY_ROWS} terms")
    table = lex.orderBy("idx").select("term", "tf", "df").toArrow()
    return table.column("term").to_pylist(), table.column("tf").to_numpy(), table.column("df").to_numpy()
