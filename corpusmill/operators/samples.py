"""Samples of documents: tables of one column, doc_num, and their algebra.

Divergences: an unknown field raises; the complement is what its name says; without a filter the sample is everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.termset import TermSet, whole


def _checked(rows: DataFrame, field: str) -> None:
    if field not in rows.columns:
        raise ValueError(f"no field {field!r}; there are {rows.columns}")


def by_expr(rows: DataFrame, condition: Column, doc: str = "doc_num") -> DataFrame:
    """Documents with a row for which the condition holds."""
    return rows.where(condition).select(F.col(doc).alias("doc_num")).distinct()


def by_terms(rows: DataFrame, field: str, terms: Sequence[str], doc: str = "doc_num") -> DataFrame:
    _checked(rows, field)
    return by_expr(rows, F.col(field).isin(list(terms)) if terms else F.lit(False), doc)


def by_regex(rows: DataFrame, field: str, pattern: str, doc: str = "doc_num") -> DataFrame:
    """Documents whose field matches the pattern as a whole."""
    _checked(rows, field)
    return by_expr(rows, F.col(field).rlike(whole(pattern)), doc)


def by_set(rows: DataFrame, field: str, terms: TermSet, doc: str = "doc_num") -> DataFrame:
    _checked(rows, field)
    return by_expr(rows, terms.test(F.col(field)), doc)


def everything(docs: DataFrame, doc: str = "doc_num") -> DataFrame:
    return docs.select(F.col(doc).alias("doc_num")).distinct()


def complement(universe: DataFrame, sample: DataFrame) -> DataFrame:
    return universe.join(sample, "doc_num", "left_anti")


def union(*samples: DataFrame) -> DataFrame:
    out = samples[0]
    for s in samples[1:]:
        out = out.union(s)
    return out.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def add(sample: DataFrame, *doc_nums: int) -> DataFrame:
    return union(sample, sample.sparkSession.createDataFrame([(d,) for d in doc_nums], sample.schema)) if doc_nums else sample


def remove(sample: DataFrame, *doc_nums: int) -> DataFrame:
    return sample.where(~F.col("doc_num").isin(list(doc_nums))) if doc_nums else sample


def restrict(tokens: DataFrame, sample: DataFrame | None) -> DataFrame:
    """The tokens of a sample's documents; all if there is none."""
    return tokens if sample is None else tokens.join(sample, "doc_num", "left_semi")


def size(sample: DataFrame) -> DataFrame:
    return sample.agg(F.count(F.lit(1)).alias("n"))


def vector(sample: DataFrame) -> DataFrame:
    """The sample in ascending order."""
    return sample.orderBy("doc_num")


def doc_map(docs: DataFrame, field: str, doc: str = "doc_id") -> DataFrame:
    """doc_num, value, key: a field's value for every document, and its number among the values."""
    _checked(docs, field)
    rows = docs.select(F.col(doc).alias("doc_num"), F.col(field).alias("value"))
    return rows.join(dictionary(docs, field), "value")


def dictionary(docs: DataFrame, field: str) -> DataFrame:
    """value, key: the distinct values of a field in byte order, numbered from 0."""
    _checked(docs, field)
    from corpusmill.operators.ranking import range_ranked

    values = docs.where(F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()
    return range_ranked(values, ["value"], "key")
