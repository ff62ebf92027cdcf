"""Lists, maps, windows, ids and samples.

Divergences: zipping needs as many keys as values; the closest item needs no order of the list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls(n: int, kind: str = "string") -> Column:
    return F.array_repeat(F.lit(None).cast(kind), n)


def zip_map(keys: Column, values: Column) -> Column:
    """A map of two lists of one length; null if they differ."""
    return F.when(F.size(keys) == F.size(values), F.map_from_arrays(keys, values))


def label_map(items: Column) -> Column:
    """Each item under its text."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x.cast("string"), x)))


def cast_all(items: Column, kind: str) -> Column:
    return F.transform(items, lambda x: x.cast(kind))


def sorted_index(items: Column) -> Column:
    """Each distinct item with its rank from 0."""
    own = F.array_sort(F.array_distinct(items))
    return F.map_from_entries(F.transform(own, lambda x, i: F.struct(x, i)))


def closest(items: Column, at: Column) -> Column:
    """The item nearest to `at`, the smaller of two."""
    best = F.array_min(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x - at).alias("d"), x.alias("x"))))
    return best["x"]


def window_of(items: Column, width: int, at: Column, fill: bool = True) -> Column:
    """2 width + 1 items around place `at` (from 0) of a list, padded with nulls or, without fill, cut at its ends."""
    if fill:
        return F.transform(F.sequence(at - width, at + width), lambda i: F.when(i >= 0, F.get(items, i)))
    start = F.greatest(at - width, F.lit(0))
    return F.slice(items, start + 1, F.greatest(F.least(at + width + 1, F.size(items)) - start, F.lit(0)))


def neighbours(rows: DataFrame, by: list[str], order: list, column: str, context: int = 20) -> DataFrame:
    """Adds prev, next, and the items before and after it within the context."""
    w = Window.partitionBy(*by).orderBy(*order)
    around = lambda a, b: F.collect_list(column).over(w.rowsBetween(a, b))
    return rows.select("*", F.lag(column).over(w).alias("prev"), F.lead(column).over(w).alias("next"), around(-context, -1).alias("before"), around(1, context).alias("after"))


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "id") -> DataFrame:
    """Sequential ids from 0 within each group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def random_rows(rows: DataFrame, n: int, seed: int, replace: bool = False) -> DataFrame:
    """n rows at random, the same ones for a seed; raises if there are fewer. With replacement a row may recur."""
    total = rows.count()
    if n > total and not replace:
        raise ValueError(f"{n} of {total} rows are asked for")
    if not replace:
        return rows.orderBy(F.rand(seed)).limit(n)
    # draws are uniform numbers of rows; the numbers come from the rows' order, range by range
    from corpusmill.operators.ranking import row_numbers

    draws = rows.sparkSession.range(n).select(F.floor(F.rand(seed) * total).cast("long").alias("_n"))
    return row_numbers(rows, "_n").join(draws, "_n").drop("_n")


def unique_names(names: Iterable[str]) -> list[str]:
    """Names in order, a repeated one with the number of its recurrence."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        k = seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}{k - 1}" if k else name)
    return out


def is_array(rows: DataFrame, name: str) -> bool:
    """Whether a column holds lists."""
    from pyspark.sql.types import ArrayType

    return isinstance(rows.schema[name].dataType, ArrayType)


#: What the elements of a typed list are called, and Spark's name of it.
ELEMENTS = {"BOOLEAN": "boolean", "BYTE": "tinyint", "SHORT": "smallint", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "STRING": "string"}


def array_of(kind: str, items: Column) -> Column:
    """A list with elements of one type; what can't be one is null."""
    return F.transform(items, lambda x: x.try_cast(ELEMENTS[kind]))
