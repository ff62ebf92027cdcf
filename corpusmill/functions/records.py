"""Records: a document's named values, each with its type, as columns of maps. The key of a value is its name and its
type; keys come in that order (name, then type)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ":"


def record(values: dict[str, Column], kinds: dict[str, str]) -> Column:
    """A record of columns; nulls are left out. kinds: each name's type."""
    pairs = F.array(*(F.struct(F.lit(f"{name}{SEPARATOR}{kinds[name]}").alias("k"), v.cast("string").alias("v")) for name, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def put(rec: Column, name: str, kind: str, value: Column) -> Column:
    """The record with a value set; a null value is an error."""
    key = F.lit(f"{name}{SEPARATOR}{kind}")
    sound = F.coalesce(value.cast("string"), F.raise_error(F.lit(f"{name} is null")).cast("string"))
    return F.map_concat(F.map_filter(rec, lambda k, v: k != key), F.create_map(key, sound))


def get(rec: Column, name: str, kind: str) -> Column:
    return F.element_at(rec, F.lit(f"{name}{SEPARATOR}{kind}"))


def has_field(rec: Column, name: str, kind: str) -> Column:
    return F.map_contains_key(rec, F.lit(f"{name}{SEPARATOR}{kind}"))


def fields(rec: Column) -> Column:
    """Names with types, by name and then type."""
    part = lambda k, i: F.element_at(F.split(k, SEPARATOR), i)
    order = F.array_sort(F.transform(F.map_keys(rec), lambda k: F.struct(part(k, 1).alias("name"), part(k, -1).alias("kind"), k.alias("key"))))
    return F.transform(order, lambda x: x["key"])


def field_names(rec: Column) -> Column:
    return F.array_distinct(F.transform(fields(rec), lambda k: F.element_at(F.split(k, SEPARATOR), 1)))


def data(rec: Column) -> Column:
    """Key and value of each field, in order."""
    return F.transform(fields(rec), lambda k: F.struct(k.alias("key"), F.element_at(rec, k).alias("value")))


def cleared(rec: Column) -> Column:
    return F.map_filter(rec, lambda k, v: F.lit(False))


def text_of(rec: Column) -> Column:
    """{'name:type' = 'value', ...} with a line for each field."""
    own = F.transform(data(rec), lambda x: F.concat(F.lit("'"), x["key"], F.lit("' = '"), x["value"], F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(own, ",\n"), F.lit("}"))


def same(a: Column, b: Column) -> Column:
    """Whether two records agree in all fields."""
    return data(a) == data(b)


def hash_of(rec: Column) -> Column:
    """Equal for equal records, whatever the order in which fields were set."""
    return F.xxhash64(text_of(rec))
