"""Token streams: from texts, and from annotations by a tokenizer.

A token is (doc_num, pos, term) and may have begin, end, payload and type. Tokens with an empty term are dropped
before positions are given; tokens outside a lexicon keep their place.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import posclass, text
from corpusmill.sources.files import dealt


def word_lists(docs: DataFrame, doc: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_num, terms (a list in text order), and the columns to keep."""
    return docs.select(F.col(doc).alias("doc_num"), text.words(F.col(text_col)).alias("terms"), *keep)


def from_lists(lists: DataFrame) -> DataFrame:
    """A row for each token: doc_num, pos, term and the kept columns."""
    rest = [c for c in lists.columns if c != "terms"]
    rows = lists.select(*rest, F.posexplode("terms").alias("pos", "term"))
    rows._lists = lists  # where all of these tokens, and nothing else, can be counted
    return rows


def word_tokens(docs: DataFrame, doc: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return from_lists(word_lists(docs, doc, text_col, keep))


def word_spans(docs: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_num, pos, term, surface, begin, end: words with their offsets in characters. Texts are dealt by document, so what
    comes after needs no shuffle of words for that."""
    docs = dealt(docs.select(doc, text_col), doc)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(doc).alias("doc_num"), F.arrays_zip(F.transform(F.split(t, text.WORD), F.length).alias("gap"), F.regexp_extract_all(t, F.lit(text.WORD), F.lit(0)).alias("word")).alias("x"))
    rows = rows.select("doc_num", F.posexplode("x").alias("pos", "x")).select("doc_num", "pos", "x.gap", "x.word").where("word is not null")
    w = Window.partitionBy("doc_num").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("word")).over(w).cast("int")
    rows = rows.withColumn("end", end)
    return rows.select("doc_num", "pos", F.lower("word").alias("term"), F.col("word").alias("surface"), (F.col("end") - F.length("word")).alias("begin"), "end")


def with_positions(rows: DataFrame, by: str | list[str] = "doc_num") -> DataFrame:
    """Adds pos: spans by begin, enclosing ones first; a span that ends before the largest end so far shares the
    position of the one before it."""
    w = Window.partitionBy(by).orderBy(F.asc("begin"), F.desc("end"), F.asc("term"))
    largest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_step", F.when(F.col("end") < largest, 0).otherwise(1))
    pos = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("pos", pos.cast("int")).drop("_step")


class Tokenizer(Protocol):
    """Columns of a token over the columns of an annotation (text, lemma, tag, id, type)."""

    def term(self) -> Column: ...

    def payload(self) -> Column: ...

    def accepts(self) -> Column: ...


@dataclass(frozen=True)
class WordTokenizer:
    """Tagged words: text or lemma in lower case, after their class if wanted; the payload is the tag."""

    lemmatize: bool = False
    add_class: bool = False
    excluded: tuple[str, ...] = ()

    def term(self) -> Column:
        group = posclass.class_of(F.col("tag")) if self.add_class else None
        return text.token_term(F.col("text"), F.col("lemma") if self.lemmatize else None, group)

    def payload(self) -> Column:
        return F.col("tag")

    def accepts(self) -> Column:
        return ~posclass.class_of(F.col("tag")).isin(list(self.excluded)) if self.excluded else F.lit(True)


@dataclass(frozen=True)
class SpanTokenizer:
    """Entities: the term is the span's id, the payload its type's short name."""

    def term(self) -> Column:
        return F.col("id")

    def payload(self) -> Column:
        return F.substring_index("type", ".", -1)

    def accepts(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class TextTokenizer:
    """Any annotation: its text as it stands, and its type."""

    def term(self) -> Column:
        return F.col("text")

    def payload(self) -> Column:
        return F.col("type")

    def accepts(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class MergedTokenizer:
    """The first tokenizer for words, the second for spans with an id, and the text for the rest."""

    words: WordTokenizer = field(default_factory=WordTokenizer)
    spans: SpanTokenizer = field(default_factory=SpanTokenizer)
    rest: TextTokenizer = field(default_factory=TextTokenizer)
    word_type: str = "Token"

    def _either(self, name: str) -> Column:
        is_word = F.col("type") == self.word_type
        parts = [getattr(t, name)() for t in (self.words, self.spans, self.rest)]
        return F.when(is_word, parts[0]).when(F.col("id").isNotNull(), parts[1]).otherwise(parts[2])

    def term(self) -> Column:
        return self._either("term")

    def payload(self) -> Column:
        return self._either("payload")

    def accepts(self) -> Column:
        return self._either("accepts")


@dataclass(frozen=True)
class TokenSpec:
    """A token field of the index: its name, the annotations it is made of, and how."""

    name: str
    type: str
    tokenizer: Tokenizer


def stream(annotations: DataFrame, spec: TokenSpec, by: str = "doc_num", base: str | None = None, within: str | None = None) -> DataFrame:
    """The tokens of one field: by, field, pos, term, begin, end, payload, type. Offsets are counted from column base. within: a
    column that `by` decides; rows that are dealt by it already stay where they are."""
    rows = annotations.where(F.array_contains("type_path", spec.type)).where(spec.tokenizer.accepts())
    start = F.col(base) if base else F.lit(0)
    rows = rows.select(*([within] if within else []), by, F.lit(spec.name).alias("field"), spec.tokenizer.term().alias("term"), (F.col("begin") - start).alias("begin"), (F.col("end") - start).alias("end"), spec.tokenizer.payload().alias("payload"), "type")
    rows = rows.where("term <> ''")
    return with_positions(rows, [within, by]).drop(within) if within else with_positions(rows, by)
