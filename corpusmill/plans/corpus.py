"""The façade: one corpus, its lexicon, samples and datasets, and their files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.operators import datasets, lexicon, samples
from corpusmill.operators.tokens import from_lists, word_lists
from corpusmill.sources import sinks
from corpusmill.sources.files import spread


class Corpus:
    """docs: a row for each document; tokens: an index's tokens (doc_num, pos, term), or None to take the words of the
    text. Of an index with several token fields, the settings' field_txt is taken, which must be there; terms may share
    a position. What is asked for is lazy; the lexicon is kept, as all datasets join it. A changed setting is a new
    corpus."""

    def __init__(self, docs: DataFrame, tokens: DataFrame | None = None, settings: Settings = Settings(), text_col: str = "text", doc: str | None = None):
        doc = doc or settings.doc_id
        self.docs, self.settings, self.doc, self.indexed = docs, settings, doc, tokens is not None
        if tokens is not None and "field" in tokens.columns:
            own = tokens.where(F.col("field") == settings.field_txt)
            if not own.isEmpty():
                tokens = own
            else:
                fields = sorted(r["field"] for r in tokens.select("field").distinct().limit(1000).collect())  # an index has few
                if len(fields) > 1:
                    raise ValueError(f"no field {settings.field_txt!r}; there are {fields}")
        split = settings.field_split if settings.field_split in docs.columns else None
        self.split = split
        if tokens is None:
            self.source = word_lists(spread(docs, settings.threads), doc, text_col, (split,) if split else ())
            self.tokens = from_lists(self.source)
        else:
            self.source = self.tokens = tokens
            if split:
                self.tokens = tokens.join(docs.select(F.col(doc).alias("doc_num"), split), "doc_num")
        self._lexicon: DataFrame | None = None

    @property
    def spark(self):
        return self.docs.sparkSession

    def lexicon(self) -> DataFrame:
        if self._lexicon is None:
            self._lexicon = lexicon.joinable(lexicon.lexicon(self.source, self.settings.min_term_freq))
        return self._lexicon

    def coverage(self) -> DataFrame:
        return lexicon.coverage(self.source, self.settings.min_term_freq)

    def sample(self, where: Column | None = None, terms: list[str] | None = None, regex: str | None = None, field: str | None = None) -> DataFrame:
        """Documents by a condition on their columns, or by terms or a regex on a field; the settings' filter if nothing
        is given, and everything if that is empty."""
        field = field or self.settings.field_filter
        if where is not None:
            return samples.by_expr(self.docs, where, self.doc)
        if terms is not None:
            return samples.by_terms(self.docs, field, terms, self.doc)
        pattern = regex if regex is not None else self.settings.filter_term
        return samples.by_regex(self.docs, field, pattern, self.doc) if pattern else samples.everything(self.docs, self.doc)

    def freq(self, split: bool = True, sample: DataFrame | None = None) -> DataFrame:
        return datasets.frequencies(self.tokens, self.lexicon(), self.split if split else None, sample)

    def posc(self, tag: str = "payload", sample: DataFrame | None = None) -> DataFrame:
        return datasets.pos_counts(self.tokens, self.lexicon(), tag, sample)

    def cooc(self, sample: DataFrame | None = None, before: int | None = None, after: int | None = None, ordered: bool = False) -> DataFrame:
        s = self.settings
        return datasets.cooccurrence(self.tokens if self.indexed else self.source, self.lexicon(), s.cooc_w_pre if before is None else before, s.cooc_w_pos if after is None else after, sample, self.indexed, ordered)

    def splits(self) -> list[str]:
        """The split's values in order: the columns of the frequency table."""
        return datasets.column_values(self.docs, self.split) if self.split else []

    def dump(self, folder: str | None = None, sample: DataFrame | None = None) -> None:
        """Writes lexicon, frequencies, part-of-speech counts (if tokens have a payload) and co-occurrences."""
        s = self.settings
        folder = folder or s.folder("tables_dir")
        at = lambda name: os.path.join(folder, name)
        lex = self.lexicon()
        sinks.write_lexicon(lex, at(s.lxcn_file), row_head=s.term_id)
        splits = self.splits()
        if splits:
            table = datasets.wide(self.freq(sample=sample), lex, splits)
        else:
            table = lex.select("idx", "term").join(self.freq(False, sample), "idx", "left").select("idx", "term", F.coalesce("n", F.lit(0)).alias("total"))
        sinks.write_dsv(table, at(s.freq_file), "term", sort_rows="idx", columns=splits or ["total"], row_head=s.term_id)
        if "payload" in self.tokens.columns:
            from corpusmill.functions.posclass import CLASSES

            table = datasets.wide(self.posc(sample=sample), lex, list(CLASSES), "pos_class")
            sinks.write_dsv(table, at(s.posc_file), "term", sort_rows="idx", columns=list(CLASSES), row_head=s.term_id)
        sinks.write_matrix(self.cooc(sample, ordered=True), at(s.cooc_file))
