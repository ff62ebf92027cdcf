"""A job from its settings: a reader, annotators in order, and a consumer.

Parts are looked up by name; each takes what the one before it returns. Documents that a reader can't parse come back
as rejects; with on_error other than continue they end the job.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from corpusmill.config import Settings
from corpusmill.operators.indexing import index_segments
from corpusmill.operators.tokens import TokenSpec
from corpusmill.plans.progress import Progress
from corpusmill.sources import markup, sinks
from corpusmill.sources.files import read_deltas, read_files, with_deltas

Tables = tuple[DataFrame, DataFrame]


class Pipeline:
    def __init__(self, settings: Settings, specs: list[TokenSpec], mapping: markup.Mapping = markup.Mapping(), segment: str = "Paragraph", xpath: str | None = None):
        self.settings, self.specs, self.mapping, self.segment, self.xpath = settings, specs, mapping, segment, xpath
        self.readers: dict[str, Callable] = {"parquet": self._parquet, "xml": self._markup, "html": self._markup}
        self.annotators: dict[str, Callable[[DataFrame, DataFrame], Tables]] = {}
        self.consumers: dict[str, Callable[[DataFrame, DataFrame], None]] = {"index": self._index, "parquet": self._write, "write": self._write}
        self.rejects: DataFrame | None = None

    def _parquet(self, spark: SparkSession) -> Tables:
        return sinks.read_documents(spark, self.settings.folder("input_dir"))

    def _markup(self, spark: SparkSession) -> Tables:
        kind = self.settings.reader
        own = self.settings.parameters("reader")
        files = read_files(spark, self.settings.folder("input_dir"), own.get("glob", f"*.{kind}"), True, int(own.get("stop_after", 0)), int(own.get("sample", 0)))
        if own.get("deltas"):  # markup under its deltas: the last one counts
            files = with_deltas(files, read_deltas(spark, files, self.settings.folder("input_dir"), own["deltas"]), "path")
        from corpusmill.functions.text import base_name

        rows = files.select(base_name(files["path"]).alias("name"), "content")
        docs, annotations, self.rejects = markup.split_tables(markup.read_markup(rows, "name", "content", self.mapping, kind, self.xpath), keep=True)
        if self.settings.on_error != "continue" and (bad := self.rejects.first()):
            raise ValueError(f"{bad['doc_id']}: {bad['error']}")
        return docs, annotations

    def _index(self, docs: DataFrame, annotations: DataFrame) -> None:
        segments, tokens = index_segments(docs, annotations, self.specs, self.segment)
        sinks.IndexWriter(self.settings.folder("index_dir")).write(segments, tokens)

    def _write(self, docs: DataFrame, annotations: DataFrame) -> None:
        """Documents in the settings' form: Parquet, XML, or a file of text for each."""
        folder, form, own = self.settings.folder("output_dir"), self.settings.writer, self.settings.parameters("writer")
        if form == "xml":
            sinks.write_xml(docs, folder)
        elif form == "text":
            sinks.write_files(docs, folder, "doc_id", "text", own.get("pattern", "%c.%e"), own.get("ext", "txt"), own.get("overwrite", "true") == "true")
        elif form == "parquet":
            sinks.write_documents(docs, annotations, folder)
        else:
            raise ValueError(f"no writer {form!r}")

    def run(self, spark: SparkSession) -> None:
        s = self.settings
        progress = Progress("job", len(s.annotators) + 2, s.quiet)
        docs, annotations = self.readers[s.reader](spark)
        progress.add()
        for name in s.annotators:
            docs, annotations = self.annotators[name](docs, annotations)
            progress.add()
        if s.dump_conf:
            folder = s.folder("output_dir")
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, "settings.json"), "w", encoding="utf-8") as out:
                json.dump({"settings": asdict(s), "docs": json.loads(docs.schema.json()), "annotations": json.loads(annotations.schema.json())}, out, indent=1)
        self.consumers[s.consumer](docs, annotations)
        progress.add()
