"""Marked-up documents to texts and stand-off annotations.

Nesting is arbitrary, so a parser walks each document in a Python worker (`mapInArrow`); everything after it is
columns. Well-formed XML goes through expat, web pages through a tolerant parser. Divergences: a repeated document id
gets a number; an element without an annotation type leaves the stack as it was; documents that don't parse come back
as rejects with the reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANNOTATIONS = "doc_id string, ann_id long, type string, begin int, end int, id string, notes string, attrs map<string,string>"
PARSED = f"row long, doc_id string, index int, xpath string, text string, error string, annotations array<struct<{ANNOTATIONS.replace('doc_id string, ', '').replace(' string', ':string').replace(' long', ':bigint').replace(' int', ':int').replace('attrs map', 'attrs:map')}>>"


def never(before: str, after: str) -> bool:
    return False


@dataclass(frozen=True)
class Mapping:
    """What elements mean. types: element to annotation type ('*': all others); marks: elements without extent; breaks:
    elements that begin a paragraph; line_ends: elements that end a line at once; skipped: elements without text; features:
    element to attribute renames; split: whether text before and after an inline mark is to be parted by a space."""

    types: dict[str, str] = field(default_factory=dict)
    marks: frozenset = frozenset()
    breaks: frozenset = frozenset()
    line_ends: frozenset = frozenset()
    skipped: frozenset = frozenset({"script", "style"})
    features: dict[str, dict[str, str]] = field(default_factory=dict)
    split: Callable[[str, str], bool] = never


class _Builder:
    """Text and annotations from a stream of starts, ends and characters. White space is collapsed as it comes."""

    def __init__(self, mapping: Mapping, root: str):
        self.m, self.root = mapping, root
        self.text: list[str] = []
        self.size, self.last = 0, ""
        self.done: list[dict] = []
        self.stack: list[tuple[str, dict | None]] = []
        self.counts: list[dict[str, int]] = [{}]
        self.path: list[str] = []
        self.para, self.n_para, self.quiet, self.armed = 0, 0, 0, ""

    def _put(self, s: str) -> None:
        if s:
            self.text.append(s)
            self.size += len(s)
            self.last = s[-1]

    def characters(self, s: str) -> None:
        if self.quiet:
            return
        s = re.sub(r"\s+", " ", s)
        if not self.size or self.last.isspace():
            s = s.lstrip()
        if s and self.armed:
            before = self.armed
            self.armed = ""
            if not self.last.isspace() and self.m.split(before, s):
                self._put(" ")
        self._put(s)

    def _end_paragraph(self) -> None:
        if self.size > self.para:
            self._put("\n")
            self.done.append({"type": "Paragraph", "begin": self.para, "end": self.size, "id": str(self.n_para), "notes": None, "attrs": {}})
            self.n_para += 1
            self.para = self.size

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        self.counts.append({})
        self.path.append(f"{tag}[{n}]" if len(self.stack) else self.root)
        if tag in self.m.skipped:
            self.quiet += 1
        if tag in self.m.breaks:
            self._end_paragraph()
        if tag in self.m.line_ends and self.size and self.last != "\n":
            self._put("\n")
        names = self.m.features.get(tag, {})
        own = {names.get(k, k): v or "" for k, v in attrs.items()}
        kind = self.m.types.get(tag, self.m.types.get("*"))
        ann = None
        if tag in self.m.marks:
            self.armed = "".join(self.text[-4:])[-80:]
            self.done.append({"type": "Mark", "begin": self.size, "end": self.size, "id": own.get("id"), "notes": tag, "attrs": own | {"xpath": "/" + "/".join(self.path)}})
        elif kind:
            ann = {"type": kind, "begin": self.size, "end": -1, "id": own.get("id"), "notes": None, "attrs": own | {"xpath": "/" + "/".join(self.path)}}
            self.done.append(ann)
        self.stack.append((tag, ann))

    def end(self, tag: str) -> None:
        if all(t != tag for t, _ in self.stack):
            return
        while self.stack:  # elements left open end with the one around them
            own, ann = self.stack.pop()
            self.path.pop()
            self.counts.pop()
            if own in self.m.skipped:
                self.quiet -= 1
            if own in self.m.breaks:
                self._end_paragraph()
            if ann is not None:
                ann["end"] = self.size
            if own == tag:
                return

    def close(self) -> tuple[str, list[dict]]:
        while self.stack:
            self.end(self.stack[-1][0])
        if self.m.breaks:
            self._end_paragraph()
        order = sorted(self.done, key=lambda a: (a["begin"], -a["end"]))
        return "".join(self.text), [{"ann_id": i, **a} for i, a in enumerate(order)]


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, builder: _Builder):
        super().__init__(convert_charrefs=True)
        self.b = builder

    def handle_starttag(self, tag, attrs):
        self.b.start(tag, dict(attrs))
        if tag in self.VOID:
            self.b.end(tag)

    def handle_startendtag(self, tag, attrs):
        self.b.start(tag, dict(attrs))
        self.b.end(tag)

    def handle_endtag(self, tag):
        if tag not in self.VOID:
            self.b.end(tag)

    def handle_data(self, data):
        self.b.characters(data)


def parse_html(source: str, mapping: Mapping, root: str) -> tuple[str, list[dict]]:
    builder = _Builder(mapping, root)
    parser = _Html(builder)
    parser.feed(source)
    parser.close()
    return builder.close()


def parse_xml(source: bytes | str, mapping: Mapping, root: str) -> tuple[str, list[dict]]:
    builder = _Builder(mapping, root)
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = builder.start, builder.end, builder.characters
    parser.Parse(source, True)
    return builder.close()


def elements(source: bytes | str, xpath: str | None) -> list[bytes]:
    """The elements that an XPath (as ElementTree knows it) selects, each serialized; the whole document without one."""
    if not xpath:
        return [source if isinstance(source, bytes) else source.encode()]
    above = ElementTree.Element("above")  # absolute paths begin at the document, not at its root element
    above.append(ElementTree.fromstring(source))
    found = []
    for e in above.iterfind("." + xpath if xpath.startswith("/") else xpath):
        alone = ElementTree.Element(e.tag, e.attrib)
        alone.text, alone[:] = e.text, e[:]  # without the text that follows the element
        found.append(ElementTree.tostring(alone))
    return found


#: Annotations, and characters of text, that a worker returns together, about.
ANNOTATIONS_AT_ONCE, CHARS_AT_ONCE = 10_000, 1 << 21

_ANNOTATION = pa.struct([("ann_id", pa.int64()), ("type", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("id", pa.string()), ("notes", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])
_PARSED = pa.schema([("row", pa.int64()), ("doc_id", pa.string()), ("index", pa.int32()), ("xpath", pa.string()), ("text", pa.string()), ("error", pa.string()), ("annotations", pa.list_(_ANNOTATION))])


def _portions(parsed: Iterator[dict]) -> Iterator[list[dict]]:
    """Parsed documents some at a time: a worker holds so many annotations and characters, whatever the batches it gets."""
    held, annotations, chars = [], 0, 0
    for x in parsed:
        held.append(x)
        annotations, chars = annotations + len(x["annotations"]) + 1, chars + len(x["text"] or "")
        if annotations >= ANNOTATIONS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield held
            held, annotations, chars = [], 0, 0
    if held:
        yield held


def read_markup(rows: DataFrame, key: str, content: str, mapping: Mapping, kind: str = "html", xpath: str | None = None) -> DataFrame:
    """A row for each document: row (of the input), doc_id, index (from 1 within the row), xpath, text, error,
    annotations. rows: a key and the markup, as text or bytes. With an XPath each element is a document, named after the
    key, the path and its number."""
    try:  # a path that can't be read is an error here, not in the workers
        ElementTree.Element("any").find(xpath.lstrip("/") if xpath else "any")
    except (SyntaxError, TypeError) as e:
        raise ValueError(f"not a path of elements: {xpath!r}") from e
    tag = re.sub("/+", "-", xpath) if xpath else ""

    def parsed(frames: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for frame in frames:
            for at in range(frame.num_rows):  # a document's markup at a time is an object
                row, name, source = (frame.column(c)[at].as_py() for c in range(3))
                try:
                    parts = [source or ""] if kind == "html" else elements(source or "", xpath)
                except ElementTree.ParseError as e:
                    yield {"row": row, "doc_id": name, "index": None, "xpath": xpath, "text": None, "error": str(e), "annotations": []}
                    continue
                for n, part in enumerate(parts, 1):
                    doc = f"{name}{tag}-{n}" if xpath else name
                    try:
                        if kind == "html":
                            part = part.decode("utf-8", "replace") if isinstance(part, bytes) else part
                            text, annotations = parse_html(part, mapping, doc)
                        else:
                            text, annotations = parse_xml(part, mapping, doc)
                        yield {"row": row, "doc_id": doc, "index": n, "xpath": xpath, "text": text, "error": None, "annotations": annotations}
                    except expat.ExpatError as e:
                        yield {"row": row, "doc_id": doc, "index": n, "xpath": xpath, "text": None, "error": str(e), "annotations": []}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _portions(parsed(frames)):
            yield pa.RecordBatch.from_pylist([x | {"annotations": [a | {"attrs": list(a["attrs"].items())} for a in x["annotations"]]} for x in own], _PARSED)

    return rows.select(F.monotonically_increasing_id().alias("r"), F.col(key).cast("string").alias("k"), F.col(content).alias("c")).mapInArrow(run, PARSED)


def split_tables(parsed: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, annotations and rejects of read_markup's rows. Documents of one id are numbered from the second on; a number
    that gives another document's id is followed by a hash. keep: the parse is stored, so that the three tables, if all
    are wanted, share it."""
    from corpusmill.operators.spans import path_column
    from corpusmill.sources.scratch import stored

    if keep:
        parsed = stored(parsed, "parsed")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("index", F.xxhash64("text"), "row")) - 1
    good = parsed.where("error is null").withColumn("_n", again)
    last = F.lead("index").over(Window.partitionBy("row").orderBy("index")).isNull()
    good = good.withColumn("is_last", last).withColumn("_id", F.when(F.col("_n") > 0, F.concat_ws("-", "doc_id", "_n")).otherwise(F.col("doc_id")))
    taken = good.where("_n = 0").select(F.col("doc_id").alias("_taken"))
    good = good.join(taken, (F.col("_id") == F.col("_taken")) & (F.col("_n") > 0), "left")
    good = good.withColumn("doc_id", F.when(F.col("_taken").isNotNull(), F.concat_ws("-", "_id", F.hex(F.xxhash64("doc_id", "_n")))).otherwise(F.col("_id")))
    docs = good.select("doc_id", "text", F.lit(None).cast("string").alias("collection"), F.col("doc_id").alias("uri"), "xpath", "index", "is_last", F.lit(False).alias("skip"), F.lit("en").alias("lang"))
    rows = good.select("doc_id", F.inline("annotations"))
    annotations = rows.select("doc_id", "ann_id", "type", path_column(F.col("type")).alias("type_path"), "begin", "end", "id", F.when(F.col("type").isin("Segment", "Paragraph"), 1).alias("level"), "notes", "attrs")
    return docs, annotations, parsed.where("error is not null").select("doc_id", "error")
