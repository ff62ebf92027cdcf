"""Annotations: typed spans [begin, end) of documents, their joins and their metadata.

An annotation has doc_id, ann_id, type, type_path (root to leaf), begin, end, id and attrs (a map). Order is by begin,
enclosing ones first. Divergences: an annotation doesn't cover itself; the common type of a type and its ancestor is
the ancestor; patterns include with + and |, exclude with -, and have nothing cut off otherwise.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.files import dealt

#: Characters of a bucket in which spans of a document meet.
BUCKET = 512

# The types and their features.
TYPES = {
    "Annotation": (None, ()),
    "Span": ("Annotation", ("attributes", "tuples", "id")),
    "Document": ("Span", ("id", "collection", "uri", "xpath", "index", "proc_isLast", "proc_skip")),
    "Entity": ("Span", ()),
    "Segment": ("Span", ("level",)),
    "Paragraph": ("Segment", ()),
    "Mark": ("Annotation", ("notes",)),
    "Token": ("Annotation", ("lemma", "tag")),
}


def type_path(name: str) -> list[str]:
    """Root to leaf; an unknown type stands below Span."""
    parent = TYPES[name][0] if name in TYPES else "Span"
    return [*(type_path(parent) if parent else []), name]


def path_column(name: Column) -> Column:
    out = F.concat(F.array(*map(F.lit, type_path("Span"))), F.array(name))
    for t in TYPES:
        out = F.when(name == t, F.array(*map(F.lit, type_path(t)))).otherwise(out)
    return out


def is_type(name: str) -> Column:
    return F.array_contains("type_path", name)


def of_types(annotations: DataFrame, types: Sequence[str]) -> DataFrame:
    """Annotations of one of the types or below; all if none is given."""
    return annotations.where(F.arrays_overlap("type_path", F.array(*map(F.lit, types)))) if types else annotations


def common_type(a: Column, b: Column) -> Column:
    """The last type that two paths share from the root on."""
    same = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.struct(x["a"].alias("t"), (F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1)).alias("ok"))), lambda x: x["ok"])
    return F.element_at(F.transform(same, lambda x: x["t"]), -1)


def require(annotations: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Raises unless the columns are there with these types."""
    have = dict(annotations.dtypes)
    wrong = {c: t for c, t in columns.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"missing or of another type: {wrong}")
    return annotations


def ordered(annotations: DataFrame) -> DataFrame:
    return annotations.orderBy("doc_id", "begin", F.desc("end"))


def _buckets(begin: str, end: str, size: int) -> Column:
    last = F.greatest(F.col(end) - 1, F.col(begin))
    return F.explode(F.sequence(F.floor(F.col(begin) / size), F.floor(last / size)))


def _sided(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("doc_id", *(F.col(c).alias(f"{prefix}{c}") for c in rows.columns if c != "doc_id"))


def covered(segments: DataFrame, members: DataFrame, size: int = BUCKET) -> DataFrame:
    """Pairs of a segment (s_ columns) and a member inside it (m_ columns), other than itself.

    A member is in the bucket of its begin, a segment in all that it touches, so a member looks at the few segments around
    its begin, and each pair is found once."""
    at = _around(segments, "s_", size)
    own = lambda s: (F.col("m_begin") >= s["s_begin"]) & (F.col("m_end") <= s["s_end"]) & (F.col("m_ann_id") != s["s_ann_id"])
    return _met(_sided(members, "m_"), "m_begin", at, own, size)


def covering(segments: DataFrame, covers: DataFrame, size: int = BUCKET) -> DataFrame:
    """Pairs of a segment (s_ columns) and a cover around it (c_ columns), other than itself."""
    own = lambda c: (c["c_begin"] <= F.col("s_begin")) & (c["c_end"] >= F.col("s_end")) & (c["c_ann_id"] != F.col("s_ann_id"))
    return _met(_sided(segments, "s_"), "s_begin", _around(covers, "c_", size), own, size)


def _around(rows: DataFrame, prefix: str, size: int) -> DataFrame:
    """doc_id, _spans: a document's spans by the buckets that they touch."""
    rows = _sided(rows, prefix)
    each = rows.select("doc_id", F.struct(*(c for c in rows.columns if c != "doc_id")).alias("_s"), _buckets(f"{prefix}begin", f"{prefix}end", size).alias("_b"))
    of_bucket = each.groupBy("doc_id", "_b").agg(F.collect_list("_s").alias("_s"))  # of one document
    return of_bucket.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_s"))).alias("_spans"))


def _met(rows: DataFrame, begin: str, around: DataFrame, own: Callable[[Column], Column], size: int) -> DataFrame:
    """Each row beside the spans of its begin's bucket for which `own` holds. Rows that are dealt by document stay so."""
    there = F.try_element_at("_spans", F.floor(F.col(begin) / size))
    return rows.hint("merge").join(around, "doc_id").select("doc_id", *(c for c in rows.columns if c != "doc_id"), F.inline(F.filter(there, own)))


def connected(annotations: DataFrame, chunks: DataFrame, size: int = BUCKET) -> DataFrame:
    """Annotations that overlap a chunk, ends included."""
    a = annotations.withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor(F.col("end") / size))))
    c = chunks.select("doc_id", F.col("begin").alias("_lo"), F.col("end").alias("_hi"))
    c = c.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    met = a.join(c, ["doc_id", "_b"]).where("begin <= _hi and end >= _lo").select("doc_id", "ann_id").distinct()
    return annotations.join(met, ["doc_id", "ann_id"], "left_semi")


def contained_by(annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Annotations inside a chunk."""
    met = covered(chunks.withColumn("ann_id", F.lit(-1)), annotations).select("doc_id", F.col("m_ann_id").alias("ann_id")).distinct()
    return annotations.join(met, ["doc_id", "ann_id"], "left_semi")


def containing(annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Annotations around a chunk."""
    met = covering(chunks.withColumn("ann_id", F.lit(-1)), annotations).select("doc_id", F.col("c_ann_id").alias("ann_id")).distinct()
    return annotations.join(met, ["doc_id", "ann_id"], "left_semi")


def by_types(pairs: DataFrame, types: Sequence[str], side: str = "m_") -> DataFrame:
    """Each pair under every requested type that its related annotation is of: adds `of_type`."""
    rows = pairs.withColumn("of_type", F.explode(F.array(*map(F.lit, types))))
    return rows.where(F.array_contains(F.col(f"{side}type_path"), F.col("of_type")))


def listed_by_types(pairs: DataFrame, types: Sequence[str], side: str = "m_") -> DataFrame:
    """doc_id, s_ann_id, of_type, n and ids: of each segment with a related annotation, for every requested type."""
    ids = [F.array_sort(F.collect_list(F.when(F.array_contains(f"{side}type_path", t), F.col(f"{side}ann_id")))).alias(f"_{k}") for k, t in enumerate(types)]
    rows = pairs.groupBy("doc_id", "s_ann_id").agg(*ids)
    each = F.array(*(F.struct(F.lit(t).alias("of_type"), F.col(f"_{k}").alias("ids")) for k, t in enumerate(types)))
    return rows.select("doc_id", "s_ann_id", F.inline(each)).withColumn("n", F.size("ids"))


def related(annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """doc_id, ann_id, name, value: `<predicate>_subject` and `<predicate>_object` of spans in relations, as Type:id of
    the other end."""
    label = F.concat_ws(":", "type", "id")
    subject = annotations.select("doc_id", F.col("ann_id").alias("subj_id"), label.alias("subj"))
    object_ = annotations.select("doc_id", F.col("ann_id").alias("obj_id"), label.alias("obj"))
    rows = relations.join(subject, ["doc_id", "subj_id"]).join(object_, ["doc_id", "obj_id"])
    ends = F.array(
        F.struct(F.col("subj_id").alias("ann_id"), F.concat("predicate", F.lit("_object")).alias("name"), F.col("obj").alias("value")),
        F.struct(F.col("obj_id").alias("ann_id"), F.concat("predicate", F.lit("_subject")).alias("name"), F.col("subj").alias("value")),
    )
    return rows.select("doc_id", F.inline(ends))


# Features renamed where documents are translated.
DOCUMENT_NAMES = {"id": "documentId", "uri": "documentUri", "collection": "collectionId", "proc_isLast": "isLastSegment"}


def translate(annotations: DataFrame, source: str, target: str, names: Mapping[str, str] | None = None, keep_source: bool = True, overwrite: bool = False) -> DataFrame:
    """Copies annotations of one exact type as another, features renamed (others keep their names if names is None, or
    are left out). overwrite: annotations of the target type that were there go."""
    own = annotations.where(F.col("type") == source)
    if names is None:
        attrs = F.col("attrs")
    else:
        attrs = F.map_filter("attrs", lambda k, v: k.isin(list(names)))
        mapping = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        attrs = F.transform_keys(attrs, lambda k, v: F.element_at(mapping, k))
    path = F.array(*map(F.lit, type_path(target)))
    copies = own.withColumns({"type": F.lit(target), "type_path": path, "attrs": attrs})
    rest = annotations.where(F.col("type") != source) if not keep_source else annotations
    if overwrite:
        rest = rest.where(F.col("type") != target)
    return rest.unionByName(copies)


def matching_features(attrs: Column, pattern: str | None) -> Column:
    """Features whose names match: `+|regex` includes, `-|regex` excludes, a bare regex includes; None keeps all."""
    if pattern is None:
        return attrs
    sign, body = (pattern[0], pattern[2:]) if pattern[:2] in ("+|", "-|") else ("+", pattern)
    return F.map_filter(attrs, lambda k, v: k.rlike(body) if sign == "+" else ~k.rlike(body))


def prefixed(attrs: Column, prefix: str) -> Column:
    return F.transform_keys(attrs, lambda k, v: F.concat(F.lit(prefix), k))


def project_paths(annotations: DataFrame, paths: Sequence[str], domain: str | None = None) -> DataFrame:
    """Features by `type:path`, as columns `<Type>:<feature>` (or `<domain>:<feature>`), null for other types; a path
    goes into structs by dots, and names not found among the columns are looked up in attrs."""
    out = []
    for p in paths:
        kind, _, path = p.partition(":")
        value = F.col(path) if path.split(".")[0] in annotations.columns else F.element_at("attrs", path)
        out.append(F.when(is_type(kind), value).alias(f"{domain or kind}:{path}"))
    return annotations.select("doc_id", "ann_id", *out)


def span_metadata(annotations: DataFrame) -> DataFrame:
    """Adds `metadata`: the names that an index field gets from an annotation (attr_<k>, seg_id, para_id, seg_level)."""
    own = prefixed(F.coalesce("attrs", F.create_map().cast("map<string,string>")), "attr_")
    pairs = F.array(
        F.when(is_type("Segment"), F.struct(F.lit("seg_id").alias("k"), F.col("id").alias("v"))),
        F.when(is_type("Paragraph"), F.struct(F.lit("para_id").alias("k"), F.col("id").alias("v"))),
        F.when(is_type("Segment"), F.struct(F.lit("seg_level").alias("k"), F.col("level").cast("string").alias("v"))),
    )
    more = F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull() & x["v"].isNotNull()))
    return annotations.withColumn("metadata", F.map_concat(own, more))


# Names of a document's fields.
DOCUMENT_FIELDS = {"doc_id": "doc_id", "collection": "doc_Collection", "uri": "doc_URI", "xpath": "doc_XPath", "index": "doc_Index", "is_last": "proc_IsLast", "skip": "proc_Skip"}


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id and `metadata` of documents: the fields they have, nulls left out."""
    pairs = F.array(*(F.struct(F.lit(v).alias("k"), F.col(c).cast("string").alias("v")) for c, v in DOCUMENT_FIELDS.items() if c in docs.columns))
    return docs.select("doc_id", F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("metadata"))


def decorated(annotations: DataFrame, functions: Mapping[str, Callable[[], Column]]) -> DataFrame:
    """Adds computed columns."""
    return annotations.withColumns({name: f() for name, f in functions.items()})


def _later_wins(*maps: Column) -> Column:
    """One map of several; of one key, the last map's value."""
    return functools.reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b), maps)


def inherited(segments: DataFrame, docs: DataFrame | None = None, covers: DataFrame | None = None) -> DataFrame:
    """segments (with metadata) whose metadata also hold their document's and their covers'; later layers win, and of
    covers the inner ones. docs: doc_id and metadata; covers: annotations with metadata."""
    empty = F.create_map().cast("map<string,string>")
    rows = segments.withColumn("_doc", empty)
    if docs is not None:
        rows = segments.join(docs.select("doc_id", F.col("metadata").alias("_doc")), "doc_id", "left")
    rows = rows.withColumn("metadata", _later_wins(F.coalesce("_doc", empty), F.coalesce("metadata", empty))).drop("_doc")
    if covers is None:
        return rows
    pairs = covering(rows.select("doc_id", "ann_id", "begin", "end"), covers)
    each = pairs.select("doc_id", F.col("s_ann_id").alias("ann_id"), F.struct("c_begin", (-F.col("c_end")).alias("e"), "c_ann_id").alias("_o"), F.explode("c_metadata").alias("_k", "_v"))
    last = each.groupBy("doc_id", "ann_id", "_k").agg(F.max_by("_v", "_o").alias("_v"))
    merged = last.groupBy("doc_id", "ann_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_cover"))
    rows = rows.join(merged, ["doc_id", "ann_id"], "left")
    return rows.withColumn("metadata", _later_wins(F.col("metadata"), F.coalesce("_cover", empty))).drop("_cover")


def counts_by_type(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def metadata_fields(annotations: DataFrame, column: str = "metadata") -> DataFrame:
    """The distinct names in maps of metadata."""
    return annotations.select(F.explode(F.map_keys(column)).alias("field")).distinct()


def paragraphs(docs: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraph annotations: what stands between line ends, the line end included; empty ones are left out. ann_id is
    the paragraph's number in its document. Texts are dealt by document."""
    docs = dealt(docs.select(doc, text_col), doc)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(doc).alias("doc_id"), F.length(t).alias("_n"), F.posexplode(F.transform(F.split(t, "\n"), F.length)).alias("_k", "_line"))
    w = Window.partitionBy("doc_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("_line") + 1).over(w)
    rows = rows.select("doc_id", "_k", "_line", (stop - F.col("_line") - 1).cast("int").alias("begin"), F.least(stop, F.col("_n")).cast("int").alias("end")).where("_line > 0")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("begin")) - 1
    path = F.array(*map(F.lit, type_path("Paragraph")))
    return rows.select("doc_id", number.cast("long").alias("ann_id"), F.lit("Paragraph").alias("type"), path.alias("type_path"), "begin", "end", number.cast("string").alias("id"), F.lit(1).alias("level"), F.create_map().cast("map<string,string>").alias("attrs"))


def merge_tokens(rows: DataFrame, joins: Column, by: str = "doc_num") -> DataFrame:
    """Runs of tokens as one span: a token for which `joins` holds continues the span of the one before it."""
    w = Window.partitionBy(by).orderBy("pos")
    rows = rows.withColumn("_j", F.coalesce(joins, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_j"), 0).otherwise(1)).over(w))
    own = rows.groupBy(by, "_run").agg(F.min("pos").alias("pos"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), "").alias("term"))
    return own.drop("_run")


# Domains that every annotation has, left out of features unless asked for.
BUILT_IN = ("Annotation", "AnnotationBase", "DocumentAnnotation", "Sofa")


def discovered_paths(annotations: DataFrame, built_ins: bool = False) -> DataFrame:
    """path (`Type:feature`): what project_paths can take of these annotations, namely the features of their types and the
    names in attrs; with built_ins also begin and end."""
    own = [(t, f"{t}:{f}") for t, (_, more) in TYPES.items() for f in more if f not in ("attributes", "tuples")]
    if built_ins:
        own += [("Annotation", f"Annotation:{f}") for f in ("begin", "end")]
    known = F.create_map(*(x for t in dict.fromkeys(t for t, _ in own) for x in (F.lit(t), F.array(*(F.lit(p) for u, p in own if u == t)))))
    there = annotations.select("type", F.explode("type_path").alias("t")).distinct()
    if not built_ins:
        there = there.where(~F.col("t").isin(*BUILT_IN))
    fixed = there.select(F.explode(F.element_at(known, F.col("t"))).alias("path"))
    named = annotations.select("type", F.explode(F.map_keys("attrs")).alias("k")).distinct().select(F.concat_ws(":", "type", "k").alias("path"))
    return fixed.union(named).distinct()


def document_names(annotations: DataFrame) -> DataFrame:
    """doc_id, id, uri: those of each document's first Document annotation."""
    w = Window.partitionBy("doc_id").orderBy("begin", F.desc("end"), "ann_id")
    first = annotations.where(is_type("Document")).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select("doc_id", "id", F.element_at("attrs", "uri").alias("uri"))


def per_segment(segments: DataFrame, members: DataFrame, function: Callable[[DataFrame], DataFrame], segment: str = "Segment") -> DataFrame:
    """A function over the members of every segment of a type (s_ columns beside m_ columns), all segments at once."""
    return function(covered(segments.where(is_type(segment)), members))
