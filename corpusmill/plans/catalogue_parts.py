"""More queries of the corpus engine: the façade on an index, files and round trips, streams, markup that the queries
make themselves, interval tests, updates of samples, lists and records."""

from __future__ import annotations

import posixpath

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.functions import collections as col
from corpusmill.functions import posclass, records, text
from corpusmill.functions.termset import ANY, EMPTY, TermSet
from corpusmill.operators import datasets, lexicon, samples, spans, tokens
from corpusmill.operators.indexing import index_segments
from corpusmill.plans.catalogue import CLASS_OF, MIN_TF, PARAS, TAG, TOK, WORDS, _NESTED, _cooc_sql, _docs, _lex, _lexicon, _lists, _nested, _tagged, _tokens, _word_annotations, query
from corpusmill.plans.corpus import Corpus
from corpusmill.sources import files, markup, scratch, sinks
from corpusmill.streaming import index as streaming

# the façade


@query(
    f"""WITH {_NESTED}, tok AS (SELECT doc_id, term, sum(step) OVER (PARTITION BY doc_id ORDER BY b, e DESC, term ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM steps), {_lex(MIN_TF)},
one AS (SELECT doc_id, pos, arg_max(idx, term) AS idx FROM tok JOIN lex USING (term) GROUP BY ALL)
SELECT p.idx AS i, q.idx AS j, sum(2520 // abs(p.pos - q.pos))::BIGINT AS s FROM one p JOIN one q ON p.doc_id = q.doc_id AND q.pos BETWEEN p.pos - 10 AND p.pos + 10 AND q.pos <> p.pos GROUP BY ALL"""
)
def cooc_stacked(spark, sf):
    """Nested tokens share a position, where the greatest term counts."""
    return Corpus(_docs(spark, sf), _nested(spark, sf)).cooc().select("i", "j", "s")


@query(_cooc_sql(30, 30, MIN_TF, 1, "lang = 'fr'").rpartition("cooc AS")[0] + "cooc AS (SELECT p.idx AS i, q.idx AS j, sum(1.0::DOUBLE / abs(p.pos - q.pos)) AS x FROM e p JOIN e q ON p.doc_id = q.doc_id AND q.pos BETWEEN p.pos - 30 AND p.pos + 25 AND q.pos <> p.pos GROUP BY ALL) SELECT i, j, round(x, 7) AS x FROM cooc")
def cooc_wide(spark, sf):
    """A window too wide for whole numbers, on a sample."""
    corpus = Corpus(_docs(spark, sf))
    return corpus.cooc(corpus.sample(terms=["fr"], field="lang"), 30, 25).select("i", "j", F.round("x", 7).alias("x"))


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, lang AS split, count(*) AS n FROM tok JOIN lex USING (term) WHERE regexp_full_match(source, 'src1.*') GROUP BY ALL")
def corpus_freq(spark, sf):
    corpus = Corpus(_docs(spark, sf), settings=Settings(field_split="lang", field_filter="source", filter_term="src1.*"))
    return corpus.freq(sample=corpus.sample())


@query(f"WITH tok AS (SELECT doc_id, lang, source, {CLASS_OF} || '_' || term AS term, pos FROM (SELECT *, {TAG} AS tag FROM ({'SELECT * FROM tok0'}))), {_lex(MIN_TF)} SELECT idx, term, tf, df FROM lex".replace("WITH tok AS", "WITH " + TOK.replace("tok AS", "tok0 AS", 1) + ", tok AS", 1))
def corpus_field(spark, sf):
    """Of an index with two token fields, the settings' one."""
    rows = _tagged(spark, sf)
    both = rows.withColumn("field", F.lit("plain")).unionByName(rows.withColumn("term", text.token_term(F.col("term"), pos_group=posclass.class_of(F.col("payload")))).withColumn("field", F.lit("classed")))
    return Corpus(_docs(spark, sf), both, Settings(field_txt="classed")).lexicon()


@query("SELECT DISTINCT doc_id AS doc_num FROM documents")
def sample_default(spark, sf):
    return Corpus(_docs(spark, sf)).sample()


@query("SELECT doc_id AS doc_num FROM documents WHERE lang = 'es' AND doc_id NOT IN (4, 5, 6, 7) UNION SELECT unnest([1, 2, 3]) ORDER BY 1")
def sample_updated(spark, sf):
    own = samples.by_terms(_docs(spark, sf), "lang", ["es"], "doc_id")
    return samples.vector(samples.remove(samples.add(own, 1, 2, 3), 4, 5, 6, 7))


@query("SELECT doc_id AS doc_num FROM documents WHERE lang = 'de' OR regexp_full_match(lang, 'e.')")
def sample_set(spark, sf):
    return samples.by_set(_docs(spark, sf), "lang", TermSet("L", terms=("de",), patterns=("e.",)), "doc_id")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source")
def field_terms(spark, sf):
    return files.terms(_docs(spark, sf), "source")


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field")
def field_names(spark, sf):
    return spark.createDataFrame([(f,) for f in files.fields(_docs(spark, sf))], "field string")


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, term, tf, df FROM lex")
def lexicon_arrays(spark, sf):
    """The lexicon as arrays for callers outside Spark, and back."""
    terms, tf, df = lexicon.arrays(_lexicon(spark, sf))
    return spark.createDataFrame([(i, t, int(n), int(d)) for i, (t, n, d) in enumerate(zip(terms, tf, df))], "idx long, term string, tf long, df long")


# predicates


@query(f"WITH {TOK} SELECT count(*) AS any_of, 0::BIGINT AS none_of FROM tok")
def termset_ends(spark, sf):
    return _tokens(spark, sf).agg(F.count(F.when(ANY.test(F.col("term")), 1)).alias("any_of"), F.count(F.when(EMPTY.test(F.col("term")), 1)).alias("none_of"))


@query(f"WITH {TOK}, t AS (SELECT doc_id, {TAG} AS tag FROM tok) SELECT doc_id AS doc_num, count(*) FILTER (tag IN ('NN', 'NNS', 'NNP', 'NNPS')) AS nouns, count(*) FILTER (tag IN ('MD', 'VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ', 'RB', 'RBR', 'RBS', 'WRB')) AS verbs_adverbs FROM t GROUP BY 1")
def tokens_in_classes(spark, sf):
    tag = F.col("payload")
    return _tagged(spark, sf).groupBy("doc_num").agg(F.count(F.when(posclass.is_in(tag, "NN", "NP"), 1)).alias("nouns"), F.count(F.when(posclass.is_in(tag, "V", "ADV"), 1)).alias("verbs_adverbs"))


# token streams and the segment index


def _annotated(spark, sf):
    """Paragraphs, and words with a tag and a lemma, as annotations of documents."""
    docs = _docs(spark, sf)
    words = _word_annotations(spark, sf).withColumn("ann_id", F.col("ann_id") + 1_000_000)
    word = F.lower("surface")
    attrs = F.create_map(F.lit("tag"), F.expr(TAG.replace("term", "lower(surface)")), F.lit("lemma"), F.regexp_replace(word, "(ing|ed|s)$", ""))
    words = words.select("doc_id", "ann_id", "type", "type_path", "begin", "end", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("level"), attrs.alias("attrs"))
    named = docs.select("doc_id", "text", F.col("lang").alias("collection"), F.col("source").alias("uri"))
    return named, spans.paragraphs(docs).unionByName(words)


_INSIDE = f"""{PARAS}, {WORDS}, inside AS (
  SELECT p.doc_id, p.b AS base, p.ann_id, w.b - p.b AS b, w.e - p.b AS e, lower(w.surface) AS term, w.pos FROM paras p JOIN words w ON w.doc_id = p.doc_id AND w.b >= p.b AND w.e <= p.e),
tagged AS (SELECT *, {TAG} AS tag, regexp_replace(term, '(ing|ed|s)$', '') AS lemma FROM inside)"""


@query(
    f"""WITH {_INSIDE}, f AS (
SELECT doc_id, base, 'word' AS field, b, e, term, tag AS payload, pos FROM tagged UNION ALL
SELECT doc_id, base, 'class', b, e, {CLASS_OF} || '_' || lemma, tag, pos FROM tagged WHERE {CLASS_OF} <> 'PUNC')
SELECT doc_id, base, field, (row_number() OVER (PARTITION BY doc_id, base, field ORDER BY b) - 1)::INT AS pos, term, payload, b::INT AS "begin", e::INT AS "end" FROM f"""
)
def index_tokens(spark, sf):
    """Two token fields of all paragraphs, as read from the compacted index."""
    docs, annotations = _annotated(spark, sf)
    specs = [tokens.TokenSpec("word", "Token", tokens.WordTokenizer()), tokens.TokenSpec("class", "Token", tokens.WordTokenizer(lemmatize=True, add_class=True, excluded=("PUNC",)))]
    folder = scratch.folder(spark, "index")
    sinks.IndexWriter(folder, parts=2).write(*index_segments(docs, annotations, specs, members=["Token"]))
    segments, found = sinks.read_index(spark, folder)
    base = segments.select("doc_num", "doc_id", F.col("begin").alias("base"))
    return found.join(base, "doc_num").select("doc_id", "base", "field", "pos", "term", "payload", "begin", "end")


@query(f"""WITH {PARAS} SELECT p.doc_id, p.b AS "begin", p.e AS "end", d.lang AS collection, d.source AS uri, p.ann_id::VARCHAR AS para_id, '1' AS seg_level FROM paras p JOIN documents d USING (doc_id)""")
def index_segments_read(spark, sf):
    docs, annotations = _annotated(spark, sf)
    folder = scratch.folder(spark, "index")
    sinks.IndexWriter(folder).write(*index_segments(docs, annotations, [tokens.TokenSpec("raw", "Paragraph", tokens.SpanTokenizer())], members=["Token"]))
    segments, _ = sinks.read_index(spark, folder)
    named = {"collection": "doc_Collection", "uri": "doc_URI", "para_id": "para_id", "seg_level": "seg_level"}
    return segments.select("doc_id", "begin", "end", *(F.element_at("metadata", v).alias(k) for k, v in named.items()))


@query(
    f"""WITH {WORDS}, a AS (
SELECT doc_id, b, e, lower(surface) AS term, {TAG.replace("term", "lower(surface)")} AS payload FROM words UNION ALL
SELECT doc_id, b, e, 'e' || length(surface), 'Entity' FROM words WHERE regexp_matches(surface, '^[A-Z]') AND length(surface) > 3 UNION ALL
SELECT doc_id, b, e, surface, 'Mark' FROM words WHERE length(surface) = 1)
SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY b) - 1)::INT AS place, term, payload, b AS "begin", e AS "end" FROM a"""
)
def merged_stream(spark, sf):
    """Words, entities and marks by one tokenizer."""
    words = _word_annotations(spark, sf)
    none = F.lit(None).cast("string")
    named = lambda kind, id_: F.struct(F.lit(kind).alias("type"), F.array(*map(F.lit, spans.type_path(kind))).alias("type_path"), id_.alias("id"))
    entity = F.when(F.expr("surface rlike '^[A-Z]' and length(surface) > 3"), named("Entity", F.concat(F.lit("e"), F.length("surface"))))
    mark = F.when(F.expr("length(surface) = 1"), named("Mark", none))
    kinds = F.filter(F.array(named("Token", none), entity, mark), lambda x: x.isNotNull())
    rows = words.select("doc_id", "begin", "end", F.inline(kinds), F.col("surface").alias("text"), F.expr(TAG.replace("term", "lower(surface)")).alias("tag"), F.lower("surface").alias("lemma"))
    found = tokens.stream(rows, tokens.TokenSpec("all", "Annotation", tokens.MergedTokenizer()), "doc_id")
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("begin")) - 1
    return found.select("doc_id", place.cast("int").alias("place"), "term", "payload", "begin", "end")


@query(f"WITH {PARAS} SELECT doc_id, ann_id, md5(substr(text, b + 1, e - b)) AS digest, substr(text, greatest(b - 10, 0) + 1, least(b + 15, length(text)) - greatest(b - 10, 0)) AS around FROM paras JOIN documents USING (doc_id) WHERE e - b >= 5")
def covered_texts(spark, sf):
    rows = spans.paragraphs(_docs(spark, sf)).join(_docs(spark, sf).select("doc_id", "text"), "doc_id").where(F.col("end") - F.col("begin") >= 5)
    b, e = F.col("begin"), F.col("end")
    return rows.select("doc_id", "ann_id", F.md5(text.covered_text(F.col("text"), b, e)).alias("digest"), text.surrounding(F.col("text"), b, b + 5, 10).alias("around"))


@query(f"WITH {WORDS}, r AS (SELECT *, sum(CASE WHEN length(surface) <= 2 AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM words) SELECT doc_id AS doc_num, min(pos)::INT AS pos, min(b) AS \"begin\", max(e) AS \"end\", string_agg(lower(surface), '' ORDER BY pos) AS term FROM r GROUP BY doc_id, run")
def merged_tokens(spark, sf):
    """A word of two letters at most goes on with the one before it."""
    return spans.merge_tokens(tokens.word_spans(_docs(spark, sf)), (F.length("surface") <= 2) & (F.col("pos") > 0))


# annotations


_CHUNKS = """chunks AS (SELECT doc_id, 100 AS lo, 400 AS hi FROM documents UNION ALL SELECT doc_id, 1000, 1100 FROM documents)"""


def _chunks(spark, sf):
    docs = _docs(spark, sf).select("doc_id")
    return docs.select("doc_id", F.inline(F.array(F.struct(F.lit(100).alias("begin"), F.lit(400).alias("end")), F.struct(F.lit(1000).alias("begin"), F.lit(1100).alias("end")))))


@query(f"WITH {PARAS}, {_CHUNKS} SELECT DISTINCT doc_id, ann_id FROM paras JOIN chunks USING (doc_id) WHERE b <= hi AND e >= lo")
def spans_connected(spark, sf):
    return spans.connected(spans.paragraphs(_docs(spark, sf)), _chunks(spark, sf)).select("doc_id", "ann_id")


@query(f"WITH {PARAS}, {_CHUNKS} SELECT DISTINCT doc_id, ann_id FROM paras JOIN chunks USING (doc_id) WHERE b >= lo AND e <= hi")
def spans_contained(spark, sf):
    return spans.contained_by(spans.paragraphs(_docs(spark, sf)), _chunks(spark, sf)).select("doc_id", "ann_id")


@query(f"WITH {PARAS}, {_CHUNKS} SELECT DISTINCT doc_id, ann_id FROM paras JOIN chunks USING (doc_id) WHERE b <= lo AND e >= hi")
def spans_containing(spark, sf):
    return spans.containing(spans.paragraphs(_docs(spark, sf)), _chunks(spark, sf)).select("doc_id", "ann_id")


@query(f"WITH {PARAS} SELECT doc_id, ann_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b, e DESC) - 1)::BIGINT AS place FROM paras")
def spans_ordered(spark, sf):
    rows = spans.ordered(spans.paragraphs(_docs(spark, sf)))
    return col.numbered(rows, ["doc_id"], [F.asc("begin"), F.desc("end")], "place").select("doc_id", "ann_id", "place")


@query(f"""WITH {PARAS} SELECT doc_id, ann_id, 1 AS "Segment:level", ann_id::VARCHAR AS "Paragraph:id", NULL::VARCHAR AS "Token:tag" FROM paras""")
def feature_paths(spark, sf):
    rows = spans.require(spans.paragraphs(_docs(spark, sf)), {"begin": "int", "type": "string", "attrs": "map<string,string>"})
    return spans.project_paths(rows, ["Segment:level", "Paragraph:id", "Token:tag"])


@query("SELECT unnest(['Segment:level', 'Span:id', 'Token:lemma', 'Token:tag']) AS path")
def feature_discovered(spark, sf):
    return spans.discovered_paths(_annotated(spark, sf)[1])


@query(f"WITH {PARAS} SELECT doc_id, ann_id, (e - b)::INT AS size, 'p_lang=' || lang AS features FROM paras JOIN documents USING (doc_id)")
def features_decorated(spark, sf):
    rows = spans.paragraphs(_docs(spark, sf)).join(_docs(spark, sf).select("doc_id", "lang"), "doc_id").withColumn("attrs", F.create_map(F.lit("lang"), "lang"))
    rows = spans.decorated(rows, {"size": lambda: F.col("end") - F.col("begin"), "features": lambda: F.array_join(F.transform(F.map_entries(spans.prefixed(F.col("attrs"), "p_")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")})
    return rows.select("doc_id", "ann_id", "size", "features")


@query(f"WITH {_INSIDE} SELECT doc_id, ann_id, count(*) AS n, sum(e - b)::BIGINT AS letters FROM inside GROUP BY ALL")
def per_segment(spark, sf):
    _, rows = _annotated(spark, sf)
    count = lambda pairs: pairs.groupBy("doc_id", F.col("s_ann_id").alias("ann_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m_end") - F.col("m_begin")).alias("letters"))
    return spans.per_segment(spans.of_types(rows, ["Paragraph"]), spans.of_types(rows, ["Token"]), count)


@query("SELECT doc_id, lang AS id, source AS uri FROM documents")
def document_names(spark, sf):
    docs = _docs(spark, sf)
    path = F.array(*map(F.lit, spans.type_path("Document")))
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("ann_id"), F.lit("Document").alias("type"), path.alias("type_path"), F.lit(0).alias("begin"), F.length(F.coalesce("text", F.lit(""))).alias("end"), F.col("lang").alias("id"), F.lit(None).cast("int").alias("level"), F.create_map(F.lit("uri"), "source").alias("attrs"))
    return spans.document_names(rows.unionByName(spans.paragraphs(docs)))


# delimited files, matrices, documents


def _lines(spark, folder, name):
    return spark.read.text(posixpath.join(folder, name)).select(F.lit(name).alias("file"), F.col("value").alias("line"))


_COLUMNS = " || '@' || ".join(f"count(*) FILTER (c = '{x}')" for x in posclass.CLASSES)


@query(
    f"""WITH {TOK}, {_lex(MIN_TF)}, c AS (SELECT term, lang, {CLASS_OF} AS c FROM (SELECT *, {TAG} AS tag FROM tok) JOIN lex USING (term))
SELECT 'lxcn.dsv' AS file, '_term_@df@tf' AS line UNION ALL SELECT 'lxcn.dsv', term || '@' || df || '@' || tf FROM lex UNION ALL
SELECT 'freq.dsv', '_term_@de@en@es@fr' UNION ALL
SELECT 'freq.dsv', term || '@' || count(*) FILTER (lang = 'de') || '@' || count(*) FILTER (lang = 'en') || '@' || count(*) FILTER (lang = 'es') || '@' || count(*) FILTER (lang = 'fr') FROM c GROUP BY term UNION ALL
SELECT 'posc.dsv', '_term_@{"@".join(posclass.CLASSES)}' UNION ALL SELECT 'posc.dsv', term || '@' || {_COLUMNS} FROM c GROUP BY term"""
)
def dump_tables(spark, sf):
    """The files of a whole dump, line by line."""
    folder = scratch.folder(spark, "dump")
    Corpus(_docs(spark, sf), _tagged(spark, sf), Settings(field_split="lang")).dump(folder)
    return _lines(spark, folder, "lxcn.dsv").union(_lines(spark, folder, "freq.dsv")).union(_lines(spark, folder, "posc.dsv"))


@query("WITH c AS (SELECT l_shipmode, l_returnflag, l_linestatus FROM (SELECT l_linenumber AS l_shipmode, l_returnflag, l_linestatus FROM lineitem)) SELECT 'id;F;O' AS line UNION ALL SELECT l_returnflag || '-' || l_shipmode || ';' || coalesce(nullif(count(*) FILTER (l_linestatus = 'F'), 0)::VARCHAR, '-') || ';' || coalesce(nullif(count(*) FILTER (l_linestatus = 'O'), 0)::VARCHAR, '-') FROM c GROUP BY l_returnflag, l_shipmode")
def wide_file(spark, sf):
    """Cells in long form as a delimited file, with a format of its own for a column and a mark for what is missing."""
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.concat_ws("-", "l_returnflag", "l_linenumber").alias("row"), F.col("l_linestatus").alias("c")).agg(F.count(F.lit(1)).alias("v"))
    folder = scratch.folder(spark, "wide")
    sinks.write_dsv(sinks.wide_table(cells, "row", "c", "v"), folder, "row", row_head="id", sep=";", missing="-", formats={"F": lambda x: x.cast("int")})
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(_cooc_sql(10, 10, MIN_TF, 2520) + " SELECT i, j, s / 2520.0::DOUBLE AS x FROM cooc")
def matrix_file(spark, sf):
    """The co-occurrence matrix as read from its files of sixteen bytes a cell."""
    folder = scratch.folder(spark, "matrix")
    sinks.write_matrix(datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf), ordered=True), folder)
    return sinks.read_matrix(spark, folder)


@query(f"WITH {PARAS} SELECT d.doc_id, md5(coalesce(d.text, '')) AS digest, count(p.ann_id) AS n, sum(p.e)::BIGINT AS ends FROM documents d LEFT JOIN paras p USING (doc_id) GROUP BY ALL")
def documents_stored(spark, sf):
    folder = scratch.folder(spark, "docs")
    docs = _docs(spark, sf).select("doc_id", "text")
    sinks.write_documents(docs, spans.paragraphs(docs), folder)
    found, annotations = sinks.read_documents(spark, folder)
    rows = annotations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends"))
    return found.join(rows, "doc_id", "left").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("n", F.lit(0)).alias("n"), "ends")


@query("SELECT page_id, url FROM pages")
def xml_stored(spark, sf):
    folder = scratch.folder(spark, "xml")
    sinks.write_xml(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), folder, "page", "pages")
    return sinks.read_xml(spark, folder, "page", "page_id long, url string")


# files


def _items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT item_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS length FROM benchmark")
def files_written(spark, sf):
    folder = scratch.folder(spark, "files")
    sinks.write_files(_items(spark, sf), folder, "item_id", "text", ext="txt")
    return files.list_files(spark, folder, suffix=".TXT").select("name", "length")


@query("WITH b AS (SELECT item_id % 7 AS k FROM benchmark UNION ALL SELECT item_id % 7 FROM benchmark), n AS (SELECT k, row_number() OVER (PARTITION BY k) - 1 AS n FROM b) SELECT CASE WHEN n = 0 THEN k || '.txt' ELSE k || '-' || n || '.txt' END AS name FROM n")
def files_numbered(spark, sf):
    """Names that recur, within a write and with what was there."""
    folder, rows = scratch.folder(spark, "files"), _items(spark, sf).withColumn("k", F.col("item_id") % 7)
    for _ in range(2):
        sinks.write_files(rows, folder, "k", "text", ext="txt", overwrite=False)
    return files.list_files(spark, folder).select("name")


@query("SELECT item_id || '.txt' AS name, md5(coalesce(text, '')) AS digest FROM benchmark ORDER BY name LIMIT 10")
def files_first(spark, sf):
    folder = scratch.folder(spark, "files")
    sinks.write_files(_items(spark, sf), folder, "item_id", "text", ext="txt")
    rows = files.read_files(spark, folder, "*.txt", stop_after=10)
    return rows.select(F.substring_index("path", "/", -1).alias("name"), F.md5("content").alias("digest"))


@query("SELECT 12::BIGINT AS n, 12::BIGINT AS names")
def files_sampled(spark, sf):
    folder = scratch.folder(spark, "files")
    sinks.write_files(_items(spark, sf), folder, "item_id", "text", ext="txt")
    return files.read_files(spark, folder, sample=12, seed=5).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("names"))


@query("SELECT item_id || '.txt' AS name FROM benchmark WHERE item_id % 10 <> 7")
def files_cleared(spark, sf):
    folder = scratch.folder(spark, "files")
    sinks.write_files(_items(spark, sf), folder, "item_id", "text", ext="txt")
    sinks.clear_files(spark, folder, "*7.txt")
    return files.list_files(spark, folder).select("name")


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'second ' WHEN item_id % 2 = 0 THEN 'first ' ELSE '' END || coalesce(text, '') AS text FROM benchmark")
def files_deltas(spark, sf):
    """Files under their deltas, which count up to the first number that is missing."""
    top, items = scratch.folder(spark, "deltas"), _items(spark, sf)
    sinks.write_files(items, posixpath.join(top, "base"), "item_id", "text", ext="txt")
    for i, step, word in ((0, 2, "first "), (1, 4, "second "), (3, 8, "lost ")):
        own = items.where(F.col("item_id") % step == 0).withColumn("text", F.concat(F.lit(word), "text"))
        sinks.write_files(own, posixpath.join(top, str(i)), "item_id", "text", ext="txt")
    base = files.read_files(spark, posixpath.join(top, "base"))
    rows = files.with_deltas(base, files.read_deltas(spark, base, posixpath.join(top, "base")), "path")
    return rows.select(text.base_name(F.col("path")).cast("long").alias("item_id"), F.col("content").cast("string").alias("text"))


# streams


#: Arrivals, and bytes of their text in one file, about.
ARRIVALS, ARRIVED_BYTES = 3, 32 << 20


def _arrivals(spark, sf):
    """A folder of files that arrive one, or, of a large table, a third at a time, their schema, and how many these are."""
    folder, docs = scratch.folder(spark, "arrivals"), _docs(spark, sf).select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at_once = max(1, -(-size // (ARRIVALS * ARRIVED_BYTES)))
    docs.repartition(ARRIVALS * at_once, "doc_id").write.parquet(folder)
    return folder, "doc_id long, text string", at_once


@query(f"WITH {TOK} SELECT doc_id AS doc_num, pos::INT AS pos, term, 'word' AS field FROM tok")
def stream_tokens(spark, sf):
    """What the stream has appended to an index; a second run finds nothing new."""
    (source, schema, at_once), index = _arrivals(spark, sf), scratch.folder(spark, "index")
    for _ in range(2):
        streaming.append_tokens(spark, source, schema, index, max_files=at_once).awaitTermination()
    return streaming.read_tokens(spark, index).select("doc_num", "pos", "term", "field")


@query(f"WITH {TOK} SELECT term, count(*) AS tf FROM tok GROUP BY term")
def stream_counts(spark, sf):
    (source, schema, _), target = _arrivals(spark, sf), scratch.folder(spark, "counts")
    streaming.running_counts(spark, source, schema, target).awaitTermination()
    return streaming.read_counts(spark, target)


# markup that the queries make: conversations as XML, one document each


def _talks(spark, sf):
    """name and xml: a conversation's turns whose text has a letter."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).alias("t")).where("t <> ''")
    turn = F.format_string('<turn n="%d" who="%s">%s</turn>', "turn", "role", "t")
    own = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda r: r["x"]), "").alias("x"))
    return own.select(F.concat(F.lit("c"), "conv_id").alias("name"), F.format_string('<conv id="%d">%s</conv>', "conv_id", "x").alias("xml"))


_TALKS = """t AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS t FROM conversations),
talks AS (SELECT conv_id, turn, role, t, row_number() OVER w AS k, coalesce(sum(length(t)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, lead(turn) OVER w IS NULL AS is_last FROM t WHERE t <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"""WITH {_TALKS} SELECT 'c' || conv_id || '-conv-turn-' || k AS doc_id, t AS text, k::INT AS "index", is_last FROM talks""")
def xml_elements(spark, sf):
    """Each element that an absolute path selects is a document."""
    parsed = markup.read_markup(_talks(spark, sf), "name", "xml", markup.Mapping(), "xml", "/conv/turn")
    return markup.split_tables(parsed)[0].select("doc_id", "text", "index", "is_last")


_TALK = markup.Mapping(types={"turn": "Entity", "conv": "Segment"}, features={"turn": {"who": "id"}})


@query(
    f"""WITH {_TALKS} SELECT 'c' || conv_id AS doc_id, 'Entity' AS type, b::INT AS "begin", (b + length(t))::INT AS "end", role AS id, '/c' || conv_id || '/turn[' || k || ']' AS xpath FROM talks
UNION ALL SELECT 'c' || conv_id, 'Segment', 0, sum(length(t))::INT, conv_id::VARCHAR, '/c' || conv_id FROM talks GROUP BY conv_id"""
)
def xml_annotations(spark, sf):
    rows = markup.split_tables(markup.read_markup(_talks(spark, sf), "name", "xml", _TALK, "xml"), keep=True)[1]
    return rows.select("doc_id", "type", "begin", "end", "id", F.element_at("attrs", "xpath").alias("xpath"))


@query(f"""WITH {_TALKS} SELECT 'c' || conv_id AS doc_id, string_agg(t, chr(10) ORDER BY k) || chr(10) AS paragraphs, string_agg(t, chr(10) ORDER BY k) AS lines, string_agg(t, ' ' ORDER BY k) AS words FROM talks GROUP BY conv_id""")
def xml_breaks(spark, sf):
    """The texts under three meanings of an element: a paragraph, a line end, and a mark that parts words."""
    rows = _talks(spark, sf)
    texts = lambda name, **m: markup.read_markup(rows, "name", "xml", markup.Mapping(**m), "xml").select("doc_id", F.col("text").alias(name))
    marked = rows.withColumn("xml", F.regexp_replace("xml", "</turn>", "</turn><lb/>"))
    words = markup.read_markup(marked, "name", "xml", markup.Mapping(marks=frozenset({"lb"}), split=lambda before, after: True), "xml").select("doc_id", F.col("text").alias("words"))
    return texts("paragraphs", breaks=frozenset({"turn"})).join(texts("lines", line_ends=frozenset({"turn"})), "doc_id").join(words, "doc_id")


@query(f"WITH {_TALKS} SELECT DISTINCT CASE WHEN conv_id % 3 = 0 THEN 'bad' WHEN conv_id % 3 = 1 THEN 'c' || conv_id ELSE 'c' || conv_id || '-1' END AS name, count(*) AS n FROM talks GROUP BY conv_id HAVING conv_id % 3 > 0 UNION ALL SELECT 'bad', count(DISTINCT conv_id) FROM talks WHERE conv_id % 3 = 0 UNION ALL SELECT 'c' || conv_id, count(*) FROM talks WHERE conv_id % 3 = 2 GROUP BY conv_id")
def xml_rejects(spark, sf):
    """Documents that don't parse are rejects, and a document that comes twice is numbered; n: its turns."""
    talks = _talks(spark, sf)
    kind = F.substring("name", 2, 20).cast("long") % 3
    broken = talks.where(kind == 0).withColumn("xml", F.replace(F.col("xml"), F.lit("</conv>"), F.lit("")))
    rows = broken.union(talks.where(kind != 0)).union(talks.where(kind == 2))
    docs, annotations, rejects = markup.split_tables(markup.read_markup(rows, "name", "xml", _TALK, "xml"), keep=True)
    counts = annotations.where("type = 'Entity'").groupBy(F.col("doc_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return docs.select(F.col("doc_id").alias("name")).join(counts, "name").union(rejects.agg(F.lit("bad").alias("name"), F.count(F.lit(1)).alias("n")))


# lists, maps and records


@query(
    """WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ')[1:9] AS ws FROM documents), l AS (SELECT *, list_transform(ws, lambda x: length(x)) AS ls, list_sort(list_distinct(ws)) AS sorted FROM w)
SELECT doc_id, array_to_string(sorted, '|') AS in_order, list_sort(list_transform(ls, lambda x: {'d': abs(x - 5), 'x': x}))[1].x::INT AS nearest, len(list_distinct(ls))::INT AS labels,
array_to_string(list_transform(ls, lambda x: x::VARCHAR), ',') AS shown, length(sorted[1])::INT AS zipped, array_to_string(ws[2:4], '|') AS around, 3 AS nulls, 0 AS unequal, len(list_filter(list_transform(ws, lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL))::INT AS numbers FROM l"""
)
def list_functions(spark, sf):
    words = F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 9)
    rows = _docs(spark, sf).select("doc_id", words.alias("ws")).withColumn("ls", F.transform("ws", F.length))
    ws, ls = F.col("ws"), F.col("ls")
    index = col.sorted_index(ws)
    in_order = F.transform(F.array_sort(F.transform(F.map_entries(index), lambda e: F.struct(e["value"], e["key"]))), lambda e: e["key"])
    keys = F.array_sort(F.array_distinct(ws))
    return rows.select(
        "doc_id", F.array_join(in_order, "|").alias("in_order"), col.closest(ls, F.lit(5)).alias("nearest"), F.size(F.map_keys(col.label_map(ls))).alias("labels"),
        F.array_join(col.cast_all(ls, "string"), ",").alias("shown"), F.element_at(col.zip_map(keys, F.transform(keys, F.length)), keys[0]).alias("zipped"),
        F.array_join(col.window_of(ws, 1, F.lit(2), False), "|").alias("around"), F.size(col.nulls(3)).alias("nulls"), F.coalesce(F.size(F.map_keys(col.zip_map(F.array(F.lit(1)), F.array().cast("array<int>")))), F.lit(0)).cast("int").alias("unequal"),
        F.size(F.filter(col.array_of("LONG", ws), lambda x: x.isNotNull())).alias("numbers"),
    )


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'a0'), (3, 'a1'), (4, 'c')) t(place, name)")
def names_unique(spark, sf):
    return spark.createDataFrame(list(enumerate(col.unique_names(["a", "b", "a", "a", "c"]))), "place int, name string")


@query("SELECT 50::BIGINT AS n, 50::BIGINT AS different, 300::BIGINT AS drawn")
def rows_drawn(spark, sf):
    docs = _docs(spark, sf).select("doc_id")
    own = col.random_rows(docs, 50, 3)
    return own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("different")).crossJoin(col.random_rows(docs, 300, 3, replace=True).agg(F.count(F.lit(1)).alias("drawn")))


@query(
    """SELECT doc_id, '{' || CASE WHEN lang IS NULL THEN '' ELSE '''lang:STRING'' = ''' || lang || ''',' || chr(10) END || '''n:LONG'' = ''' || n_chars || ''',' || chr(10) || '''seen:BOOLEAN'' = ''true''' || CASE WHEN source IS NULL THEN '' ELSE ',' || chr(10) || '''source:STRING'' = ''' || source || '''' END || '}' AS shown,
'lang,n,seen,source' AS names, lang AS lang, true AS again, true AS has_n, 0 AS left_over FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"""
)
def record_functions(spark, sf):
    rows = _docs(spark, sf).where("lang is not null and source is not null")
    kinds = {"source": "STRING", "n": "LONG", "lang": "STRING"}
    rec = records.put(records.record({"source": F.col("source"), "n": F.col("n_chars"), "lang": F.col("lang")}, kinds), "seen", "BOOLEAN", F.lit(True))
    other = records.put(records.record({"lang": F.col("lang"), "n": F.col("n_chars"), "source": F.col("source")}, kinds), "seen", "BOOLEAN", F.lit(True))
    rows = rows.select("doc_id", rec.alias("a"), other.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "doc_id", records.text_of(a).alias("shown"), F.array_join(records.field_names(a), ",").alias("names"), records.get(a, "lang", "STRING").alias("lang"),
        (records.same(a, b) & (records.hash_of(a) == records.hash_of(b))).alias("again"), records.has_field(a, "n", "LONG").alias("has_n"), F.size(F.map_keys(records.cleared(a))).alias("left_over"),
    )
