"""Sources, sinks, markup, the segment index, jobs from settings, and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.operators import lexicon, spans, tokens
from corpusmill.operators.indexing import index_segments
from corpusmill.plans.corpus import Corpus
from corpusmill.plans.pipeline import Pipeline
from corpusmill.sources import files, markup, sinks
from corpusmill.streaming import index as streaming

MAPPING = markup.Mapping(types={"doc": "Document", "name": "Entity"}, breaks=frozenset({"p"}), marks=frozenset({"lb"}), features={"name": {"key": "id"}}, split=lambda before, after: True)
XML = '<doc n="1"><p>The  <name key="k1">old\n dog</name> ran.</p><p></p><p>New<lb/>line</p></doc>'


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_delimited_files(spark, tmp_path):
    g1 = spark.createDataFrame([(1, "the cat saw the dog", "x"), (2, "the dog ran", "y")], "doc_id long, text string, split_field string")
    c = Corpus(g1, settings=Settings(min_term_freq=2, cooc_w_pre=2, cooc_w_pos=2))
    c.dump(str(tmp_path))
    assert lines(spark, f"{tmp_path}/lxcn.dsv") == ["_term_@df@tf", "the@2@3", "dog@2@2"]
    assert lines(spark, f"{tmp_path}/freq.dsv") == ["_term_@x@y", "the@2@1", "dog@1@1"]
    assert {(r.i, r.j): r.x for r in sinks.read_matrix(spark, f"{tmp_path}/cooc.bin").collect()} == {(0, 1): 2.0, (1, 0): 2.0}
    cells = spark.createDataFrame([("b", "y", 1), ("a", "x", 2)], "r string, c string, v int")
    sinks.write_dsv(sinks.wide_table(cells, "r", "c", "v"), f"{tmp_path}/wide", "r", row_head="id", sep=";", missing="-")
    assert lines(spark, f"{tmp_path}/wide") == ["id;x;y", "a;2;-", "b;-;1"]


def test_plain_matrix_file(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(sinks.matrix_bytes([(2, 0, 3.0), (0, 1, 0.5)]))
    assert np.fromfile(tmp_path / "m.bin", sinks.TRIPLET)["i"].tolist() == [0, 2]
    assert sorted(map(tuple, sinks.read_matrix_file(spark, str(tmp_path / "m.bin")).collect())) == [(0, 1, 0.5), (2, 0, 3.0)]


def test_file_scans(spark, tmp_path):
    for name in ("a.txt", "b.TXT", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert files.list_files(spark, str(tmp_path), recursive=True, suffix=".txt").count() == 3
    assert {r.name for r in files.list_files(spark, str(tmp_path), "a*").collect()} == {"a.txt"}
    assert [bytes(r.content) for r in files.read_files(spark, str(tmp_path), recursive=True, stop_after=1).collect()] == [b"a.txt"]
    assert files.read_files(spark, str(tmp_path), recursive=True, sample=2, seed=4).count() == 2
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path), stop_after=9)
    assert files.delta_path("/x/y/d.xml", 2) == "/x/2/d.xml"
    base = spark.createDataFrame([("a", "0"), ("b", "0")], "doc_id string, text string")
    deltas = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "9", 3), ("c", "1", 0)], "doc_id string, text string, delta_no int")
    assert {tuple(r) for r in files.with_deltas(base, deltas).collect()} == {("a", "2"), ("b", "0")}
    with pytest.raises(ValueError):
        files.terms(base, "nothing")


def test_xml(spark):
    rows = spark.createDataFrame([("f", XML), ("g", "<doc><p>open</doc>"), ("f", XML)], "k string, x string")
    docs, ann, rejects = markup.split_tables(markup.read_markup(rows, "k", "x", MAPPING, "xml"))
    assert sorted(r.doc_id for r in docs.collect()) == ["f", "f-1"] and [r.doc_id for r in rejects.collect()] == ["g"]
    text = docs.first()["text"]
    assert text == "The old dog ran.\nNew line\n"
    found = {(r.type, text[r.begin : r.end], r.id) for r in ann.where("doc_id = 'f'").collect()}
    assert found == {("Document", text, None), ("Entity", "old dog", "k1"), ("Paragraph", "The old dog ran.\n", "0"), ("Paragraph", "New line\n", "1"), ("Mark", "", None)}
    paths = {r.type: r.attrs.get("xpath") for r in ann.where("doc_id = 'f'").collect()}
    assert paths["Entity"] == "/f/p[1]/name[1]"
    parts = markup.read_markup(spark.createDataFrame([("f", XML)], "k string, x string"), "k", "x", MAPPING, "xml", "//p")
    assert sorted(r.doc_id for r in parts.collect()) == ["f-p-1", "f-p-2", "f-p-3"]


def test_html_is_tolerant(spark):
    m = markup.Mapping(types={"b": "Span"}, breaks=frozenset({"p"}))
    rows = spark.createDataFrame([(1, "<p>a <b>b<p>c</b> d<script>'</p>'</script><br>e"), (2, None), (3, "")], "id long, h string")
    got = {r.doc_id: r for r in markup.read_markup(rows, "id", "h", m).collect()}
    assert got["1"].text.replace("\n", "|").startswith("a b") and "</p>" not in got["1"].text and got["2"].text == got["3"].text == ""
    assert all(0 <= a.begin <= a.end <= len(got["1"].text) for a in got["1"].annotations)


def test_index_and_job(spark, tmp_path):
    (tmp_path / "data/input").mkdir(parents=True)
    (tmp_path / "data/input/f.xml").write_text(XML)
    (tmp_path / "data/input/bad.xml").write_text("<doc>")
    s = Settings(home_dir=str(tmp_path), reader="xml", consumer="index", dump_conf=True)
    specs = [tokens.TokenSpec("names", "Entity", tokens.SpanTokenizer()), tokens.TokenSpec("raw", "Entity", tokens.TextTokenizer())]
    job = Pipeline(s, specs, MAPPING)
    job.run(spark)
    segments, stream = sinks.read_index(spark, s.folder("index_dir"))
    assert segments.count() == 2 and {(r.field, r.term, r.begin, r.payload) for r in stream.collect()} == {("names", "k1", 4, "Entity"), ("raw", "old dog", 4, "Entity")}
    assert {r.metadata["doc_id"] for r in segments.collect()} == {"f"} and job.rejects.count() == 1
    writer = sinks.IndexWriter(s.folder("index_dir"), update=True, wipe=False)
    writer.compact(spark, 1)
    stream = sinks.read_index(spark, s.folder("index_dir"))[1]
    assert stream.count() == 2
    assert lexicon.lexicon(stream.where("field = 'names'")).first()["term"] == "k1"
    with pytest.raises(ValueError):
        sinks.IndexWriter("x", update=True, wipe=True)
    with pytest.raises(ValueError):
        index_segments(segments, segments, [])
    with pytest.raises(ValueError):
        Pipeline(Settings(home_dir=str(tmp_path), reader="xml", on_error="terminate"), specs, MAPPING).run(spark)


def test_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a\nb")], "doc_id string, text string")
    ann = spans.paragraphs(docs)
    sinks.write_documents(docs, ann, str(tmp_path))
    a, b = sinks.read_documents(spark, str(tmp_path))
    assert a.collect() == docs.collect() and sorted(b.collect()) == sorted(ann.collect())
    sinks.write_xml(docs.select("doc_id", F.lit("x").alias("t")), f"{tmp_path}/xml")
    assert sinks.read_xml(spark, f"{tmp_path}/xml", "document").first()["t"] == "x"


def test_stream_appends_once(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, text string"
    for k in range(2):
        spark.createDataFrame([(k, f"a b w{k}")], schema).write.mode("append").parquet(source)
        streaming.append_tokens(spark, source, schema, index).awaitTermination()
        assert streaming.read_tokens(spark, index).count() == 3 * (k + 1)
    streaming.append_tokens(spark, source, schema, index).awaitTermination()
    assert streaming.read_tokens(spark, index).count() == 6
    for _ in range(2):
        streaming.running_counts(spark, source, schema, f"{tmp_path}/counts").awaitTermination()
        assert {r.term: r.tf for r in streaming.read_counts(spark, f"{tmp_path}/counts").collect()} == {"a": 2, "b": 2, "w": 2}
