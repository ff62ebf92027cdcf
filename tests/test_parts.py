"""Hand-sized cases of the façade on an index, markup, files, records, settings and shared resources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.functions import collections as col
from corpusmill.functions import records, text
from corpusmill.operators import datasets, lexicon, samples, spans, tokens
from corpusmill.plans.corpus import Corpus
from corpusmill.plans.pipeline import Pipeline
from corpusmill.plans.progress import Progress, Shared
from corpusmill.sources import markup, sinks


def test_shared_positions(spark):
    """New York city: the greatest of the terms at one place counts, as in an index with nested tokens."""
    docs = spark.createDataFrame([(1, "new york city")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, "new york", 0, 8), (1, "new", 0, 3), (1, "york", 4, 8), (1, "city", 9, 13)], "doc_num long, term string, begin int, end int")
    placed = tokens.with_positions(rows)
    assert {(r.term, r.pos) for r in placed.collect()} == {("new york", 0), ("new", 0), ("york", 1), ("city", 2)}
    corpus = Corpus(docs, placed, Settings(min_term_freq=1))
    name = {r.idx: r.term for r in corpus.lexicon().collect()}
    got = {(name[r.i], name[r.j]): r.x for r in corpus.cooc().collect()}
    assert got == {("new york", "york"): 1, ("york", "new york"): 1, ("york", "city"): 1, ("city", "york"): 1, ("new york", "city"): 0.5, ("city", "new york"): 0.5}


def test_fields_of_an_index(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, "a", "text_field"), (1, 0, "a", "other")], "doc_num long, pos int, term string, field string")
    assert Corpus(docs, rows, Settings(min_term_freq=1)).lexicon().first()["tf"] == 1
    assert Corpus(docs, rows.where("field = 'other'"), Settings(min_term_freq=1)).lexicon().first()["tf"] == 1
    with pytest.raises(ValueError):
        Corpus(docs, rows, Settings(field_txt="none"))


def test_wide_windows(spark):
    rng = np.random.default_rng(4)
    terms = [f"t{x}" for x in rng.integers(0, 5, 90)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(terms)], "doc_num long, pos int, term string")
    lex = lexicon.lexicon(rows)
    idx = {r.term: r.idx for r in lex.collect()}
    want = {}
    for p, a in enumerate(terms):
        for q in range(max(0, p - 40), min(len(terms), p + 31)):
            if q != p:
                want[idx[a], idx[terms[q]]] = want.get((idx[a], idx[terms[q]]), 0) + 1 / abs(p - q)
    got = {(r.i, r.j): r.x for r in datasets.cooccurrence(rows, lex, 40, 30).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    narrow = {(r.i, r.j): r.x for r in datasets.cooccurrence(rows, lex, 5, 3).collect()}
    wide = {(r.i, r.j): r.x for r in datasets._by_distance(_pairs(rows, lex, 5), F.col("pos") - F.col("p"), 5, 3).collect()}
    assert narrow.keys() == wide.keys() and all(abs(narrow[k] - wide[k]) < 1e-9 for k in wide)


def _pairs(rows, lex, width):
    x = lexicon.with_idx(rows, lex).select(F.col("pos").alias("p"), F.col("idx").alias("a"))
    y = lexicon.with_idx(rows, lex).select("pos", "idx")
    return x.join(y, (F.col("pos") > F.col("p")) & (F.col("pos") - F.col("p") <= width))


def test_dictionary_of_like_values(spark):
    rows = spark.createDataFrame([(f"http://same.host/{i:04d}",) for i in range(500)][::-1], "url string")
    got = {r.value: r.key for r in samples.dictionary(rows, "url").collect()}
    assert got == {f"http://same.host/{i:04d}": i for i in range(500)}


def test_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(datasets, "MAX_COLUMNS", 3)
    rows = spark.createDataFrame([(str(i),) for i in range(4)], "split string")
    with pytest.raises(ValueError):
        datasets.column_values(rows, "split")


def test_absolute_paths(spark):
    xml = "<doc><p>one</p>tail<p>two<q>three</q></p></doc>"
    rows = spark.createDataFrame([("f", xml)], "k string, x string")
    texts = lambda path: [r.text for r in markup.read_markup(rows, "k", "x", markup.Mapping(), "xml", path).orderBy("index").collect()]
    assert texts("/doc/p") == ["one", "twothree"] and texts("//q") == ["three"]
    assert texts("/doc") == texts("/*") == ["onetailtwothree"] and texts("/p") == []
    with pytest.raises(ValueError):
        texts("/doc[")


def test_ids_that_look_numbered(spark):
    rows = spark.createDataFrame([("vol-1", "<d/>"), ("vol-2", "<d/>"), ("a", "<d>1</d>"), ("a", "<d>2</d>"), ("a-1", "<d>3</d>")], "k string, x string")
    docs = markup.split_tables(markup.read_markup(rows, "k", "x", markup.Mapping(), "xml"))[0].collect()
    assert len({r.doc_id for r in docs}) == 5 and all(r.is_last for r in docs)
    assert {r.text for r in docs if r.doc_id == "a-1"} == {"3"}


def test_speech(spark):
    said = ["before Recorder. he spoke", "Before Recorder. he spoke", "Mr. Smith. I saw it", "Ann Lee, a w. I was there", "1 Q. who - A. me", "who was it? -A. me", "nothing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    kinds = [r.k for r in rows.select("i", text.speech_kind(F.col("t")).alias("k")).orderBy("i").collect()]
    assert kinds == ["none", "none", "testimony", "testimony", "question", "answered", "none"]
    parts = {}
    for r in rows.select("i", F.inline(text.speech_parts(F.col("t"), F.lit(100)))).collect():
        parts[r.i, r.part] = said[r.i][r.begin - 100 : r.end - 100]
    assert parts == {
        (2, "prefix"): "Mr. ", (2, "speaker"): "Mr. Smith", (2, "testimony"): " I saw it",
        (3, "speaker"): "Ann Lee", (3, "descriptor"): ", a w", (3, "testimony"): " I was there",
        (4, "question"): "who ", (4, "answer"): " me", (5, "question"): "who was it", (5, "answer"): " me",
    }
    assert rows.select(text.verbatim(F.lit("a  b"), F.lit(True)).alias("v")).first().v == "a  b\n"


def test_records(spark):
    row = spark.range(1).select(records.record({"b": F.lit("x"), "a": F.lit(1)}, {"b": "STRING", "a": "INT"}).alias("r"))
    got = row.select(records.text_of(F.col("r")).alias("t"), records.fields(F.col("r")).alias("f"), F.size(records.data(F.col("r"))).alias("n")).first()
    assert got.t == "{'a:INT' = '1',\n'b:STRING' = 'x'}" and got.f == ["a:INT", "b:STRING"] and got.n == 2
    with pytest.raises(Exception, match="is null"):
        row.select(records.put(F.col("r"), "c", "INT", F.lit(None)).alias("r")).collect()
    assert col.is_array(spark.createDataFrame([([1],)], "x array<int>"), "x") and not col.is_array(row, "r")


def test_files_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "k string, t string")
    for _ in range(2):
        sinks.write_files(rows, str(tmp_path / "x"), "k", "t", overwrite=False)
    assert sorted(p.name for p in (tmp_path / "x").iterdir() if p.suffix == ".data") == ["a-1.data", "a-2.data", "a-3.data", "a.data", "b-1.data", "b.data"]
    assert sinks.clear_files(spark, str(tmp_path), "a*", True) >= 4
    assert [p.name for p in (tmp_path / "x").iterdir() if p.suffix == ".data" and p.name[0] == "a"] == []


def test_index_recovers(spark, tmp_path):
    index = str(tmp_path / "index")
    seg = spark.createDataFrame([(1, "d")], "doc_num long, doc_id string")
    tok = spark.createDataFrame([(1, "f", "t")], "doc_num long, field string, term string")
    writer = sinks.IndexWriter(index)
    writer.write(seg, tok)
    (tmp_path / "index/tokens").rename(tmp_path / "index/.tokens-old")  # stopped before the new files were in place
    writer.compact(spark, 1)
    assert sinks.read_index(spark, index)[1].count() == 1 and sorted(p.name for p in (tmp_path / "index").iterdir()) == ["segments", "tokens"]


def test_writers_of_a_job(spark, tmp_path):
    (tmp_path / "data/input").mkdir(parents=True)
    (tmp_path / "data/input/f.xml").write_text("<doc><p>one</p><p>two</p></doc>")
    base = Settings(home_dir=str(tmp_path), reader="xml", consumer="write", quiet=True)
    spec = [tokens.TokenSpec("raw", "Entity", tokens.TextTokenizer())]
    for form in ("text", "xml", "parquet"):
        s = base.with_values({"writer": form, "output_dir": form, "writer.ext": "md"})
        Pipeline(s, spec, xpath="/doc/p").run(spark)
        if form == "text":
            assert sorted((p.name, p.read_text()) for p in (tmp_path / "data/text").iterdir() if p.suffix == ".md") == [("f-doc-p-1.md", "one"), ("f-doc-p-2.md", "two")]
        elif form == "xml":
            assert {r.text for r in sinks.read_xml(spark, s.folder("output_dir"), "document").collect()} == {"one", "two"}
        else:
            assert sinks.read_documents(spark, s.folder("output_dir"))[0].count() == 2
    with pytest.raises(ValueError):
        Pipeline(base.with_values({"writer": "none"}), spec).run(spark)


def test_settings_of_parts(tmp_path):
    s = Settings().with_values({"min_term_freq": "3", "reader.glob": "*.xml", "x.words": "a, b", "x.sizes": "k:1,l:2"})
    assert s.min_term_freq == 3 and s.parameters("reader") == {"glob": "*.xml"}
    assert s.get_list("x.words") == ["a", "b"] and s.get_map("x.sizes", int) == {"k": 1, "l": 2} and s.get_other("none", default=4) == 4
    with pytest.raises(ValueError):
        Settings().with_values({"none": "1"})


def test_progress_and_shared():
    told, log = [], []
    p = Progress("job", 40, tell=told.append)
    for _ in range(40):
        p.add()
    assert len(told) == 21 and told[-1] == "job: 40 of 40 (100 %)"
    Progress("job", 4, quiet=True, tell=told.append).add(4)
    assert len(told) == 21
    shared = Shared(lambda: log.append("open") or 7, lambda x: log.append(x))
    with shared as a, shared as b:
        assert a == b == 7
    assert log == ["open", 7]


def test_features(spark):
    docs = spark.createDataFrame([("d", "one\ntwo")], "doc_id string, text string")
    rows = spans.paragraphs(docs).withColumn("attrs", F.create_map(F.lit("k"), F.lit("v")))
    assert {r.path for r in spans.discovered_paths(rows).collect()} == {"Span:id", "Segment:level", "Paragraph:k"}
    assert "Annotation:begin" in {r.path for r in spans.discovered_paths(rows, True).collect()}


def test_packed_cells(spark, monkeypatch):
    """Sums of pairs from word lists and from tokens against loops: through many small sums and ranges, in order if wanted, with
    documents that recur or have no number, and parts of a corpus added up."""
    from corpusmill.operators import cells, matrix

    for name, n in (("PAIRS", 64), ("SUMS", 50), ("ROWS", 7), ("RANGE", 100)):
        monkeypatch.setattr(cells, name, n)
    rng = np.random.default_rng(8)
    texts = [(d, " ".join(f"{'abcdefghijklmnopq'[min(16, x)]}" for x in rng.geometric(0.2, rng.integers(0, 60)))) for d in [*range(12), 3, None]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for rows in (docs.where("doc_id <> 3"), docs):  # a document that comes twice is one
        lists = tokens.word_lists(rows)
        lex = lexicon.lexicon(lists, 2)
        idx = {r.term: r.idx for r in lex.collect()}
        of = {}
        for r in rows.collect():
            of.setdefault(r.doc_id, []).extend((p, idx[t]) for p, t in enumerate(r.text.split()) if t in idx)
        for before, after in ((10, 10), (2, 5), (5, 0), (30, 25)):
            want = {}
            for d, own in of.items():
                for p, a in own if d is not None else ():
                    for q, b in own:
                        if p - before <= q <= p + after and p != q:
                            want[a, b] = want.get((a, b), 0) + 1 / abs(p - q)
            for source in (lists, tokens.from_lists(lists)):
                for ordered in (False, True):
                    got = [((r.i, r.j), r.x) for r in datasets.cooccurrence(source, lex, before, after, ordered=ordered).collect()]
                    assert len(got) == len(want) and all(abs(x - want[k]) < 1e-9 for k, x in got)
                    assert not ordered or got == sorted(got)
    parts = [datasets.cooccurrence(lists, lex, 3, 1, docs.where(c).select(F.col("doc_id").alias("doc_num"))) for c in ("doc_id < 5", "doc_id >= 5")]
    whole = {(r.i, r.j): r.s for r in datasets.cooccurrence(lists, lex, 3, 1).collect()}
    added = matrix.merge(*parts, value="s")
    assert {(r.i, r.j): r.s for r in added.collect()} == whole
    assert {(r.i, r.j): r.s for r in matrix.merge(*(p.select("*") for p in parts), value="s").collect()} == whole


def test_ordered_matrix_is_written_as_it_comes(spark, tmp_path):
    """Triplets and files of a matrix that comes in order need no sort of their own."""
    from corpusmill.operators import matrix

    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcacbadcb")], "doc_num long, pos int, term string")
    cells = datasets.cooccurrence(rows, lexicon.lexicon(rows), 3, 3, ordered=True)
    assert "Sort" not in matrix.triplets(cells)._jdf.queryExecution().logical().toString()
    sinks.write_matrix(cells, f"file://{tmp_path}/m")
    got = [tuple(r) for r in sinks.read_matrix(spark, f"file://{tmp_path}/m").collect()]
    assert sorted(got) == [(r.i, r.j, r.x) for r in cells.collect()] and got


def test_markup_workers_hold_a_portion(spark, monkeypatch):
    """A worker returns parsed documents some at a time, with a bounded number of annotations and characters."""
    from corpusmill.sources.markup import Mapping, _portions, read_markup

    found = [{"annotations": [{}] * 5, "text": "x" * 10} for _ in range(100)]
    monkeypatch.setattr(markup, "ANNOTATIONS_AT_ONCE", 24)
    assert [len(x) for x in _portions(iter(found))] == [4] * 25
    monkeypatch.setattr(markup, "CHARS_AT_ONCE", 20)
    assert sum(map(len, _portions(iter(found)))) == 100 and max(map(len, _portions(iter(found)))) == 2
    rows = spark.createDataFrame([(i, f"<p a='{i}' b=''>t{i}</p>" if i % 3 else None) for i in range(40)], "k long, c string").coalesce(1)
    got = read_markup(rows, "k", "c", Mapping(types={"p": "Segment"})).collect()
    assert sorted(int(r.doc_id) for r in got) == list(range(40))
    assert all(r.annotations[0].attrs == {"a": r.doc_id, "b": "", "xpath": f"/{r.doc_id}"} and r.text == f"t{r.doc_id}" for r in got if int(r.doc_id) % 3)
    assert all(r.annotations == [] and r.text == "" and r["index"] == 1 for r in got if int(r.doc_id) % 3 == 0)


def test_words_stay_with_their_document(spark):
    """Words, paragraphs and their pairs are dealt by document once: texts are, not words."""
    docs = spark.createDataFrame([(i, "a bc\n\nd  efg\n" * 80) for i in range(9)] + [(None, "x y"), (50, None)], "doc_id long, text string")
    words = tokens.word_spans(docs).select(F.col("doc_num").alias("doc_id"), (F.col("pos") + 1_000_000).alias("ann_id"), "begin", "end", "surface")
    pairs = spans.covered(spans.paragraphs(docs).select("doc_id", "ann_id", "begin", "end"), words)
    rows = pairs.groupBy("doc_id", "s_ann_id").agg(F.array_sort(F.collect_list("m_surface")).alias("x"))
    found = rows.collect()
    assert len(found) == 9 * 160 and {tuple(r.x) for r in found} == {("a", "bc"), ("d", "efg")}
    plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()  # before it runs
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the texts of both sides
    by_type = spans.listed_by_types(pairs.withColumn("m_type_path", F.array(F.lit("Token"))), ["Entity", "Token"]).collect()
    assert {(r.of_type, r.n, len(r.ids)) for r in by_type} == {("Entity", 0, 0), ("Token", 2, 2)} and len(by_type) == 2 * 9 * 160


def test_index_cuts_long_texts(spark):
    """Covered texts of long documents, also beyond one piece and outside of the basic plane; tokens of a compacted index, by field."""
    from corpusmill.operators.indexing import index_segments

    texts = {1: "".join(f"w{i}\U0001f600é " for i in range(900)), 2: "x" * 1300, 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = lambda kind: F.array(*map(F.lit, spans.type_path(kind)))
    marks = [(1, 5, 500, 530), (1, 6, 1020, 2100), (1, 7, 3, 3), (2, 5, 511, 1300)]
    rows = spark.createDataFrame(marks + [(d, 1, 0, len(t or "")) for d, t in texts.items()], "doc_id long, ann_id long, begin int, end int")
    kind = F.when(F.col("ann_id") == 1, "Paragraph").otherwise("Mark")
    rows = rows.withColumn("type", kind).withColumn("type_path", F.when(F.col("ann_id") == 1, path("Paragraph")).otherwise(path("Mark")))
    rows = rows.select("*", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("level"), F.create_map().cast("map<string,string>").alias("attrs"))
    specs = [tokens.TokenSpec("a", "Mark", tokens.TextTokenizer()), tokens.TokenSpec("b", "Mark", tokens.TextTokenizer())]
    _, found = index_segments(docs, rows, specs, members=["Mark"])
    want = sorted((texts[d][b:e], b, e) for d, _, b, e in marks if e > b)
    for name in "ab":
        assert sorted((r.term, r.begin, r.end) for r in found.where(F.col("field") == name).collect()) == want


def test_arrivals_of_large_tables(spark, monkeypatch):
    """Files that arrive are of a bounded size, whatever the table's, and all of them are counted."""
    from corpusmill.plans import catalogue, catalogue_parts

    sf = "/root/testdata/sf0.001"
    assert catalogue_parts._arrivals(spark, sf)[2] == 1
    monkeypatch.setattr(catalogue_parts, "ARRIVED_BYTES", 20_000)
    folder, _, at_once = catalogue_parts._arrivals(spark, sf)
    size = spark.read.parquet(folder).groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert at_once > 3 and len(size) > 2 * at_once and sorted(r.n for r in size)[len(size) // 2] < 40_000
    want = catalogue._tokens(spark, sf).count()
    assert catalogue.queries()["stream_tokens"](spark, sf).count() == want
    assert catalogue.queries()["stream_counts"](spark, sf).agg(F.sum("tf")).first()[0] == want
