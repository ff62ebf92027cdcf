"""Hand-sized cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.config import Settings, load, read_properties
from corpusmill.functions import collections as col
from corpusmill.functions import posclass, text
from corpusmill.functions.termset import ANY, EMPTY, TermSet, whole
from corpusmill.operators import datasets, lexicon, matrix, ranking, samples, spans, tokens
from corpusmill.plans import catalogue
from corpusmill.plans.corpus import Corpus


@pytest.fixture(scope="module")
def g1(spark):
    return spark.createDataFrame([(1, "the cat saw the dog", "x"), (2, "the dog ran", "y")], "doc_id long, text string, split_field string")


def cells(m):
    return {(r.i, r.j): r.x for r in m.collect()}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("from_stream", [False, True])
def test_lexicon(g1, from_stream):
    source = tokens.word_tokens(g1) if from_stream else tokens.word_lists(g1)
    rows = lambda k: sorted(tuple(r) for r in lexicon.lexicon(source, k).collect())
    assert rows(1) == [(0, "the", 3, 2), (1, "dog", 2, 2), (2, "cat", 1, 1), (3, "ran", 1, 1), (4, "saw", 1, 1)]
    assert rows(2) == [(0, "the", 3, 2), (1, "dog", 2, 2)]
    assert tuple(lexicon.coverage(source, 2).first()) == (8, 5, 0.625, 2)
    assert tuple(lexicon.coverage(source, 1).first()) == (8, 8, 1.0, 5)


@pytest.mark.parametrize("pre,pos,want", [(2, 2, {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 2.0}), (0, 1, {(0, 1): 1.0, (1, 0): 1.0}), (1, 0, {(0, 1): 1.0, (1, 0): 1.0}), (0, 0, {})])
def test_cooccurrence(spark, pre, pos, want):
    t = tokens.word_tokens(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"))
    assert cells(datasets.cooccurrence(t, lexicon.lexicon(t), pre, pos)) == want


def test_gap_is_kept(spark):
    t = tokens.word_tokens(spark.createDataFrame([(1, "a x a")], "doc_id long, text string"))
    lex = lexicon.lexicon(t, 2)
    assert cells(datasets.cooccurrence(t, lex, 2, 2)) == {(0, 0): 1.0}
    assert cells(datasets.cooccurrence(t, lex, 1, 1)) == {}


def test_sample_restricts_counts_only(g1):
    c = Corpus(g1, settings=Settings(min_term_freq=2, cooc_w_pre=2, cooc_w_pos=2))
    assert cells(c.cooc()) == {(0, 1): 2.0, (1, 0): 2.0}
    d2 = c.sample(F.col("doc_id") == 2)
    assert cells(c.cooc(d2)) == {(0, 1): 1.0, (1, 0): 1.0}
    dense = datasets.dense(c.freq(sample=d2), c.lexicon(), g1.select(F.col("split_field").alias("split")))
    assert {(r.idx, r.split): r.n for r in dense.collect()} == {(0, "x"): 0, (0, "y"): 1, (1, "x"): 0, (1, "y"): 1}
    with pytest.raises(ValueError):
        c.sample(terms=["x"], field="no_such_field")


def test_cooccurrence_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(6)
    t = tokens.word_tokens(docs).persist()
    lex = lexicon.lexicon(t, 2).persist()
    idx = {r.term: r.idx for r in lex.collect()}
    seq = {}
    for r in t.collect():
        seq.setdefault(r.doc_num, {})[r.pos] = idx.get(r.term)
    for pre, pos in ((10, 10), (2, 5), (0, 3), (3, 0)):
        want = {}
        for own in seq.values():
            for p, i in own.items():
                for q in range(p - pre, p + pos + 1):
                    if q != p and i is not None and own.get(q) is not None:
                        want[i, own[q]] = want.get((i, own[q]), 0) + 1 / abs(p - q)
        got = cells(datasets.cooccurrence(t, lex, pre, pos))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    a, b = (datasets.cooccurrence(t, lex, *w) for w in ((2, 5), (5, 2)))
    assert cells(a) == cells(matrix.transpose(b))


def test_nested_positions(spark):
    rows = [(1, "new york", 0, 8), (1, "new", 0, 3), (1, "york", 4, 8), (1, "city", 9, 13)]
    got = tokens.with_positions(spark.createDataFrame(rows, "doc_num long, term string, begin int, end int"))
    assert {r.term: r.pos for r in got.collect()} == {"new york": 0, "new": 0, "york": 1, "city": 2}
    lex = lexicon.lexicon(got)
    ids = {r.term: r.idx for r in lex.collect()}
    assert (ids["new york"], ids["york"]) in cells(datasets.cooccurrence(got, lex, 1, 1, stacked=True))


def test_empty_terms_leave_no_gap(spark):
    path = spans.type_path("Token")
    rows = [(1, "a", "Token", path, 0, 1), (1, "", "Token", path, 2, 2), (1, "b", "Token", path, 3, 4)]
    ann = spark.createDataFrame([(*r, None, "NN", None) for r in rows], "doc_num long, text string, type string, type_path array<string>, begin int, end int, lemma string, tag string, id string")
    got = tokens.stream(ann, tokens.TokenSpec("w", "Token", tokens.WordTokenizer()))
    assert {r.term: r.pos for r in got.collect()} == {"a": 0, "b": 1}
    got = tokens.stream(ann.where("text <> ''"), tokens.TokenSpec("w", "Token", tokens.WordTokenizer(add_class=True)))
    assert {r.term: r.pos for r in got.collect()} == {"NN_a": 0, "NN_b": 1}
    assert tokens.stream(ann, tokens.TokenSpec("w", "Token", tokens.WordTokenizer(excluded=("NN",)))).count() == 0
    assert {r.payload for r in tokens.stream(ann, tokens.TokenSpec("w", "Token", tokens.MergedTokenizer())).collect()} == {"NN"}


def test_pos_classes(spark):
    want = {"NN": "NN", "NNS": "NN", "NNP": "NP", "VBZ": "V", "MD": "V", "WRB": "ADV", "WDT": "ART", "PRP$": "PR", "TO": "PP", "SYM": "PUNC", "": "O", "XYZ": "O"}
    rows = spark.createDataFrame([(t,) for t in want], "tag string").select("tag", posclass.class_of(F.col("tag")).alias("c"))
    assert dict(map(tuple, rows.collect())) == want


def test_term_sets(spark):
    num = TermSet("NUM", patterns=("[0-9]+",))
    rows = spark.createDataFrame([("42",), ("42a",), ("",)], "t string")
    t = F.col("t")
    assert [tuple(r) for r in rows.select(num.rewrite(t), ANY.test(t), EMPTY.test(t)).collect()] == [("NUM", True, False), ("42a", True, False), ("", True, False)]
    both = num.followed_by(TermSet("A", terms=("a",)), "NA")
    assert [r[0] for r in rows.select(both.test(t)).collect()] == [False, True, False]
    for bad in ("a~b", "a&b", "@", "<1-5>"):
        with pytest.raises(ValueError):
            whole(bad)
    assert whole(r"a\~|[@&]")


def test_sample_algebra(spark):
    s = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_num long")
    ids = lambda df: [r[0] for r in samples.vector(df).collect()]
    u, a, b = s(1, 2, 3, 4), s(1, 2), s(2, 3)
    assert ids(samples.intersect(a, b)) == [2] and ids(samples.union(a, b)) == [1, 2, 3] and ids(samples.complement(u, a)) == [3, 4]
    assert ids(samples.add(a, 9)) == [1, 2, 9] and ids(samples.remove(a, 1)) == [2] and samples.size(a).first()[0] == 2


def test_spans(spark):
    seg = spark.createDataFrame([("d", 100, 0, 20), ("d", 101, 20, 40)], "doc_id string, ann_id long, begin int, end int")
    ann = spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 18, 22), ("d", 3, 20, 40)], "doc_id string, ann_id long, begin int, end int")
    for size in (4, 512):
        assert {(r.s_ann_id, r.m_ann_id) for r in spans.covered(seg, ann, size).collect()} == {(100, 1), (101, 3)}
        assert {(r.s_ann_id, r.c_ann_id) for r in spans.covering(ann, seg, size).collect()} == {(1, 100), (3, 101)}
    assert {r.ann_id for r in spans.connected(ann, seg.where("ann_id = 100")).collect()} == {1, 2, 3}
    assert {r.ann_id for r in spans.contained_by(ann, seg).collect()} == {1, 3}
    assert {r.ann_id for r in spans.containing(seg, ann).collect()} == {100, 101}


def test_cover_metadata_wins(spark):
    empty = F.create_map().cast("map<string,string>")
    seg = spark.createDataFrame([("d", 1, 0, 5)], "doc_id string, ann_id long, begin int, end int").withColumn("metadata", F.create_map(F.lit("k"), F.lit("segment"), F.lit("s"), F.lit("1")))
    docs = spark.createDataFrame([("d",)], "doc_id string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("doc"), F.lit("d"), F.lit("2")))
    covers = spark.createDataFrame([("d", 7, 0, 9, "outer"), ("d", 8, 0, 6, "inner")], "doc_id string, ann_id long, begin int, end int, v string").withColumn("metadata", F.create_map(F.lit("k"), F.col("v")))
    assert spans.inherited(seg, docs, covers).first()["metadata"] == {"k": "inner", "s": "1", "d": "2"}
    assert spans.inherited(seg, docs, covers.where("false").withColumn("metadata", empty)).first()["metadata"]["k"] == "segment"


def test_types_and_translation(spark):
    row = one(spark, spans.common_type(spans.path_column(F.lit("Segment")), spans.path_column(F.lit("Paragraph"))).alias("a"), spans.common_type(spans.path_column(F.lit("Mark")), spans.path_column(F.lit("Entity"))).alias("b"))
    assert tuple(row) == ("Segment", "Annotation")
    ann = spark.createDataFrame([("d", 1, "Document", spans.type_path("Document"), 0, 9, {"id": "7", "x": "y"})], "doc_id string, ann_id long, type string, type_path array<string>, begin int, end int, attrs map<string,string>")
    got = spans.translate(ann, "Document", "Entity", spans.DOCUMENT_NAMES, keep_source=False).collect()
    assert [(r.type, r.attrs) for r in got] == [("Entity", {"documentId": "7"})]
    assert spans.project_paths(ann, ["Document:x", "Segment:x"]).first()[2:] == ("y", None)
    with pytest.raises(ValueError):
        spans.require(ann, {"begin": "bigint"})


def test_text(spark):
    assert one(spark, text.collapse_blanks(F.lit("  a \n\n b\t c ")))[0] == "a b c "
    assert one(spark, text.readable_size(F.lit(1536)), text.base_name(F.lit("/a/b.c.txt")), text.extension(F.lit("/a/b.c.txt")), text.decode(F.lit("0x1"), "INTEGER")) == ("1.50 KB", "b.c", "txt", None)
    assert one(spark, text.surrounding(F.lit("abcdef"), F.lit(2), F.lit(3), 1))[0] == "bcd"
    ends = lambda a, b, c: one(spark, text.ends_no_sentence(F.lit(a), F.lit(b), F.lit(c)))[0]
    assert (ends("Esq", ".", "a"), ends("dog", ".", "a"), ends("dog", ".", "The"), ends("12s", ".", "x")) == ("YES", "NO", None, "YES")
    kinds = [one(spark, text.speech_kind(F.lit(x)))[0] for x in ("John Smith. I was there", "Before the judge. x", "Q Who? - A. Me", "Who? -A. Me", "nothing")]
    assert kinds == ["testimony", "none", "question", "answered", "none"]


def test_collections(spark):
    x = F.array(*map(F.lit, "pqr"))
    w = lambda at, fill=True: one(spark, col.window_of(x, 1, F.lit(at), fill))[0]
    assert (w(0), w(2), w(0, False)) == ([None, "p", "q"], ["q", "r", None], ["p", "q"])
    n = F.array(*map(F.lit, (9, 4, 1)))
    assert one(spark, col.closest(n, F.lit(6)), col.zip_map(x, n), col.sorted_index(x), F.size(col.nulls(2)), col.cast_all(n, "double"), col.label_map(n)) == (4, {"p": 9, "q": 4, "r": 1}, {"p": 0, "q": 1, "r": 2}, 2, [9.0, 4.0, 1.0], {"9": 9, "4": 4, "1": 1})
    assert col.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a0", "a1"]
    rows = spark.range(50)
    assert col.random_rows(rows, 5, 1).count() == 5 and col.random_rows(rows, 70, 1, True).count() == 70
    with pytest.raises(ValueError):
        col.random_rows(rows, 51, 1)
    assert sorted(r.n for r in ranking.row_numbers(rows.repartition(7), "n").collect()) == list(range(50))


def test_matrix(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (2, 0, 3.0)], "i long, j long, x double")
    assert cells(matrix.merge(m, m)) == {(0, 1): 2.0, (2, 0): 6.0}
    assert tuple(matrix.shape(m).first()) == (2, 2, 2, 1) and tuple(matrix.shape(m.where("false")).first()) == (0, 0, -1, -1)
    assert [a.tolist() for a in matrix.arrays(m)] == [[0, 2], [1, 0], [1.0, 3.0]]


def test_settings(tmp_path):
    (tmp_path / "base.properties").write_text("# x\ncorpus.min_term_freq = 7\nother.cooc_w_pre = 1\nquiet = true\nannotators = a, b\n")
    assert read_properties(str(tmp_path / "base.properties"), "corpus") == {"min_term_freq": "7", "quiet": "true", "annotators": "a, b"}
    s = load(str(tmp_path), namespace="corpus", home="/h")
    assert (s.min_term_freq, s.quiet, s.annotators, s.cooc_w_pre, s.folder("index_dir")) == (7, True, ("a", "b"), 10, "/h/data/index")
    with pytest.raises(ValueError):
        Settings().with_values({"nothing": "1"})


def test_sizes_of_all_documents(spark, tmp_path):
    sizes = [None, 0, 1023, 1024, 1536, 999_999, 1_000_000, 1024**2 - 1, 1024**2, 3 * 1024**2 // 2, 1024**3, 1024**4, 5 * 1024**4]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.size_0 for r in catalogue.readable_sizes(spark, str(tmp_path)).collect()}
    want = [None, "0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "976.56 KB", "976.56 KB", "1024.00 KB", "1.00 MB", "1.50 MB", "1.00 GB", "1.00 TB", "5.00 TB"]
    assert got == dict(enumerate(want))


def test_props_are_decoded(spark):
    rows = catalogue.decoded_values(spark, "/root/testdata/sf0.001")
    assert rows.where("n is not null").count() == rows.count() > 0
