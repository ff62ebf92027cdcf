"""All queries of the corpus engine, by name, with the SQL that checks them.

The corpus is `documents`: a document's tokens are its maximal runs of letters in lower case. The data have no
part-of-speech tags; TAG is a rule on the token that stands in for a tagger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import collections as col
from corpusmill.functions import posclass, text
from corpusmill.functions.termset import TermSet
from corpusmill.operators import datasets, lexicon, matrix, samples, spans, tokens
from corpusmill.sources import files, markup

MIN_TF = 5
TAG = """CASE WHEN term IN ('the', 'a', 'an', 'le', 'la', 'der', 'die', 'el') THEN 'DT' WHEN term IN ('and', 'et', 'und', 'y') THEN 'CC'
  WHEN term LIKE '%ly' THEN 'RB' WHEN term LIKE '%ing' THEN 'VBG' WHEN term LIKE '%ed' THEN 'VBD' WHEN length(term) = 1 THEN 'SYM'
  WHEN length(term) = 2 THEN 'IN' WHEN term LIKE '%s' THEN 'NNS' WHEN length(term) % 5 = 0 THEN 'JJ' WHEN length(term) % 7 = 0 THEN 'XYZ' ELSE 'NN' END"""

TOK = r"""tok AS (
  SELECT doc_id, lang, source, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS ws FROM documents))"""


def _lex(k: int) -> str:
    return f"""lex AS (
  SELECT row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, term, tf, df
  FROM (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY term HAVING count(*) >= {k}))"""


PARAS = r"""lines AS (
  SELECT doc_id, length(t) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k
  FROM (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))),
offsets AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM lines),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ann_id, (stop - length(line) - 1)::INT AS b, least(stop, n)::INT AS e
  FROM offsets WHERE line <> '')"""
WORDS = r"""ws AS (
  SELECT doc_id, unnest(w) AS surface, generate_subscripts(w, 1) - 1 AS pos, unnest(g[1:len(w)]) AS gap
  FROM (SELECT doc_id, regexp_extract_all(t, '\p{L}+') AS w, regexp_split_to_array(t, '\p{L}+') AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))),
words AS (
  SELECT doc_id, pos, surface, (stop - length(surface))::INT AS b, stop::INT AS e
  FROM (SELECT *, sum(length(gap) + length(surface)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM ws))"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _lists(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return tokens.word_lists(files.spread(_docs(spark, sf).select("doc_id", "text", *keep)), keep=keep)


def _tokens(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return tokens.from_lists(_lists(spark, sf, *keep))


def _lexicon(spark: SparkSession, sf: str, min_tf: int = MIN_TF) -> DataFrame:
    return lexicon.joinable(lexicon.lexicon(_lists(spark, sf), min_tf))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).withColumn("payload", F.expr(TAG))


def _word_annotations(spark: SparkSession, sf: str) -> DataFrame:
    rows = tokens.word_spans(_docs(spark, sf)).withColumnRenamed("doc_num", "doc_id")
    path = F.array(*map(F.lit, spans.type_path("Token")))
    return rows.select("doc_id", F.col("pos").cast("long").alias("ann_id"), F.lit("Token").alias("type"), path.alias("type_path"), "begin", "end", "surface")


def _paragraph_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.paragraphs(_docs(spark, sf)).select("doc_id", "ann_id", "begin", "end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# lexicon


@query(f"WITH {TOK}, {_lex(1)} SELECT * FROM lex")
def lexicon_all(spark, sf):
    return lexicon.lexicon(_lists(spark, sf))


QUERIES["lexicon"], SQL["lexicon"] = QUERIES.pop("lexicon_all"), SQL.pop("lexicon_all")


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT * FROM lex")
def lexicon_min5(spark, sf):
    return lexicon.lexicon(_lists(spark, sf), MIN_TF)


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT * FROM lex")
def lexicon_of_stream(spark, sf):
    return lexicon.lexicon(_tokens(spark, sf), MIN_TF)


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT u AS u_freq, n AS n_freq, n / u AS cover, s AS size FROM (SELECT (SELECT count(*) FROM tok) AS u, sum(tf)::BIGINT AS n, count(*) AS s FROM lex)")
def lexicon_stats(spark, sf):
    return lexicon.coverage(_lists(spark, sf), MIN_TF)


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, term, tf FROM lex WHERE idx IN (0, 10, 100, 1000) OR term IN ('the', 'und', 'no such word')")
def lexicon_lookup(spark, sf):
    lex = lexicon.lexicon(_lists(spark, sf), MIN_TF)
    return lex.where(F.col("idx").isin(0, 10, 100, 1000) | F.col("term").isin("the", "und", "no such word")).select("idx", "term", "tf")


@query(r"""WITH b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark), """ + f"{TOK}, {_lex(MIN_TF)} SELECT item_id, count(*) AS known FROM b JOIN lex USING (term) GROUP BY item_id")
def lexicon_members(spark, sf):
    items = tokens.word_tokens(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    return lexicon.members(items, _lexicon(spark, sf)).groupBy(F.col("doc_num").alias("item_id")).agg(F.count(F.lit(1)).alias("known"))


@query(f"WITH {TOK} SELECT doc_id AS doc_num, pos::INT AS pos FROM tok WHERE term = 'the' AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def postings(spark, sf):
    sample = samples.by_terms(_docs(spark, sf), "lang", ["en"], "doc_id")
    return lexicon.postings(_tokens(spark, sf), "the", sample).select("doc_num", "pos")


# samples


@query("SELECT doc_id AS doc_num FROM documents WHERE lang = 'fr'")
def sample_term(spark, sf):
    return samples.by_terms(_docs(spark, sf), "lang", ["fr"], "doc_id")


@query("SELECT doc_id AS doc_num FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def sample_terms(spark, sf):
    return samples.by_terms(_docs(spark, sf), "source", ["src1", "src3", "src5"], "doc_id")


@query("SELECT doc_id AS doc_num FROM documents WHERE regexp_full_match(source, 'src1[0-9]?')")
def sample_regex(spark, sf):
    return samples.by_regex(_docs(spark, sf), "source", "src1[0-9]?", "doc_id")


@query("SELECT d.doc_id AS doc_num FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.n_chars > 1000 GROUP BY 1")
def sample_expr(spark, sf):
    rows = _docs(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return samples.by_expr(rows, (F.col("quality") == 1) & (F.col("n_chars") > 1000), "doc_id")


@query(f"WITH {TOK} SELECT DISTINCT doc_id AS doc_num FROM tok WHERE regexp_full_match(term, 'inter.*|und')")
def sample_by_token(spark, sf):
    return samples.by_regex(_tokens(spark, sf), "term", "inter.*|und")


@query("SELECT doc_id AS doc_num FROM documents WHERE lang <> 'en' OR lang IS NULL")
def sample_complement(spark, sf):
    docs = _docs(spark, sf)
    return samples.complement(samples.everything(docs, "doc_id"), samples.by_terms(docs, "lang", ["en"], "doc_id"))


@query("SELECT doc_id AS doc_num FROM documents WHERE lang = 'en' AND source LIKE 'src1%'")
def sample_intersect(spark, sf):
    docs = _docs(spark, sf)
    return samples.intersect(samples.by_terms(docs, "lang", ["en"], "doc_id"), samples.by_regex(docs, "source", "src1.*", "doc_id"))


@query("SELECT doc_id AS doc_num FROM documents WHERE lang = 'de' OR source LIKE 'src1%'")
def sample_union(spark, sf):
    docs = _docs(spark, sf)
    return samples.union(samples.by_terms(docs, "lang", ["de"], "doc_id"), samples.by_regex(docs, "source", "src1.*", "doc_id"))


@query("SELECT count(*) AS n FROM documents WHERE lang = 'es'")
def sample_size(spark, sf):
    return samples.size(samples.by_terms(_docs(spark, sf), "lang", ["es"], "doc_id"))


@query("SELECT doc_id AS doc_num, source AS value, dense_rank() OVER (ORDER BY source) - 1 AS key FROM documents WHERE source IS NOT NULL")
def doc_map(spark, sf):
    return samples.doc_map(_docs(spark, sf), "source")


@query("SELECT source AS value, row_number() OVER (ORDER BY source) - 1 AS key FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def split_dict(spark, sf):
    return samples.dictionary(_docs(spark, sf), "source")


# frequencies


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, tf AS n FROM lex")
def freq_total(spark, sf):
    return datasets.frequencies(_tokens(spark, sf), _lexicon(spark, sf))


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, lang AS split, count(*) AS n FROM tok JOIN lex USING (term) GROUP BY ALL")
def freq_by_lang(spark, sf):
    return datasets.frequencies(_tokens(spark, sf, "lang"), _lexicon(spark, sf), "lang")


@query(f"""WITH {TOK}, {_lex(MIN_TF)}, c AS (SELECT idx, lang AS split, count(*) AS n FROM tok JOIN lex USING (term) GROUP BY ALL)
SELECT l.idx, s.split, coalesce(n, 0) AS n FROM lex l CROSS JOIN (SELECT DISTINCT lang AS split FROM documents) s LEFT JOIN c ON c.idx = l.idx AND c.split = s.split""")
def freq_by_lang_dense(spark, sf):
    lex = _lexicon(spark, sf)
    long = datasets.frequencies(_tokens(spark, sf, "lang"), lex, "lang")
    return datasets.dense(long, lex, _docs(spark, sf).select(F.col("lang").alias("split")))


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, term, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM tok JOIN lex USING (term) GROUP BY idx, term")
def freq_by_lang_wide(spark, sf):
    lex = _lexicon(spark, sf)
    return datasets.wide(datasets.frequencies(_tokens(spark, sf, "lang"), lex, "lang"), lex, ["de", "en", "es", "fr"])


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, source AS split, count(*) AS n FROM tok JOIN lex USING (term) WHERE lang = 'fr' GROUP BY ALL")
def freq_sampled(spark, sf):
    sample = samples.by_terms(_docs(spark, sf), "lang", ["fr"], "doc_id")
    return datasets.frequencies(_tokens(spark, sf, "source"), _lexicon(spark, sf), "source", sample)


@query(r"""WITH tok AS (SELECT conv_id AS doc_id, role, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS term FROM conversations), """ + f"{_lex(MIN_TF)} SELECT idx, role AS split, count(*) AS n FROM tok JOIN lex USING (term) GROUP BY ALL")
def freq_by_role(spark, sf):
    lists = tokens.word_lists(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", keep=("role",))
    stream = tokens.from_lists(lists)
    return datasets.frequencies(stream, lexicon.joinable(lexicon.lexicon(stream, MIN_TF)), "role")


@query("SELECT l_returnflag AS idx, l_linestatus AS split, count(*) AS n FROM lineitem GROUP BY ALL")
def freq_contingency(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus")
    return rows.groupBy(F.col("l_returnflag").alias("idx"), F.col("l_linestatus").alias("split")).agg(F.count(F.lit(1)).alias("n"))


# co-occurrence


def _cooc_sql(before: int, after: int, min_tf: int, scale: int, where: str = "true") -> str:
    return f"""WITH {TOK}, {_lex(min_tf)}, e AS (SELECT doc_id, pos, idx FROM tok JOIN lex USING (term) WHERE {where}),
cooc AS (SELECT p.idx AS i, q.idx AS j, sum({scale} // abs(p.pos - q.pos))::BIGINT AS s
  FROM e p JOIN e q ON p.doc_id = q.doc_id AND q.pos BETWEEN p.pos - {before} AND p.pos + {after} AND q.pos <> p.pos GROUP BY ALL)"""


@query(_cooc_sql(10, 10, MIN_TF, 2520) + f" SELECT i, j, s, s / 2520.0::DOUBLE AS x FROM cooc")
def cooc_10_10(spark, sf):
    return datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf))


@query(_cooc_sql(2, 5, MIN_TF, 60) + " SELECT i, j, s, s / 60.0::DOUBLE AS x FROM cooc")
def cooc_asym_2_5(spark, sf):
    return datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf), 2, 5)


@query(_cooc_sql(5, 5, MIN_TF, 60, "lang = 'de'") + " SELECT i, j, s, s / 60.0::DOUBLE AS x FROM cooc")
def cooc_sampled(spark, sf):
    sample = samples.by_terms(_docs(spark, sf), "lang", ["de"], "doc_id")
    return datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf), 5, 5, sample)


@query(_cooc_sql(10, 10, MIN_TF, 2520) + " SELECT i, count(*) AS cells, sum(s)::BIGINT AS total, max(s) AS most FROM cooc GROUP BY i")
def cooc_row_stats(spark, sf):
    return matrix.row_stats(datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf), ordered=True))


@query(_cooc_sql(10, 10, MIN_TF, 2520) + " SELECT count(*) AS cells, count(DISTINCT i) AS n_rows, max(i) AS last_i, max(j) AS last_j FROM cooc")
def cooc_shape(spark, sf):
    return matrix.shape(datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf), ordered=True))


@query(_cooc_sql(10, 10, MIN_TF, 2520) + " SELECT i, j, s FROM cooc ORDER BY i, j")
def cooc_triplets(spark, sf):
    return matrix.triplets(datasets.cooccurrence(_lists(spark, sf), _lexicon(spark, sf), ordered=True)).select("i", "j", "s")


@query(_cooc_sql(10, 10, MIN_TF, 2520, "lang IN ('en', 'de')") + " SELECT i, j, s FROM cooc")
def cooc_merge(spark, sf):
    lex, lists, docs = _lexicon(spark, sf), _lists(spark, sf), _docs(spark, sf)
    parts = [datasets.cooccurrence(lists, lex, 10, 10, samples.by_terms(docs, "lang", [x], "doc_id")) for x in ("en", "de")]
    return matrix.merge(*parts, value="s")


# part-of-speech classes

CLASS_OF = "CASE " + " ".join(f"WHEN tag IN ({', '.join(repr(t) if chr(39) not in t else chr(39) * 6 for t in tags)}) THEN '{c}'" for c, tags in posclass.CLASSES.items()) + " ELSE 'O' END"


@query(f"WITH {TOK}, {_lex(MIN_TF)} SELECT idx, {CLASS_OF} AS pos_class, count(*) AS n FROM (SELECT term, {TAG} AS tag FROM tok) JOIN lex USING (term) GROUP BY ALL")
def posc_long(spark, sf):
    return datasets.pos_counts(_tagged(spark, sf), _lexicon(spark, sf))


@query(f"WITH {TOK}, {_lex(MIN_TF)}, c AS (SELECT idx, term, {CLASS_OF} AS c FROM (SELECT term, {TAG} AS tag FROM tok) JOIN lex USING (term)) SELECT idx, term, " + ", ".join(f"count(*) FILTER (c = '{x}') AS {x}" for x in posclass.CLASSES) + " FROM c GROUP BY ALL")
def posc_wide(spark, sf):
    lex = _lexicon(spark, sf)
    return datasets.wide(datasets.pos_counts(_tagged(spark, sf), lex), lex, list(posclass.CLASSES), "pos_class")


_TAGS = "(VALUES " + ", ".join(f"({repr(t) if chr(39) not in t else chr(39) * 6})" for tags in posclass.CLASSES.values() for t in (*tags,)) + ", ('XYZ'), ('nn')) t(tag)"


@query(f"SELECT tag, {CLASS_OF} AS pos_class FROM {_TAGS}")
def pos_class_map(spark, sf):
    rows = spark.createDataFrame([(t,) for tags in posclass.CLASSES.values() for t in tags] + [("XYZ",), ("nn",)], "tag string")
    return rows.select("tag", posclass.class_of(F.col("tag")).alias("pos_class"))


@query(f"WITH {TOK} SELECT c || '_' || term AS term, count(*) AS n FROM (SELECT term, {CLASS_OF} AS c FROM (SELECT term, {TAG} AS tag FROM tok)) GROUP BY 1")
def tokens_pos_prefixed(spark, sf):
    rows = _tagged(spark, sf).select(text.token_term(F.col("term"), pos_group=posclass.class_of(F.col("payload"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT doc_id AS doc_num, count(*) AS n FROM (SELECT doc_id, {CLASS_OF} AS c FROM (SELECT doc_id, term, {TAG} AS tag FROM tok)) WHERE c IN ('ADJ', 'ADV', 'NN', 'NP', 'V') GROUP BY 1")
def tokens_lexical_only(spark, sf):
    rows = _tagged(spark, sf).where(posclass.class_of(F.col("payload")).isin(list(posclass.LEXICALS)))
    return rows.groupBy("doc_num").agg(F.count(F.lit(1)).alias("n"))


# term sets


@query(f"WITH {TOK} SELECT CASE WHEN regexp_full_match(term, '.*tion|.*ung') THEN 'ABSTRACT' ELSE term END AS term, count(*) AS n FROM tok GROUP BY 1")
def termset_rewrite(spark, sf):
    found = TermSet("ABSTRACT", patterns=(".*tion|.*ung",))
    return _tokens(spark, sf).groupBy(found.rewrite(F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT term, count(*) AS n FROM tok WHERE term IN ('the', 'of') OR regexp_full_match(term, 'de.?') GROUP BY 1")
def termset_union(spark, sf):
    found = TermSet("A", terms=("the", "of")).union(TermSet("B", patterns=("de.?",)))
    return _tokens(spark, sf).where(found.test(F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT term, count(*) AS n FROM tok WHERE regexp_full_match(term, '(d|t)(.*ar|.*e)') GROUP BY 1")
def termset_concat(spark, sf):
    found = TermSet("P", terms=("d", "t")).followed_by(TermSet("S", patterns=(".*ar|.*e",)), "PS")
    return _tokens(spark, sf).where(found.test(F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# texts


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ +', '')) AS digest FROM documents")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.collapse_blanks(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '#[.,]#', '#', 'g')) AS digest FROM documents")
def text_rules(spark, sf):
    rules = text.rules_of(["[0-9]+", "#", "#[.,]#", "#"])
    return _docs(spark, sf).select("doc_id", F.md5(text.apply_rules(F.col("text"), rules)).alias("digest"))


@query(f"""WITH {PARAS} SELECT doc_id, ann_id, b AS "begin", e AS "end" FROM paras""")
def paragraphs(spark, sf):
    return spans.paragraphs(_docs(spark, sf)).select("doc_id", "ann_id", "begin", "end")


@query(f"""WITH {WORDS} SELECT doc_id AS doc_num, pos::INT AS pos, lower(surface) AS term, b AS "begin", e AS "end" FROM words""")
def token_offsets(spark, sf):
    return tokens.word_spans(_docs(spark, sf)).drop("surface")


_NESTED = f"""{WORDS}, nested AS (
  SELECT doc_id, b, e, lower(surface) AS term FROM words UNION ALL
  SELECT doc_id, b, next_e, lower(surface) || ' ' || lower(next) FROM (
    SELECT *, lead(e) OVER w AS next_e, lead(surface) OVER w AS next FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE length(surface) = 3 AND next IS NOT NULL),
steps AS (SELECT *, CASE WHEN e < max(e) OVER (PARTITION BY doc_id ORDER BY b, e DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS step FROM nested)"""


def _nested(spark, sf):
    rows = tokens.word_spans(_docs(spark, sf))
    w = Window.partitionBy("doc_num").orderBy("pos")
    rows = rows.withColumn("_e", F.lead("end").over(w)).withColumn("_t", F.lead("term").over(w))
    one = F.struct("term", "begin", "end")
    two = F.when(F.expr("length(surface) = 3 and _t is not null"), F.struct(F.concat_ws(" ", "term", "_t").alias("term"), "begin", F.col("_e").alias("end")))
    both = rows.select("doc_num", F.inline(F.filter(F.array(one, two), lambda x: x.isNotNull())))
    return tokens.with_positions(both)


@query(f"""WITH {_NESTED} SELECT doc_id AS doc_num, term, b AS "begin", e AS "end", (sum(step) OVER (PARTITION BY doc_id ORDER BY b, e DESC, term ROWS UNBOUNDED PRECEDING) - 1)::INT AS pos FROM steps""")
def token_positions(spark, sf):
    return _nested(spark, sf)


@query(f"WITH {TOK} SELECT doc_id AS doc_num, pos::INT AS pos, term, coalesce(lag(term) OVER w, '') AS prev, coalesce(lead(term) OVER w, '') AS next, coalesce(string_agg(term, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def token_neighbours(spark, sf):
    rows = col.neighbours(_tokens(spark, sf), ["doc_num"], ["pos"], "term", 3)
    return rows.select("doc_num", "pos", "term", F.coalesce("prev", F.lit("")).alias("prev"), F.coalesce("next", F.lit("")).alias("next"), F.array_join("before", " ").alias("before"))


@query(f"WITH {TOK} SELECT doc_id AS doc_num, coalesce(max(term) FILTER (pos = 2), '-') || ' ' || coalesce(max(term) FILTER (pos = 3), '-') || ' ' || coalesce(max(term) FILTER (pos = 4), '-') AS around FROM tok GROUP BY doc_id")
def token_window(spark, sf):
    rows = _lists(spark, sf).where("size(terms) > 0")
    own = F.transform(col.window_of(F.col("terms"), 1, F.lit(3)), lambda x: F.coalesce(x, F.lit("-")))
    return rows.select("doc_num", F.array_join(own, " ").alias("around"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id FROM documents")
def seq_ids(spark, sf):
    return col.numbered(_docs(spark, sf).select("doc_id", "lang"), ["lang"], ["doc_id"]).select("doc_id", "id")


_SIZE = "CASE WHEN {n} IS NULL THEN NULL WHEN {n} < 1024 THEN printf('%.2f B', {n}::DOUBLE) WHEN {n} < 1048576 THEN printf('%.2f KB', round({n} / 1024.0, 2)) WHEN {n} < 1073741824 THEN printf('%.2f MB', round({n} / 1048576.0, 2)) WHEN {n} < 1099511627776 THEN printf('%.2f GB', round({n} / 1073741824.0, 2)) ELSE printf('%.2f TB', round({n} / 1099511627776.0, 2)) END"


@query("SELECT doc_id, " + ", ".join(f"{_SIZE.format(n=f'(n_chars::DOUBLE * {k})')} AS size_{i}" for i, k in enumerate((1, 1024, 1048576, 1073741824))) + f", {_SIZE.format(n='nullif(n_chars % 3, 0)')} AS size_or_null FROM documents")
def readable_sizes(spark, sf):
    n = F.col("n_chars")
    sizes = [text.readable_size(n.cast("double") * 1024**i).alias(f"size_{i}") for i in range(4)]
    return _docs(spark, sf).select("doc_id", *sizes, text.readable_size(F.nullif(n % 3, F.lit(0))).alias("size_or_null"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS base FROM pages")
def file_names(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name"), text.base_name(F.col("url")).alias("base"))


@query("""SELECT event_id, try_cast(d AS INTEGER) AS n, try_cast(props AS INTEGER) AS whole, try_cast(d || '0000000' AS BIGINT) AS big, try_cast(d AS TINYINT) AS small, try_cast(d || '.25' AS DOUBLE) AS x,
try_cast(CASE WHEN user_id % 3 = 0 THEN 'true' WHEN user_id % 3 = 1 THEN 'false' ELSE 'maybe' END AS BOOLEAN) AS flag, substr(event_type, 1, 1) AS first FROM (SELECT *, regexp_extract(props, '[0-9]+') AS d FROM events)""")
def decoded_values(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("d", F.regexp_extract("props", "[0-9]+", 0))
    d, flag = F.col("d"), F.element_at(F.array(*map(F.lit, ("true", "false", "maybe"))), (F.col("user_id") % 3 + 1).cast("int"))
    return rows.select(
        "event_id", text.decode(d, "INTEGER").alias("n"), text.decode(F.col("props"), "INTEGER").alias("whole"), text.decode(F.concat(d, F.lit("0000000")), "LONG").alias("big"),
        text.decode(d, "BYTE").alias("small"), text.decode(F.concat(d, F.lit(".25")), "REAL").alias("x"), text.decode(flag, "BOOLEAN").alias("flag"), text.decode(F.col("event_type"), "CHAR").alias("first"),
    )


@query(r"""WITH t AS (SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}£]+|\.') AS x FROM documents)),
n AS (SELECT *, lag(token) OVER w AS prev, lead(token) OVER w AS next FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INT AS pos, CASE WHEN starts_with(prev, 'Knt') OR prev LIKE '%Serj%' OR prev LIKE '%Esq%' OR prev LIKE '%viz%' OR prev LIKE '%£%' OR regexp_matches(prev, '[0-9][lsd]$') THEN 'YES' ELSE 'NO' END AS dump
FROM n WHERE token = '.' AND length(next) = 1 AND next BETWEEN 'a' AND 'z'""")
def abbrev_period(spark, sf):
    """On the texts in lower case, where a sentence may begin with one letter."""
    rows = _docs(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}£]+|\."), F.lit(0))).alias("pos", "token"))
    rows = col.neighbours(rows, ["doc_id"], ["pos"], "token", 20)
    rows = rows.withColumn("dump", text.ends_no_sentence(F.col("prev"), F.col("token"), F.col("next")))
    return rows.where("dump is not null").select("doc_id", "pos", "dump")


# The SQL of speech spells its patterns by itself.
_SAID = "'^((mrs?\\. )?[a-z'']+( [a-z'']+)?)(, a [a-z''])?\\.(.+)'"
_ASKED, _ANSWERED = "'(Q\\.?\\ ?)(.*)(- A[.,\\ ])(.*)'", "'(.*)(\\?\\ -A\\.?)(.*)'"
_NOT_SAID = " OR ".join(f"regexp_matches(lower(text), {p})" for p in ("'^(before|for|in|guilty)'", "'conducted the prosecution'", "'sworn\\.$'", "'^N\\.\\ ?B\\.?'", "'^\\w+\\b(indictment|count)'", "'cross examination'"))
_SPEECH = f"""CASE WHEN regexp_matches(lower(text), {_SAID}) AND NOT ({_NOT_SAID}) THEN 'testimony' WHEN regexp_matches(text, {_ASKED}) THEN 'question' WHEN regexp_matches(text, {_ANSWERED}) THEN 'answered' ELSE 'none' END"""


@query(f"SELECT conv_id, turn, {_SPEECH} AS kind FROM conversations")
def speech_turns(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", text.speech_kind(F.col("text")).alias("kind"))


def _said(k: int) -> str:
    return f"length(regexp_extract(lower(text), {_SAID}, {k}))"


@query(
    f"""WITH k AS (SELECT conv_id, turn, text, {_SPEECH} AS kind FROM conversations), p AS (
SELECT conv_id, turn, 'prefix' AS part, 0 AS b, {_said(2)} AS e FROM k WHERE kind = 'testimony' UNION ALL
SELECT conv_id, turn, 'speaker', 0, {_said(1)} FROM k WHERE kind = 'testimony' UNION ALL
SELECT conv_id, turn, 'descriptor', {_said(1)}, {_said(1)} + {_said(4)} FROM k WHERE kind = 'testimony' UNION ALL
SELECT conv_id, turn, 'testimony', {_said(0)} - {_said(5)}, {_said(0)} FROM k WHERE kind = 'testimony')
SELECT conv_id, turn, part, b::INT AS "begin", e::INT AS "end" FROM p WHERE e > b"""
)
def speech_testimonies(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where(text.speech_kind(F.col("text")) == "testimony")
    return rows.select("conv_id", "turn", F.inline(text.speech_parts(F.col("text"))))


_QUIZ = "'1 Q. ' || coalesce(text, '') || ' - A. ' || role"


@query(f"""WITH k AS (SELECT conv_id, turn, {_QUIZ} AS text FROM conversations), g AS (SELECT *, regexp_extract(text, {_ASKED}, 0) AS g0, regexp_extract(text, {_ASKED}, 1) AS g1, regexp_extract(text, {_ASKED}, 2) AS g2, regexp_extract(text, {_ASKED}, 4) AS g4 FROM k WHERE {_SPEECH} = 'question')
SELECT conv_id, turn, part, b::INT AS "begin", e::INT AS "end" FROM (
SELECT conv_id, turn, 'question' AS part, instr(text, g0) - 1 + length(g1) AS b, instr(text, g0) - 1 + length(g1) + length(g2) AS e FROM g UNION ALL
SELECT conv_id, turn, 'answer', instr(text, g0) - 1 + length(g0) - length(g4), instr(text, g0) - 1 + length(g0) FROM g) WHERE e > b""")
def speech_questions(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.concat(F.lit("1 Q. "), F.coalesce("text", F.lit("")), F.lit(" - A. "), "role").alias("text"))
    return rows.where(text.speech_kind(F.col("text")) == "question").select("conv_id", "turn", F.inline(text.speech_parts(F.col("text"))))


# annotations


@query(f"WITH {PARAS}, {WORDS} SELECT p.doc_id, p.ann_id, count(*) AS n, md5(string_agg(w.surface, ' ' ORDER BY w.pos)) AS digest FROM paras p JOIN words w ON w.doc_id = p.doc_id AND w.b >= p.b AND w.e <= p.e GROUP BY ALL")
def spans_covered(spark, sf):
    pairs = spans.covered(_paragraph_spans(spark, sf), _word_annotations(spark, sf).withColumn("ann_id", F.col("ann_id") + 1_000_000))
    rows = pairs.groupBy("doc_id", "s_ann_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("m_begin", "m_surface"))).alias("x"))
    return rows.select("doc_id", F.col("s_ann_id").alias("ann_id"), "n", F.md5(F.array_join(F.transform("x", lambda r: r["m_surface"]), " ")).alias("digest"))


@query(f"WITH {PARAS}, {WORDS} SELECT w.doc_id, w.pos AS word, p.ann_id AS paragraph FROM words w JOIN paras p ON w.doc_id = p.doc_id AND p.b <= w.b AND p.e >= w.e")
def spans_covering(spark, sf):
    words = _word_annotations(spark, sf).withColumn("ann_id", F.col("ann_id") + 1_000_000)
    pairs = spans.covering(words, _paragraph_spans(spark, sf))
    return pairs.select("doc_id", (F.col("s_ann_id") - 1_000_000).alias("word"), F.col("c_ann_id").alias("paragraph"))


@query(f"""WITH {PARAS} SELECT p.doc_id, p.ann_id, d.lang AS "doc_Collection", p.ann_id::VARCHAR AS seg_id, p.ann_id::VARCHAR AS para_id, '1' AS seg_level FROM paras p JOIN documents d USING (doc_id)""")
def segment_metadata(spark, sf):
    docs = _docs(spark, sf)
    named = spans.document_metadata(docs.select("doc_id", F.col("lang").alias("collection"), F.col("source").alias("uri")))
    rows = spans.inherited(spans.span_metadata(spans.paragraphs(docs)), named)
    return rows.select("doc_id", "ann_id", *(F.element_at("metadata", k).alias(k) for k in ("doc_Collection", "seg_id", "para_id", "seg_level")))


@query(f"""WITH {PARAS} SELECT doc_id, type, count(*) AS n FROM (SELECT doc_id, 'Paragraph' AS type FROM paras UNION ALL SELECT doc_id, 'Entity' FROM paras) GROUP BY ALL""")
def type_translate(spark, sf):
    return spans.counts_by_type(spans.translate(spans.paragraphs(_docs(spark, sf)), "Paragraph", "Entity"))


@query("SELECT a.t AS a, b.t AS b, CASE WHEN a.t = b.t THEN a.t WHEN 'Mark' IN (a.t, b.t) THEN 'Annotation' WHEN 'Segment' IN (a.t, b.t) AND 'Paragraph' IN (a.t, b.t) THEN 'Segment' ELSE 'Span' END AS common FROM (VALUES ('Span'), ('Document'), ('Entity'), ('Segment'), ('Paragraph'), ('Mark')) a(t), (VALUES ('Span'), ('Document'), ('Entity'), ('Segment'), ('Paragraph'), ('Mark')) b(t)")
def type_common_parent(spark, sf):
    names = ["Span", "Document", "Entity", "Segment", "Paragraph", "Mark"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    return rows.select("a", "b", spans.common_type(spans.path_column(F.col("a")), spans.path_column(F.col("b"))).alias("common"))


@query(f"WITH {PARAS} SELECT doc_id, count(*) AS n FROM paras GROUP BY 1")
def type_subsumption(spark, sf):
    return spans.of_types(spans.paragraphs(_docs(spark, sf)), ["Segment", "Entity"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PARAS}, {WORDS} SELECT doc_id, 'Paragraph' AS type, count(*) AS n FROM paras GROUP BY 1 UNION ALL SELECT doc_id, 'Token', count(*) FROM words GROUP BY 1")
def annotation_counts(spark, sf):
    rows = spans.paragraphs(_docs(spark, sf)).select("doc_id", "type").unionByName(_word_annotations(spark, sf).select("doc_id", "type"))
    return spans.counts_by_type(rows)


@query(f"WITH {PARAS}, {WORDS} SELECT p.doc_id, p.ann_id, t.of_type, count(*) FILTER (t.of_type <> 'Entity') AS n FROM paras p JOIN words w ON w.doc_id = p.doc_id AND w.b >= p.b AND w.e <= p.e CROSS JOIN (VALUES ('Annotation'), ('Token'), ('Entity')) t(of_type) GROUP BY ALL")
def members_by_type(spark, sf):
    pairs = spans.covered(_paragraph_spans(spark, sf), _word_annotations(spark, sf).withColumn("ann_id", F.col("ann_id") + 1_000_000))
    rows = spans.listed_by_types(pairs, ["Annotation", "Token", "Entity"])
    return rows.select("doc_id", F.col("s_ann_id").alias("ann_id"), "of_type", F.col("n").cast("long").alias("n"))


@query("SELECT unnest(['doc_Collection', 'doc_URI', 'doc_id', 'seg_id', 'para_id', 'seg_level']) AS field")
def attr_fields(spark, sf):
    docs = _docs(spark, sf)
    named = spans.document_metadata(docs.select("doc_id", F.col("lang").alias("collection"), F.col("source").alias("uri")))
    return spans.metadata_fields(spans.inherited(spans.span_metadata(spans.paragraphs(docs)), named))


@query("SELECT doc_id, 'lang=' || lang AS kept, 'source=' || source AS left_out FROM documents")
def feature_map_filter(spark, sf):
    attrs = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return _docs(spark, sf).select("doc_id", shown(spans.matching_features(attrs, "+|^la")).alias("kept"), shown(spans.matching_features(attrs, "-|^la")).alias("left_out"))


@query("""WITH t AS (SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT * FROM t WHERE next_turn IS NOT NULL)
SELECT conv_id::VARCHAR AS doc_id, turn AS ann_id, 'answers_object' AS name, 'Entity:' || next_role AS value FROM r UNION ALL SELECT conv_id::VARCHAR, next_turn, 'answers_subject', 'Entity:' || role FROM r""")
def relation_fields(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("ann_id"), F.lit("Entity").alias("type"), F.col("role").alias("id"))
    w = Window.partitionBy("doc_id").orderBy("ann_id")
    pairs = turns.select("doc_id", F.col("ann_id").alias("subj_id"), F.lit("answers").alias("predicate"), F.lead("ann_id").over(w).alias("obj_id")).where("obj_id is not null")
    return spans.related(turns, pairs)


# markup


PAGE = markup.Mapping(types={"*": "Span", "a": "Entity", "body": "Segment"}, breaks=frozenset({"p", "div", "h1", "h2", "h3", "li", "title"}), marks=frozenset({"br", "img", "hr"}))


def _pages(spark, sf):
    return markup.split_tables(markup.read_markup(files.spread(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")), "page_id", "html", PAGE))


@query()
def page_xpath(spark, sf):
    return _pages(spark, sf)[1].select("doc_id", "ann_id", "type", "begin", "end", F.element_at("attrs", "xpath").alias("xpath"))


@query()
def page_documents(spark, sf):
    return _pages(spark, sf)[0].select("doc_id", "text", "index", "is_last", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusmill.plans import catalogue_parts  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from corpusmill.plans import catalogue_parts  # noqa: F401

    return dict(SQL)
