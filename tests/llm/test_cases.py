"""Clashing column names, nulls, very long texts and empty tables for every operator and stage; feature of media; and the
pipeline against brute force, stage by stage and as a whole."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from corpusmill.llm import common, op1_line_dedup, op2_packing, op3_arrow_stream, op4_rules, op5_suffix, op6_media, op7_topk, op8_mixing, op9_compaction, op10_order_minhash, tokens
from test_operators import SCHEMA, Classes, brute_classes, corpus, levenshtein, words

CLASHING = ("_doc", "_x", "_key", "_text", "_id", "_h1", "_h2", "_n", "_rank", "_salt", "_own", "_before", "block", "family", "n", "shard", "rank", "id", "taken", "size", "target", "source_size", "piece", "start", "length", "tile", "h", "g", "f", "a", "b", "p", "key", "line", "line_no", "gone", "n_links", "score", "predicted", "sequence_id", "offset", "media", "n_bytes", "copies", "class_id", "component", "doc", "b_no", "q_no", "dim", "v", "norm", "bound")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one line here\ntwo lines there " * 3, "en", "s", 5), (2, None, None, None, None), (None, "", "en", "t", 0), (3, "one line here", "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.selectExpr("*", *(f"struct(doc_id, '{c}' as own) as {c}" for c in CLASHING))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_clashing_names(spark, clashing):
    assert op1_line_dedup.line_classes(clashing).count() == 7
    assert op2_packing.pack_documents(clashing, 32).select("doc_id").distinct().count() == 4
    manifest = op3_arrow_stream.write_shards(clashing, common.scratch_path(spark, "t"), seq_len=16, shards=2)
    assert op3_arrow_stream.read_documents(spark, manifest, 16).count() == 4
    model = op4_rules.RuleEnsemble(0.5, [], [])
    scored = op4_rules.scored(clashing, model)
    assert sorted(scored.columns) == sorted(clashing.columns) and scored.select("score").count() == 4
    assert op5_suffix.stripped(clashing).count() == 4
    assert op6_media.media_features(op6_media.encode_media(clashing)).count() == 4
    assert op8_mixing.mix_sizes(op8_mixing.sized(clashing)).count() == 4
    assert op10_order_minhash.near_duplicates(clashing).count() == 4
    store = op9_compaction.ShardStore(spark, common.scratch_path(spark, "s"))
    store.append(clashing)
    assert store.read().count() == 4
    for left in (op1_line_dedup.dedup(clashing), op4_rules.accepted(clashing, model), op8_mixing.mixed(clashing), op10_order_minhash.dedup(clashing)):
        assert left.columns == clashing.columns and left.count()
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<float>")
    odd = vectors.selectExpr("*", *(f"'{c}' as {c}" for c in CLASHING))
    assert sorted(op7_topk.top_k(odd).collect()) == sorted(op7_topk.top_k(vectors).collect())


def test_very_long_texts(spark):
    """A text of two megabytes, without spaces in part, beside a copy of it and a near copy."""
    rnd = random.Random(7)
    long = "\n".join(words(rnd, 200) for _ in range(1500)) + "\n" + "x" * 50_000
    near = long.replace("a", "A", 1)
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, long, "en", "s", 0), (3, near, "en", "t", 0), (4, "short", "en", "t", 0)], SCHEMA)
    assert op1_line_dedup.line_classes(docs).where("keep").count() == 1502
    lib = tokens.Encoder(tokens.tokenizer_path())
    want = {d: len(lib.plain(t)) // 4 + 1 for d, t in ((1, long), (3, near), (4, "short"))}
    packed = op2_packing.pack_documents(docs).groupBy("doc_id").sum("length").collect()
    manifest = op3_arrow_stream.write_shards(docs, common.scratch_path(spark, "t"), shards=2)
    read = op3_arrow_stream.read_documents(spark, manifest).collect()
    for got in (dict(map(tuple, packed)), {r.doc_id: r.n_tokens for r in read}):
        assert got == {1: want[1], 2: want[1], 3: want[3], 4: want[4]}
    assert op4_rules.scored(docs, op4_rules.RuleEnsemble(0.5, [], [])).count() == 4
    gone = {r.doc_id: r.n_removed for r in op5_suffix.stripped(docs).collect()}
    assert gone[1] == gone[2] == len(long.encode()) and 0 < gone[3] < len(near.encode()) and gone[4] == 0
    assert op6_media.media_features(op6_media.encode_media(docs)).where("doc_id = 1").first().n_bytes == len(long.encode())
    assert {r.doc_id: r.class_id for r in op10_order_minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_feature_of_media():
    """The hash by the cosine transform's definition, on a small and a large image."""
    rnd = np.random.default_rng(3)
    for shape in ((1, 64), (70, 64), (33, 256)):
        image = rnd.integers(0, 256, shape, dtype=np.uint8)
        bits = op6_media.cosine_hash(image)
        n = op6_media.GRID
        small = op6_media._averaged(image.astype(np.int64), n) >> 4
        small = op6_media._averaged(np.ascontiguousarray(small.T), n).T >> 8
        low = [[sum(op6_media.COSINES[u, x] * op6_media.COSINES[v, y] * small[x, y] for x in range(n) for y in range(n)) for v in range(8)] for u in range(8)]
        flat = [int(x) for row in low for x in row]
        median = sorted(flat[1:])[31]
        assert bits == np.packbits([0, *(x > median for x in flat[1:])]).tobytes()
    assert op6_media.cosine_hash(np.full((9, 64), 7, np.uint8)) == op6_media.cosine_hash(np.full((9, 64), 7, np.uint8))


def write_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, tmp_path, [], [])).count() == 0


def deduped_lines(rows):
    """Rows without the lines that don't stay, by comparing all lines with all."""
    lines = sorted({x for r in rows for x in (r[1] or "").split("\n")})
    classes = Classes()
    for i, a in enumerate(lines):
        classes.find(a)
        for b in lines[i + 1 :]:
            k = min(len(a), len(b)) // 20
            if abs(len(a) - len(b)) <= k and levenshtein(a, b) <= k:
                classes.join(a, b)
    first = {}
    order = lambda d: (d is not None, d if d is not None else 0)
    for r in sorted(rows, key=lambda r: order(r[0])):
        for k, x in enumerate((r[1] or "").split("\n")):
            first.setdefault(classes.find(x), (r[0], k))
    out = []
    for d, t, *rest in rows:
        own = (t or "").split("\n")
        left = [x for k, x in enumerate(own) if first[classes.find(x)] == (d, k) or not x.strip(" ")]
        if len(left) == len(own):
            out.append((d, t, *rest[:2], None if t is None else len(t)))
        elif any(x.strip() for x in left) or not (t or "").strip():
            text = "\n".join(left)
            out.append((d, text, *rest[:2], len(text)))
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    rows = [r for r in corpus(4) if r[0] is not None]
    rows = list({r[0]: (r[0], (r[1] or "")[:900] if r[1] else r[1], *r[2:]) for r in rows}.values())
    base = max(r[0] for r in rows) + 1
    rows += [(base + i, "| $$$ !! " * 20 + words(rnd, 4), "en", "src1", 0) for i in range(40)]
    labels = [(r[0], int("$$$" not in (r[1] or "")), 0) for r in rows]
    sf = write_tables(spark, tmp_path, rows, labels)
    docs, left = common.documents(spark, sf), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        left[name] = [tuple(r) for r in docs.collect()]
    key = lambda r: (r[0], r[1] or "")

    # quality: the model's own scores, rule by rule
    model = op4_rules.fit_on(common.documents(spark, sf), common.table(spark, sf, "labels"))
    names = list(op4_rules.statistics())
    x = common.documents(spark, sf).select("doc_id", *(c.alias(k) for k, c in op4_rules.statistics().items())).toPandas()
    good = set(x["doc_id"][model.score(names, x[names].to_numpy(float)) >= op4_rules.THRESHOLD])
    assert sorted(left["quality"], key=key) == sorted((r for r in rows if r[0] in good), key=key)
    assert not [r for r in left["quality"] if "$$$" in (r[1] or "")] and len(left["quality"]) >= 55
    # lines
    assert sorted(left["line_dedup"], key=key) == sorted(deduped_lines(left["quality"]), key=key)
    # near copies: the least doc_id of each class
    classes, least = brute_classes(left["line_dedup"]), {}
    for r in left["line_dedup"]:
        c = classes.find(r[1] or "")
        least[c] = min(least.get(c, r[0]), r[0])
    assert sorted(left["near_dedup"], key=key) == sorted((r for r in left["line_dedup"] if least[classes.find(r[1] or "")] == r[0]), key=key)
    # mix: only those documents, whole but for one of each source, within a word of the targets
    size, taken = defaultdict(int), defaultdict(int)
    text = {r[0]: r[1] or "" for r in left["near_dedup"]}
    for r in left["near_dedup"]:
        size[r[3]] += len((r[1] or "").split())
    cut = Counter()
    for r in left["mix"]:
        taken[r[3]] += len(r[1].split())
        cut[r[3]] += r[1] != text[r[0]]
        assert text[r[0]].startswith(r[1])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in full or free:
            target[s] = 3 * size[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        free = free - full if full else set()
    assert all(abs(taken[s] - target[s]) <= 1 and cut[s] <= 1 for s in order)
    # pieces
    lib, want = tokens.encoder(tokens.tokenizer_path()), Counter()
    for r in left["mix"]:
        ids = lib.plain(r[1]) + (2).to_bytes(4, "little")
        n = len(ids) // 4
        cuts = [0, *range(n % 1024 or 1024, n, 1024), n]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(own)[k][0] == sum(n for _, n in sorted(own)[:k]) for own in bins.values() for k in range(len(own)))
    assert max(sum(n for _, n in own) for own in bins.values()) <= 1024
