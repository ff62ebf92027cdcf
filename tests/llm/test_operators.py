"""Every operator against brute force, on small tables with nulls, empty and repeated rows, and clashing columns."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import common, op1_line_dedup, op2_packing, op3_arrow_stream, op4_rules, op5_suffix, op6_media, op7_topk, op8_mixing, op9_compaction, op10_order_minhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, source string, n_chars long, score double, length int, n int, key string, line string, doc string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def corpus(seed=1):
    """Texts with exact and near copies, shared passages, repeated words, blanks, nulls, and rows that recur."""
    rnd = random.Random(seed)
    passage, line = words(rnd, 120), words(rnd, 12)
    texts = [words(rnd, rnd.randint(1, 300)) for _ in range(40)]
    texts += [f"{words(rnd, 30)}\n{line}\n{passage}\n{words(rnd, 30)}" for _ in range(8)]
    base = words(rnd, 200).split()
    for k in range(8):
        own = list(base)
        own[k * 7] = "changed"
        texts.append(" ".join(own))
    texts += [texts[3], texts[3], "", None, None, " ", "\n\n", "word " * 500, "ü€" * 300, "a", line + "x", line[:5] + "y" + line[6:]]
    rows = [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id " + passage, "en", "src1", 0), (rows[7][0], "the same id, another text", "de", "src2", 3)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, "one line\ntwo lines", "s", 5, 0.5, 1, 2, "k", "l", "d"), (2, None, None, None, None, None, None, None, None, None)], ODD)


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# 1


def test_lines(docs, rows):
    got = op1_line_dedup.line_classes(docs).collect()
    lines = sorted({x for _, t, *_ in rows for x in (t or "").split("\n")})
    classes = Classes()
    for i, a in enumerate(lines):
        for b in lines[i:]:
            k = min(2, min(len(a), len(b)) // 20)
            if a == b or (abs(len(a) - len(b)) <= k and levenshtein(a, b) <= k):
                classes.join(a, b)
    assert len(got) == sum(len((t or "").split("\n")) for t in {(r[0], r[1] or ""): r[1] for r in rows}.values()) + len((rows[5][1] or "").split("\n"))
    keyed = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text").select("doc_id", common.row_key().alias("x"), "text")
    text = {(r.doc_id, r.x): r.text.split("\n") for r in keyed.collect()}
    kept = {(r.doc_id, r._x, r.line_no): classes.find(text[r.doc_id, r._x][r.line_no]) for r in got if r.keep}
    assert sorted(kept.values()) == sorted({classes.find(x) for x in lines})
    first = {c: key for key, c in kept.items()}
    for r in got:
        key = first[classes.find(text[r.doc_id, r._x][r.line_no])]
        assert (r.class_doc_id, r.class_line_no) == (key[0], key[2])


def taken_by_hand(size, value, gram=op1_line_dedup.GRAM):
    """For each line, whether the taken grams are all up to some place in the order, with enough of them side by side."""
    at, out, begin = op1_line_dedup.taken(size, value).tolist(), [], 0
    for n in size.tolist():
        own = [p for p in at if begin <= p < begin + n]
        inside = range(begin, begin + n - gram + 1)
        worst = max(value[p] for p in own)
        assert sorted(p for p in inside if value[p] <= worst) == own
        apart, end = 0, begin
        for p in own:
            if p >= end:
                apart, end = apart + 1, p + gram
        assert apart > n // 20 + 1
        begin += n
        out.append(len(own))
    return out


def test_taken_grams():
    rnd = np.random.default_rng(8)
    size = rnd.integers(60, 3000, 40)
    value = rnd.integers(0, 1 << 60, int(size.sum()) - op1_line_dedup.GRAM + 1).astype(np.uint64)
    assert sum(taken_by_hand(size, value)) < 0.25 * size.sum()
    taken_by_hand(size, np.zeros(len(value), np.uint64))


def test_lines_links(spark):
    """Numbers of links against brute force, in a large group of near copies too."""
    rnd = random.Random(31)
    lines = []
    for n in (30, 90, 700, 1500):
        base = [rnd.choice("abcdefgh   ") for _ in range(n)]
        for _ in range(60):
            x = list(base)
            for _ in range(rnd.randint(0, n // 25)):
                x[rnd.randrange(n)] = rnd.choice("XYZ")
            lines.append("".join(x))
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(lines)] + [(1000, lines[0] + "\n" + lines[70], "en", "s", 0)], SCHEMA).repartition(5)
    different = sorted(set(lines))
    links = Counter()
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            k = min(len(a), len(b)) // 20
            if abs(len(a) - len(b)) <= k and op1_line_dedup._long_within(*sorted((a, b), key=len), k):
                links[a] += 1
                links[b] += 1
    got = op1_line_dedup.line_classes(docs, None).collect()
    assert len(got) == len(lines) + 2
    copies = Counter([*lines, lines[0], lines[70]])
    for r in got:
        x = lines[r.doc_id] if r.doc_id < 1000 else (lines[0], lines[70])[r.line_no]
        assert (r.n_links, r.n_copies) == (links[x], copies[x])


def test_lines_of_a_crowd(spark):
    """A large group of lines about as far apart as the threshold makes no pairs but those of a bounded number a line, and
    loses no link, whether links are counted or lines are only connected."""
    rnd = random.Random(5)
    base, lines = [rnd.choice("abcdefgh   ") for _ in range(240)], set()
    while len(lines) < 300:
        x = list(base)
        for _ in range(rnd.randint(4, 9)):
            x[rnd.randrange(240)] = rnd.choice("XYZ")
        lines.add("".join(x))
    lines = sorted(lines)
    hashes, crowds = np.arange(300), []
    rec = op1_line_dedup.seeds(lines, hashes, np.zeros(op1_line_dedup.SLOTS, np.uint8), 60, 1000)
    made = sum(len(p[0]) for p in op1_line_dedup.seeded_pairs(rec, crowds=crowds))
    assert crowds and made <= op1_line_dedup.CROWD * len(rec)
    links, classes = Counter(), Classes()
    for i, a in enumerate(lines):
        classes.find(a)
        for b in lines[i + 1 :]:
            if op1_line_dedup._long_within(a, b, 12):
                links.update((a, b))
                classes.join(a, b)
    assert 0 < sum(links.values()) < 300 * 299 / 2
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(classes.find(x), i)
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(lines)], SCHEMA).repartition(5)
    for every in (True, False):
        for r in op1_line_dedup.line_classes(docs, None, every).collect():
            assert r.class_doc_id == first[classes.find(lines[r.doc_id])]
            assert r.n_links == (links[lines[r.doc_id]] if every else None)


def test_crowded_lines_meet_once(spark, monkeypatch):
    """A link between lines of several crowded buckets is found in one tile, whatever buckets and parts they are in."""
    rnd = random.Random(6)
    lines = set()
    for n in (62, 64, 66, 240, 250):
        base = [rnd.choice("abcdefgh   ") for _ in range(n)]
        for _ in range(60):
            x = list(base)
            for _ in range(rnd.randint(0, n // 20)):
                x[rnd.randrange(n)] = rnd.choice("XYZ")
            lines.add("".join(x) + "e" * rnd.randint(0, 2))
    lines = sorted(lines)
    texts = spark.createDataFrame([(i, 1000 + i, x) for i, x in enumerate(lines)], "id long, h long, line string")
    # each line is in ten of thirty buckets, and any two lines are in one
    crowds = spark.createDataFrame([(b, 1000 + i, b, -1) for b in range(30) for i in range(len(lines)) if b < 8 or (i + b) % 3 == 0], "tile long, a long, b long, votes long")
    want = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if abs(len(a) - len(b)) <= 12 and op1_line_dedup._long_within(*sorted((a, b), key=len), min(len(a), len(b)) // 20)}
    for part in (2048, 40):
        monkeypatch.setattr(op1_line_dedup, "PART", part)
        got = [(r.b, r.a) for r in op1_line_dedup.crowded(crowds, texts, None).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    known = texts.withColumn("c", F.col("h") % 7)
    classes = Classes()
    for r in op1_line_dedup.crowded(crowds, known, None).collect():
        classes.join(r.a, r.b)
    for i in range(len(lines)):
        classes.join(i, i % 7 if (1000 + i) % 7 == (1000 + i % 7) % 7 else i)
    assert all(classes.find(i) == classes.find(j) for i, j in want)


def test_distances_of_many_kinds(monkeypatch):
    """Lines of many kinds of characters are compared in smaller batches, with equal distances."""
    rnd = random.Random(10)
    texts = ["".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(90)) for _ in range(40)]
    texts += [x[:30] + x[33:] + "abc" for x in texts]
    lines, p, t = op1_line_dedup.Lines(texts), np.arange(40), np.arange(40, 80)
    want = lines.distances(p, t, 31)
    assert want.tolist() == [levenshtein(texts[i], texts[j]) for i, j in zip(p, t)]
    monkeypatch.setattr(op1_line_dedup, "WORDS", 10_000)
    assert (lines.distances(p, t, 31) == want).all()


def test_long_edits_random():
    rnd = random.Random(9)
    a, b = [], []
    for _ in range(90):
        x = [rnd.choice("abcdü€") for _ in range(rnd.choice((60, 150, 300, 500, 750)) + rnd.randint(0, 30))]
        y = list(x)
        for _ in range(rnd.randint(0, len(x) // 7)):
            p = rnd.randrange(len(y))
            y[p : p + rnd.randint(0, 1)] = [rnd.choice("abcd")] * rnd.randint(0, 1)
        a.append("".join(x))
        b.append("".join(y))
    want = [levenshtein(x, y) <= min(len(x), len(y)) // 20 for x, y in zip(a, b)]
    assert op1_line_dedup.within_edits(a, b, None).tolist() == want and 20 < sum(want) < 80


def common_text(r):
    return r[1] or ""


def test_edits_random():
    rnd = random.Random(3)
    a, b = [], []
    for _ in range(300):
        x = [rnd.choice("abcd") for _ in range(rnd.randint(18, 70))]
        y = list(x)
        for _ in range(rnd.randint(0, 3)):
            p = rnd.randrange(len(y))
            y[p : p + rnd.randint(0, 1)] = [rnd.choice("abcd")] * rnd.randint(0, 1)
        a.append("".join(x))
        b.append("".join(y))
    want = [levenshtein(x, y) <= min(2, min(len(x), len(y)) // 20) for x, y in zip(a, b)]
    assert op1_line_dedup.within_edits(a, b).tolist() == want


def test_line_dedup_keeps_columns(docs, odd, empty):
    left = op1_line_dedup.dedup(docs)
    assert left.columns == docs.columns
    seen = Counter(x for r in left.dropDuplicates(["doc_id", "text"]).collect() for x in (r.text or "").split("\n") if x.strip())
    assert max(seen.values()) == 1
    assert op1_line_dedup.dedup(odd).columns == odd.columns and op1_line_dedup.dedup(odd).count() == 2
    assert op1_line_dedup.line_classes(empty).count() == 0


# 2 and 3


def test_encoder_agrees():
    """The ids are those of the library as its file sets it up, whatever white space, marks or special tokens are there."""
    lib = tokens.Encoder(tokens.tokenizer_path())
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    rnd = random.Random(2)
    texts = [t or "" for _, t, *_ in corpus(9)]
    parts = ["a", "b", " ", " ", ".", ",", "\n", "\t", "  ", "é", "'", "'s", "1", "€", "<|endoftext|>", "...", "\x01", "\u3000", "ß", "Ω", "n't", "\u00a0", "\u0301", "中"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 900))) for _ in range(300)]
    calm = ["ab", " ", " ", ".", "(", "\n", "é", "'", "'s", "'ll", "1", "€", "<|endoftext|>", "-", "Ω", "n't", "\u0301", "中", "_", "x.y"]
    texts += ["".join(rnd.choice(calm) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["hi <|endoftext|> there", "x  \n", " \n", "a \n b", "\n\nw\n\n", "it's 'so'. he'd.'s", "word " * 200_000, "x" * 100_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert lib.ids_of(texts) == want
    assert lib.ids_of(pa.array(texts[::-1])) == want[::-1]


def test_packing(docs, rows, empty, odd):
    got = op2_packing.pack_documents(docs, 64).collect()
    lib = tokens.encoder(tokens.tokenizer_path())
    want = Counter()
    for d, t, *_ in rows:
        ids = lib.plain(t or "") + (2).to_bytes(4, "little")
        first = (len(ids) // 4) % 64 or 64
        cuts = [0, *range(first, len(ids) // 4, 64), len(ids) // 4]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1
    assert op2_packing.pack_documents(empty, 64).count() == 0
    assert op2_packing.pack_documents(odd, 64).count() == 2


def test_two_fit_takes_the_tighter_pair():
    # greedy takes 6 and 3; the 3 gives way to 2 + 2, which fill the gap
    assert op2_packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def test_arrow_files(spark, docs, rows, empty):
    manifest = op3_arrow_stream.write_shards(docs, common.scratch_path(spark, "t"), seq_len=32, shards=3)
    got = sorted(op3_arrow_stream.read_documents(spark, manifest, 32).collect(), key=lambda r: r.start)
    lib = tokens.encoder(tokens.tokenizer_path())
    want = Counter((d, len(ids) // 4, zlib.crc32(ids)) for d, t, *_ in rows for ids in [lib.plain(t or "") + bytes(4)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert op3_arrow_stream.write_shards(empty, common.scratch_path(spark, "t"), seq_len=32) == []
    big = 2**53 + 1
    ids = spark.createDataFrame([(big, "a"), (None, "b"), (big + 2, "c")], "doc_id long, text string").coalesce(1)
    back = op3_arrow_stream.read_documents(spark, op3_arrow_stream.write_shards(ids, common.scratch_path(spark, "t"), seq_len=32, shards=1), 32)
    assert {r.doc_id for r in back.collect()} == {big, None, big + 2}
    with pytest.raises(ValueError):
        op3_arrow_stream.Writer(pa.BufferOutputStream(), 4, False).add(np.array([70000], np.uint32))
    shard = op3_arrow_stream.open_shard(manifest[0]["path"].replace(manifest[0]["path"].rsplit("/", 1)[1], "part-" + manifest[0]["path"].rsplit("/", 1)[1]) + ".arrow", 32, False)
    seq, mask = shard.sequence(0)
    assert len(seq) == 32 and len(mask) == 32 and not seq.flags.owndata


# 4


def test_quality(spark, odd, empty):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.7
        rows.append((i, words(rnd, 80) + "." if good else "| $$$ !! " * 30 + words(rnd, 5), "en", "s", 0))
        labels.append((i, int(good), 0))
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op4_rules.fit_on(docs, table)
    got = {r.doc_id: r for r in op4_rules.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    names = list(op4_rules.statistics())
    x = docs.select("doc_id", *(c.alias(k) for k, c in op4_rules.statistics().items())).toPandas()
    assert np.allclose(model.score(names, x[names].to_numpy(float)), [got[i].score for i in x["doc_id"]])
    assert op4_rules.scored(odd, model).where("score between 0 and 1").count() == 2
    assert op4_rules.accepted(docs, model).columns == docs.columns
    assert op4_rules.scored(empty, model).count() == 0
    assert op4_rules.fit_on(docs, table.where("false")).rules == []


# 5


@pytest.mark.parametrize("length,window", [(400, 200), (60, 30)])
def test_suffixes(docs, rows, empty, odd, length, window):
    found = Counter()
    texts = [(r[0], common_text(r).encode()) for r in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            found[b[p : p + length]] += 1
    want = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if found[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r)[:5] for r in op5_suffix.stripped(docs, length, window).collect())
    assert got == want
    assert op5_suffix.stripped(empty).count() == 0 and op5_suffix.stripped(odd).count() == 2


def test_suffix_query(spark, tmp_path):
    passage = "é" * 250
    spark.createDataFrame([(1, "x" + passage, None, None, 0), (2, "y" + passage + "z", None, None, 0), (3, None, None, None, 0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_kept, r.kept_text) for r in op5_suffix.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (500, 1, "x"), 2: (500, 2, "yz"), 3: (0, 0, "")}


def test_long_text_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(op5_suffix, "CHUNK", 1000)
    data = np.random.default_rng(1).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    offsets = np.array([0, len(data)])
    starts = []
    for a, b, begin, end in op5_suffix._pieces(offsets, 400):
        p1, p2, _ = op5_suffix.sampled(memoryview(data[begin:end]), np.array([end - begin]), 400, 200)
        starts += [begin + p for x, y in zip(p1, p2) for p in range(x, y + 1)]
    assert starts == list(range(len(data) - 399))


# 6


def test_media(docs, rows, empty):
    stored = op6_media.encode_media(docs)
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in op6_media.media_features(stored).collect())
    want = Counter()
    for r in rows:
        raw = common_text(r).encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(r[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))] += 1
    assert got == want
    assert op6_media.media_features(op6_media.encode_media(empty)).count() == 0


def test_png_filters_and_damage():
    rnd = np.random.default_rng(2)
    image = rnd.integers(0, 256, (9, 16), dtype=np.uint8)
    data = op6_media.encode_png(image.tobytes(), 16)
    assert (op6_media.decode_png(data) == image).all()
    with pytest.raises(ValueError):
        op6_media.decode_png(data[:50] + bytes([data[50] ^ 1]) + data[51:])
    for kind in (3, 4):  # average and Paeth, filtered here sample by sample
        raw = np.zeros((9, 17), np.uint8)
        raw[:, 0] = kind
        for y in range(9):
            for x in range(16):
                a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                raw[y, x + 1] = (int(image[y, x]) - guess) % 256
        assert (op6_media.unfilter(raw) == image).all()


# 7


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(op7_topk, "BUCKET", 40)
    monkeypatch.setattr(op7_topk, "CHUNK", 4)
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rnd.normal(0, 1, 8) * rnd.choice([0.1, 1, 5])], 1) for i in range(400)]
    rows += [(400, rows[7][1], 1), (401, None, 1), (402, [1.0, None] * 4, 1), (450, [float("nan")] * 8, 1), (404, [], 1), (405, [0.0] * 8, 1), (None, [1.0] * 8, 1)]
    got = sorted(map(tuple, op7_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()))
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in sorted(v):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], e)), i) for i, e in v.items() if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert op7_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 8


def test_mix(docs, rows, empty):
    got = op8_mixing.mix_sizes(op8_mixing.sized(docs)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    for r in got:
        assert r.source_size == sizes[r.source] and r.target <= 3 * r.source_size and abs(taken[r.source] - r.target) <= 1
    own = {r.source: r.target for r in got}
    assert abs(sum(own.values()) - sum(sizes.values())) < 1e-6
    mixed = op8_mixing.mixed(docs)
    assert mixed.columns == docs.columns
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.source] += len(r.text.split())
    assert all(abs(count[s] - taken[s]) <= 2 for s in sizes)
    assert op8_mixing.mix_sizes(op8_mixing.sized(empty)).count() == 0


# 9


def test_shards(spark, docs, rows, empty):
    store = op9_compaction.ShardStore(spark, common.scratch_path(spark, "store"), target_bytes=1 << 20, base_bytes=1 << 10, fan_in=3)
    assert store.read().count() == 0
    for k in range(7):
        store.append(docs.where(f"pmod(coalesce(doc_id, 0), 7) = {k}").coalesce(2))
    before = len(store.manifest()[0])
    last = store.compact()
    shards = store.manifest()[0]
    assert len(shards) < before and last == store.version()
    assert Counter((r.doc_id, r.text) for r in store.read().collect()) == Counter((r[0], r[1]) for r in rows)
    assert op9_compaction.plan(shards, store.target, store.fan_in) == []
    with pytest.raises(op9_compaction.Conflict):
        store.commit(last - 1, shards, docs.schema)
    store.append(empty)
    assert store.read().count() == len(rows)


# 10


def brute_classes(rows, least=0.8):
    runs = {t: op10_order_minhash.runs_of(t) for t in {r[1] or "" for r in rows}}
    texts = sorted(runs)
    classes = Classes()
    for i, a in enumerate(texts):
        classes.find(a)
        for b in texts[i + 1 :]:
            x, y = runs[a].tolist(), runs[b].tolist()
            if not x or not y or min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            last = [0] * (len(y) + 1)
            for u in x:
                now = [0]
                for j, w in enumerate(y):
                    now.append(last[j] + 1 if u == w else max(last[j + 1], now[j]))
                last = now
            if last[-1] >= least * (len(x) + len(y) - last[-1]):
                classes.join(a, b)
    return classes


def test_near_duplicates(docs, rows, empty):
    got = op10_order_minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    classes = brute_classes(rows)
    members = defaultdict(list)
    for r in rows:
        members[classes.find(r[1] or "")].append(r[0])
    order = lambda d: (d is not None, d)
    want = Counter((d, min(own, key=order), len(own)) for own in members.values() for d in own)
    assert Counter((r.doc_id, r.class_id, r.class_docs) for r in got) == want
    kept = op10_order_minhash.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert op10_order_minhash.near_duplicates(empty).count() == 0


def test_alignment_band():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        a = rnd.permutation(60).astype(np.uint64)
        b = np.delete(a, rnd.integers(0, 60, 4))
        assert op10_order_minhash.similar(a, b) and op10_order_minhash.aligned(a, b, 12) == len(np.unique(b))
    assert not op10_order_minhash.similar(np.arange(50, dtype=np.uint64), np.arange(100, 150, dtype=np.uint64))


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    classes = Classes()
    for a, b in edges:
        if a != b:
            classes.join(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = defaultdict(lambda: 10**9)
    for x in classes.up:
        least[classes.find(x)] = min(least[classes.find(x)], x)
    assert got == {x: least[classes.find(x)] for x in classes.up}


def test_long_lines(spark):
    """One edit in 20 characters whatever the length: replaced words, scattered edits, and lines just beyond."""
    rnd = random.Random(21)
    lines = []
    for n in (45, 58, 60, 61, 62, 79, 80, 119, 120, 121, 126, 199, 200, 209, 399, 400, 650, 900):
        for _ in range(2 if n < 300 else 1):
            x = "".join(rnd.choice("abcd efgh") for _ in range(n))
            lines.append(x)
            for k in (n // 20, n // 20 + 1):
                y = list(x)
                for e in range(k):  # evenly spread, so that no long part stays
                    p = min(len(y) - 1, (2 * e + 1) * n // (2 * k))
                    y[p : p + 1] = rnd.choice(["X", "", y[p] + "X"]) if rnd.random() < 0.8 else "X"
                lines.append("".join(y))
            p = rnd.randrange(n - n // 20)
            lines.append(x[:p] + "Y" * (n // 20) + x[p + n // 20 :])
    near = functools.cache(lambda a, b: abs(len(a) - len(b)) <= (k := min(len(a), len(b)) // 20) and levenshtein(a, b) <= k)
    want = {(i, j) for i, a in enumerate(lines) for j in range(i + 1, len(lines)) if a == lines[j] or near(a, lines[j])}
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= min(len(a), len(b)) // 20]
    assert op1_line_dedup.within_edits(*zip(*pairs), None).tolist() == [a == b or near(a, b) for a, b in pairs]
    classes = Classes()
    for i, a in enumerate(lines):
        classes.join(i, i)
    for i, j in want:
        classes.join(i, j)
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(lines)], SCHEMA).repartition(5)
    got = op1_line_dedup.line_classes(docs, None).collect()
    first = {}
    for i in range(len(lines)):
        first.setdefault(classes.find(i), i)
    assert {r.doc_id: r.class_doc_id for r in got} == {i: first[classes.find(i)] for i in range(len(lines))}
    assert op1_line_dedup.dedup(docs).count() == len(first)
    assert op1_line_dedup.line_classes(docs).where("keep").count() > len(first)


def test_compaction_keeps_versions(spark, docs, rows):
    store = op9_compaction.ShardStore(spark, common.scratch_path(spark, "store"), target_bytes=1 << 20, base_bytes=1 << 10, fan_in=3)
    for k in range(4):
        store.append(docs.where(f"pmod(coalesce(doc_id, 0), 4) = {k}").coalesce(1))
    old, reader = store.version(), store.read()
    in_flight = f"{store.folder}/data-in-flight"
    docs.coalesce(1).write.parquet(in_flight)
    assert store.compact() > old
    assert reader.count() == store.read(old).count() == store.read().count() == len(rows)
    store.vacuum(keep=1)
    assert spark.read.parquet(in_flight).count() == len(rows)
    assert store.read().count() == len(rows) and len([f for f in store.fs.listStatus(store._path(store.folder)) if f.getPath().getName().startswith("manifest-")]) == 1
    store.vacuum(keep=1, orphan_age=-60)
    assert not [f for f in store.fs.listStatus(store._path(in_flight)) if f.getPath().getName().startswith("part-")]


def test_two_writers(spark, docs):
    one = op9_compaction.ShardStore(spark, common.scratch_path(spark, "store"))
    one.append(docs)
    two = op9_compaction.ShardStore(spark, one.folder)
    base, (shards, schema) = two.version(), two.manifest()
    folder = f"{one.folder}/data-late"
    docs.coalesce(1).write.parquet(folder)
    late = two._files(folder, docs.schema)
    one.vacuum()  # leaves what isn't committed yet
    one.append(docs)
    with pytest.raises(op9_compaction.Conflict):
        two.commit(base, [*shards, *late], schema)
    two.commit(base + 1, [*two.manifest()[0], *late], schema)
    assert two.read().count() == one.read().count() == 3 * docs.count()
    common.hadoop_delete(spark, folder)
    with pytest.raises(RuntimeError):
        one.commit(1, [*shards, *late], schema)
    with pytest.raises(ValueError):
        one.append(docs.selectExpr("doc_id", "1 as _shard"))
    with pytest.raises(ValueError):
        one.append(docs.selectExpr("cast(doc_id as string) doc_id"))


def test_components_settle_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(path, max_rounds=1)
    assert {r.component for r in common.components(path).collect()} == {0}


def test_sweep_trims_the_driver(spark):
    """What the driver's JVM has freed outside its heap goes back to the system."""
    import re
    from pathlib import Path

    jvm = spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid = field.get(None), jvm.java.lang.ProcessHandle.current().pid()

    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024

    size, places = 1 << 16, []
    for _ in range(3200):  # 200 MB, in pieces that malloc doesn't map one by one
        places.append(unsafe.allocateMemory(size))
        unsafe.setMemory(places[-1], size, 1)
    for place in places[:-1]:  # the last one keeps the end of the arena
        unsafe.freeMemory(place)
    before = held()
    common.sweep(spark)
    after = held()
    unsafe.freeMemory(places[-1])
    assert before - after > 100


@pytest.mark.parametrize("every", [True, False])
def test_lines_leave_no_pairs(spark, docs, every):
    """Tables of candidates and texts are deleted once nothing reads them."""
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    seen = set(os.listdir(folder))
    assert op1_line_dedup.line_classes(docs, None, every).count()
    left = {name.split("-")[1] for name in set(os.listdir(folder)) - seen if name.startswith("corpusmill-")}
    assert not left & {"short", "band", "pairs", "crowds", "texts", "known"} and "links" in left
