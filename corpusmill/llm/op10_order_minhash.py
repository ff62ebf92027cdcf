"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's words (letters and digits, lower case) give runs of five, each labelled with its number among equal runs.
Each of `SKETCHES` hash functions samples the three runs with the least hashes and keeps them in text order; the
sampled triple is a bucket. Two texts whose labelled runs agree to 0.8 share a sampled triple with probability
0.8^3 each, so they share two of twenty or more with probability 0.99999. Texts that share two buckets are
candidates, and candidates' connected components are families: every link lies inside a family. The pairs of a family
are counted by an inverted list of its runs, which bounds their similarity from above, and pairs at or above 0.8 are
aligned: the longest common subsequence m of the runs, in a band that the threshold allows, must reach
m / (n1 + n2 - m) >= 0.8. Pairs that are in one class already are not aligned again, so a group of copies costs about
one alignment a member and no task lists all its pairs.

Equal texts are one node from the start. Families are cut into blocks by length, so that a task holds two blocks; blocks
whose lengths differ too much for the threshold never meet. Buckets are found by counts, pairs of buckets by stars on
the least member, and components by rounds of joins: nothing is collected.

Cases: a null text is empty; all empty texts are copies of each other, and so are all texts without a character other
than white space only if equal; a text without letters or digits is taken by its pieces between white space; fewer
than five words make one run; rows that agree in doc_id and text are one document; a null doc_id may be a class's
name if it is the least (nulls come first); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

WORDS, SIMILARITY, SKETCHES, SAMPLED = 5, 0.8, 20, 3
#: Runs of words in a block of a family, about, counting 250 more for each text.
BLOCK_RUNS = 500_000

_M = np.uint64
_WORD = re.compile(r"\w+")
_odd = np.random.default_rng(5).integers(1, 2**63, WORDS + SKETCHES, dtype=np.uint64) * _M(2) + _M(1)
_SEEDS = _odd[WORDS:, None]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(32))) * _M(0xD6E8FEB86659FD93)
    return x ^ (x >> _M(29))


def runs_of(text: str | None) -> np.ndarray:
    """Hashes of a text's labelled runs of words, in text order; no two are equal."""
    words = _WORD.findall(text.lower()) or text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        runs += h[k : k + n] * _odd[k]
    runs = _mix(runs)
    order = np.argsort(runs, kind="stable")
    same = np.r_[False, runs[order][1:] == runs[order][:-1]]
    if same.any():
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        runs = _mix(runs + label * _M(0x9E3779B97F4A7C15))
    return runs


def sketches_of(runs: np.ndarray) -> np.ndarray:
    """SKETCHES buckets: each samples the least runs under one hash function, in text order."""
    if not len(runs):
        return np.zeros(0, np.int64)
    n = len(runs)
    step = max(1, 2_000_000 // n)
    picked = []
    for a in range(0, SKETCHES, step):
        x = _mix((runs[None, :] ^ _SEEDS[a : a + step]) * _SEEDS[a : a + step])
        picked.append(np.argpartition(x, SAMPLED - 1, axis=1)[:, :SAMPLED] if n > SAMPLED else np.tile(np.arange(n), (len(x), 1)))
    own = runs[np.sort(np.concatenate(picked), axis=1)]
    out = _SEEDS[:, 0].copy()
    for k in range(own.shape[1]):
        out = _mix((out + own[:, k]) * _M(0x9FB21C651E98DF25))
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of a and b among pairs of places at most `band` apart, bit-parallel:
    one machine operation for many places, one row of the alignment after the other."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return n
    head = int(differ[0])
    tail = int(np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])[0]) if len(np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])) else n - head
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    place: dict[int, list[int]] = {}
    for i, c in enumerate(x):
        place.setdefault(c, []).append(i)
    width = 2 * band + 1
    top = 1 << (width - 1)
    v, got = (1 << width) - 1, 0
    full = v
    for j, c in enumerate(y):  # bit k of v stands for place j - band + k of x; a zero is a step of the length
        match, low = 0, j - band
        for i in place.get(c, ()):
            if 0 <= i - low < width:
                match |= 1 << (i - low)
        if match:
            u = v & match
            v = ((v + u) | (v - u)) & full
        got += not v & 1
        v = (v >> 1) | top
    return head + tail + got + (width - v.bit_count())


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    n = len(a) + len(b)
    need = least / (1 + least) * n  # m / (n - m) >= least
    band = int(n - 2 * need) + 1
    return aligned(a, b, band) >= need - 1e-9


def links_within(runs: list[np.ndarray], left: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs of these texts connect. left: texts of the first block if two blocks
    meet, whose inner pairs another task takes; all true if there is one."""
    n, sets, out = len(runs), common.Sets(len(runs)), []
    size = np.array([len(r) for r in runs])
    one = bool(left.all())
    codes, at = np.unique(np.concatenate(runs), return_inverse=True)
    doc = np.repeat(np.arange(n), size)
    count = np.bincount(at, minlength=len(codes))
    shared = count[at] > 1
    at, doc = at[shared], doc[shared]
    order = np.argsort(at, kind="stable")
    posts, starts = doc[order], np.searchsorted(at[order], np.arange(len(codes) + 1))
    ends = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        if sets.left == 1:
            break
        if not one and not left[i]:
            continue
        mine = at[ends[i] : ends[i + 1]]
        if len(mine) < least * size[i]:
            continue
        lens = starts[mine + 1] - starts[mine]
        take = np.repeat(starts[mine] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        common_runs = np.bincount(posts[take], minlength=n)
        near = common_runs >= least * (size + size[i] - common_runs) - 1e-9
        near[i] = False
        near[size == 0] = False
        if one:
            near[:i] = False
        else:
            near &= ~left
        for j in np.flatnonzero(near).tolist():
            if sets.find(i) != sets.find(j) and similar(runs[i], runs[j], least):
                sets.union(i, j)
                out.append((i, j))
    return out


def text_keys(text: str = "text") -> tuple[Column, Column]:
    """128 bits of a text; null is the empty text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(1), t).alias("_h2")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, _h1, _h2, n (runs), buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                runs = map(runs_of, part.column(3).to_pylist())
                rows = [(len(r), sketches_of(r)) for r in runs]
                buckets = pa.array([s for _, s in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([n for n, _ in rows], pa.int64()), buckets], names=["doc_id", "_h1", "_h2", "n", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), F.col("text").cast("string"))
    return rows.mapInArrow(common.tidy(run), "doc_id long, _h1 long, _h2 long, n long, buckets array<long>")


def families(texts: DataFrame) -> DataFrame:
    """id, family of all distinct texts (id, n, buckets) that share two buckets with another."""
    each = texts.select("id", F.explode("buckets").alias("b"))
    many = each.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("b")
    own = each.join(many, "b", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("b")).alias("bs")).where("size(bs) > 1")
    own = common.written(own, "buckets")
    # copies share nearly all buckets: neighbours in the list already connect most of them, and all pairs of buckets are
    # then looked up once for what is connected, not for each copy
    some = own.select("id", F.explode(F.transform(F.slice("bs", F.lit(2), F.size("bs") - 1), lambda y, i: F.xxhash64(F.get("bs", i), y))).alias("p"))
    near = common.written(common.components(_stars(some)), "near")
    common.sweep(texts.sparkSession)
    named = own.join(near.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("component", "id").alias("id"), "bs")
    pairs = F.flatten(F.transform("bs", lambda x, i: F.transform(F.slice("bs", i + 2, SKETCHES), lambda y: F.xxhash64(x, y))))
    two = common.written(named.select("id", F.explode(pairs).alias("p")).distinct(), "pairs")
    joined = common.written(common.components(_stars(two)), "joined")
    common.discard(two)
    common.sweep(texts.sparkSession)
    top = near.select(F.col("node").alias("id"), "component").join(joined.select(F.col("node").alias("component"), F.col("component").alias("family")), "component", "left")
    top = top.select("id", F.coalesce("family", "component").alias("family"))
    alone = joined.join(near.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    return top.union(alone.select(F.col("node").alias("id"), F.col("component").alias("family")))


def _stars(rows: DataFrame) -> DataFrame:
    """a, b: each id of a p with the least id of that p."""
    star = rows.groupBy("p").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("p", "lo")
    return rows.join(star, "p").where("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b"))


def links(docs: DataFrame, texts: DataFrame, found: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b: ids that are linked, enough to connect all classes."""
    spark = docs.sparkSession
    members = found.join(texts.select("id", "doc_id", "_h1", "_h2", "n"), "id")
    # places by length from prefix sums over the lengths of a family, of which there are few; texts of one length are
    # spread over their stretch by hash
    sizes = members.groupBy("family", "n").agg(F.sum(F.col("n") + 250).alias("_size"))
    w = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    members = members.join(sizes, ["family", "n"]).withColumn("block", F.floor((F.col("_from") + spread * F.col("_size")) / BLOCK_RUNS))
    members = common.written(members.drop("_size", "_from"), "members")
    meta = members.groupBy("family", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = meta.alias("x"), meta.alias("y")
    meet = (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.hi") >= least * F.col("y.lo"))
    met = x.join(y, meet).select(F.col("x.family").alias("family"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    tasks = met.select("family", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    placed = members.join(tasks, ["family", "block"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), F.col("text").cast("string").alias("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d._h1") == F.col("m._h1")) & (F.col("d._h2") == F.col("m._h2"))
    rows = rows.join(placed.alias("m"), same).select("m.family", "m.i", "m.j", "m.block", "m.id", "d.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, _), own in common.groups(batches, 3):
            ids, first = np.unique(own.column(4).to_numpy(), return_index=True)
            blocks, texts_ = own.column(3).to_numpy()[first], own.column(5).take(pa.array(first)).to_pylist()
            runs = [runs_of(t) for t in texts_]
            if out := links_within(runs, blocks == i, least):
                yield pa.RecordBatch.from_pydict({"a": ids[[p for p, _ in out]], "b": ids[[q for _, q in out]]})

    dealt = rows.repartition(common.parts(spark), "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(common.tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, _h1, _h2, copy_of (least doc_id with that text), class_id (least doc_id of its class), class_docs: a
    row for each row of docs."""
    common.sweep(docs.sparkSession)  # the jobs before this have made the driver large
    seen = common.written(sketch(docs), "sketches")
    texts = seen.groupBy("_h1", "_h2").agg(F.min_by(F.struct("n", "buckets"), F.struct("doc_id")).alias("s"), F.min(F.struct("doc_id")).alias("d"), F.count(F.lit(1)).alias("copies"))
    texts = common.written(texts.select(F.monotonically_increasing_id().alias("id"), F.col("d.doc_id").alias("doc_id"), "_h1", "_h2", "copies", "s.n", "s.buckets"), "texts")
    common.sweep(docs.sparkSession)
    linked = common.written(links(docs, texts, families(texts), least), "links")
    common.sweep(docs.sparkSession)
    found = common.components(linked)
    named = texts.join(found, texts["id"] == found["node"], "left").select("_h1", "_h2", "doc_id", "copies", F.coalesce("component", "id").alias("c"))
    classes = named.groupBy("c").agg(F.min(F.struct("doc_id"))["doc_id"].alias("class_id"), F.sum("copies").alias("class_docs"))
    named = named.join(classes, "c").select("_h1", "_h2", F.col("doc_id").alias("copy_of"), "class_id", "class_docs")
    return seen.select("doc_id", "_h1", "_h2").join(named, ["_h1", "_h2"])


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class, that of the least doc_id; the rows as they were."""
    kept = near_duplicates(docs, least).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("copy_of")))
    kept = kept.select(F.col("doc_id").alias("_id"), "_h1", "_h2").distinct()
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), *text_keys()).alias("d")
    same = F.col("d._id").eqNullSafe(F.col("k._id")) & (F.col("d._h1") == F.col("k._h1")) & (F.col("d._h2") == F.col("k._h2"))
    return rows.join(kept.alias("k"), same, "left_semi").dropDuplicates(["_id", "_h1", "_h2"]).select("_doc.*")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "copy_of", "class_docs", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"))
