"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A window is a string of `LENGTH` bytes inside one document. Every byte that a window covers goes if that window also
starts anywhere else. A suffix array would find this by sorting all suffixes: they are put into buckets by an initial
q-gram, and a bucket is refined by sorting its members on the identifiers of the buckets that they have at later
offsets, until it has one member or its members agree in as many bytes as are asked for. Here:

1. Every place has the bucket of its q-gram (`GRAM` bytes). The bucket of 2 q bytes is named by the pair of a place's
   bucket and that at q bytes on; that name is used again for the next step, at 2 q bytes on, and so up to the wanted
   number of bytes (`identifiers`). Names are 64-bit hashes of such pairs instead of ranks: only who shares a bucket
   matters, not the order of buckets, and documents can be named apart from each other.
2. Suffixes are sampled: each window elects the suffix at its least q-gram among its first `WINDOW` places, the leftmost
   of equal ones. Equal windows elect the same place, so windows of different suffixes' buckets never have to be
   compared. The windows that elect one suffix are a run of neighbours, and all of them hold the suffix's first
   LENGTH - WINDOW + 1 bytes, whose bucket it is put into. Suffixes alone in their bucket are done.
3. A bucket is refined by the identifiers at the run's two ends. Runs found twice are settled: all their windows repeat.
4. Only buckets that still hold different runs are refined again, one run of each kind taking part: its windows are
   sorted by their own bucket and by that of a later offset, which both cover the window together.

Step 4 gets few rows, as only runs at the ends of a repeated passage are left. What meets in a task is dealt by
identifiers of `BLOCK` offsets, so a passage that is in a third of all documents is spread over its offsets.

Cases: a null text is empty; texts shorter than LENGTH bytes lose nothing; rows that agree in doc_id and text are
copies of each other and lose all their windows; a null doc_id is kept; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

LENGTH, WINDOW, GRAM, BLOCK = 400, 200, 8, 8
#: Bytes that a task samples together, and windows of a partition in step 4, about.
CHUNK, WINDOWS = 1 << 19, 1_500_000

_U = np.uint64
_PLACE = _U((1 << 24) - 1)  # a chunk with its overlap is shorter
RUNS = "doc_id long, _x long, p1 int, p2 int, near int, core long, span long, last int, times int"
KEY = ["doc_id", "_x"]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _U(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def identifiers(data: memoryview, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each of these ascending numbers of bytes (GRAM at least), the bucket of the string of so many bytes that
    begins at each place: two places are in one bucket if their strings are equal."""
    n, m = len(data), GRAM
    found = []
    names = np.ndarray((max(0, n - GRAM + 1),), "<u8", data, 0, (1,)) if n >= GRAM else np.zeros(0, np.uint64)
    names = _pairs(names, _U(0))
    for size in sizes:
        while 2 * m <= size:
            names = _pairs(names[:-m], names[m:]) if len(names) > m else names[:0]
            m *= 2
        later = size - m  # the last step's two strings overlap
        found.append((_pairs(names[: len(names) - later], names[later:]) if len(names) > later else names[:0]) if later else names)
    return found


def sampled(data: memoryview, sizes: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows in the texts of these sizes that stand one after the other in data: first and last start of the
    windows, and the suffix they elect."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    grams = np.ndarray((n - GRAM + 1,), "<u8", data, 0, (1,))
    key = grams * _U(0x9E3779B97F4A7C15)
    key ^= key >> _U(29)
    key *= _U(0xBF58476D1CE4E5B9)
    key &= ~_PLACE
    key |= np.arange(len(key), dtype=np.uint64)
    # least key of each window: from the start of a block of places to its end, and on from the next block's start
    m = len(key)
    rows = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
    rows[:m] = key
    rows = rows.reshape(-1, window)
    onward = np.minimum.accumulate(rows, axis=1).ravel()[window - 1 : m]
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: m - window + 1]
    elected = (np.minimum(onward, back) & _PLACE).astype(np.int64)
    left = np.repeat(np.cumsum(sizes), sizes)[: len(elected)] - np.arange(len(elected))
    p = np.flatnonzero(left >= length)
    if not len(p):
        return none, none, none
    at = elected[p]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(p) - 1]
    return p[first], p[last], at[first]


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """A binary column's bytes and the offsets of its values."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows a..b that are CHUNK bytes at most; or a part of one long row, from byte `begin` up to byte `end` of it, where
    parts overlap so that each window is in one of them."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        size = int(offsets[b] - offsets[a])
        if size <= CHUNK + length:
            yield a, b, 0, size
        else:
            for begin in range(0, max(1, size - length + 1), CHUNK):
                yield a, b, begin, min(size, begin + CHUNK + length - 1)
        a = b


def sample(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """A row for each sampled suffix: its windows start at p1..p2 of the document, the last one `near` bytes before it.
    A suffix whose bytes follow `times` times without a gap, as in a text that repeats one word, is one row up to `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(2))
            ids = [c.to_numpy(zero_copy_only=False) if c.null_count == 0 else None for c in batch.columns[:2]]
            for a, b, begin, end in _pieces(offsets, length):
                base = int(offsets[a]) + begin
                own = data[base : int(offsets[a]) + end]
                sizes = np.diff(offsets[a : b + 1]) if b > a + 1 else np.array([len(own)])
                p1, p2, at = sampled(own, sizes, length, window)
                if not len(p1):
                    continue
                starts = np.cumsum(sizes) - sizes
                row = np.searchsorted(np.cumsum(sizes), p1, side="right")
                short, whole = identifiers(own, (length - window + 1, length))
                core, span = short[at], _pairs(_pairs(whole[p1], whole[p2]), (p2 - p1).astype(np.uint64))
                anew = np.flatnonzero(np.r_[True, (core[1:] != core[:-1]) | (span[1:] != span[:-1]) | (row[1:] != row[:-1]) | (p1[1:] != p2[:-1] + 1)])
                times = np.diff(np.r_[anew, len(p1)])
                end_of = p2[anew + times - 1]
                p1, p2, at, row, core, span = (v[anew] for v in (p1, p2, at, row, core, span))
                shift = begin - starts[row]
                keys = [pa.array(v[a + row]) if v is not None else c.take(pa.array(a + row)) for v, c in zip(ids, batch.columns)]
                ints = [pa.array(v.astype(np.int32)) for v in (p1 + shift, p2 + shift, at - p2)]
                more = [pa.array(v.astype(np.int32)) for v in (end_of + shift, times)]
                yield pa.RecordBatch.from_arrays([*keys, *ints, pa.array(core.view(np.int64)), pa.array(span.view(np.int64)), *more], names=["doc_id", "_x", "p1", "p2", "near", "core", "span", "last", "times"])

    return _texts(docs).mapInArrow(common.tidy(run), RUNS)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, _x, text as bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", common.row_key().alias("_x"), F.col("text").cast("binary").alias("text"))


def _with_texts(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    t, w = _texts(docs).alias("t"), by_doc.alias("w")
    more = [F.col(f"w.{c}") for c in by_doc.columns if c not in KEY]
    return t.join(w, (F.col("t._x") == F.col("w._x")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), how).select("t.doc_id", "t._x", "t.text", *more)


def _windows(rows: DataFrame, n: int, length: int) -> DataFrame:
    """p, blob: the windows of the runs in column `runs`, as arrays of one partition: two hashes, document and place."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        to, lo, hi, doc, null, x, pos, mark = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(cuts))
        cols = [c[order] for c in (lo, hi, doc, null, x, pos, mark)]
        return pa.RecordBatch.from_pydict({"p": pa.array(full, pa.int32()), "blob": pa.array([b"".join(c[cuts[k] : cuts[k + 1]].tobytes() for c in cols) for k in full], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = _bytes(batch.column(2))
            for k, (doc, x, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                own = data[int(offsets[k]) : int(offsets[k + 1])]
                block, places, mark = [], [], []
                half = (length + 1) // 2
                (names,) = identifiers(own, (half,))
                for r in runs:
                    first, last, near = r["p1"], r["p2"], r["near"]
                    p = np.arange(last, first - 1, -1)
                    # windows of one block of offsets hold the same bytes around the suffix
                    low = (near + last - p) // BLOCK * BLOCK
                    start = last + near - low
                    block.append(_pairs(_pairs(names[start], names[start - BLOCK + 1 + length - half]), low.astype(np.uint64)))
                    places.append(p)
                    mark.append(np.full(len(p), r["mark"], np.bool_))
                p = np.concatenate(places)
                lo, hi = names[p], names[p + length - half]  # a window's bucket, and that of its later half
                m = len(p)
                held.append((np.concatenate(block) % _U(n), _pairs(lo, hi), (_pairs(hi, lo) >> _U(32)).astype(np.uint32), np.full(m, doc or 0, np.int64), np.full(m, doc is None), np.full(m, x, np.int64), p.astype(np.int32), np.concatenate(mark)))
                size += m
                if size > 500_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "p int, blob binary")


def _repeated(blobs: DataFrame) -> DataFrame:
    """doc_id, _x, p1, p2: runs of marked windows that occur twice at least."""
    width = 8 + 4 + 8 + 1 + 8 + 4 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in common.groups(batches, 1):
            cols: list[list] = [[] for _ in range(7)]
            for blob in own.column(1).to_pylist():
                m, at = len(blob) // width, 0
                for c, kind in zip(cols, ("<u8", "<u4", "<i8", "?", "<i8", "<i4", "?")):
                    c.append(np.frombuffer(blob, kind, m, at))
                    at += c[-1].nbytes
            lo, hi, doc, null, x, pos, mark = map(np.concatenate, cols)
            order = np.lexsort((hi, lo))
            same = (lo[order][1:] == lo[order][:-1]) & (hi[order][1:] == hi[order][:-1])
            twice = np.zeros(len(lo), bool)
            twice[order] = np.r_[False, same] | np.r_[same, False]
            keep = np.flatnonzero(twice & mark)
            if not len(keep):
                continue
            keep = keep[np.lexsort((pos[keep], null[keep], doc[keep], x[keep]))]
            doc, null, x, pos = doc[keep], null[keep], x[keep], pos[keep]
            cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (pos[1:] != pos[:-1] + 1)])
            last = np.r_[cut[1:] - 1, len(keep) - 1]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[cut], pa.int64(), mask=null[cut]), "_x": x[cut], "p1": pos[cut], "p2": pos[last]})

    return blobs.mapInArrow(run, "doc_id long, _x long, p1 int, p2 int")


def repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, _x, p1, p2: runs of windows that also start elsewhere. _x tells documents of one doc_id apart."""
    if window + GRAM > length or length < 2 * (GRAM + BLOCK):
        raise ValueError("the election's window and its gram must fit into a window of bytes")
    spark = docs.sparkSession
    runs = common.written(sample(docs, length, window), "suffixes")
    buckets = runs.groupBy("core").agg(F.sum("times").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    buckets = buckets.where("n > 1").select("core", (F.col("lo") != F.col("hi")).alias("open"))
    shared = common.written(runs.join(buckets, "core"), "shared")
    common.discard(runs)
    common.sweep(spark)
    kinds = shared.groupBy("core", "span").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "_x", "p1", "p2", "near")).alias("one"), F.max("open").alias("open"))
    kinds = common.written(kinds, "kinds")
    settled = shared.join(kinds.where("n > 1").select("core", "span"), ["core", "span"], "left_semi").select("doc_id", "_x", "p1", F.col("last").alias("p2"))
    settled = common.written(settled, "settled")
    common.discard(shared)
    common.sweep(spark)
    # one run of each kind: those found once are still to be judged, the others are there to be met
    left = kinds.where("open").select("one.*", (F.col("n") == 1).alias("mark"))
    total = left.agg(F.sum(F.col("p2") - F.col("p1") + 1)).first()[0] or 0
    n = max(common.parts(spark), -(-total // WINDOWS))
    by_doc = left.groupBy(*KEY).agg(F.collect_list(F.struct("p1", "p2", "near", "mark")).alias("runs"))  # runs of one document
    dealt = _windows(_with_texts(docs, by_doc, "inner"), n, length).repartition(n, "p").sortWithinPartitions("p")
    found = common.written(_repeated(dealt), "repeats")
    common.discard(kinds)
    common.sweep(spark)
    return settled.union(found)


def _removed(size: int, runs: list | None, length: int) -> tuple[np.ndarray, int]:
    """A mask of the bytes that go, and the number of their maximal runs."""
    edge = np.zeros(size + 1, np.int32)
    if runs:
        ends = np.array([(r["p1"], r["p2"] + length) for r in runs])
        np.add.at(edge, ends[:, 0], 1)
        np.add.at(edge, np.minimum(ends[:, 1], size), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(size > 0 and bool(gone[0]))


def _kept(docs: DataFrame, length: int, window: int) -> DataFrame:
    found = repeats(docs, length, window)
    by_doc = found.groupBy(*KEY).agg(F.collect_list(F.struct("p1", "p2")).alias("runs"))  # runs of one document
    return _with_texts(docs, by_doc, "left")


def stripped(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(2))
            rows: list[list] = [[] for _ in range(5)]
            for k, runs in enumerate(batch.column(3).to_pylist()):
                own = data[int(offsets[k]) : int(offsets[k + 1])]
                gone, spans = _removed(len(own), runs, length)
                kept = np.frombuffer(own, np.uint8)[~gone].tobytes() if runs else bytes(own)
                for col, v in zip(rows, (len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _kept(docs, length, window).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and what is left: n_kept and the text, in which a character that was cut is U+FFFD."""
    rows = stripped(common.documents(spark, sf_dir))
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), left)
