"""Best-two-fit packing of token sequences into rows of a fixed capacity.

A document's ids are those of its text and an end id; only longer documents than the capacity are cut, from the end,
so that all pieces but the first are full. Pieces are packed by length alone, and there are at most `capacity`
lengths, so the packing is solved once for the whole corpus over the histogram of lengths (a few kilobytes whatever
the input) and then carried out as an equi-join: the r-th piece of a length takes the r-th place made for that
length. Every bin is filled greedily with the largest piece that fits; then its smallest piece is replaced by two
unpacked pieces that fill the gap it leaves more tightly, as long as that helps. A bin's pattern is used as often as
the histogram lasts, which gives just what packing bin after bin would.

Cases: a null text is empty (one piece, the end id alone); rows that agree in doc_id and text are packed each; a null
doc_id is kept; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that a task ranks together at most, about.
RANKED_TOGETHER = 500_000
#: Rows of the table of places that are broadcast at most; each has at most `capacity` offsets, a few as a rule.
BROADCAST_ROWS = 50_000


def cut_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and on request the ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            all_ids, all_texts = batch.column(0), batch.column(1)
            for a, b in tokens.runs(all_texts):
                doc_ids = all_ids[a:b].to_pylist()
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(doc_ids, enc.ids_of(all_texts[a:b])):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    for k, begin in enumerate([0, *range(first, n, capacity)]):
                        own = ids[4 * begin : 4 * (begin + capacity if k else first)]
                        for col, x in zip(out, (doc, k, begin, len(own) // 4, zlib.crc32(own), own)):
                            col.append(x)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(run), PIECES + ", ids binary" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a bin, descending) and how many bins have them, for so many pieces of each length."""
    left = dict(counts)
    sizes = sorted(x for x, n in left.items() if n)

    def largest(most: int, used: Counter) -> int:
        i = bisect_right(sizes, most)
        while i:
            if left[sizes[i - 1]] > used[sizes[i - 1]]:
                return sizes[i - 1]
            i -= 1
        return 0

    bins = []
    while sizes:
        used: Counter = Counter()
        row, gap = [], capacity
        while gap and (x := largest(gap, used)):
            row.append(x)
            used[x] += 1
            gap -= x
        while gap and len(row) > 1:
            small = min(row)
            used[small] -= 1
            room, best, pair = gap + small, small, None
            for x in sizes[: bisect_right(sizes, room - 1)]:
                if 2 * x < room - gap + 1 and 2 * x < best and x + sizes[-1] <= best:
                    continue
                if left[x] > used[x]:
                    used[x] += 1
                    y = largest(room - x, used)
                    used[x] -= 1
                    if y and x + y > best:
                        best, pair = x + y, (x, y)
                        if best == room:
                            break
            if pair is None:
                used[small] += 1
                break
            row.remove(small)
            row += pair
            used.update(pair)
            gap = room - best
        used += Counter()
        times = min(left[x] // n for x, n in used.items())
        bins.append((tuple(sorted(row, reverse=True)), times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                sizes.remove(x)
    return bins


def places(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """For each length and pattern: length, first rank, ranks end, first sequence, offsets of its places in a bin."""
    out, taken, first = [], defaultdict(int), 0
    for row, times in bins:
        offsets, at = defaultdict(list), 0
        for x in row:
            offsets[x].append(at)
            at += x
        for x, own in offsets.items():
            out.append((x, taken[x], taken[x] + len(own) * times, first, own))
            taken[x] += len(own) * times
        first += times
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a written table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    total = pieces.count()
    salts = max(8, total // RANKED_TOGETHER)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_n", F.row_number().over(own) - 1).join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_n") + F.col("_before"))
    # a row for each length and pattern of a bin; a pattern that is used up uses up one of its lengths
    rows = places(best_two_fit(counts, capacity))
    table = spark.createDataFrame(rows, "length long, _from long, _to long, _seq long, _offsets array<int>")
    if len(rows) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    at = F.col("_rank") - F.col("_from")
    width = F.size("_offsets")
    joined = ranked.alias("p").join(table.alias("t"), (F.col("p.length") == F.col("t.length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    kept = [F.col(f"p.{c}") for c in pieces.columns]
    return joined.select(*kept, (F.col("_seq") + F.floor(at / width)).cast("long").alias("sequence_id"), F.get("_offsets", F.pmod(at, width).cast("int")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32(, ids), sequence_id, offset."""
    pieces = common.written(cut_pieces(docs, capacity, end_id, tokenizer or tokens.tokenizer_path(), with_ids), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The rows to train on, from pack_documents(with_ids=True): sequence_id, ids as bytes (little-endian unsigned
    32-bit), doc_ids and offsets of its pieces. A sequence has at most capacity pieces."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("x"))
    ids = F.aggregate("x", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets"))


def op2_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
