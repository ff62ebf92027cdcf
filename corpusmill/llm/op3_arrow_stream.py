"""Token ids in Arrow stream files of fixed-size lists.

A shard is one file `part-*.arrow` in the Arrow stream format: batches of `BATCH` rows, each row a sequence of exactly
`seq_len` ids (fixed-size list of unsigned 16- or 32-bit integers) and a mask of as many booleans (true: a token,
false: padding after the shard's last token). All full batches have one size in bytes, so the place of any sequence
is computed from its number, and a reader maps the file and gets the row as a view, without a copy or a search
(`Shard.sequence`). A second stream file `docs-*.arrow` beside it holds doc_id, start and n_tokens of each document.

Documents are range-partitioned and sorted by doc_id; a shard is a range. A task streams its rows, holds one batch of
sequences at a time, and writes under a name of its own attempt; only files named in the manifest, which holds one row
a shard, count, so that a task that runs twice or dies leaves nothing that is read.

Cases: a null text is empty (the end id alone); a null doc_id comes first; rows of one doc_id follow by a hash of
their text; an id that doesn't fit the shard's width is an error; an empty table gives no shards; other columns
aren't read.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, tokens

#: Sequences in a batch of the file.
BATCH = 64
#: Text of a shard, about.
SHARD_BYTES = 128 << 20
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"


def file_schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class Writer:
    """Appends documents' ids to a shard's stream file."""

    def __init__(self, sink, seq_len: int, wide: bool):
        self.schema, self.seq_len = file_schema(seq_len, wide), seq_len
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.room = np.zeros(BATCH * seq_len, self.dtype)
        self.full = self.tokens = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {int(ids.max())} doesn't fit into {self.dtype.itemsize} bytes: write wide shards")
        self.tokens += len(ids)
        while len(ids):
            n = min(len(ids), len(self.room) - self.full)
            self.room[self.full : self.full + n] = ids[:n]
            self.full, ids = self.full + n, ids[n:]
            if self.full == len(self.room):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.full // self.seq_len)
        values = self.room[: rows * self.seq_len]
        values[self.full :] = 0
        mask = np.arange(len(values)) < self.full
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.seq_len) for v in (values, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += rows
        self.room = np.zeros(BATCH * self.seq_len, self.dtype)
        self.full = 0

    def close(self) -> None:
        if self.full:
            self._flush()
        self.out.close()


class Shard:
    """Random access to a stream file of Writer: no copy where the file is mapped, and nothing read but the batches that
    are asked for."""

    def __init__(self, source: pa.NativeFile, seq_len: int, wide: bool):
        self.source, self.seq_len, self.schema = source, seq_len, file_schema(seq_len, wide)
        self.dtype = np.dtype("<u4" if wide else "<u2")
        if pa.ipc.read_message(source).type != "schema":
            raise ValueError("not an Arrow stream")
        self.first = source.tell()
        try:
            pa.ipc.read_message(source)
            self.step = source.tell() - self.first
        except EOFError:
            self.step = 0
        self._at, self._ids, self._mask = -1, None, None

    def _batch(self, k: int) -> None:
        if k != self._at:
            self.source.seek(self.first + k * self.step)
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
            self._at, self._ids, self._mask = k, batch.column(0).values.to_numpy(), batch.column(1).values

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        self._batch(i // BATCH)
        at = i % BATCH * self.seq_len
        return self._ids[at : at + self.seq_len], self._mask[at : at + self.seq_len]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start: a view where they lie in one batch."""
        size, out = BATCH * self.seq_len, []
        while n:
            k, at = divmod(start, size)
            self._batch(k)
            got = self._ids[at : min(at + n, size)]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, self.dtype)


def open_shard(path: str, seq_len: int, wide: bool) -> Shard:
    fs, p = common.open_store(path)
    return Shard(pa.memory_map(p) if fs.type_name == "local" else fs.open_input_file(p), seq_len, wide)


def write_shards(docs: DataFrame, folder: str, seq_len: int = 2048, end_id: int = 0, tokenizer: str | None = None, shards: int | None = None, wide: bool | None = None) -> list[dict]:
    """Writes all documents and returns the manifest: a row for each shard, in order, with `start`, its first id's place.
    If not given, the ids' width follows from the size of the vocabulary, and shards are as many as keep each to about
    SHARD_BYTES of text."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.tokenizer_path()
    wide = is_wide(tokenizer, end_id) if wide is None else wide
    if spark.conf.get("spark.master", "").startswith("local") or folder.startswith("file:"):
        common.open_store(folder)[0].create_dir(common.open_store(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, out = tokens.encoder(tokenizer), TaskContext.get().partitionId(), None
        end, n_docs = end_id.to_bytes(4, "little"), 0
        fs, base = common.open_store(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for a, b in tokens.runs(batch.column(1)):
                if out is None:
                    sinks = [fs.open_output_stream(posixpath.join(base, f"{kind}-{name}.arrow")) for kind in ("part", "docs")]
                    out, index = Writer(sinks[0], seq_len, wide), pa.ipc.new_stream(sinks[1], DOCS)
                rows: tuple[list, list, list] = ([], [], [])
                ids = batch.column(0)[a:b].to_pylist()
                for doc, own in zip(ids, enc.ids_of(batch.column(1)[a:b])):
                    own = np.frombuffer(own + end, "<u4")
                    for col, x in zip(rows, (doc, out.tokens, len(own))):
                        col.append(x)
                    out.add(own)
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=DOCS))
                n_docs += len(ids)
        if out is not None:
            out.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [posixpath.join(folder, name)], "n_docs": [n_docs], "n_tokens": [out.tokens], "n_sequences": [out.sequences]})

    n = shards or max(common.parts(spark), -(-(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = [r.asDict() for r in ranged.mapInArrow(common.tidy(run), MANIFEST).collect()]  # one row a shard
    manifest.sort(key=lambda r: r["shard"])
    for r, start in zip(manifest, accumulate((r["n_tokens"] for r in manifest), initial=0)):
        r["start"] = start
    return manifest


def is_wide(tokenizer: str, end_id: int) -> bool:
    """Whether the vocabulary's ids need more than 16 bits."""
    return max(tokens.encoder(tokenizer).lib.get_vocab_size(), end_id + 1) > 1 << 16


def read_documents(spark: SparkSession, manifest: list[dict], seq_len: int = 2048, wide: bool = False) -> DataFrame:
    """Every document read back from the shards: doc_id, start, n_tokens, ids_crc32, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for folder, first, shard in zip(*(rows.column(k).to_pylist() for k in ("path", "start", "shard"))):
                base, name = posixpath.split(folder)
                data = open_shard(posixpath.join(base, f"part-{name}.arrow"), seq_len, wide)
                fs, p = common.open_store(posixpath.join(base, f"docs-{name}.arrow"))
                with fs.open_input_stream(p) as f, pa.ipc.open_stream(f) as index:
                    for batch in index:
                        starts, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                        crcs = [zlib.crc32(data.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(starts, sizes)]
                        cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in ([first + a for a in starts], sizes, crcs)), pa.array([shard] * len(sizes), pa.int32())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    if not manifest:
        return spark.createDataFrame([], out)
    rows = spark.createDataFrame([(r["shard"], r["path"], r["start"]) for r in manifest], "shard int, path string, start long")
    return rows.repartition(len(manifest)).mapInArrow(run, out)


def op3_arrow_stream_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(common.documents(spark, sf_dir), common.scratch_path(spark, "arrow"))
    return read_documents(spark, manifest)
