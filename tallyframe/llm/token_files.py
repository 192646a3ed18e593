"""Token-ID output: Arrow stream files of fixed-size-list batches.

`write_tokens` encodes every text, appends an end id to each document, and writes the ids of each range of documents as one
sequence of equal-length rows: a file in Arrow's stream format whose record batches hold `ids` (fixed-size list of the
narrowest unsigned type that fits the vocabulary) and `mask` (fixed-size list of booleans, false on the padding of a file's
last row). Rows are of equal length, so row r of a memory-mapped file is found by arithmetic, without copying. An index file
beside it (same format) has doc_id, start in the file, and n_tokens.

Recovery: a task writes under a name that holds its attempt, and reports the name in its manifest row; the manifest is
written through Spark's commit protocol, so files of failed or repeated attempts are never read.

Cases: null and empty texts have only the end id; documents with a null id come first; repeated ids and rows are each encoded,
in the order of id, then text (equal ones in any order, which gives the same files); texts of any length are encoded whole; an
empty table gives no files and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, scan_parts, shuffle_parts, small_batches, task_ids
from .tokens import encoder, release

MANIFEST = "shard long, ids_path string, index_path string, n_docs long, n_ids long"


class _RowWriter:
    """Cuts a stream of ids into rows of `length`, and writes them in batches of `batch_rows`."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch_rows: int):
        self.length, self.size, self.dtype, self.held, self.n = length, length * batch_rows, dtype, bytearray(), 0
        kinds = [("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(kinds)
        self.out = ipc.new_stream(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held += ids
        step = self.size * self.dtype.itemsize
        while len(self.held) >= step:
            self._write(np.frombuffer(bytes(self.held[:step]), self.dtype), self.size)
            del self.held[:step]

    def _write(self, ids: np.ndarray, real: int) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < real)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n += real

    def close(self) -> int:
        if self.held:
            ids = np.frombuffer(bytes(self.held), self.dtype)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()
        return self.n


def write_tokens(docs: DataFrame, vocabulary: str, root: str, end_id: int = 1, length: int = 1024, batch_rows: int = 64, parts: int | None = None) -> DataFrame:
    """Writes the files under `root`, a URI that every executor can write to; returns the manifest.

    docs: doc_id, text. The manifest has a row for each file: shard (ascending with doc_id), ids_path, index_path, n_docs, n_ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, writer, streams = None, None, []
        store, base = fs.FileSystem.from_uri(root)
        words, done, n_docs = encoder(vocabulary), 0, 0
        end = np.array([end_id], words.dtype).tobytes()
        shard, attempt = task_ids()
        for batch in batches:
            if not batch.num_rows:
                continue
            if where is None:
                store.create_dir(base, recursive=True)
                where = [f"{base}/{kind}-{shard:06d}-{attempt}.arrows" for kind in ("ids", "index")]
                streams = [store.open_output_stream(x) for x in where]
                writer = _RowWriter(streams[0], words.dtype, length, batch_rows)
                index = ipc.new_stream(streams[1], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
            counts = []
            for text in batch.column("text").to_pylist():
                ids = words.encode(text or "") + end
                writer.add(ids)
                counts.append(len(ids) // words.dtype.itemsize)
            starts = done + np.cumsum([0, *counts[:-1]])
            index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema()))
            done, n_docs = done + sum(counts), n_docs + len(counts)
        if where is not None:
            n_ids = writer.close()
            index.close()
            for x in streams:
                x.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "ids_path": [where[0]], "index_path": [where[1]], "n_docs": [n_docs], "n_ids": [n_ids]})
        release(encoders=False)  # the worker's next range of documents needs it

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(parts or scan_parts(rows), F.col("doc_id").asc_nulls_first())
    with small_batches(docs.sparkSession):
        return materialize(ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(encode, MANIFEST), "manifest")


def index_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class RowReader:
    """Random access to the rows of one file; on a local disk the batches are views of the memory-mapped file."""

    def __init__(self, store: fs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.batches = [(b.column(0).flatten().to_numpy(), b.column(1).flatten()) for b in ipc.open_stream(source)]
        self.length = 0
        if self.batches:
            self.length = len(self.batches[0][0])

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, as one view for each batch that they lie in."""
        while n > 0:
            k, at = divmod(start, self.length)
            part = self.batches[k][0][at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def read_documents(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, and ids of its first row's place: row, offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for m in batch.to_pylist():
                rows = RowReader(store, m["ids_path"])
                with store.open_input_stream(m["index_path"]) as f:
                    for part in ipc.open_stream(f):
                        crcs = []
                        for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                            crc = 0
                            for ids in rows.spans(start, n):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        starts = pa.array(part.column(1).to_numpy() + m["base"], pa.int64())
                        yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "start": starts, "n_tokens": part.column(2), "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array([m["shard"]] * len(crcs), pa.int64())})

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # the manifest: one row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = placed.repartition(shuffle_parts(spark), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def encode_to_files(docs: DataFrame, vocabulary: str, end_id: int = 1) -> tuple[DataFrame, str]:
    """Writes the files in a new folder of the shared directory; returns the manifest and the folder."""
    root = new_folder(docs.sparkSession, "tokens")
    root = root if "://" in root else "file://" + root.removeprefix("file:")
    return write_tokens(docs, vocabulary, root, end_id), root
