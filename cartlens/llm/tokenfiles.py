"""Token files: Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned by id and sorted; each task encodes its
documents in order, appends the end id to each, and writes one file

    part-NNNNN.arrow         ids: fixed_size_list<uint16 or uint32>[length],
                             mask: fixed_size_list<bool>[length]
    part-NNNNN.index.arrow   doc_id, start, n_tokens (within the part)

whose rows are the part's token stream cut every ``length`` ids; the last row
is padded and its mask false there.  Row ``i`` of a part begins at id
``i * length``, so any sequence or document is found by arithmetic, and a
memory-mapped file is read without copying.

Files are written under a temporary name and renamed when complete, so a
retried or speculative task leaves one whole file with the same content.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import checkpointed, map_arrow, partitions_of, slices, text_of
from cartlens.llm.tokens import WORD_BPE, encoder, vocabulary
from cartlens.runtime import scratch_folder

BATCH_SEQUENCES = 256


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder or file given as a URI or a path."""
    if re.match(r"file:/+", uri):
        uri = "/" + re.sub(r"^file:/+", "", uri)
    if uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


class _File:
    """An Arrow file that appears under its name only when closed."""

    def __init__(self, fs, path: str, schema: pa.Schema):
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        self.sink = fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, schema)

    def write(self, *columns) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays(list(columns), schema=self.writer_schema))

    def close(self) -> None:
        self.writer.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class _Sequences(_File):
    """Cuts a stream of ids into rows of equal length."""

    def __init__(self, fs, path: str, length: int, dtype):
        self.length, self.dtype, self.held, self.n_held = length, dtype, [], 0
        value = pa.from_numpy_dtype(dtype)
        self.writer_schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        super().__init__(fs, path, self.writer_schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        whole = self.length * BATCH_SEQUENCES  # every batch but the last is full, so a row is found by arithmetic
        if self.n_held >= whole:
            self._flush(self.n_held // whole * whole)

    def _flush(self, n: int, pad: int = 0) -> None:
        ids = np.concatenate([*self.held, np.zeros(pad, self.dtype)]) if self.held else np.zeros(0, self.dtype)
        rest = ids[n + pad:]
        ids = ids[:n + pad]
        mask = np.arange(len(ids)) < n
        for at in range(0, len(ids), self.length * BATCH_SEQUENCES):
            some = slice(at, at + self.length * BATCH_SEQUENCES)
            self.write(pa.FixedSizeListArray.from_arrays(pa.array(ids[some]), self.length),
                       pa.FixedSizeListArray.from_arrays(pa.array(mask[some]), self.length))
        self.held, self.n_held = ([rest] if len(rest) else []), len(rest)

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held, -self.n_held % self.length)
        super().close()


class _Index(_File):
    def __init__(self, fs, path: str):
        self.writer_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        super().__init__(fs, path, self.writer_schema)


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      vocab_path: str | None = None, end_id: int = 1, length: int = 2048,
                      partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` into Arrow files under ``folder`` (default: a new folder
    in the shared checkpoint folder).  Returns the manifest, one row per part:
    ``part``, ``file``, ``n_docs``, ``n_tokens``; parts are in id order.

    A null text is empty and yields the end id alone.  Null ids come first;
    rows with the same id are ordered by text and each is written.  A very long
    text lies in as many fixed-size lists as it needs, across batches.  Empty
    parts write no file; an empty table gives an empty manifest.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    parts = partitions_of(spark, partitions)
    folder = folder or scratch_folder(spark, "tokens")
    path = vocab_path or vocabulary(WORD_BPE)
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(
        parts, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        name = posixpath.join(base, f"part-{part:06d}")
        sequences = index = None
        n_docs = n_tokens = 0
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            enc = encoder(path)
            if sequences is None:
                dtype = np.uint16 if max(enc.size, end_id + 1) <= 1 << 16 else np.uint32
                sequences, index = _Sequences(fs, f"{name}.arrow", length, dtype), _Index(fs, f"{name}.index.arrow")
            starts, counts = [], []
            for ids in enc.encode(batch.column("text").to_pylist(), end_id):
                sequences.add(ids)
                starts.append(n_tokens)
                counts.append(len(ids))
                n_tokens += len(ids)
            index.write(batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()))
            n_docs += batch.num_rows
        if sequences is not None:
            sequences.close()
            index.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [posixpath.join(folder, f"part-{part:06d}.arrow")],
                "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return checkpointed(map_arrow(placed, write, "part int, file string, n_docs long, n_tokens long"))


class TokenFile:
    """Random access to one part: local files are memory-mapped, and the ids of
    a sequence are a view of the file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._batch = (-1, None)

    def ids(self, batch: int) -> np.ndarray:
        if self._batch[0] != batch:
            column = self.reader.get_batch(batch).column("ids")
            self._batch = (batch, column.values.to_numpy(zero_copy_only=True))
        return self._batch[1]

    def document(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the part's stream."""
        per, out = self.length * BATCH_SEQUENCES, []
        while n > 0:
            batch, at = divmod(start, per)
            piece = self.ids(batch)[at:at + n]
            if not len(piece):
                raise EOFError("the file ends before the document")
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers)."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part
    offsets = manifest.select("part", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("_before"))

    def read(batches):
        for batch in batches:
            for part, uri in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist()):
                fs, index_path = filesystem(uri.removesuffix(".arrow") + ".index.arrow")
                tokens = TokenFile(uri)
                with fs.open_input_file(index_path) as f:
                    reader = pa.ipc.open_file(f)
                    for k in range(reader.num_record_batches):
                        rows = reader.get_batch(k)
                        crcs = [zlib.crc32(tokens.document(a, n).astype("<u4").tobytes())
                                for a, n in zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * rows.num_rows, pa.int32()), *rows.columns, pa.array(crcs, pa.int64())],
                            names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "file")
    read_rows = map_arrow(files, read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
