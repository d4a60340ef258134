"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.runtime import checkpoint_dir, ship_package

# Rows handled at a time inside a Python task: bounds memory when texts are long.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 24
# Bytes of a text that are cut into words at a time; numbers of a piece of a long array.
PIECE, NUMBERS = 1 << 20, 1 << 16

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does just that for a text
    whose bytes are all ASCII, and is much faster than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def partitions_of(spark: SparkSession, partitions: int | None = None) -> int:
    """Partitions of a large shuffle: the caller's number, or the session's
    ``spark.sql.shuffle.partitions`` (sized by the user for the input)."""
    return int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; lineage is cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable by the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes (one row at least)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _cut(batch.slice(at, rows), size)


def _cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _cut(batch.slice(0, half), size)
    yield from _cut(batch.slice(half), size)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all documents from which nothing is learned:
    crc32 of the id as text, modulo 5, is 0.  A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def is_held_out(doc_id: int | None) -> bool:
    """``held_out`` for one id, inside a Python task."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lower case, some at a time: bytes ``lower`` and
    ``split`` act on A-Z and on the blanks 0x20 and 0x09-0x0D only."""
    data, at = text.encode().lower(), 0
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE)
        to = cut.start() if cut else len(data)
        yield data[at:to].split()
        at = to


def pieces_of(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A long array of counts in numbered pieces; a piece with few counts as
    their places and values.  The first byte tells which, and how wide a count is."""
    kind, wide = (np.int32, b"4") if counts.max(initial=0) < 1 << 31 else (np.int64, b"8")
    for at in range(0, len(counts), NUMBERS):
        piece = counts[at:at + NUMBERS].astype(kind)
        some = np.flatnonzero(piece)
        if 3 * len(some) < len(piece):
            yield at // NUMBERS, b"s" + wide + some.astype(np.uint16).tobytes() + piece[some].tobytes()
        else:
            yield at // NUMBERS, b"d" + wide + piece.tobytes()


def add_piece(total: np.ndarray, uses: bytes) -> None:
    """Add a piece of ``pieces_of`` to ``total``."""
    kind, size = (np.int32, 4) if uses[1:2] == b"4" else (np.int64, 8)
    if uses[:1] == b"d":
        n = (len(uses) - 2) // size
        total[:n] += np.frombuffer(uses, kind, n, 2)
    else:
        n = (len(uses) - 2) // (2 + size)
        total[np.frombuffer(uses, np.uint16, n, 2)] += np.frombuffer(uses, kind, n, 2 + 2 * n)


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Arrays of ``size`` counts from all tasks, as rows (piece, uses), added up:
    each piece in a task of its own.  The sums reach the driver, so ``size`` must
    not grow with the corpus."""
    def add(batches):
        total, at = np.zeros(NUMBERS, np.int64), None
        for batch in slices(batches, 16):
            for piece, uses in zip(batch.column("piece").to_pylist(), batch.column("uses").to_pylist()):
                add_piece(total, uses)
                at = piece
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "uses"])

    out = np.zeros(-(-size // NUMBERS) * NUMBERS, np.int64)
    sums = map_arrow(parts.repartitionById(max(1, len(out) // NUMBERS), F.col("piece")), add, "piece int, uses binary").toArrow()
    for piece, uses in zip(sums.column("piece").to_pylist(), sums.column("uses").to_pylist()):
        out[piece * NUMBERS:(piece + 1) * NUMBERS] = np.frombuffer(uses, np.int64)
    return out[:size]
