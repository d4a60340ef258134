"""Contiguous shards of near-equal bytes.

Rows are put in id order by a range partitioning of narrow rows (id, size,
crc); each partition's byte total is summed, the prefix sums of the totals
give every partition its global offset, a running sum inside the partition
gives every row its place in the byte stream, and the stream is cut at
``n_shards`` equal targets.  No window spans the table: the only single task
sees one total per partition.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import checkpointed, partitions_of, text_of


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                partitions: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``size`` (UTF-8 bytes of the text
    plus 1), ``text_crc32``, ``shard`` (0 to n_shards - 1, in id order) and
    ``slot`` (position in the shard, gapless from 0).

    A row belongs to the shard whose byte range holds the row's middle byte,
    so a shard differs from the equal target by at most one row at each end.

    A null text has no bytes (size 1).  Null ids come first; rows with the
    same id are ordered by size and crc, and equal rows take neighbouring
    slots.  A text longer than a target leaves the shards it covers short or
    empty.  An empty table gives no rows.  Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    parts = partitions_of(docs.sparkSession, partitions)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    # written once: the totals and the rows must see the same splitters
    placed = checkpointed(rows.repartitionByRange(parts, "_id", "size", "text_crc32")
                          .withColumn("_part", F.spark_partition_id()))
    w_parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(w_parts), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(w_parts), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_all_bytes"))
    w = Window.partitionBy("_part").orderBy(F.col("_id").asc_nulls_first(), "size", "text_crc32")
    # one row per partition
    numbered = (placed.withColumn("_upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .withColumn("_row", F.row_number().over(w))
                .join(F.broadcast(offsets), "_part"))
    cut = numbered.select(
        "_id", "size", "text_crc32", (F.col("_rows_before") + F.col("_row")).alias("_row"),
        F.least(F.lit(n_shards - 1), F.expr(
            f"((2 * (_bytes_before + _upto) - size) * {n_shards}) div (2 * _all_bytes)").cast("int")).alias("shard"))
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_first"))
    # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("_row") - F.col("_first")).cast("bigint").alias("slot"))
