"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the normalised text,
sorted (Spark's external sort) so that equal texts lie side by side, and each
row is compared in full with its neighbour.

* The splitter key is a fixed-width digest of the sort order (first 32
  characters, 64-bit hash, salt), so the splitters the driver holds stay
  small however long the texts are.  Inside a key the order and the
  comparison are on the whole normalised text.
* A text held by more rows (or bytes) than one partition's fair share is hot.
  Hot texts are found by a map-side combined count and their rows are dealt
  over ``salts`` sub-runs.  Fewer than ``2 * partitions`` texts can be hot, so
  the list that is broadcast has a proven bound.  The sub-runs' heads (one row
  per salt) are then compared in full and merged.

DataFrame functions only; no Python code touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import ascii_lower, checkpointed, partitions_of, text_of

_KEY = ["_p", "_h", "_s"]


def _hot_list(rows: DataFrame, parts: int) -> DataFrame | None:
    """(_h, _n_salts) of the texts above a fair share by rows or bytes; None if there are none."""
    counted = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_nb"))
    # texts held once are folded into one row, of a null hash, for the totals
    folded = checkpointed(counted.groupBy(F.when(F.col("_n") > 1, F.col("_h")).alias("_h")).agg(
        F.sum("_n").alias("_n"), F.sum("_nb").alias("_nb")))
    n, b = folded.agg(F.sum("_n"), F.sum("_nb")).first()
    if not n:
        return None
    ratio = F.greatest(F.col("_n") * F.lit(parts / n), F.col("_nb") * F.lit(parts / max(b, 1)))
    hot = folded.where(F.col("_h").isNotNull() & (ratio > 1)).select("_h", F.ceil(ratio).cast("int").alias("_n_salts"))
    return None if hot.isEmpty() else hot


def _runs(rows: DataFrame, parts: int, newest: bool) -> DataFrame:
    """Sort by content and number the runs of equal texts inside each key."""
    order = F.col("_id").desc_nulls_last() if newest else F.col("_id").asc_nulls_last()
    w = Window.partitionBy(*_KEY).orderBy("_norm", order)
    same = F.lag("_norm").over(w) == F.col("_norm")
    ranged = rows.repartitionByRange(parts, *_KEY).withColumn("_norm", ascii_lower(F.col("_t")))
    marked = ranged.withColumn("_start", F.when(same, 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_start").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.withColumn("_sha", F.sha2("_norm", 256)).withColumn(
        "_head", F.when((F.col("_start") == 1) & (F.col("_n_salts") > 1), F.col("_norm"))).drop("_norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 partitions: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and the ``carry`` columns packed in a struct ``carried``.

    Texts are equal if identical after lower-casing A-Z.  Of each group the
    row with the largest id stays (``keep='min'``: the smallest).

    A null text counts as empty and groups with empty texts.  A null id loses
    to any other; if all ids of a group are null, ``keep_id`` is null.  Rows
    repeated with the same id form one group in which exactly one row is
    ``kept``.  An empty table gives no rows.  Further columns are ignored
    unless named in ``carry``; their names cannot clash.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    newest = keep == "max"
    parts = partitions_of(docs.sparkSession, partitions)
    # the text travels once: as _t, with a mark for null
    extra = [F.struct(*[F.col(c) for c in carry if c != text_col], F.col(text_col).isNull().alias("_no_text")).alias("_row")] \
        if carry else []
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), *extra)
    norm = ascii_lower(F.col("_t"))
    keyed = (base.withColumn("_h", F.xxhash64(norm)).withColumn("_p", F.substring(norm, 1, 32))
             .withColumn("_b", F.octet_length("_t").cast("bigint") + 1))
    hot = _hot_list(keyed.select("_h", "_b"), parts)
    if hot is None:
        salted = keyed.withColumn("_n_salts", F.lit(1))
    else:
        salted = keyed.join(F.broadcast(hot), "_h", "left").withColumn(
            "_n_salts", F.coalesce("_n_salts", F.lit(1)))
    salted = salted.withColumn("_s", F.pmod(F.xxhash64("_id", F.lit("salt")), F.col("_n_salts").cast("bigint"))).drop("_b")

    best = F.max if newest else F.min
    w_run = Window.partitionBy(*_KEY, "_run")
    runs = _runs(salted, parts, newest)
    if not carry:
        runs = runs.drop("_t")
    out = (runs.withColumn("_size", F.count(F.lit(1)).over(w_run))
           .withColumn("_keep", best("_id").over(w_run)).withColumn("_first", F.col("_start") == 1))
    if hot is not None:
        heads = (_runs(salted.drop("_row").where("_n_salts > 1"), parts, newest).drop("_t")
                 .withColumn("_size", F.count(F.lit(1)).over(w_run))
                 .withColumn("_keep", best("_id").over(w_run)).where("_head is not null"))
        w_text = Window.partitionBy("_h", "_head")
        order = F.col("_keep").desc_nulls_last() if newest else F.col("_keep").asc_nulls_last()
        merged = heads.select(
            "_h", "_s", "_run", F.sum("_size").over(w_text).alias("_msize"),
            best("_keep").over(w_text).alias("_mkeep"),
            (F.row_number().over(w_text.orderBy(order, "_s")) == 1).alias("_mfirst"))
        # one row per salt of a hot text: at most 4 * partitions rows
        out = (out.join(F.broadcast(merged), ["_h", "_s", "_run"], "left")
               .withColumn("_first", F.col("_first") & F.coalesce("_mfirst", F.lit(True)))
               .withColumn("_size", F.coalesce("_msize", "_size"))
               .withColumn("_keep", F.when(F.col("_mfirst").isNull(), F.col("_keep")).otherwise(F.col("_mkeep"))))
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
        F.col("_size").cast("bigint").alias("group_size"), F.col("_first").alias("kept"),
        F.col("_sha").alias("text_sha256"), *([F.struct(*[_carried(c, text_col) for c in carry]).alias("carried")] if carry else []))


def _carried(name: str, text_col: str) -> Column:
    if name != text_col:
        return F.col("_row").getField(name).alias(name)
    return F.when(~F.col("_row").getField("_no_text"), F.col("_t")).alias(name)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    As in ``exact_groups``: null and empty texts are one group; of rows with the
    same id and text one stays; a null id stays only where the group has no
    other; texts of any length are compared whole; an empty table gives no rows."""
    groups = exact_groups(docs, id_col, text_col, keep, carry=docs.columns)
    return groups.where("kept").select(*[_field(c) for c in docs.columns])


def _field(name: str) -> Column:
    return F.col("carried").getField(name).alias(name)
