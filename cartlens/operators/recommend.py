"""Scoring of ranked recommendation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reciprocal_ranks(ranked: DataFrame, targets: DataFrame, key: str = "session_id",
                     item: str = "item_id") -> DataFrame:
    """Per evaluated (session, target item), 1/rank of the target in the
    session's list, 0 when it is not in the list.  Evaluated = sessions that
    have both a list and a target.  The list is read once: every list row
    meets the session's target, and one aggregate keeps the hit."""
    t = targets.select(key, F.col(item).alias("_target"))
    hit = F.when(F.col(item) == F.col("_target"), F.lit(1.0) / F.col("rank"))
    return (ranked.select(key, item, "rank").join(t, key, "inner")
                  .groupBy(key, "_target")
                  .agg(F.coalesce(F.max(hit), F.lit(0.0)).alias("rr"))
                  .select(key, F.col("_target").alias(item), "rr"))


def mrr(ranked: DataFrame, targets: DataFrame, key: str = "session_id", item: str = "item_id") -> DataFrame:
    """Mean reciprocal rank over the evaluated sessions (A13, C12):
    one row ``(mrr, n_sessions)``."""
    rr = reciprocal_ranks(ranked, targets, key, item)
    return rr.agg(F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n_sessions"))


def list_reciprocal(ranked: DataFrame, key: str = "session_id") -> DataFrame:
    """The list-only score as the reference codes it (A16): per list, the
    sum over positions of (1 / list length) * (1 / rank), ranks from 1."""
    return ranked.groupBy(key).agg(F.avg(F.lit(1.0) / F.col("rank")).alias("score"))
