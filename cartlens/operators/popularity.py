"""Item popularity and session-length distribution (the notebook's first
two analyses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.constants import TOP_ITEMS
from cartlens.operators.sessions import session_lengths

ITEM, SESSION = "item_id", "session_id"


def item_views(sessions: DataFrame) -> DataFrame:
    """Views per item (A2), most viewed first (T1), ties by item id."""
    return (sessions.groupBy(ITEM).agg(F.count(ITEM).alias("count_seen"))
                    .orderBy(F.col("count_seen").desc(), ITEM))


def top_items(sessions: DataFrame, n: int = TOP_ITEMS) -> DataFrame:
    """The ``n`` items viewed most (T1, T3) with their position from 1.  The
    position is numbered after the limit, on at most ``n`` rows."""
    w = Window.orderBy(F.col("count_seen").desc(), ITEM)
    return item_views(sessions).limit(n).withColumn("position", F.row_number().over(w))


def item_purchases(purchases: DataFrame) -> DataFrame:
    """Purchases per item (A3), most bought first, ties by item id."""
    return (purchases.groupBy(ITEM).agg(F.count(ITEM).alias("count_purchased"))
                     .orderBy(F.col("count_purchased").desc(), ITEM))


def views_vs_purchases(sessions: DataFrame, purchases: DataFrame, n: int | None = TOP_ITEMS) -> DataFrame:
    """Views and purchases side by side (C13, J3): inner join, so items
    never bought drop out; most viewed first; the top ``n`` (T3).

    Both counts are two-phase aggregates; the join then runs on one row
    per item, and the top-n is a TakeOrdered (n rows per task)."""
    seen = sessions.groupBy(ITEM).agg(F.count(ITEM).alias("count_seen"))
    bought = purchases.groupBy(ITEM).agg(F.count(ITEM).alias("count_purchased"))
    out = (seen.join(bought, ITEM, "inner").select(ITEM, "count_seen", "count_purchased")
               .orderBy(F.col("count_seen").desc(), ITEM))
    return out.limit(n) if n is not None else out


def length_distribution(sessions: DataFrame) -> DataFrame:
    """Items per session, longest first."""
    return (session_lengths(sessions, "n_consumed_items")
            .orderBy(F.col("n_consumed_items").desc(), SESSION))
