"""Sessions stored by session, so that work per session needs no shuffle.

``store_by_session`` writes the rows as a table bucketed by ``session_id``:
lengths, joins and windows by session all read that one layout, and none of
them exchanges rows on ``session_id`` again.  A bucket is read by one task, so the rows
of sessions above ``rows_per_task`` are kept beside it in a plain table and take
the ordinary plans, which spread a hot session over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.constants import RECENT_ITEMS
from cartlens.operators import sessions as S
from cartlens.runtime import scratch_folder

SESSION = "session_id"


@dataclass
class StoredSessions:
    """Ordinary sessions in buckets, and the rows of hot ones (None if there are none)."""

    bucketed: DataFrame
    hot: DataFrame | None
    names: tuple[str, ...]

    def _both(self, work) -> DataFrame:
        """``work`` on the ordinary sessions and on the hot ones; no session is in both."""
        out = work(self.bucketed)
        return out if self.hot is None else out.unionByName(work(self.hot))

    def rows(self) -> DataFrame:
        return self._both(lambda rows: rows)

    def lengths(self) -> DataFrame:
        """Items per session (A1)."""
        return self._both(S.session_lengths)

    def in_band(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Rows of the sessions of these lengths."""
        return self._both(lambda rows: S.sessions_in_band(rows, lo, hi))

    def time_spent(self, rows_per_task: int = 1 << 20) -> DataFrame:
        """Seconds to the next view (W1): a window in the buckets; hot sessions are cut in pieces."""
        out = S.plain_time_spent(self.bucketed)
        return out if self.hot is None else out.unionByName(S.time_spent(self.hot, rows_per_task=rows_per_task))

    def recent_items(self, n: int = RECENT_ITEMS) -> DataFrame:
        """The newest rows of each session."""
        return self._both(lambda rows: S.recent_items(rows, n))

    def drop(self) -> None:
        """Forget the tables; their folders stay."""
        for name in self.names:
            self.bucketed.sparkSession.sql(f"drop table if exists `{name}`")


def store_by_session(sessions: DataFrame, name: str, buckets: int | None = None, path: str | None = None,
                     rows_per_task: int = 1 << 20) -> StoredSessions:
    """Store ``sessions`` under ``name`` (and ``name_hot``), in the shared folder
    or below ``path``.

    One shuffle by session writes one file per bucket, sorted by session;
    ``buckets`` is about the rows divided by what a task should read (the
    session's ``spark.sql.shuffle.partitions`` if not given).  Rows without a session id go to the plain table, as no
    bucket should hold all of them."""
    spark = sessions.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_folder(spark, "stored")
    # at most (all rows / rows_per_task) sessions are hot, so this side is small
    hot = (sessions.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_n"))
           .where((F.col("_n") > rows_per_task) | F.col(SESSION).isNull()).select(F.col(SESSION).alias("_hot")))
    names, apart = [name], None
    is_hot = F.col(SESSION).eqNullSafe(F.col("_hot"))
    if not hot.isEmpty():
        names.append(f"{name}_hot")
        sessions.join(hot, is_hot, "left_semi").write.option("path", f"{path}/hot").saveAsTable(names[1])
        apart = spark.table(names[1])
        sessions = sessions.join(hot, is_hot, "left_anti")
    (sessions.repartition(buckets, SESSION).write.bucketBy(buckets, SESSION).sortBy(SESSION)
             .option("path", f"{path}/buckets").saveAsTable(name))
    return StoredSessions(spark.table(name), apart, tuple(names))
