"""Preference by clustering (long sessions) and per-session cluster
statistics, both on top of the k-modes job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.constants import KMODES_CLUSTERS, LONG_SESSION_MIN_ITEMS, RECENT_ITEMS
from cartlens.functions.scalar import epoch_micros, majority_vote
from cartlens.operators import kmodes as KM
from cartlens.operators.sessions import sessions_in_band, time_spent
from cartlens.runtime import written

SESSION, ITEM, DATE = "session_id", "item_id", "date"


def newest_first(rows: DataFrame) -> list[Column]:
    """Group order of the clustered sessions: newest view first, then item id;
    views without a date come last."""
    return [F.col(DATE).isNull(), -epoch_micros(DATE, rows.schema[DATE].dataType), F.col(ITEM)]


def clustering_rows(sessions: DataFrame, packed: DataFrame, lo: int | None = LONG_SESSION_MIN_ITEMS,
                    hi: int | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Rows of sessions in the length band joined to packed item vectors
    (J1, J2): ``(session_id, item_id, date, w...)``; featureless items drop."""
    return sessions_in_band(sessions.select(SESSION, ITEM, DATE), lo, hi, lengths).join(packed, ITEM, "inner")


def fit_sessions(rows: DataFrame, words: Sequence[str], n_features: int, k: int = KMODES_CLUSTERS,
                 payload: Sequence[str] = (ITEM, DATE)) -> KM.KModesResult:
    """k-modes of every session, round limit = the session's row count.  The
    rows are written once: the fit reads them several times, and they come from joins."""
    rows = written(rows.select(SESSION, *payload, *words), "fit-rows")
    return KM.fit(rows, SESSION, newest_first(rows), words, n_features, k, max_iter="rows", payload=payload)


def clustered_preferences(result: KM.KModesResult, words: Sequence[str],
                          n_recent: int = RECENT_ITEMS) -> DataFrame:
    """Preference of each long session (C4, T8, F4): the mode of the cluster
    most of its ``n_recent`` newest rows are nearest to (strict majority for
    cluster 1, else cluster 0).  ``(session_id, w...)``."""
    # the fit's rows (read from its checkpoint) carry the vectors and the
    # newest-first order key, so the input is not computed again
    w = Window.partitionBy(SESSION).orderBy("_ord")
    recent = (result.assignments.select(SESSION, "_ord", *words)
                    .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_recent).drop("_r"))
    arr = KM.modes_array(result.modes, SESSION, words)
    # the words of both modes as columns of their own: fixed-width, so the aggregate is a hash aggregate
    both = [F.get("_modes", F.lit(c))[w].alias(f"_m{c}_{w}") for c in range(2) for w in words]
    votes = (recent.join(arr, SESSION).select(SESSION, KM.nearest_mode(words).alias("_c"), *both)
                   .groupBy(SESSION).agg(F.sum("_c").alias("_s"), F.count(F.lit(1)).alias("_n"),
                                         *[F.first(f"_m{c}_{w}").alias(f"_m{c}_{w}") for c in range(2) for w in words]))
    second = majority_vote("_s", "_n").cast("int") == 1
    return votes.select(SESSION, *[F.when(second, F.col(f"_m1_{w}")).otherwise(F.col(f"_m0_{w}")).alias(w) for w in words])


def cluster_statistics(rows: DataFrame, targets: DataFrame, packed: DataFrame,
                       words: Sequence[str], n_features: int) -> DataFrame:
    """Per session (C10, A14, W1): ``session_length`` (rows clustered),
    ``var1_d``/``var2_d`` population variance of the distance of each
    cluster's rows to its mode, ``var1_t``/``var2_t`` of their time spent
    (seconds to the next view; the last view has none), 0 for an empty or
    one-value cluster, and ``true_cluster``, the mode nearest to the vector
    of the session's target item, null for a session without a target that
    has features."""
    words = list(words)
    timed = time_spent(rows, keep=words)
    result = fit_sessions(timed, words, n_features, payload=(ITEM, DATE, "time_spent"))
    per = result.assignments.select(SESSION, KM.CLUSTER, F.col("distance").alias("_d"), "time_spent")

    def var(c: str, cl: int) -> Column:
        return F.coalesce(F.var_pop(F.when(F.col(KM.CLUSTER) == cl, F.col(c))), F.lit(0.0)).cast("float")
    stats = per.groupBy(SESSION).agg(
        F.count(F.lit(1)).cast("int").alias("session_length"),
        var("_d", 0).alias("var1_d"), var("_d", 1).alias("var2_d"),
        var("time_spent", 0).alias("var1_t"), var("time_spent", 1).alias("var2_t"))
    target_vec = targets.select(SESSION, ITEM).join(packed, ITEM, "inner")
    arr = KM.modes_array(result.modes, SESSION, words)
    truth = target_vec.join(arr, SESSION).select(SESSION, KM.nearest_mode(words).alias("true_cluster"))
    return stats.join(truth, SESSION, "left")
