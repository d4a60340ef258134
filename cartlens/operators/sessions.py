"""Sessions: lengths, bands, joins to item features, mean-and-threshold
preferences, strata, time spent, recency and the stratified sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.constants import PREFERENCE_THRESHOLD, RECENT_ITEMS, SAMPLE_BANDS, SHORT_SESSION_MAX_ITEMS
from cartlens.functions.bits import quoted
from cartlens.functions.scalar import band_fraction, epoch_micros, sample_unit, threshold_sql
from cartlens.operators.cells import cell_sums, cell_words, planes_of
from cartlens.operators.sampling import band_of, bottom_k, quotas
from cartlens.runtime import checkpoint_dir

SESSION, ITEM, DATE = "session_id", "item_id", "date"


def session_lengths(sessions: DataFrame, name: str = "nb_items") -> DataFrame:
    """``count(item_id)`` per session (A1): non-null items, repeats counted.
    Partial counts are taken map-side, so a hot session reaches the reducer
    as one row per map task."""
    return sessions.groupBy(SESSION).agg(F.count(ITEM).alias(name))


def session_count(lengths: DataFrame) -> DataFrame:
    """Number of sessions (A4): non-null session ids of the length table."""
    return lengths.agg(F.count(SESSION).alias("n_sessions"))


def length_between(lengths: DataFrame, lo: int | None = None, hi: int | None = None,
                   name: str = "nb_items") -> DataFrame:
    """Length predicate (P4): ``lo <= nb_items <= hi``; either end open.
    ``lo == hi`` is the exact stratum (P5)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(name) >= lo)
    if hi is not None:
        cond = cond & (F.col(name) <= hi)
    return lengths.where(cond)


def sessions_in_band(sessions: DataFrame, lo: int | None = None, hi: int | None = None,
                     lengths: DataFrame | None = None, null_session: bool = False) -> DataFrame:
    """Rows of sessions whose length is in the band (J1, P4): a left semi
    join on ``session_id`` with the qualifying lengths.  Spark broadcasts
    the length side only when its runtime size passes the threshold.
    ``lengths``: those of ``session_lengths``, if known already.  Rows without a
    session id are left out, unless ``null_session`` takes them for one session."""
    keep = length_between(session_lengths(sessions) if lengths is None else lengths, lo, hi).select(SESSION)
    if null_session:
        return sessions.join(keep.withColumnRenamed(SESSION, "_kept"), F.col(SESSION).eqNullSafe(F.col("_kept")), "left_semi")
    return sessions.join(keep, SESSION, "left_semi")


def session_feature_rows(sessions: DataFrame, features: DataFrame) -> DataFrame:
    """Sessions joined to item features on ``item_id`` (J2): items without
    features vanish, a repeated view repeats its feature row."""
    return sessions.join(features, ITEM, "inner")


def session_feature_means(sessions: DataFrame, encoded: DataFrame, feature_cols: Sequence[str],
                          lo: int | None = None, hi: int | None = SHORT_SESSION_MAX_ITEMS,
                          planes: int | None = None) -> DataFrame:
    """Per-session mean of every feature column over the joined rows (A6),
    for sessions whose length (A1) is in ``[lo, hi]``.

    One pass gives both the length (all rows, as A1 counts them) and the
    means (joined rows only, as the inner join and ``avg`` of the reference
    give them); sessions with no joined row are dropped, as the inner join
    drops them.  Cells are non-null counts, as ``encode_features`` gives
    them; ``planes`` is the number of bits of the largest (1 for a cleaned
    table), looked up if not given.  The rows are shuffled by session with their items' packed words;
    see ``cells``."""
    cols = list(feature_cols)
    planes = planes or planes_of(encoded, cols)
    sums = cell_sums(sessions, cell_words(encoded, cols, planes), cols, SESSION, planes)
    cond = F.col("_joined") > 0
    if lo is not None:
        cond = cond & (F.col("_len") >= lo)
    if hi is not None:
        cond = cond & (F.col("_len") <= hi)
    return sums.where(cond).selectExpr(
        SESSION, *[f"cast({quoted(c)} as double) / _joined as {quoted(c)}" for c in feature_cols])


def session_preferences(sessions: DataFrame, encoded: DataFrame, feature_cols: Sequence[str],
                        threshold_value: float = PREFERENCE_THRESHOLD,
                        lo: int | None = None, hi: int | None = SHORT_SESSION_MAX_ITEMS,
                        planes: int | None = None) -> DataFrame:
    """Binary preference vector per session (C3, C5, P8): feature means over
    the joined rows, then ``mean >= threshold`` gives 1.  Default band is
    sessions of at most 20 items."""
    means = session_feature_means(sessions, encoded, feature_cols, lo, hi, planes)
    return means.selectExpr(SESSION, *[f"{threshold_sql(c, threshold_value)} as {quoted(c)}" for c in feature_cols])


def stratum_sessions(sessions: DataFrame, length: int, n: int | None = None,
                     name: str = "n_consumed_items") -> DataFrame:
    """Sessions of exactly ``length`` items (P5), optionally the first ``n``
    by session id (T3): ``orderBy(...).limit(n)`` is a TakeOrdered, each
    task keeps n rows."""
    out = (session_lengths(sessions, name).where(F.col(name) == length)
           .select(name, SESSION))
    if n is not None:
        out = out.orderBy(SESSION).limit(n)
    return out


def _gaps(frame: DataFrame, following: Column, kind, keep: Sequence[str]) -> DataFrame:
    seconds = (epoch_micros(following, kind) - epoch_micros(DATE, kind)) / F.lit(1e6)
    return frame.select(SESSION, ITEM, DATE, *keep, seconds.alias("time_spent"))


def plain_time_spent(sessions: DataFrame, order: Sequence[str] = (DATE, ITEM), keep: Sequence[str] = (), kind=None) -> DataFrame:
    """``time_spent`` by one window per session, for sessions that fit a task."""
    w = Window.partitionBy(SESSION).orderBy(*[F.col(c) for c in order])
    return _gaps(sessions, F.lead(DATE).over(w), kind or sessions.schema[DATE].dataType, keep)


def time_spent(sessions: DataFrame, order: Sequence[str] = (DATE, ITEM),
               rows_per_task: int = 1 << 20, keep: Sequence[str] = ()) -> DataFrame:
    """Seconds from each view to the next one of the same session (W1);
    null for the last view.  Rows follow ``order`` (date, then item id; null
    dates first); ``keep`` columns are carried through.

    Ordinary sessions take a plain window.  The rows of sessions above
    ``rows_per_task`` are range-partitioned on (session, order), so they are
    cut by rows whatever their dates are; ``lead`` runs inside each piece,
    and the last row of a piece takes the first row of the session's next
    piece (a window over one row per piece)."""
    keep = [c for c in keep if c not in (SESSION, ITEM, DATE)]
    rows = sessions.select(SESSION, ITEM, DATE, *keep)
    kind = sessions.schema[DATE].dataType
    by = [F.col(c) for c in order]

    gap = lambda frame, following: _gaps(frame, following, kind, keep)
    plain = lambda frame: plain_time_spent(frame, order, keep, kind)
    # at most (all rows / rows_per_task) sessions are hot, so this side is small
    hot = (rows.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task))
    pieces = hot.agg(F.sum(F.ceil(F.col("_n") / F.lit(rows_per_task)))).first()[0]
    if not pieces:
        return plain(rows)
    hot = hot.select(F.col(SESSION).alias("_hot"))
    in_hot = F.col(SESSION).eqNullSafe(F.col("_hot"))
    checkpoint_dir(sessions.sparkSession)
    # written once: both uses must see the same pieces
    cut = (rows.join(hot, in_hot, "left_semi").repartitionByRange(int(pieces), SESSION, *by)
               .withColumn("_piece", F.spark_partition_id()).checkpoint())
    heads = cut.groupBy(SESSION, "_piece").agg(F.min(DATE).alias("_head"))
    following = heads.select(F.col(SESSION).alias("_s"), F.col("_piece").alias("_p"),
                             F.lead("_head").over(Window.partitionBy(SESSION).orderBy("_piece")).alias("_next"))
    w = Window.partitionBy(SESSION, "_piece").orderBy(*by)
    joined = (cut.withColumn("_lead", F.lead(DATE).over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
                 .join(following, F.col(SESSION).eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")), "left"))
    linked = gap(joined, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead")))
    return plain(rows.join(hot, in_hot, "left_anti")).unionByName(linked)


def recent_items(sessions: DataFrame, n: int = RECENT_ITEMS, tie: Sequence[str] = (ITEM,)) -> DataFrame:
    """The ``n`` most recent rows of each session (T8) with their recency
    position from 1 (W2), newest first, ties by item id.  The filter on
    ``row_number`` is planned as a WindowGroupLimit, applied map-side
    before the shuffle, so a hot session ships at most n rows per task."""
    w = Window.partitionBy(SESSION).orderBy(F.col(DATE).desc(), *[F.col(c) for c in tie])
    return (sessions.select(SESSION, ITEM, DATE, F.row_number().over(w).alias("recency"))
                    .where(F.col("recency") <= n))


def sample_sessions(sessions: DataFrame, encoded: DataFrame, feature_cols: Sequence[str],
                    seed: int = 42, bands=None, sample_size: int | None = None) -> DataFrame:
    """Stratified sample of whole sessions by length.

    Length 20-30 keeps 70%, 31-50 80%, 51-100 all; other lengths none.  A
    session is kept when its seeded hash unit is below its fraction, so the
    sample repeats exactly and needs no driver-side fraction map.  With
    ``sample_size`` exactly that many sessions are kept (or as many as the
    fractions allow), shared out over the bands in proportion to fraction times
    sessions, in each band those of smallest hash (``sampling``).  Rows of kept
    sessions are joined to the item features (inner)."""
    lengths = session_lengths(sessions)
    bands = SAMPLE_BANDS if bands is None else bands
    if sample_size is None:
        kept = lengths.where(sample_unit(SESSION, seed) < band_fraction("nb_items", bands)).select(SESSION)
    else:
        keyed = lengths.select(SESSION, band_of("nb_items", bands).alias("stratum")).where("stratum is not null")
        kept = bottom_k(keyed, SESSION, quotas(keyed, [f for *_, f in bands], sample_size), seed).select(SESSION)
    rows = sessions.select(SESSION, DATE, ITEM).join(kept, SESSION, "left_semi")
    return rows.join(encoded.select(ITEM, *feature_cols), ITEM, "inner") \
               .select(SESSION, DATE, ITEM, *feature_cols)
