"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Column names match the DuckDB oracle in ``cartlens.plans.oracle``.
Inputs (see FIXTURES.md): ``event_sessions`` with the embedding features for
preferences, profiles, k-modes and k-NN; ``order_sessions`` for lengths and
short strata; ``customer_sessions`` for long sessions and sampling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.constants import STRATUM_SESSIONS
from cartlens.functions.scalar import category_int
from cartlens.operators import categorical as CT
from cartlens.operators import distance as D
from cartlens.operators import features as FT
from cartlens.operators import hamming_index as HI
from cartlens.operators import kmodes as KM
from cartlens.operators import popularity as PO
from cartlens.operators import preference as PF
from cartlens.operators import profiles as PR
from cartlens.operators import recommend as RC
from cartlens.operators import sessions as S
from cartlens.operators.session_store import SessionSums, loads
from cartlens.plans.inputs import (EMB_CATS, EMB_COLS, EMB_WORDS, PART_CATS, PART_WORDS, customer_views, emb_encoded,
                                  emb_encoded_raw, emb_packed, part_packed, pref_words, wide_pref_words)
from cartlens.runtime import scratch_folder
from cartlens.sources import fixtures as X
from cartlens.sources.files import (read_csv, read_csv_no_header, reuse_if_unchanged, reuse_or_compute, schema_from_header,
                                    write_table)
from cartlens.sources.inference import read_inferred
from cartlens.sources.stored import store_by_session

# Rows of the top lists here: fewer than the fixture's 100 items, so order and limit show.
SHOWN = 30

Query = Callable[[SparkSession, str], DataFrame]


def q_session_lengths(spark, sf_dir):
    """A1: items per order session."""
    return S.session_lengths(X.order_sessions(spark, sf_dir))


def q_session_count(spark, sf_dir):
    """A4: number of order sessions."""
    return S.session_count(S.session_lengths(X.order_sessions(spark, sf_dir)))


def q_item_views(spark, sf_dir):
    """A2: views per item."""
    return PO.item_views(X.event_sessions(spark, sf_dir))


def q_item_purchases(spark, sf_dir):
    """A3: purchases per item."""
    return PO.item_purchases(X.event_purchases(spark, sf_dir))


def q_views_vs_purchases(spark, sf_dir):
    """Top 30 items by views with their purchases."""
    return PO.views_vs_purchases(X.event_sessions(spark, sf_dir), X.event_purchases(spark, sf_dir), SHOWN)


def q_top_items(spark, sf_dir):
    """The 30 items viewed most, with their position."""
    return PO.top_items(X.event_sessions(spark, sf_dir), SHOWN)


def q_length_distribution(spark, sf_dir):
    """C14: items per customer session, longest first."""
    return PO.length_distribution(X.customer_sessions(spark, sf_dir))


def q_clean_features(spark, sf_dir):
    """One row per (item, category) of the raw embedding features."""
    return FT.clean_features(X.embedding_features(spark, sf_dir))


def q_encode_features(spark, sf_dir):
    """Multi-hot table of the 73 part categories."""
    return FT.encode_features(FT.clean_features(X.part_features(spark, sf_dir)), PART_CATS)


def q_short_session_rows(spark, sf_dir):
    """Rows of event sessions of at most 20 items."""
    return S.sessions_in_band(X.event_sessions(spark, sf_dir), hi=20)


def q_session_feature_rows(spark, sf_dir):
    """Event sessions joined to the encoded item features."""
    return S.session_feature_rows(X.event_sessions(spark, sf_dir), emb_encoded(spark, sf_dir))


def q_session_feature_means(spark, sf_dir):
    """Mean of each feature over the joined rows, sessions <= 20 items."""
    return S.session_feature_means(X.event_sessions(spark, sf_dir), emb_encoded(spark, sf_dir),
                                   EMB_COLS, hi=20, planes=1)


def q_session_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of at most 20 items -> binary preference vector."""
    return S.session_preferences(X.event_sessions(spark, sf_dir),
                                 emb_encoded(spark, sf_dir), EMB_COLS, hi=20, planes=1)


def q_stratum_sessions(spark, sf_dir):
    """Four order sessions of exactly 5 items, by session id."""
    return S.stratum_sessions(X.order_sessions(spark, sf_dir), 5, STRATUM_SESSIONS)


def q_stratum_purchases(spark, sf_dir):
    """Purchases of event sessions of exactly 20 items."""
    stratum = S.stratum_sessions(X.event_sessions(spark, sf_dir), 20)
    return PR.stratum_purchases(X.event_purchases(spark, sf_dir), stratum)


def q_feature_profile(spark, sf_dir):
    """Category shares of every event session's items."""
    return PR.feature_profile(X.event_sessions(spark, sf_dir), X.embedding_features(spark, sf_dir),
                              EMB_CATS)


PROFILE_LENGTHS = (100, 20, 5, 1)


def q_profile_comparison(spark, sf_dir):
    """Consumed versus purchased profile, event sessions of 20 items."""
    return PR.profile_comparison(X.event_sessions(spark, sf_dir), X.event_purchases(spark, sf_dir),
                                 X.embedding_features(spark, sf_dir), EMB_CATS, 20)


def q_profile_comparison_strata(spark, sf_dir):
    """The same for event sessions of 100, 20, 5 and 1 items, with the length, in one pass."""
    return PR.profile_comparison(X.event_sessions(spark, sf_dir), X.event_purchases(spark, sf_dir),
                                 X.embedding_features(spark, sf_dir), EMB_CATS, PROFILE_LENGTHS)


def q_sample_sessions(spark, sf_dir):
    """Seeded stratified sample of customer sessions, with features."""
    return S.sample_sessions(X.customer_sessions(spark, sf_dir), emb_encoded(spark, sf_dir), EMB_COLS)


SAMPLE_SIZE = 100


def q_sample_sessions_sized(spark, sf_dir):
    """Exactly 100 customer sessions, shared out over the length bands, with features."""
    return S.sample_sessions(X.customer_sessions(spark, sf_dir), emb_encoded(spark, sf_dir), EMB_COLS, sample_size=SAMPLE_SIZE)


def q_session_preferences_loaded(spark, sf_dir):
    """Preferences from sums that three loads of rows were merged into."""
    layout, folder = SessionSums(EMB_COLS), scratch_folder(spark, "sums")
    sums, encoded = None, emb_encoded(spark, sf_dir)
    for part in loads(X.event_sessions(spark, sf_dir), 3, "item_id", "date"):
        sums = layout.load(part, encoded, folder)
    return layout.preferences(sums)


def _stored_events(spark, sf_dir):
    """Event sessions stored by session, under a name of their own."""
    folder = scratch_folder(spark, "stored")
    return store_by_session(X.event_sessions(spark, sf_dir).select("session_id", "item_id", "date"),
                            folder.rsplit("/", 1)[1].replace("-", "_"), path=folder)


def q_time_spent_stored(spark, sf_dir):
    """W1 over sessions stored by session."""
    return _stored_events(spark, sf_dir).time_spent()


def q_recent_items_stored(spark, sf_dir):
    """T8, W2, T2 over sessions stored by session."""
    return _stored_events(spark, sf_dir).recent_items(10)


def q_short_session_rows_stored(spark, sf_dir):
    """J1, P4 over sessions stored by session."""
    return _stored_events(spark, sf_dir).in_band(hi=20)


def q_time_spent(spark, sf_dir):
    """Seconds to the next view of the same event session."""
    return S.time_spent(X.event_sessions(spark, sf_dir))


def q_recent_items(spark, sf_dir):
    """The 10 most recent views of each event session."""
    return S.recent_items(X.event_sessions(spark, sf_dir), 10)


KNN_K = 10


def q_pairwise_hamming(spark, sf_dir):
    """distance from each session's preference vector to the vector of
    the item it bought last."""
    left = pref_words(spark, sf_dir).join(X.last_purchases(spark, sf_dir), "session_id")
    return D.hamming_pairs(left, emb_packed(spark, sf_dir), "item_id", EMB_WORDS, keep=["session_id"])


def q_knn_items(spark, sf_dir):
    """The 10 items nearest to each session's preference."""
    return D.knn(pref_words(spark, sf_dir), emb_packed(spark, sf_dir), KNN_K, EMB_WORDS)


def q_knn_mrr(spark, sf_dir):
    """Mean reciprocal rank of the last purchase in the k-NN list."""
    return RC.mrr(q_knn_items(spark, sf_dir), X.last_purchases(spark, sf_dir))


def q_list_reciprocal(spark, sf_dir):
    """The list-only reciprocal score of each k-NN list."""
    return RC.list_reciprocal(q_knn_items(spark, sf_dir))


def q_distance_multiplicity(spark, sf_dir):
    """Each session's distances to all items, with multiplicity."""
    return D.distance_multiplicity(pref_words(spark, sf_dir), emb_packed(spark, sf_dir), EMB_WORDS)


def q_next_distance(spark, sf_dir):
    """Next larger distance value for each stored one."""
    return D.next_distance(q_distance_multiplicity(spark, sf_dir))


def q_distance_listing(spark, sf_dir):
    """T5: each session's distances in ascending order, repeats as position ranges."""
    return D.distance_listing(q_distance_multiplicity(spark, sf_dir))


def q_knn_items_wide(spark, sf_dir):
    """C11 over the 73 part categories (two words): customer sessions and parts."""
    return D.knn(wide_pref_words(spark, sf_dir), part_packed(spark, sf_dir), KNN_K, PART_WORDS)


def _wide_index(spark, sf_dir):
    return HI.knn_indexed(wide_pref_words(spark, sf_dir), part_packed(spark, sf_dir), KNN_K, PART_WORDS, len(PART_CATS))


def q_knn_items_indexed(spark, sf_dir):
    """The 10 items nearest to each session's preference, by multi-index hashing."""
    return HI.knn_indexed(pref_words(spark, sf_dir), emb_packed(spark, sf_dir), KNN_K, EMB_WORDS, len(EMB_CATS)).neighbours


def q_knn_items_wide_indexed(spark, sf_dir):
    """C11 over the 73 part categories by multi-index hashing."""
    return _wide_index(spark, sf_dir).neighbours


def q_knn_index_work(spark, sf_dir):
    """C11: candidates that each customer session's search by index looked at."""
    return _wide_index(spark, sf_dir).work.select("session_id", "looked", "probes", "radius", "scanned")


def _wide_fit(spark, sf_dir):
    rows = PF.clustering_rows(customer_views(spark, sf_dir), part_packed(spark, sf_dir), lo=11)
    return PF.fit_sessions(rows, PART_WORDS, len(PART_CATS))


def q_kmodes_fit_wide(spark, sf_dir):
    """C8 over the 73 part categories (two words): every long customer session."""
    return _wide_fit(spark, sf_dir).assignments.select("session_id", "item_id", "date", "cluster")


def q_clustered_preferences_wide(spark, sf_dir):
    """C4 over the 73 part categories (two words)."""
    return FT.words_to_wide(PF.clustered_preferences(_wide_fit(spark, sf_dir), PART_WORDS), PART_CATS, ["session_id"])


def _long_rows(spark, sf_dir):
    """Event sessions of more than 10 items joined to packed item vectors."""
    return PF.clustering_rows(X.event_sessions(spark, sf_dir), emb_packed(spark, sf_dir), lo=11)


def _unpacked(df: DataFrame, keep) -> DataFrame:
    return FT.words_to_wide(df, EMB_CATS, keep)


def q_value_domain(spark, sf_dir):
    """Distinct cell values of the raw multi-hot item table."""
    return FT.value_domain(emb_encoded_raw(spark, sf_dir), EMB_COLS)


def q_value_frequency(spark, sf_dir):
    """A10: count of each value in each column of the raw multi-hot table."""
    return FT.value_frequency(emb_encoded_raw(spark, sf_dir), EMB_COLS)


def q_group_mode(spark, sf_dir):
    """Column-wise mode of each long session's item vectors."""
    modes = KM.group_mode(_long_rows(spark, sf_dir), "session_id", EMB_WORDS, len(EMB_CATS))
    return _unpacked(modes, ["session_id"])


def _valued_rows(spark, sf_dir):
    """Long event sessions with the raw cells (0, 1, 2) of their items in lanes."""
    raw = emb_encoded_raw(spark, sf_dir)
    codec = CT.dictionary(raw, EMB_COLS)
    return codec, PF.clustering_rows(X.event_sessions(spark, sf_dir), CT.encode(raw, codec, ["item_id"]), lo=11)


def q_group_mode_values(spark, sf_dir):
    """A11 beyond 0/1: most frequent raw cell of each category in each long session, the lowest on ties."""
    codec, rows = _valued_rows(spark, sf_dir)
    return CT.group_modes(rows, "session_id", codec).select("session_id", *codec.decoded(dict.fromkeys(EMB_COLS, "bigint")))


def q_kmodes_fit_values(spark, sf_dir):
    """C8 beyond 0/1: k-modes of the raw cells of every long session, three clusters from density seeds."""
    codec, rows = _valued_rows(spark, sf_dir)
    fit = CT.fit(rows, "session_id", PF.newest_first(rows), codec, 3, "rows", ["item_id", "date"])
    return fit.assignments.select("session_id", "item_id", "date", "cluster")


def q_kmodes_density_seeds(spark, sf_dir):
    """C7 for k = 3: density seeds of each long session."""
    rows = _long_rows(spark, sf_dir)
    return KM.density_seeds(rows, "session_id", PF.newest_first(rows), EMB_WORDS, len(EMB_CATS), 3, ["item_id", "date"]) \
        .select("session_id", "seed", "item_id", "date")


def _laid_out(spark, sf_dir):
    rows = _long_rows(spark, sf_dir)
    return KM.laid_out(rows, "session_id", PF.newest_first(rows), EMB_WORDS, ["item_id", "date"])


def q_kmodes_seeds(spark, sf_dir):
    """The two seed rows of each long session."""
    seeds = KM.seeds(_laid_out(spark, sf_dir), "session_id", [F.col("_ord")], EMB_WORDS, len(EMB_CATS),
                     payload=["item_id", "date"])
    return seeds.select("session_id", "seed", "item_id", "date")


def q_kmodes_assign(spark, sf_dir):
    """First assignment of each row to its nearest seed."""
    rows = _laid_out(spark, sf_dir)
    seeds = KM.seeds(rows, "session_id", [F.col("_ord")], EMB_WORDS, len(EMB_CATS)).withColumnRenamed("seed", "cluster")
    return KM.assign(rows, seeds, "session_id", EMB_WORDS).select("session_id", "item_id", "date", "cluster")


def _fit(spark, sf_dir):
    return PF.fit_sessions(_long_rows(spark, sf_dir), EMB_WORDS, len(EMB_CATS))


def q_kmodes_fit(spark, sf_dir):
    """Final cluster of every row of every long session."""
    return _fit(spark, sf_dir).assignments.select("session_id", "item_id", "date", "cluster")


def q_cluster_sizes(spark, sf_dir):
    """Rows per non-empty cluster after the fit."""
    return KM.cluster_sizes(_fit(spark, sf_dir).assignments, "session_id")


def q_clustered_preferences(spark, sf_dir):
    """Preference of each long session by k-modes and vote."""
    rows = _long_rows(spark, sf_dir)
    prefs = PF.clustered_preferences(PF.fit_sessions(rows, EMB_WORDS, len(EMB_CATS)), EMB_WORDS)
    return _unpacked(prefs, ["session_id"])


def q_cluster_statistics(spark, sf_dir):
    """Cluster statistics of every long event session."""
    packed = emb_packed(spark, sf_dir)
    return PF.cluster_statistics(_long_rows(spark, sf_dir), X.last_purchases(spark, sf_dir), packed, EMB_WORDS, len(EMB_CATS))


def _saved(spark, df, fmt="csv"):
    """``df`` written whole (S4) to a new folder of the shared storage."""
    folder = scratch_folder(spark, "table")
    write_table(df, folder, fmt=fmt)
    return folder


def _line_items(spark, sf_dir):
    return X.order_sessions(spark, sf_dir).select("session_id", "item_id", F.col("l_linenumber").alias("line"))


def q_csv_typed(spark, sf_dir):
    """Order lines through CSV, read with declared types."""
    df = _line_items(spark, sf_dir)
    return read_csv(spark, _saved(spark, df), schema=df.schema)


def q_csv_strings(spark, sf_dir):
    """Item features through CSV as strings, the category read as an int."""
    raw = read_csv(spark, _saved(spark, X.part_features(spark, sf_dir)))
    return raw.withColumn("feature_category_id", category_int("feature_category_id"))


def q_csv_no_header(spark, sf_dir):
    """S3: a CSV without header, columns named by place."""
    folder = scratch_folder(spark, "table")
    write_table(_line_items(spark, sf_dir), folder, fmt="csv", header=False)
    return read_csv_no_header(spark, folder)


def q_csv_header_schema(spark, sf_dir):
    """The multi-hot item table through CSV, typed from its header."""
    folder = _saved(spark, q_encode_features(spark, sf_dir))
    return read_csv(spark, folder, schema=schema_from_header(spark, folder, "item_id"))


def q_reused_counts(spark, sf_dir):
    """Session lengths computed and saved once, then read from the saved copy."""
    folder = scratch_folder(spark, "counts")
    reuse_or_compute(spark, folder, lambda: S.session_lengths(X.order_sessions(spark, sf_dir)))
    return reuse_or_compute(spark, folder, lambda: S.session_lengths(X.order_sessions(spark, sf_dir).limit(0)))


def q_reused_after_growth(spark, sf_dir):
    """Saved session lengths whose input has grown are computed again."""
    source, saved = scratch_folder(spark, "source"), scratch_folder(spark, "counts")
    first, second = loads(X.order_sessions(spark, sf_dir).select("session_id", "item_id"), 2, "session_id", "item_id")
    lengths = lambda: S.session_lengths(spark.read.parquet(source))
    first.write.parquet(source)
    reuse_if_unchanged(spark, saved, lengths)
    second.write.mode("append").parquet(source)
    return reuse_if_unchanged(spark, saved, lengths)


def q_csv_inferred(spark, sf_dir):
    """Order lines through CSV, typed from a sample of every file; no row misfits."""
    return read_inferred(spark, _saved(spark, _line_items(spark, sf_dir)), rows_per_file=500).rows


QUERIES: dict[str, Query] = {
    "session_lengths": q_session_lengths,
    "session_count": q_session_count,
    "item_views": q_item_views,
    "item_purchases": q_item_purchases,
    "views_vs_purchases": q_views_vs_purchases,
    "length_distribution": q_length_distribution,
    "clean_features": q_clean_features,
    "encode_features": q_encode_features,
    "short_session_rows": q_short_session_rows,
    "session_feature_rows": q_session_feature_rows,
    "session_feature_means": q_session_feature_means,
    "session_preferences": q_session_preferences,
    "stratum_sessions": q_stratum_sessions,
    "stratum_purchases": q_stratum_purchases,
    "feature_profile": q_feature_profile,
    "profile_comparison": q_profile_comparison,
    "profile_comparison_strata": q_profile_comparison_strata,
    "sample_sessions": q_sample_sessions,
    "time_spent": q_time_spent,
    "recent_items": q_recent_items,
    "pairwise_hamming": q_pairwise_hamming,
    "knn_items": q_knn_items,
    "knn_mrr": q_knn_mrr,
    "list_reciprocal": q_list_reciprocal,
    "distance_multiplicity": q_distance_multiplicity,
    "next_distance": q_next_distance,
    "distance_listing": q_distance_listing,
    "knn_items_wide": q_knn_items_wide,
    "knn_items_indexed": q_knn_items_indexed,
    "knn_items_wide_indexed": q_knn_items_wide_indexed,
    "knn_index_work": q_knn_index_work,
    "kmodes_fit_wide": q_kmodes_fit_wide,
    "clustered_preferences_wide": q_clustered_preferences_wide,
    "top_items": q_top_items,
    "csv_typed": q_csv_typed,
    "csv_strings": q_csv_strings,
    "csv_no_header": q_csv_no_header,
    "csv_header_schema": q_csv_header_schema,
    "reused_counts": q_reused_counts,
    "reused_after_growth": q_reused_after_growth,
    "csv_inferred": q_csv_inferred,
    "sample_sessions_sized": q_sample_sessions_sized,
    "session_preferences_loaded": q_session_preferences_loaded,
    "time_spent_stored": q_time_spent_stored,
    "recent_items_stored": q_recent_items_stored,
    "short_session_rows_stored": q_short_session_rows_stored,
    "group_mode_values": q_group_mode_values,
    "kmodes_fit_values": q_kmodes_fit_values,
    "kmodes_density_seeds": q_kmodes_density_seeds,
    "value_domain": q_value_domain,
    "value_frequency": q_value_frequency,
    "group_mode": q_group_mode,
    "kmodes_seeds": q_kmodes_seeds,
    "kmodes_assign": q_kmodes_assign,
    "kmodes_fit": q_kmodes_fit,
    "cluster_sizes": q_cluster_sizes,
    "clustered_preferences": q_clustered_preferences,
    "cluster_statistics": q_cluster_statistics,
}
