"""Batch jobs over files, one per entry point of the reference's data
preparation: clean the item features, encode them, build the session
preference table, draw the stratified sample.  Each reads whole folders,
runs the operators and writes a whole folder (CSV with a header, as the
reference keeps its tables, or Parquet).

Raw CSV keys are read as strings and cast (F5); saved wide tables are typed
from their header.  Nothing is inferred from values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.constants import LONG_SESSION_MIN_ITEMS, PREFERENCE_THRESHOLD
from cartlens.functions.bits import word_names
from cartlens.functions.scalar import category_int
from cartlens.operators import distance as D
from cartlens.operators import preference as PF
from cartlens.operators import recommend as RC
from cartlens.operators.features import clean_features, encode_features, wide_to_words, words_to_wide
from cartlens.operators.sessions import sample_sessions, session_lengths, session_preferences
from cartlens.runtime import folder_exists
from cartlens.sources.files import read_csv, reuse_if_unchanged, reuse_or_compute, schema_from_header, write_table


def _scan(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return read_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)


def _features(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Raw or clean features: the two keys typed, other columns carried through as they are."""
    return (_scan(spark, path, fmt).withColumn("item_id", F.col("item_id").cast("long"))
            .withColumn("feature_category_id", category_int("feature_category_id")))


def _encoded(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A saved multi-hot item table, typed from its header."""
    if fmt == "csv":
        return read_csv(spark, path, schema=schema_from_header(spark, path, "item_id"))
    return spark.read.parquet(path)


def _sessions(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    df = _scan(spark, path, fmt)
    # text carries no zone, so it is read as a clock time and not through the session's zone
    date = F.col("date") if fmt != "csv" else F.col("date").cast("timestamp_ntz")
    return df.select(F.col("session_id").cast("long").alias("session_id"),
                     F.col("item_id").cast("long").alias("item_id"), date.alias("date"))


def clean_dataset(spark: SparkSession, features_path: str, dest: str, fmt: str = "csv",
                  mode: str = "errorifexists") -> None:
    """One row per (item, category) of the raw feature table."""
    write_table(clean_features(_features(spark, features_path, fmt)), dest, fmt=fmt, mode=mode)


def preprocess_features(spark: SparkSession, features_path: str, dest: str, categories: Sequence[int],
                        fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Multi-hot item table, one column per category."""
    write_table(encode_features(_features(spark, features_path, fmt), categories), dest, fmt=fmt, mode=mode)


def preprocess_sessions(spark: SparkSession, sessions_path: str, encoded_path: str, dest: str,
                        fmt: str = "csv", threshold: float = PREFERENCE_THRESHOLD,
                        max_len: int = 20, mode: str = "errorifexists") -> None:
    """Binary preference vector of every session of at most ``max_len`` items
    (C3): the encoded item table is read back with its category columns."""
    enc = _encoded(spark, encoded_path, fmt)
    cols = [c for c in enc.columns if c != "item_id"]
    prefs = session_preferences(_sessions(spark, sessions_path, fmt), enc, cols, threshold, hi=max_len)
    write_table(prefs, dest, fmt=fmt, mode=mode)


def sample(spark: SparkSession, sessions_path: str, encoded_path: str, dest: str, fmt: str = "csv",
           seed: int = 42, mode: str = "errorifexists", sample_size: int | None = None) -> None:
    """Stratified sample of sessions of 20 to 100 items with their item
    features (C6); exactly ``sample_size`` sessions if given."""
    enc = _encoded(spark, encoded_path, fmt)
    cols = [c for c in enc.columns if c != "item_id"]
    sampled = sample_sessions(_sessions(spark, sessions_path, fmt), enc, cols, seed, sample_size=sample_size)
    write_table(sampled, dest, fmt=fmt, mode=mode)


def session_counts(spark: SparkSession, sessions_path: str, counts_path: str, fmt: str = "csv") -> DataFrame:
    """Items per session (A1), computed and saved at the first call and read
    from ``counts_path`` afterwards, as long as the files of the sessions stay
    as they are (S6), or are gone altogether."""
    schema = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("nb_items", T.LongType())])
    reuse = reuse_if_unchanged if folder_exists(spark, sessions_path) else reuse_or_compute
    return reuse(spark, counts_path, lambda: session_lengths(_sessions(spark, sessions_path, fmt)), fmt, schema)


def _packed(spark: SparkSession, encoded_path: str, fmt: str) -> tuple[DataFrame, list[str], list[str]]:
    """Packed item vectors of a saved multi-hot table (cells must be 0 or 1), its categories and its words."""
    enc = _encoded(spark, encoded_path, fmt)
    cols = [c for c in enc.columns if c != "item_id"]
    return wide_to_words(enc, cols, ["item_id"], binary=True), cols, word_names(len(cols))


def _words(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    prefs = read_csv(spark, path, schema=schema_from_header(spark, path, "session_id")) if fmt == "csv" else spark.read.parquet(path)
    return wide_to_words(prefs, [c for c in prefs.columns if c != "session_id"], ["session_id"], binary=True)


def _long_fit(spark: SparkSession, sessions_path: str, encoded_path: str, fmt: str, min_len: int):
    packed, cols, words = _packed(spark, encoded_path, fmt)
    rows = PF.clustering_rows(_sessions(spark, sessions_path, fmt), packed, lo=min_len)
    return rows, packed, cols, words


def cluster_sessions(spark: SparkSession, sessions_path: str, encoded_path: str, dest: str, fmt: str = "csv",
                     min_len: int = LONG_SESSION_MIN_ITEMS, mode: str = "errorifexists") -> None:
    """Preference vector of every session of at least ``min_len`` items by clustering (C4)."""
    rows, _, cols, words = _long_fit(spark, sessions_path, encoded_path, fmt, min_len)
    prefs = PF.clustered_preferences(PF.fit_sessions(rows, words, len(cols)), words)
    write_table(words_to_wide(prefs, cols, ["session_id"]), dest, fmt=fmt, mode=mode)


def session_cluster_statistics(spark: SparkSession, sessions_path: str, purchases_path: str, encoded_path: str,
                               dest: str, fmt: str = "csv", min_len: int = LONG_SESSION_MIN_ITEMS,
                               mode: str = "errorifexists") -> None:
    """Cluster statistics of the same sessions."""
    rows, packed, cols, words = _long_fit(spark, sessions_path, encoded_path, fmt, min_len)
    stats = PF.cluster_statistics(rows, _purchases(spark, purchases_path, fmt), packed, words, len(cols))
    write_table(stats, dest, fmt=fmt, mode=mode)


def recommend(spark: SparkSession, preferences_path: str, encoded_path: str, dest: str, k: int, fmt: str = "csv",
              mode: str = "errorifexists") -> None:
    """The ``k`` items nearest to every saved preference (C11)."""
    packed, _, words = _packed(spark, encoded_path, fmt)
    write_table(D.knn(_words(spark, preferences_path, fmt), packed, k, words), dest, fmt=fmt, mode=mode)


def evaluate(spark: SparkSession, recommendations_path: str, purchases_path: str, fmt: str = "csv") -> DataFrame:
    """Mean reciprocal rank of the purchased items in saved recommendations."""
    ranked = _scan(spark, recommendations_path, fmt).selectExpr(
        "cast(session_id as bigint) session_id", "cast(rank as int) rank", "cast(item_id as bigint) item_id")
    return RC.mrr(ranked, _purchases(spark, purchases_path, fmt))


# ---------------------------------------------------------------- analyses
# The notebook's analyses over files (read as strings, as the notebook reads
# them, and cast).  They return DataFrames; the caller collects or plots.

def _purchases(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return _scan(spark, path, fmt).select(F.col("session_id").cast("long").alias("session_id"),
                                          F.col("item_id").cast("long").alias("item_id"))


def popularity(spark: SparkSession, sessions_path: str, purchases_path: str, fmt: str = "csv",
               top: int | None = 100) -> DataFrame:
    """Views and purchases per item, most viewed first."""
    from cartlens.operators.popularity import views_vs_purchases
    return views_vs_purchases(_sessions(spark, sessions_path, fmt), _purchases(spark, purchases_path, fmt), top)


def length_distribution(spark: SparkSession, sessions_path: str, fmt: str = "csv") -> DataFrame:
    """Items per session, longest first (C14)."""
    from cartlens.operators.popularity import length_distribution as dist
    return dist(_sessions(spark, sessions_path, fmt))


def stratum_profiles(spark: SparkSession, sessions_path: str, purchases_path: str, features_path: str,
                     categories: Sequence[int], length: int, fmt: str = "csv") -> DataFrame:
    """Consumed versus purchased feature shares for every session of exactly
    ``length`` items (C15)."""
    from cartlens.operators.profiles import profile_comparison
    return profile_comparison(_sessions(spark, sessions_path, fmt), _purchases(spark, purchases_path, fmt),
                              _features(spark, features_path, fmt), categories, length)
