"""Shared inputs of the named queries: fixture sessions and item features in
the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlens.constants import SHORT_SESSION_MAX_ITEMS
from cartlens.functions.bits import word_names
from cartlens.operators import preference as PF
from cartlens.operators.features import clean_features, encode_features, pack_features, wide_to_words
from cartlens.operators.sessions import session_lengths, session_preferences, sessions_in_band
from cartlens.runtime import written
from cartlens.sources import fixtures

EMB_CATS = fixtures.EMBEDDING_CATEGORIES
PART_CATS = fixtures.PART_CATEGORIES
EMB_COLS = [str(c) for c in EMB_CATS]
PART_COLS = [str(c) for c in PART_CATS]
EMB_WORDS = word_names(len(EMB_CATS))
PART_WORDS = word_names(len(PART_CATS))


def emb_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide 0/1 item table from the cleaned embedding features."""
    return encode_features(clean_features(fixtures.embedding_features(spark, sf_dir)), EMB_CATS)


def emb_encoded_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide count table from the raw embedding features (cells 0, 1, 2)."""
    return encode_features(fixtures.embedding_features(spark, sf_dir), EMB_CATS)


def emb_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors as packed words (one word for 64 categories)."""
    return pack_features(fixtures.embedding_features(spark, sf_dir), EMB_CATS)


def session_words(sessions: DataFrame, features: DataFrame, categories, boundary: int = SHORT_SESSION_MAX_ITEMS) -> DataFrame:
    """Packed preference vector of every session with an item that has
    features: by mean and threshold up to ``boundary`` items (C3), by
    clustering above it (C4).  The sessions and their lengths are written once:
    both ways read them several times, and they may come from a join of large tables."""
    cols, words = [str(c) for c in categories], word_names(len(categories))
    sessions = written(sessions.select("session_id", "item_id", "date"), "sessions")
    lengths = written(session_lengths(sessions), "lengths")
    encoded = encode_features(clean_features(features), categories)
    some = sessions_in_band(sessions, hi=boundary, lengths=lengths, null_session=True)
    short = wide_to_words(session_preferences(some, encoded, cols, hi=boundary, planes=1), cols, ["session_id"])
    rows = PF.clustering_rows(sessions, pack_features(features, categories), lo=boundary + 1, lengths=lengths)
    return short.unionByName(PF.clustered_preferences(PF.fit_sessions(rows, words, len(cols)), words))


def pref_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed preference vector of every event session."""
    return session_words(fixtures.event_sessions(spark, sf_dir), fixtures.embedding_features(spark, sf_dir), EMB_CATS)


def wide_pref_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed preference vector of every customer session over the 73 part categories."""
    return session_words(customer_views(spark, sf_dir), fixtures.part_features(spark, sf_dir), PART_CATS)


def customer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.customer_sessions(spark, sf_dir).select("session_id", "item_id", "date")


def part_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors of the 73 part categories as two packed words."""
    return pack_features(fixtures.part_features(spark, sf_dir), PART_CATS)
