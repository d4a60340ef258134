"""Feature share profiles: consumed items of a session against the item
that was purchased (the notebook's third analysis, in one plan instead of
one Spark job per item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators.cells import cell_sums, cell_words, planes_of
from cartlens.operators.features import clean_features, encode_features
from cartlens.operators.sessions import session_lengths

SESSION, ITEM = "session_id", "item_id"


def _long(wide: DataFrame, keys: Sequence[str], categories: Sequence[int], value: str) -> DataFrame:
    """One row per (keys, category) from one column per category."""
    return wide.unpivot(list(keys), [str(c) for c in categories], "_cat", value) \
               .withColumn("category", F.col("_cat").cast("int")).drop("_cat") \
               .select(*keys, "category", value)


def _shares_wide(items: DataFrame, counts: DataFrame, categories: Sequence[int], key: str) -> DataFrame:
    """Per key, one share column per category: feature rows / list length."""
    cols = [str(c) for c in categories]
    planes = planes_of(counts, cols)
    per_key = cell_sums(items, cell_words(counts, cols, planes), cols, key, planes)
    return per_key.selectExpr(f"`{key}`", *[f"`{c}` / _n as `{c}`" for c in cols])


def _item_counts(features: DataFrame, categories: Sequence[int], dedupe: bool) -> DataFrame:
    feats = clean_features(features) if dedupe else features
    return encode_features(feats, categories).select(ITEM, *[str(c) for c in categories])


def feature_profile(items: DataFrame, features: DataFrame, categories: Sequence[int],
                    key: str = SESSION, dedupe: bool = False) -> DataFrame:
    """Share of each category over an item list (A7, J5):
    ``(key, category, share)``, every category present.

    share = feature rows of the list's items with that category / list
    length.  The list length counts every row, featureless items too; a
    repeated item counts again.  ``dedupe=True`` uses the cleaned feature
    table; by default a repeated (item, category) row counts twice.

    Items are joined once to the per-item category counts (one row per
    item), aggregated per key, then unpivoted, so categories absent from a
    list come out as 0 without a join to the category list."""
    shares = _shares_wide(items, _item_counts(features, categories, dedupe), categories, key)
    return _long(shares, [key], categories, "share")


def stratum_purchases(purchases: DataFrame, stratum: DataFrame) -> DataFrame:
    """Purchases of the sessions in a stratum (J4): one row per purchase."""
    return purchases.join(stratum.select(SESSION), SESSION, "inner").select(SESSION, ITEM)


def profile_comparison(sessions: DataFrame, purchases: DataFrame, features: DataFrame,
                       categories: Sequence[int], length: int | Sequence[int], dedupe: bool = False) -> DataFrame:
    """Consumed versus purchased profile for every session of exactly
    ``length`` items (C15): ``(session_id, purchased_item, category,
    consumed_share, purchased_share)``, one block per purchase.  With several
    lengths, all their sessions in one pass, and their ``length``.

    The purchased item is a list of one, so its shares are its own count
    row.  Consumed shares (one aggregate per session) and the purchased
    item's counts are joined wide, one row per purchase, and unpivoted
    together: no join on (session, category)."""
    counts = _item_counts(features, categories, dedupe)
    lengths, carry = ([length], []) if isinstance(length, int) else (list(length), ["length"])
    stratum = session_lengths(sessions, "length").where(F.col("length").isin(lengths)).select(SESSION, *carry)
    consumed = _shares_wide(sessions.join(stratum, SESSION, "left_semi"), counts, categories, SESSION)
    consumed = consumed.selectExpr(SESSION, *[f"`{c}` as c{c}" for c in categories])
    bought = purchases.join(stratum, SESSION, "inner").select(SESSION, F.col(ITEM).alias("purchased_item"), *carry)
    item_cells = counts.selectExpr(f"{ITEM} as purchased_item", *[f"`{c}` as p{c}" for c in categories])
    wide = bought.join(consumed, SESSION, "inner").join(item_cells, "purchased_item", "left")
    cells = F.expr("explode(array(" + ", ".join(
        f"named_struct('category', {c}, 'consumed_share', c{c}, "
        f"'purchased_share', cast(coalesce(p{c}, 0) as double))" for c in categories) + ")) as _x")
    return wide.select(SESSION, "purchased_item", *carry, cells).select(
        SESSION, "purchased_item", "_x.category", "_x.consumed_share", "_x.purchased_share",
        *[F.col(c).cast("int").alias(c) for c in carry])
