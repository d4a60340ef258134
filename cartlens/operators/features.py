"""Item features: clean, encode (multi-hot), pack into words.

The long form ``(item_id, feature_category_id, ...)`` is canonical.  The wide
form has one column per category, named after it, built with an explicit
category list so its schema is known before the job runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.bits import n_words, quoted

ITEM, CATEGORY = "item_id", "feature_category_id"


def _lit(v) -> str:
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def clean_features(features: DataFrame, keys: Sequence[str] = (ITEM, CATEGORY)) -> DataFrame:
    """One row per (item, category).

    Where rows of one key differ in other columns, the smallest remaining
    payload is kept, column by column in order, a missing value after any
    other, so the result does not depend on the input order.
    A two-phase aggregate: duplicates collapse map-side before the shuffle.
    """
    payload = [c for c in features.columns if c not in keys]
    if not payload:
        return features.dropDuplicates(list(keys))
    if len(payload) == 1:
        # a plain min keeps a fixed-width buffer (hash aggregate, no sort)
        return features.groupBy(*keys).agg(F.min(payload[0]).alias(payload[0]))
    ranked = [x for c in payload for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    return (features.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_p"))
                    .select(*keys, *[F.col("_p").getField(c).alias(c) for c in payload]))


def encode_features(features: DataFrame, categories: Sequence[int],
                    item: str = ITEM, category: str = CATEGORY) -> DataFrame:
    """Multi-hot pivot (A5, P7, C2): ``item_id`` plus one bigint column per
    category holding its row count, 0 when absent (0/1 on clean input).

    One hash aggregate with a conditional count per category; categories
    outside the list are ignored, as an explicit pivot list does."""
    counts = [F.expr(f"count_if({quoted(category)} = {_lit(c)}) as {quoted(str(c))}") for c in categories]
    return features.groupBy(item).agg(*counts)


def pack_features(features: DataFrame, categories: Sequence[int], item: str = ITEM,
                  category: str = CATEGORY, prefix: str = "w") -> DataFrame:
    """Binary item vectors as packed words: ``(item_id, w0, w1, ...)``.

    Bit ``i`` of the vector is set when the item has category
    ``categories[i]``; repeats are absorbed by ``bit_or``.  The category
    to bit-mask lookup is a literal map built from the list, a bounded
    constant, so no join is needed."""
    pairs = ", ".join(f"{_lit(c)}, {i}" for i, c in enumerate(categories))
    pos = F.expr(f"map({pairs})[{quoted(category)}]")
    df = (features.select(item, pos.alias("_i"))
                  .where(F.col("_i").isNotNull()))
    words = []
    for j in range(n_words(len(categories))):
        in_word = (F.col("_i") >= j * 64) & (F.col("_i") < (j + 1) * 64)
        bit = F.expr(f"shiftleft(1L, _i - {j * 64})")
        words.append(F.coalesce(F.bit_or(F.when(in_word, bit)), F.lit(0).cast("long")).alias(f"{prefix}{j}"))
    return df.groupBy(item).agg(*words)


def wide_to_words(df: DataFrame, feature_cols: Sequence[str], keep: Sequence[str],
                  prefix: str = "w", binary: bool = False) -> DataFrame:
    """Wide columns to packed words, row by row (one SQL expression per word).
    A cell other than 0 sets its bit and a missing one does not; with
    ``binary`` a cell that is neither 0, 1 nor missing is an error instead."""
    cols = list(feature_cols)
    exprs = []
    for j in range(n_words(len(cols))):
        part = cols[j * 64:(j + 1) * 64]
        text = " | ".join(f"shiftleft(cast(coalesce({quoted(c)}, 0) <> 0 as bigint), {b})" for b, c in enumerate(part))
        if binary:
            fits = " and ".join(f"coalesce({quoted(c)}, 0) in (0, 1)" for c in part)
            text = f"case when {fits} then {text} else cast(raise_error('a feature cell is neither 0 nor 1') as bigint) end"
        exprs.append(f"{text} as {quoted(prefix + str(j))}")
    return df.selectExpr(*[quoted(k) for k in keep], *exprs)


def words_to_wide(df: DataFrame, categories: Sequence[int], keep: Sequence[str],
                  prefix: str = "w") -> DataFrame:
    """Packed words to one 0/1 int column per category, named after it."""
    exprs = [f"cast(shiftright({quoted(prefix + str(i // 64))}, {i % 64}) & 1 as int) as {quoted(str(c))}"
             for i, c in enumerate(categories)]
    return df.selectExpr(*[quoted(k) for k in keep], *exprs)


def value_domain(wide: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Distinct values over all feature cells (A9): unpivot, then a
    two-phase distinct, so each map task ships only the values it saw."""
    cells = wide.select(F.expr("explode(array(" + ", ".join(f"cast({quoted(c)} as bigint)" for c in feature_cols)
                               + ")) as value"))
    return cells.distinct()


def value_frequency(wide: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """How often each value occurs in each feature column (A10):
    ``(category, value, n)``, zero counts left out; ``category`` is the
    column name read as an int when it is one."""
    def cat(c: str) -> str:
        return c if c.isdigit() else "'" + c.replace("'", "''") + "'"
    pairs = F.expr("explode(array(" + ", ".join(
        f"named_struct('category', {cat(c)}, 'value', cast({quoted(c)} as bigint))" for c in feature_cols) + ")) as _c")
    return (wide.select(pairs).select("_c.category", "_c.value")
                .groupBy("category", "value").agg(F.count(F.lit(1)).alias("n")))
