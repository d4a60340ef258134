"""Sums of item feature cells over the rows of a session.

The cells of an item travel as packed words, not as one column per category:
bit ``i`` of plane ``p`` is bit ``p`` of the item's count in category ``i``
(a clean 0/1 table has one plane).  Session rows are joined to the words,
shuffled once by session with a few words each, and the sums per category are
taken after that shuffle.  If a session is above ``rows_per_task`` rows,
repeats of an item are counted first, and such sessions' items are spread
over several tasks whose sums are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.bits import WORD_BITS, n_words, quoted

ITEM = "item_id"


def planes_of(encoded: DataFrame, cols: Sequence[str]) -> int:
    """Bits that the largest cell of a wide count table needs."""
    most = encoded.agg(F.max(F.expr("greatest(" + ", ".join(map(quoted, cols)) + ", 0)"))).first()[0]
    return max(1, int(most or 0).bit_length())


def cell_words(encoded: DataFrame, cols: Sequence[str], planes: int = 1) -> DataFrame:
    """``(item_id, _p0_w0, ...)``: the cells of a wide count table in words."""
    out = []
    for p in range(planes):
        for j in range(n_words(len(cols))):
            bits = " | ".join(f"shiftleft(shiftright(cast(coalesce({quoted(c)}, 0) as bigint), {p}) & 1, {b})"
                              for b, c in enumerate(cols[j * WORD_BITS:(j + 1) * WORD_BITS]))
            out.append(F.expr(f"{bits} as _p{p}_w{j}"))
    return encoded.select(ITEM, *out)


def cell_sums(items: DataFrame, words: DataFrame, cols: Sequence[str], key: str, planes: int = 1,
              rows_per_task: int = 1 << 20) -> DataFrame:
    """Per key: ``_n`` rows, ``_len`` rows with an item, ``_joined`` rows whose
    item has features, and the sum of every category's cells, named after it."""
    rows = items.select(key, ITEM)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_task)
    salts = hot.agg(F.max(F.ceil(F.col("_rows") / F.lit(rows_per_task)))).first()[0]
    if salts:  # repeats of an item in a session become one row with a weight
        rows = rows.groupBy(key, ITEM).agg(F.count(F.lit(1)).alias("_w"))
    else:
        rows = rows.withColumn("_w", F.lit(1).cast("long"))
    joined = rows.join(words.withColumn("_hit", F.lit(1)), ITEM, "left")
    sums = [F.sum("_w").alias("_n"), F.expr(f"coalesce(sum(case when {ITEM} is not null then _w end), 0) as _len"),
            F.expr("coalesce(sum(case when _hit is not null then _w end), 0) as _joined")]
    for i, c in enumerate(cols):
        j, b = divmod(i, WORD_BITS)
        cell = " + ".join(f"shiftleft(shiftright(_p{p}_w{j}, {b}) & 1, {p})" for p in range(planes))
        sums.append(F.expr(f"coalesce(sum(_w * ({cell})), 0) as {quoted(c)}"))
    if not salts:
        return joined.repartition(key).groupBy(key).agg(*sums)
    # at most (all rows / rows_per_task) keys are hot; other rows have salt 0
    marked = joined.join(hot.select(F.col(key).alias("_hot")), F.col(key).eqNullSafe(F.col("_hot")), "left")
    spread = F.pmod(F.xxhash64(ITEM), F.lit(int(salts)))
    salted = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.lit(0)))
    parts = salted.repartition(key, "_salt").groupBy(key, "_salt").agg(*sums)
    return parts.groupBy(key).agg(*[F.sum(quoted(c)).alias(c) for c in ("_n", "_len", "_joined", *cols)])
