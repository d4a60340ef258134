"""Samples of exact size by seeded hash: the ``quota`` keys of smallest hash
in every stratum.

A hash of (seed, key) orders the keys of a stratum, so the sample is a function
of the set of keys: any partitioning, order or retry gives the same one, and
the samples of two tables merge into the sample of both (``merge_bottom_k``).
Bounded state: hashes are counted in ``buckets`` ranges per stratum; every key
in a range below the one that holds the quota-th is taken, and only the keys
of that one range are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.constants import SAMPLE_BANDS
from cartlens.functions.scalar import sample_unit

STRATUM, QUOTA, UNIT = "stratum", "quota", "unit"


def band_of(length: Column | str, bands: Sequence[tuple[int, int, float]] = SAMPLE_BANDS) -> Column:
    """Number of the length band (P9), from 0; null outside every band."""
    length, out = F.col(length) if isinstance(length, str) else length, None
    for i, (lo, hi, _) in enumerate(bands):
        out = F.when(length.between(lo, hi), F.lit(i)) if out is None else out.when(length.between(lo, hi), F.lit(i))
    return out


def quotas(keyed: DataFrame, weights: Sequence[float], sample_size: int) -> DataFrame:
    """``(stratum, n, quota)``: ``sample_size`` shared out over the strata in
    proportion to weight times keys, exact in total: a stratum's quota is the
    difference of the rounded-down shares up to it and before it.  If the weights allow
    fewer (the sum of weight times keys), that many, rounded down."""
    counts = keyed.groupBy(STRATUM).agg(F.count(F.lit(1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col(STRATUM) + 1)
    # one row per stratum
    up_to = Window.orderBy(STRATUM).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.orderBy(STRATUM).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = counts.withColumn("_w", weight * F.col("n")).withColumn("_c", F.sum("_w").over(up_to)) \
                   .withColumn("_t", F.sum("_w").over(all_))
    size = F.least(F.lit(float(sample_size)), F.floor(F.col("_t")).cast("double"))
    rounded = shares.withColumn("_r", F.when(F.col("_t") > 0, F.floor(size * F.col("_c") / F.col("_t"))).otherwise(F.lit(0)))
    return rounded.select(STRATUM, "n", (F.col("_r") - F.coalesce(F.lag("_r").over(Window.orderBy(STRATUM)), F.lit(0))).alias(QUOTA))


def bottom_k(keyed: DataFrame, key: str, quota: DataFrame, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """``(stratum, key, unit)``: of every stratum the ``quota`` keys of smallest
    hash, ties by key; all keys of a stratum with fewer.  ``keyed`` has one row per key, ``(stratum, key)``;
    ``quota`` is ``(stratum, quota)``, one row per stratum."""
    hashed = keyed.select(STRATUM, key, sample_unit(key, seed).alias(UNIT)) if UNIT not in keyed.columns else keyed.select(STRATUM, key, UNIT)
    ranged = hashed.withColumn("_range", F.floor(F.col(UNIT) * buckets).cast("int"))
    counts = ranged.groupBy(STRATUM, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per stratum and range
    up_to = Window.partitionBy(STRATUM).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).join(quota.select(STRATUM, QUOTA), STRATUM) \
                 .where(F.col("_before") < F.col(QUOTA)) \
                 .select(STRATUM, "_range", (F.col(QUOTA) - F.col("_before")).alias("_room"), F.col("_n"))
    some = ranged.join(cuts, [STRATUM, "_range"])
    whole = some.where(F.col("_n") <= F.col("_room")).select(STRATUM, key, UNIT)
    order = Window.partitionBy(STRATUM, "_range").orderBy(UNIT, key)
    edge = some.where(F.col("_n") > F.col("_room")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_room"))
    return whole.unionByName(edge.select(STRATUM, key, UNIT))


def merge_bottom_k(samples: Sequence[DataFrame], key: str, quota: DataFrame) -> DataFrame:
    """The bottom-k sample of several disjoint tables from theirs.  Each must
    have been taken with quotas at least as large as these."""
    out = samples[0]
    for more in samples[1:]:
        out = out.unionByName(more)
    return bottom_k(out, key, quota)
