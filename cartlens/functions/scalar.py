"""Scalar column expressions used by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.constants import PREFERENCE_THRESHOLD, SAMPLE_BANDS, VOTE_SHARE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold_sql(name: str, t: float = PREFERENCE_THRESHOLD) -> str:
    """SQL text of P8 for the column ``name``: 1 when ``>= t``, else 0."""
    return f"case when `{name}` >= {float(t)!r}D then 1 else 0 end"


def threshold(c: Column | str, t: float = PREFERENCE_THRESHOLD) -> Column:
    """1 when ``c >= t`` (inclusive), else 0."""
    if isinstance(c, str):
        return F.expr(threshold_sql(c, t))
    return F.when(c >= F.lit(t), F.lit(1)).otherwise(F.lit(0))


def band_fraction(length: Column | str,
                  bands: Sequence[tuple[int, int, float]] = SAMPLE_BANDS) -> Column:
    """Sampling fraction of a session length (P9); null outside every band."""
    out = None
    for lo, hi, frac in bands:
        cond = _col(length).between(lo, hi)
        out = F.when(cond, F.lit(float(frac))) if out is None else out.when(cond, F.lit(float(frac)))
    return out


def sample_unit(key: Column | str, seed: int = 42) -> Column:
    """A uniform value in [0, 1) fixed by (seed, key): the first 32 bits of
    ``md5(seed:key)``.  Same key, same value, on every executor and retry."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def majority_vote(cluster_sum: Column | str, n: Column | str, share: float = VOTE_SHARE) -> Column:
    """Cluster 1 when the 0/1 assignments sum to more than ``share * n``."""
    return F.when(_col(cluster_sum) > F.lit(share) * _col(n), F.lit(1)).otherwise(F.lit(0))


def epoch_micros(c: Column | str, kind: T.DataType) -> Column:
    """Microseconds since 1970-01-01 of a date or timestamp of type ``kind``.
    A timestamp without zone is read on its own clock, never through the
    session's zone, whose clock may jump."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(_col(c))
    gap = _col(c).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda field: F.extract(F.lit(field), gap)
    whole = part("DAY").cast("long") * 86_400 + part("HOUR").cast("long") * 3_600 + part("MINUTE").cast("long") * 60
    return whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def category_int(c: Column | str) -> Column:
    """A category read as text becomes an int."""
    return _col(c).cast("int")
