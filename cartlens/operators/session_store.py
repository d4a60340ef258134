"""Session sums that new rows are merged into, and preferences derived from them.

A session's means are sums over its rows divided by their number, so the sums
can be kept and added to: ``sums`` of a load, ``merged`` with the saved ones, give the
sums of all rows, however the rows were split into loads.  A saved row holds
the session's row counts and the sums of all categories in lanes of
``lane_bits`` bits, several to a bigint, so that merging is one addition per
bigint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.constants import PREFERENCE_THRESHOLD, SHORT_SESSION_MAX_ITEMS
from cartlens.functions.bits import quoted
from cartlens.functions.scalar import threshold_sql
from cartlens.operators.cells import cell_sums, cell_words
from cartlens.runtime import delete_folder, folder_exists, folder_names

SESSION = "session_id"
COUNTS = ("_n", "_len", "_joined")


@dataclass
class SessionSums:
    """The layout of the sums of 0/1 cells (or counts below ``2^planes``) of
    these categories.  A lane holds sums below ``2^lane_bits``; a session that
    reaches that is an error, not a wrong sum."""

    categories: list[str]
    lane_bits: int = 21
    planes: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.lane_bits <= 63:
            raise ValueError("lane_bits must be between 1 and 63")
        self.per_word = 63 // self.lane_bits
        self.words = [f"_s{j}" for j in range(-(-len(self.categories) // self.per_word))]

    def _lane(self, i: int) -> tuple[str, int]:
        j, lane = divmod(i, self.per_word)
        return self.words[j], lane * self.lane_bits

    def _checked(self, sums: DataFrame) -> DataFrame:
        """No lane can have run into the next: a sum is at most rows times the largest cell."""
        most = (1 << self.lane_bits) - 1
        fits = F.col("_joined") * ((1 << self.planes) - 1) <= most
        error = F.raise_error(F.lit(f"a session has more rows than lanes of {self.lane_bits} bits can count"))
        return sums.withColumn("_joined", F.when(fits, F.col("_joined")).otherwise(error.cast("bigint")))

    def sums(self, sessions: DataFrame, encoded: DataFrame) -> DataFrame:
        """``(session_id, _n, _len, _joined, _s0, ...)`` of one load: rows, rows with
        an item, rows whose item has features, and the sums of its cells."""
        per = cell_sums(sessions, cell_words(encoded, self.categories, self.planes), self.categories, SESSION, self.planes)
        per = self._checked(per)
        words = []
        for j, word in enumerate(self.words):
            part = [i for i in range(j * self.per_word, min((j + 1) * self.per_word, len(self.categories)))]
            words.append(F.expr(" | ".join(
                f"if(_joined >= 0, shiftleft(cast({quoted(self.categories[i])} as bigint), {self._lane(i)[1]}), 0L)" for i in part) + f" as {word}"))
        return per.select(SESSION, *COUNTS, *words)

    def merged(self, *parts: DataFrame) -> DataFrame:
        """The sums of all rows of the parts: one shuffle of one row per session and part."""
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        added = out.groupBy(SESSION).agg(*[F.sum(c).alias(c) for c in (*COUNTS, *self.words)])
        return self._checked(added).select(SESSION, *COUNTS, *self.words)

    def lengths(self, sums: DataFrame, name: str = "nb_items") -> DataFrame:
        """``session_lengths`` (A1) of all rows so far."""
        return sums.select(SESSION, F.col("_len").alias(name))

    def means(self, sums: DataFrame, lo: int | None = None, hi: int | None = SHORT_SESSION_MAX_ITEMS) -> DataFrame:
        """``session_feature_means`` (A6) of all rows so far."""
        cond = F.col("_joined") > 0
        if lo is not None:
            cond = cond & (F.col("_len") >= lo)
        if hi is not None:
            cond = cond & (F.col("_len") <= hi)
        cells = []
        for i, c in enumerate(self.categories):
            word, shift = self._lane(i)
            cells.append(f"cast(shiftright({word}, {shift}) & {(1 << self.lane_bits) - 1}L as double) / _joined as {quoted(c)}")
        return sums.where(cond).selectExpr(SESSION, *cells)

    def preferences(self, sums: DataFrame, threshold: float = PREFERENCE_THRESHOLD, lo: int | None = None,
                    hi: int | None = SHORT_SESSION_MAX_ITEMS) -> DataFrame:
        """``session_preferences`` (C3, C5) of all rows so far."""
        return self.means(sums, lo, hi).selectExpr(SESSION, *[f"{threshold_sql(c, threshold)} as {quoted(c)}" for c in self.categories])

    # ------------------------------------------------- saved sums
    def saved(self, spark: SparkSession, folder: str) -> DataFrame | None:
        """The sums saved last, None if there are none."""
        at = _last(spark, folder)
        return None if at is None else spark.read.parquet(f"{folder}/v-{at}")

    def load(self, sessions: DataFrame, encoded: DataFrame, folder: str, keep: int = 2) -> DataFrame:
        """Merge a load of new rows into the sums saved in ``folder``; the
        result, read back.  Each load writes a version of its own, which counts once it is
        complete, so a load that fails changes nothing and can be repeated; the
        last ``keep`` versions stay.  Loads must not overlap in time."""
        spark = sessions.sparkSession
        at, new = _last(spark, folder), self.sums(sessions, encoded)
        out = new if at is None else self.merged(spark.read.parquet(f"{folder}/v-{at}"), new)
        to = 0 if at is None else at + 1
        out.write.mode("overwrite").parquet(f"{folder}/v-{to}")
        for old in _versions(spark, folder):
            if old <= to - keep:
                delete_folder(spark, f"{folder}/v-{old}")
        return spark.read.parquet(f"{folder}/v-{to}")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[2:]) for n in folder_names(spark, folder) if n.startswith("v-") and n[2:].isdigit())


def _last(spark: SparkSession, folder: str) -> int | None:
    """The last complete version."""
    done = [v for v in _versions(spark, folder) if folder_exists(spark, f"{folder}/v-{v}/_SUCCESS")]
    return done[-1] if done else None


def loads(sessions: DataFrame, n: int, *by: str) -> Sequence[DataFrame]:
    """The rows in ``n`` loads, by a hash of some columns."""
    return [sessions.where(F.pmod(F.xxhash64(*by), F.lit(n)) == i) for i in range(n)]
