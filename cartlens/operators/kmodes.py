"""k-modes clustering of binary rows, all groups at once, as Spark jobs.

Rows are ``(group, order..., payload..., w0, w1, ...)`` with packed 0/1
feature words.  Every group (for example every session) is clustered on its
own; all groups advance together:

* seeds (C7): per group and feature the majority value, shifted by the
  feature position modulo the number of distinct cell values (F3), and its
  complement (F2); each seed is then replaced by the nearest row, the first
  row in the group order winning ties (T7);
* assignment (C9, J7, T6): each row takes the nearest mode, the lowest
  cluster index winning ties;
* update (A11): per cluster and feature, 1 where ones outnumber zeros
  (ties 0); an empty cluster has the zero vector.

Reassignment is simultaneous (all rows against the modes of the previous
round).  A group stops when a round moves no row or its round limit is
reached; further rounds leave it as it is.

Layout.  ``laid_out`` writes the rows once, hash-partitioned and sorted by
group.  Seeds, rounds and the final assignment join one state row per group
to them on that key, so the rows are neither shuffled nor sorted again; the
state of a round comes out in the same layout, so rounds planned together
run without any shuffle.  If some group has more than ``rows_per_task`` rows,
the layout key is (group, salt): a group of ``n`` rows has
``ceil(n / rows_per_task)`` salts, its state is copied to each, and only the
sums of each salt move.  Several rounds are planned together and written as
one small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.constants import KMODES_CLUSTERS, KMODES_MAX_ITER
from cartlens.functions.bits import WORD_BITS, complement_words, quoted, shift_seed_words
from cartlens.operators import kmodes_rows as R
from cartlens.runtime import checkpoint_dir, checkpoint_in_place, delete_folder, scratch_folder

CLUSTER = "cluster"
ROWS_PER_TASK = 1 << 20
# Three counters of 21 bits share a bigint where a group has fewer rows than that.
LANE_BITS = 21
_LANES = sum(1 << LANE_BITS * i for i in range(3))
# Rounds planned together, between two looks at which groups are finished.
ROUNDS_PER_STEP = 4


def _bit_sums(words: Sequence[str], n_features: int) -> list[Column]:
    """``sum`` of every feature bit over the rows, as columns ``_o{i}``.
    Written as SQL text: one call per expression instead of a dozen per bit."""
    out = []
    for i in range(n_features):
        j, b = divmod(i, WORD_BITS)
        out.append(F.expr(f"coalesce(sum(shiftright({quoted(words[j])}, {b}) & 1), 0) as _o{i}"))
    return out


def _lane_sums(words: Sequence[str], n_features: int) -> list[Column]:
    """As ``_bit_sums``, three features to a sum: bits b, b + 21 and b + 42 of
    word j are counted in the lanes of ``_l{j}_{b}`` (bit 63 in ``_l{j}_63``)."""
    out = []
    for j, w in enumerate(words):
        used = min(WORD_BITS, n_features - j * WORD_BITS)
        out += [F.expr(f"coalesce(sum(shiftright({quoted(w)}, {b}) & {_LANES}L), 0) as _l{j}_{b}")
                for b in range(min(LANE_BITS, used))]
        if used == WORD_BITS:
            out.append(F.expr(f"coalesce(sum(shiftrightunsigned({quoted(w)}, 63)), 0) as _l{j}_63"))
    return out


def _lane(i: int) -> str:
    """SQL text of the count of feature ``i`` in its lane."""
    j, b = divmod(i, WORD_BITS)
    lane, at = divmod(b, LANE_BITS)
    return f"_l{j}_63" if b == 63 else f"(shiftright(_l{j}_{at}, {lane * LANE_BITS}) & {(1 << LANE_BITS) - 1}L)"


def _majority_words(n_col: str, n_features: int, prefix: str = "w", ones=lambda i: f"_o{i}") -> list[Column]:
    """Pack ``2 * ones > n`` of every feature (SQL text of its count) into words."""
    words = []
    for j in range(-(-n_features // WORD_BITS)):
        terms = [f"shiftleft(cast({ones(j * WORD_BITS + b)} * 2 > {quoted(n_col)} as bigint), {b})"
                 for b in range(min(WORD_BITS, n_features - j * WORD_BITS))]
        words.append(F.expr(" | ".join(terms) + f" as {quoted(prefix + str(j))}"))
    return words


def distance_to(words: Sequence[str], other: Sequence[Column]) -> Column:
    total = None
    for w, o in zip(words, other):
        t = F.bit_count(F.col(w).bitwiseXOR(o))
        total = t if total is None else total + t
    return total.cast("int")


def value_count(rows: DataFrame, group: str, words: Sequence[str], n_features: int,
                carry: Sequence[str] = ()) -> DataFrame:
    """Per group: rows ``n``, distinct cell values ``n_values`` (1 when every
    cell is equal, else 2 for binary rows), the feature sums ``_o{i}`` and
    ``first`` of each ``carry`` column."""
    sums = _bit_sums(words, n_features)
    agg = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in carry], *sums)
    total = F.expr(" + ".join(f"_o{i}" for i in range(n_features)))
    n_values = F.when((total == 0) | (total == F.col("n") * n_features), F.lit(1)).otherwise(F.lit(2))
    return agg.withColumn("n_values", n_values)


def group_mode(rows: DataFrame, group: Sequence[str] | str, words: Sequence[str],
               n_features: int) -> DataFrame:
    """Column-wise mode of each group (A11): ``(group..., w0, ...)``."""
    group = [group] if isinstance(group, str) else list(group)
    agg = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *_bit_sums(words, n_features))
    return agg.select(*group, *_majority_words("_n", n_features))


def laid_out(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str],
             payload: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows as ``(group, _ord, payload..., w...)``, written once,
    partitioned and sorted by group; with ``_nsalt`` and ``_salt``, and laid out
    by (group, salt), if some group has more than ``rows_per_task`` rows.

    At most (all rows / rows_per_task) groups can, so the table joined for the
    salts is small and Spark broadcasts it on its runtime size check.  Rows
    equal in every column share a salt.  The number of partitions follows from
    the rows, a quarter of ``ROWS_PER_TASK`` in each, but is at least the
    session's ``spark.sql.shuffle.partitions``: a join shuffles a side with
    fewer."""
    spark = rows.sparkSession
    prepared = rows.select(group, F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)]).alias("_ord"),
                           *payload, *words)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    total, most = sizes.agg(F.coalesce(F.sum("_gn"), F.lit(0)), F.coalesce(F.max("_gn"), F.lit(0))).first()
    keys = [group]
    if most > rows_per_task:
        hot = (sizes.where(F.col("_gn") > rows_per_task)
                    .select(group, F.ceil(F.col("_gn") / F.lit(rows_per_task)).cast("int").alias("_hs")))
        prepared = prepared.join(hot, group, "left").withColumn("_nsalt", F.coalesce(F.col("_hs"), F.lit(1))).drop("_hs")
        prepared = prepared.withColumn("_salt", F.pmod(F.xxhash64("_ord", *payload, *words), F.col("_nsalt")).cast("int"))
        keys = [group, "_salt"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // ROWS_PER_TASK))
    return checkpoint_in_place(prepared.repartition(parts, *keys).sortWithinPartitions(*keys))


def _keys(rows: DataFrame, group: str) -> list[str]:
    """The layout key of laid-out rows."""
    return [group, "_salt"] if "_salt" in rows.columns else [group]


def _salts(rows: DataFrame, group: str, per_group: DataFrame) -> DataFrame:
    """``per_group`` with the ``_nsalt`` of each group, if the rows are salted."""
    if "_salt" not in rows.columns:
        return per_group
    return per_group.join(rows.groupBy(group).agg(F.first("_nsalt").alias("_nsalt")), group)


def _spread(per_group: DataFrame) -> DataFrame:
    """One row per group to one per layout key."""
    if "_nsalt" not in per_group.columns:
        return per_group
    return per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_nsalt") - 1))).drop("_nsalt")


def seeds(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str],
          n_features: int, k: int = KMODES_CLUSTERS, payload: Sequence[str] = (),
          rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Initial modes (C7): ``(group, seed, payload..., w...)``, one row per
    seed, each an actual row of the group.

    ``order`` is a list of sortable columns giving the group order (for the
    reference's sessions: newest first); its first row wins distance ties.
    Only ``k = 2`` is defined: an alternating complement repeats seeds beyond
    two; ``density_seeds`` takes any k.

    ``rows`` that come from ``laid_out`` are used as they are, others are laid
    out first.  They are read twice: for the feature sums, and for the row
    least by (distance, order) to each seed, both seeds at once.  That is a
    sorted aggregate by the layout key over rows in that order already, so at
    most one candidate per seed and key moves."""
    if k != 2:
        raise ValueError("this seeding is defined for k = 2; see density_seeds for other k")
    words = list(words)
    if "_ord" not in rows.columns:
        rows = laid_out(rows, group, order, words, payload, rows_per_task)
    keys = _keys(rows, group)
    carry = ["_nsalt"] if len(keys) > 1 else []
    stats = value_count(rows, group, words, n_features, carry=carry)
    maj = stats.select(group, "n_values", *carry, *_majority_words("n", n_features, "_m"))
    q1 = shift_seed_words([f"_m{j}" for j in range(len(words))], "n_values", n_features)
    q2 = complement_words(q1, n_features)
    targets = maj.select(group, *carry, *[q.alias(f"_q0_{w}") for q, w in zip(q1, words)],
                         *[q.alias(f"_q1_{w}") for q, w in zip(q2, words)])
    near = [F.struct(distance_to(words, [F.col(f"_q{s}_{w}") for w in words]).alias("_d"), "_ord", *payload, *words)
            for s in range(2)]
    best = (rows.join(_spread(targets), keys).groupBy(*keys)
                .agg(*[F.min(n).alias(f"_b{s}") for s, n in enumerate(near)]))
    if carry:
        best = best.groupBy(group).agg(*[F.min(f"_b{s}").alias(f"_b{s}") for s in range(2)])
    found = best.select(group, F.explode(F.array(*[
        F.struct(F.lit(s).alias("seed"), F.col(f"_b{s}").alias("_b")) for s in range(2)])).alias("_s"))
    return found.select(group, F.col("_s.seed").alias("seed"),
                        *[F.col("_s")["_b"][c].alias(c) for c in [*payload, *words]])


@dataclass
class Bits:
    """What ``density_seeds`` asks of 0/1 cells in words."""

    n_features: int

    def sums(self, words: Sequence[str]) -> list[Column]:
        """Counts of a group, as columns ``_o...``."""
        return _bit_sums(words, self.n_features)

    def agreement(self, words: Sequence[str]) -> Column:
        """Cells of the group (``n`` rows) that agree with the row's, over all
        features: the ones of each feature the row has, the rest of the others."""
        terms = []
        for i in range(self.n_features):
            j, b = divmod(i, WORD_BITS)
            terms.append(f"if(shiftright({quoted(words[j])}, {b}) & 1 = 1, _o{i}, n - _o{i})")
        return F.expr(" + ".join(terms))

    def distance(self, words: Sequence[str], other: Sequence[Column]) -> Column:
        return distance_to(words, other)


def density_seeds(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str], n_features: int, k: int,
                  payload: Sequence[str] = (), cells: Bits | None = None) -> DataFrame:
    """Initial modes for any ``k``: ``(group, seed, payload..., w...)``, k distinct rows of each group.

    The density of a row is the number of cells of the group that agree with it,
    feature by feature.  The first seed is the densest row; each later one is
    the row with the greatest product of density and distance to the nearest
    seed so far, so that seeds are typical but apart.  Of equal products the
    first row in the group order (``order``, then payload, then words) is
    taken.  A group with fewer than ``k`` distinct rows is an error, as its
    products are all 0 at some seed.

    One aggregate per seed for all groups at once: the products are computed
    where the rows lie, and only the best row of each task and group moves.
    Rows are laid out by group once and keep their density there, so each
    aggregate joins one row per layout key, and a group above a task's rows stays
    split.  The seeds so far are k * words numbers a group."""
    words, spark, cells = list(words), rows.sparkSession, cells or Bits(n_features)
    base = rows if "_ord" in rows.columns else laid_out(rows, group, order, words, payload)
    keys = _keys(base, group)
    carry = [F.first("_nsalt").alias("_nsalt")] if len(keys) > 1 else []
    counts = base.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *carry, *cells.sums(words))
    dense = checkpoint_in_place(base.drop("_nsalt").join(_spread(counts), keys).select(
        *keys, "_ord", *payload, *words, cells.agreement(words).alias("_density")))
    folder = scratch_folder(spark, "seeds")
    chosen = None  # (group, _s0_w0, ..., _s{s}_w{j}): the seeds so far
    for s in range(k):
        entry = F.struct("_score", "_ord", *payload, *words)
        if s == 0:
            scored = dense.withColumn("_score", -F.col("_density"))
        else:
            near = [cells.distance(words, [F.col(f"_s{t}_{w}") for w in words]) for t in range(s)]
            away = F.least(*near) if s > 1 else near[0]
            so_far = _spread(_salts(base, group, chosen.drop(*[f"_p{t}" for t in range(s)])))
            scored = dense.join(so_far, keys).withColumn("_score", -F.col("_density") * away)
        best = scored.groupBy(group).agg(F.min(entry).alias("_b"))
        if s:  # a product of 0: every row equals a seed
            best = best.withColumn("_b", F.when(F.col("_b._score") < 0, F.col("_b")).otherwise(
                F.raise_error(F.lit(f"density seeds: a group has fewer than {k} distinct rows"))))
        best = best.select(group, *[F.col("_b")[w].alias(f"_s{s}_{w}") for w in words],
                           F.struct(F.lit(s).alias("seed"), *[F.col("_b")[c].alias(c) for c in [*payload, *words]]).alias(f"_p{s}"))
        chosen = best if s == 0 else chosen.join(best, group)
        chosen.write.parquet(f"{folder}/{s}")
        chosen = spark.read.parquet(f"{folder}/{s}")
        if s:
            delete_folder(spark, f"{folder}/{s - 1}")
    return chosen.select(group, F.explode(F.array(*[f"_p{s}" for s in range(k)])).alias("_p")).select(group, "_p.*")


def modes_array(modes: DataFrame, group: str, words: Sequence[str], *also: Column) -> DataFrame:
    """One row per group holding its k modes as ``_modes``, an array of
    ``struct(c, w...)`` sorted by cluster (bounded: k entries)."""
    return modes.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct(F.col(CLUSTER).alias("c"), *[F.col(w) for w in words])))
         .alias("_modes"), *also)


def _nearest(words: Sequence[str], modes: Sequence[Sequence[Column]]) -> Column:
    """Index of the nearest mode, the lowest on ties.  Plain expressions
    (k distances, ``least``, a CASE), so the row loop stays in generated code."""
    dists = [distance_to(words, m) for m in modes]
    best = F.least(*dists) if len(dists) > 1 else dists[0]
    out = F.when(dists[0] == best, F.lit(0))
    for c, d in enumerate(dists[1:], 1):
        out = out.when(d == best, F.lit(c))
    return out


def nearest_mode(words: Sequence[str], modes: str = "_modes", k: int = KMODES_CLUSTERS) -> Column:
    """Index of the nearest of the ``k`` modes in the array column ``modes``
    (sorted by cluster), the lowest index on ties; null when the array is null."""
    return _nearest(words, [[F.col(modes)[c][w] for w in words] for c in range(k)])


def assign(rows: DataFrame, modes: DataFrame, group: str, words: Sequence[str],
           k: int = KMODES_CLUSTERS) -> DataFrame:
    """Rows with the index of their nearest mode (C9, J7, T6).  Rows from
    ``laid_out`` are joined on their layout key and stay as they are."""
    arr = _salts(rows, group, modes_array(modes, group, words))
    joined = rows.join(_spread(arr), _keys(rows, group))
    return joined.withColumn(CLUSTER, nearest_mode(words, k=k)).drop("_modes")


def cluster_sizes(assigned: DataFrame, group: str) -> DataFrame:
    """Rows per non-empty cluster."""
    return assigned.groupBy(group, CLUSTER).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class KModesResult:
    assignments: DataFrame   # (group, payload..., cluster, distance to own mode, rounds, _ord, w...)
    modes: DataFrame         # (group, cluster, w...)
    rounds: int              # rounds run by the slowest group


def _copied(state: DataFrame) -> DataFrame:
    """``_spread`` that keeps ``_nsalt``."""
    if "_nsalt" not in state.columns:
        return state
    return state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_nsalt") - 1)))


class _Rounds:
    """The per-group state and one round over it.

    State columns: ``_m{c}_{j}`` the modes for the next assignment, ``_u{c}_{j}``
    those used by the last one (null before the first), ``_done``, ``_rounds`` and,
    for salted rows, ``_nsalt``.  All are fixed-width, so the aggregates over the
    rows are hash aggregates in generated code.  Rows that are not salted have
    groups of at most ``rows_per_task`` rows, so their counts fit in lanes."""

    def __init__(self, group: str, words: Sequence[str], n_features: int, k: int, limit: Column, salted: bool,
                 rows_per_task: int = ROWS_PER_TASK):
        self.group, self.words, self.k = group, list(words), k
        lanes = not salted and rows_per_task < 1 << LANE_BITS
        extra = ["_nsalt"] if salted else []
        cells = [(c, j) for c in range(k) for j in range(len(self.words))]
        self.now, self.used = [f"_m{c}_{j}" for c, j in cells], [f"_u{c}_{j}" for c, j in cells]
        self.kept = [*self.now, *self.used, *extra, "_done", "_rounds"]
        n = len(self.words)
        modes = lambda names: [[F.col(x) for x in names[c * n:(c + 1) * n]] for c in range(k)]
        self.near_now, self.near_used = _nearest(words, modes(self.now)), _nearest(words, modes(self.used))
        self.per_cluster = [F.count(F.lit(1)).alias("_n"), F.max("_moved").alias("_any"),
                            *[F.first(c).alias(c) for c in self.kept],
                            *(_lane_sums if lanes else _bit_sums)(words, n_features)]
        self.new_words = _majority_words("_n", n_features, "_w", *([_lane] if lanes else []))
        new = [F.coalesce(F.max(F.when(F.col(CLUSTER) == c, F.col(f"_w{j}"))), F.lit(0).cast("long")).alias(f"_new{c}_{j}")
               for c, j in cells]
        self.per_group = [F.max("_any").alias("_any"), F.sum("_n").alias("_rows"), *[F.first(c).alias(c) for c in self.kept], *new]
        ended = (F.col("_rounds") + 1 >= limit) | ((F.col("_any") == 0) & (F.col("_rounds") >= 1))
        keep = lambda old, value: F.when(F.col("_done"), F.col(old)).otherwise(value).alias(old)
        self.advance = [
            *[keep(m, F.col(f"_new{c}_{j}")) for m, (c, j) in zip(self.now, cells)],
            *[keep(u, F.col(m)) for u, m in zip(self.used, self.now)],
            *[F.col(c) for c in extra], keep("_done", ended), keep("_rounds", F.col("_rounds") + 1)]

    def start(self, modes: DataFrame) -> DataFrame:
        """State before the first round, from ``_modes`` arrays (and ``_nsalt``)."""
        first = [F.col("_modes")[c][w].alias(self.now[c * len(self.words) + j])
                 for c in range(self.k) for j, w in enumerate(self.words)]
        return modes.select(self.group, *first, *[F.lit(None).cast("long").alias(u) for u in self.used],
                            *[c for c in self.kept if c == "_nsalt"], F.lit(False).alias("_done"), F.lit(0).alias("_rounds"))

    def one(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        assigned = (rows.drop("_nsalt").join(_copied(state), _keys(rows, self.group))
            .select(self.group, *self.kept, *self.words, self.near_now.alias(CLUSTER),
                    F.coalesce(self.near_used, F.lit(-1)).alias("_before"))
            .withColumn("_moved", (F.col("_before") != F.col(CLUSTER)).cast("int")))
        clusters = (assigned.groupBy(self.group, CLUSTER).agg(*self.per_cluster)
                            .select(self.group, CLUSTER, "_n", "_any", *self.kept, *self.new_words))
        return clusters.groupBy(self.group).agg(*self.per_group).select(self.group, *self.advance)


def _checked(initial: DataFrame, group: str, words: Sequence[str], k: int) -> DataFrame:
    """``initial`` modes as ``_modes`` arrays, with an error in a group that has other rows than one for each cluster."""
    arrays = modes_array(initial, group, words, F.count(F.lit(1)).alias("_k"))
    return arrays.select(group, F.when(
        (F.col("_k") == k) & (F.transform("_modes", lambda m: m["c"].cast("int")) == F.sequence(F.lit(0), F.lit(k - 1))),
        F.col("_modes")).otherwise(F.raise_error(F.lit(f"initial modes: one row for each of {k} clusters"))).alias("_modes"))


def fit(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str], n_features: int,
        k: int = KMODES_CLUSTERS, max_iter: int | str = KMODES_MAX_ITER, payload: Sequence[str] = (),
        rows_per_task: int = ROWS_PER_TASK, spark: SparkSession | None = None,
        initial: DataFrame | None = None, in_row: int = R.IN_ROW) -> KModesResult:
    """k-modes of every group.

    ``initial`` gives the starting modes ``(group, cluster, w...)``, one row
    for each of the clusters ``0..k-1`` of every group (a group with other
    rows is an error); without it the seeds of ``seeds`` are used.

    ``max_iter`` is a round limit: an int for all groups, or ``"rows"`` for
    each group's row count (as the reference's session clustering uses).
    Returns the final assignment and the modes computed from it.

    Groups of at most ``in_row`` rows are dealt and sorted by group, and a task runs all
    rounds of many of them at once (``kmodes_rows.fitted_bits``): one stage, whatever the number of
    rounds.  Larger groups are laid out and advance together, a job for every
    few rounds (``_fit_by_rounds``).  Both give the same result; only where
    groups of both kinds occur are the rows written first, as each way then reads its own."""
    spark, words, in_row = spark or rows.sparkSession, list(words), min(in_row, (1 << R.LANE) - 1)
    order = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    rows = rows.select(group, *payload, *words, *order).where(F.col(group).isNotNull())
    order = [F.col(f"_o{i}") for i in range(len(order))]
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    least, most = sizes.agg(F.coalesce(F.min("_gn"), F.lit(0)), F.coalesce(F.max("_gn"), F.lit(0))).first()
    if initial is None and k != 2:
        initial = density_seeds(rows, group, order, words, n_features, k, payload).withColumnRenamed("seed", CLUSTER)
    parts, how = [], (group, order, words, n_features, k, max_iter, payload)
    if most > in_row >= least:
        checkpoint_dir(spark)
        rows = rows.checkpoint()
    # at most (all rows / in_row) groups are large, so this side is small and Spark may broadcast it
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_gn")).where(F.col("_gn") > in_row).select(group)
    if least <= in_row:
        small = rows.join(large, group, "left_anti") if most > in_row else rows
        parts.append(_fit_in_rows(small, *how, initial))
    if most > in_row:
        some = rows.join(large, group, "left_semi") if least <= in_row else rows
        parts.append(_fit_by_rounds(some, *how, initial, rows_per_task, spark))
    if len(parts) == 1:
        return parts[0]
    return KModesResult(parts[0].assignments.unionByName(parts[1].assignments), parts[0].modes.unionByName(parts[1].modes),
                        max(p.rounds for p in parts))


def _fit_in_rows(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str], n_features: int, k: int,
                 max_iter: int | str, payload: Sequence[str], initial: DataFrame | None) -> KModesResult:
    """``fit`` of groups that are small: all rounds in the task that holds the group."""
    if initial is not None:
        initial = _checked(initial, group, words, k)
    checkpoint_dir(rows.sparkSession)
    done = R.fitted_bits(rows, group, order, words, n_features, k, max_iter, payload, CLUSTER, initial).checkpoint()
    n = len(words)
    cells = [f"named_struct('{CLUSTER}', {c}, " + ", ".join(f"'{w}', _m[{c * n + j}]" for j, w in enumerate(words)) + ")" for c in range(k)]
    modes = done.where("_m is not null").select(group, F.expr(f"inline(array({', '.join(cells)}))"))
    return KModesResult(done.select(group, *payload, CLUSTER, "distance", "rounds", "_ord", *words), modes,
                        done.agg(F.max("rounds")).first()[0] or 0)


def _fit_by_rounds(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str], n_features: int, k: int,
                   max_iter: int | str, payload: Sequence[str], initial: DataFrame | None, rows_per_task: int,
                   spark: SparkSession) -> KModesResult:
    """``fit`` of groups of any size.

    A round's assignment depends only on the rows and the modes, and whether
    a row moved only on the two last rounds' modes, so no per-row state is
    kept.  The state is written as a small table every ``ROUNDS_PER_STEP``
    rounds and the table before it is deleted; finished groups go to a table
    of their own, and the rows are compacted when the unfinished groups have
    halved.  The final assignment is the nearest of the modes each group used
    in its last round."""
    base = laid_out(rows, group, order, words, payload, rows_per_task)
    keys = _keys(base, group)
    if initial is None:
        seeded = seeds(base, group, [F.col("_ord")], words, n_features, k).withColumnRenamed("seed", CLUSTER)
        starts = modes_array(seeded, group, words)
    else:
        starts = _checked(initial, group, words, k)
    rounds = _Rounds(group, words, n_features, k, F.col("_rows") if max_iter == "rows" else F.lit(int(max_iter)),
                     len(keys) > 1, rows_per_task)
    folder = scratch_folder(spark, "kmodes")

    def written(state: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        state.write.mode(mode).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    state = written(rounds.start(_salts(base, group, starts)), "state-0")
    rows_now, active_then, step = base, None, 0
    while True:
        step += 1
        ahead = state
        for _ in range(ROUNDS_PER_STEP):
            ahead = rounds.one(rows_now, ahead)
        ahead = written(ahead, f"ahead-{step}")
        delete_folder(spark, f"{folder}/state-{step - 1}")
        ended = written(ahead.where("_done"), "finished", "append")
        state = written(ahead.where(~F.col("_done")), f"state-{step}")
        delete_folder(spark, f"{folder}/ahead-{step}")
        active = state.count()
        if not active:
            break
        if active_then is None:
            active_then = active
        elif 2 * active < active_then:
            left = _spread(state.select(group, *[c for c in state.columns if c == "_nsalt"]))
            rows_now = checkpoint_in_place(rows_now.join(left, keys, "left_semi").sortWithinPartitions(*keys))
            active_then = active
    n = len(words)
    cells = [[F.col(x) for x in rounds.now[c * n:(c + 1) * n]] for c in range(k)]
    used = [[F.col(x) for x in rounds.used[c * n:(c + 1) * n]] for c in range(k)]
    joined = base.drop("_nsalt").join(_copied(ended.drop("_done")), keys)
    own = [F.coalesce(*[F.when(F.col(CLUSTER) == c, m[j]) for c, m in enumerate(cells)]) for j in range(n)]
    assignments = (joined.withColumn(CLUSTER, _nearest(words, used)).withColumn("distance", distance_to(words, own))
                         .select(group, *payload, CLUSTER, "distance", F.col("_rounds").alias("rounds"), "_ord", *words))
    modes = ended.select(group, F.explode(F.array(*[
        F.struct(F.lit(c).alias(CLUSTER), *[m.alias(w) for m, w in zip(cells[c], words)]) for c in range(k)])).alias("_s"))
    return KModesResult(assignments, modes.select(group, "_s.*"), ended.agg(F.max("_rounds")).first()[0] or 0)
