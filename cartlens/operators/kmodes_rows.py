"""k-modes of groups that fit one row: all rounds in one expression.

A group's rows are gathered into a sorted array (``gathered``), so the group
is one row of at most ``IN_ROW`` entries.  Seeds, rounds and the stop rule are
then higher-order functions over that array: the rounds of all groups run in the
stage that gathered them, and the driver takes no part.  The results are those
of ``kmodes.fit``, which uses this for its small groups.

Feature counts are vertical: plane ``p`` of a word holds bit ``p`` of the
counts of its 64 features.  Adding a row is a ripple of ANDs and XORs over the planes,
and "more than half" one comparison of planes, so the work per row does not
depend on the number of features in a word.

For 0/1 cells the same rounds run over whole batches of groups at once
(``fitted_bits``): rows sorted by group in each task, their bits counted in lanes
of a word, a group's counts one segment of a sum.

The expressions are SQL text.  ``(x -> body)`` over a one-element array binds a
value that is used more than once, since lambdas have no common subexpressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.bits import WORD_BITS, quoted, valid_mask
from cartlens.runtime import ship_package

# Entries of a gathered row at most.
IN_ROW = 1024

_ODD = -0x5555555555555556


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _distance(row: str, words: Sequence[str], modes: str, at: int) -> str:
    return " + ".join(f"bit_count({row}.{quoted(w)} ^ {modes}[{at + j}])" for j, w in enumerate(words))


def _nearest(row: str, words: Sequence[str], modes: str, k: int, distance=_distance) -> str:
    """Cluster of the nearest mode, the lowest on ties."""
    pairs = [f"named_struct('d', {distance(row, words, modes, c * len(words))}, 'c', {c})" for c in range(k)]
    return f"array_min(array({', '.join(pairs)})).c"


def _counted(rows: str, words: Sequence[str], planes: int) -> str:
    """Array: number of rows, then the planes of every word's counts."""
    zero = ", ".join(["0L"] * (1 + planes * len(words)))
    added = ["a[0] + 1L"]
    for j, w in enumerate(words):
        at = 1 + j * planes
        for p in range(planes):
            carry = " & ".join([f"r.{quoted(w)}", *[f"a[{at + q}]" for q in range(p)]])
            added.append(f"a[{at + p}] ^ ({carry})")
    return f"aggregate({rows}, array({zero}), (a, r) -> array({', '.join(added)}))"


def _majority(counts: str, words: Sequence[str], planes: int) -> list[str]:
    """Words with the bits that more than half of the rows have: count >
    floor(rows / 2), compared plane by plane from the top."""
    out = []
    for j in range(len(words)):
        at, terms = 1 + j * planes, []
        for p in range(planes):
            half = lambda q: f"(-(shiftright({counts}[0], {q + 1}) & 1L))"
            same = [f"~({counts}[{at + q}] ^ {half(q)})" for q in range(p + 1, planes)]
            terms.append("(" + " & ".join([f"{counts}[{at + p}]", f"~{half(p)}", *same]) + ")")
        out.append("(" + " | ".join(terms) + ")")
    return out


def _mode(rows: str, words: Sequence[str], planes: int) -> str:
    """Array of the words of the rows' mode; zeros where there are no rows."""
    return _let(_counted(rows, words, planes), "n", f"array({', '.join(_majority('n', words, planes))})")


def planes_for(rows: int) -> int:
    """Planes that hold counts up to ``rows``."""
    return max(1, int(rows).bit_length())


def gathered(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """``(group, _rows)``: one row per group, its rows as an array of ``(_ord,
    payload..., w...)`` in group order.  For groups of bounded size only."""
    entry = F.struct(F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)]).alias("_ord"), *payload, *words)
    return (rows.where(F.col(group).isNotNull()).select(group, entry.alias("_r"))
                .groupBy(group).agg(F.sort_array(F.collect_list("_r")).alias("_rows")))


def seed_words(words: Sequence[str], n_features: int, planes: int) -> str:
    """SQL text: the words of both seeds of ``_rows`` (the rule of
    ``kmodes.seeds``), as one array: the shifted majority and its complement,
    each replaced by the first of the rows nearest to it."""
    ones = "aggregate(_rows, 0L, (t, r) -> t + " + " + ".join(f"bit_count(r.{quoted(w)})" for w in words) + ")"
    mixed = f"({ones}) not in (0L, cast(size(_rows) as bigint) * {n_features})"
    first = [f"if(v, m[{j}] ^ ({_ODD & valid_mask(n_features, j)}L), 0L)" for j in range(len(words))]
    second = [f"(~q[{j}] & ({valid_mask(n_features, j)}L))" for j in range(len(words))]
    n = len(words)

    def found(s: int) -> str:
        nearest = f"array_min(transform(_rows, (r, i) -> named_struct('d', {_distance('r', words, 't', s * n)}, 'i', i))).i"
        return _let(f"_rows[{nearest}]", "x", f"array({', '.join(f'x.{quoted(w)}' for w in words)})")
    both = _let(f"concat(q, array({', '.join(second)}))", "t", f"concat({found(0)}, {found(1)})")
    return _let(_mode("_rows", words, planes), "m", _let(mixed, "v", _let(f"array({', '.join(first)})", "q", both)))


def fitted(groups: DataFrame, words: Sequence[str], k: int, limit: str, planes: int, starts: str, distance=_distance,
           mode=_mode) -> DataFrame:
    """``groups`` with ``_fit``: ``m`` the final modes (k times the words),
    ``cl`` the cluster of every entry, ``done`` and ``rounds``.

    ``limit`` and ``starts`` are SQL text: the round limit, and the starting
    modes.  ``distance`` and ``mode`` write the SQL of those two for other cells
    than bits (``categorical``).  A round assigns all rows at once and takes the modes of the
    clusters; it is the last if it moves no row (the first always moves) or is
    the ``limit``-th."""
    clusters = [_let(f"filter(_rows, (r, i) -> cl[i] = {c})", "own", mode("own", words, planes)) for c in range(k)]
    one = _let(f"transform(_rows, r -> {_nearest('r', words, 's.m', k, distance)})", "cl",
               f"named_struct('m', concat({', '.join(clusters)}), 'cl', cl, "
               f"'done', s.rounds + 1 >= ({limit}) or cl = s.cl, 'rounds', s.rounds + 1)")
    # before the first round no row has a cluster, so the first moves all of them
    start = f"named_struct('m', {starts}, 'cl', transform(_rows, r -> -1), 'done', false, 'rounds', 0)"
    rounds = f"aggregate(sequence(1, greatest(1, {limit})), {start}, (s, i) -> if(s.done, s, {one}))"
    return groups.withColumn("_fit", F.expr(rounds))


def assignments_of(done: DataFrame, group: str, words: Sequence[str], payload: Sequence[str], cluster: str, distance=_distance) -> DataFrame:
    """One row per entry: ``(group, payload..., cluster, distance, rounds, _ord, w...)``."""
    n = len(words)
    own = f"slice(_fit.m, _fit.cl[i] * {n} + 1, {n})"
    away = _let(own, "o", distance("r", words, "o", 0))
    fields = [*[f"'{p}', r.{quoted(p)}" for p in payload], f"'{cluster}', _fit.cl[i]", f"'distance', cast({away} as int)",
              "'rounds', _fit.rounds", "'_ord', r._ord", *[f"'{w}', r.{quoted(w)}" for w in words]]
    return done.select(group, F.expr(f"inline(transform(_rows, (r, i) -> named_struct({', '.join(fields)})))"))


def modes_of(done: DataFrame, group: str, words: Sequence[str], k: int, cluster: str) -> DataFrame:
    """One row per cluster: ``(group, cluster, w...)``."""
    n = len(words)
    rows = [f"named_struct('{cluster}', {c}, " + ", ".join(f"'{w}', _fit.m[{c * n + j}]" for j, w in enumerate(words)) + ")" for c in range(k)]
    return done.select(group, F.expr(f"inline(array({', '.join(rows)}))"))


# Rows taken up at a time by ``fitted_bits``, and bits of the lanes they are counted in.
BATCH, LANE = 1 << 15, 16
_LANES = np.uint64(sum(1 << LANE * i for i in range(WORD_BITS // LANE)))


def _lanes(words: np.ndarray, n_features: int) -> list[list[np.ndarray]]:
    """Per word, the bits b, b + 16, ... of every row in the lanes of array b."""
    return [[words[:, j] >> np.uint64(b) & _LANES for b in range(min(LANE, n_features - j * WORD_BITS))] for j in range(words.shape[1])]


def _segment_sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the segments of ``values``, 0 for an empty one."""
    out = np.zeros(len(starts), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some])
    return out


def _counts_majority(counts: list[list[np.ndarray]], sizes: np.ndarray, n_features: int) -> np.ndarray:
    """Words with the bits that more than half of ``sizes`` rows have."""
    out = np.zeros((len(sizes), len(counts)), np.uint64)
    for i in range(n_features):
        j, b = divmod(i, WORD_BITS)
        ones = counts[j][b % LANE] >> np.uint64(b // LANE * LANE) & np.uint64((1 << LANE) - 1)
        out[:, j] |= (2 * ones.astype(np.int64) > sizes).astype(np.uint64) << np.uint64(b)
    return out


def _away(words: np.ndarray, modes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distance of every row to its group's mode."""
    return sum(np.bitwise_count(words[:, j] ^ modes[owner, j]).astype(np.int64) for j in range(words.shape[1]))


def seeds_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_features: int) -> np.ndarray:
    """Both seeds of every group (groups, 2, words), by the rule of ``seed_words``."""
    owner, lanes = np.repeat(np.arange(len(sizes)), sizes), _lanes(words, n_features)
    valid = np.array([valid_mask(n_features, j) & (1 << 64) - 1 for j in range(words.shape[1])], np.uint64)
    major = _counts_majority([[np.add.reduceat(a, starts) for a in w] for w in lanes], sizes, n_features)
    ones = np.add.reduceat(np.bitwise_count(words).sum(axis=1, dtype=np.int64), starts)
    mixed = (ones != 0) & (ones != sizes * n_features)
    first = np.where(mixed[:, None], major ^ (np.uint64(_ODD & (1 << 64) - 1) & valid), np.uint64(0))
    out = np.empty((len(sizes), 2, words.shape[1]), np.uint64)
    for s, target in enumerate((first, ~first & valid)):
        # the first row of those nearest: distance and place as one number
        key = _away(words, target, owner) << 32 | np.arange(len(words))
        out[:, s] = words[np.minimum.reduceat(key, starts) & 0xFFFFFFFF]
    return out


def fit_batch(words: np.ndarray, sizes: np.ndarray, n_features: int, starts_at: np.ndarray | None, limits: np.ndarray, k: int):
    """All rounds of some groups, whose rows lie one after the other: the cluster of every row, the modes
    (groups, k, words) and the rounds of every group.  ``starts_at``: the starting
    modes, or None for ``seeds_of``.  Groups that have ended are left out of further rounds."""
    starts = np.cumsum(sizes) - sizes
    modes = (seeds_of(words, starts, sizes, n_features) if starts_at is None else starts_at).copy()
    rounds, clusters = np.zeros(len(sizes), np.int64), np.full(len(words), -1, np.int64)
    open_, rows, own, at, n = np.arange(len(sizes)), np.arange(len(words)), words, starts, sizes
    lanes = _lanes(words, n_features)
    total = [[np.add.reduceat(a, at) for a in w] for w in lanes]
    while len(open_):
        owner = np.repeat(np.arange(len(open_)), n)
        now = modes[open_]
        away = np.stack([_away(own, now[:, c], owner) for c in range(k)])
        nearest = np.argmin(away, axis=0)                        # the lowest on ties
        moved = np.logical_or.reduceat(nearest != clusters[rows], at)
        clusters[rows] = nearest
        rest, left = [list(w) for w in total], n.copy()
        for c in range(k):
            if c < k - 1:
                is_c = nearest == c
                some, size = np.flatnonzero(is_c), np.add.reduceat(is_c.astype(np.int64), at)
                begin = np.cumsum(size) - size
                counts = [[_segment_sums(a[some], begin, size) for a in w] for w in lanes]
                rest = [[r - a for r, a in zip(x, y)] for x, y in zip(rest, counts)]
                left = left - size
            else:                                                # what the others leave
                counts, size = rest, left
            modes[open_, c] = _counts_majority(counts, size, n_features)
        rounds[open_] += 1
        go_on = moved & (rounds[open_] < limits[open_])
        if not go_on.all():
            keep = np.repeat(go_on, n)
            open_, rows, own, n = open_[go_on], rows[keep], own[keep], n[go_on]
            lanes = [[a[keep] for a in w] for w in lanes]
            total = [[a[go_on] for a in w] for w in total]
            at = np.cumsum(n) - n
    return clusters, modes, rounds


def _whole_groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by group as tables of about ``BATCH`` rows that cut no group, with the group sizes."""
    held, size = [], 0

    def table_of(parts):
        table = pa.Table.from_batches(parts)
        keys = table.column(group).combine_chunks()
        n = len(keys)
        changed = np.ones(n, bool)
        changed[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        return table, np.flatnonzero(changed)
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BATCH:
            table, first = table_of(held)
            if len(first) > 1:  # the last group may go on
                yield table[:first[-1]], np.diff(first)
                held = table[first[-1]:].to_batches()
                size = sum(b.num_rows for b in held)
    if held:
        table, first = table_of(held)
        yield table, np.diff(first, append=table.num_rows)


def fitted_bits(rows: DataFrame, group: str, order: Sequence[Column], words: Sequence[str], n_features: int, k: int,
                max_iter: int | str, payload: Sequence[str], cluster: str, initial: DataFrame | None = None) -> DataFrame:
    """k-modes of 0/1 rows in groups of fewer than ``2^LANE``: ``(group, payload..., cluster, distance,
    rounds, _ord, w..., _m)``, one row per row of a group, in group order.  ``_m``, the modes (k times
    the words), is on the first row of a group only.

    Rows are dealt and sorted by group, and a task reads them in batches of bounded
    size.  ``initial``: ``(group, _modes)``, an array of the modes' structs by cluster."""
    words, payload = list(words), list(payload)
    ship_package(rows.sparkSession)
    entry = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)])
    known = rows.where(F.col(group).isNotNull()).select(group, *payload, entry.alias("_ord"), *words)
    if initial is not None:
        flat = ", ".join(f"_modes[{c}].{quoted(w)}" for c in range(k) for w in words)
        known = known.join(initial.select(group, F.expr(f"array({flat})").alias("_start")), group)
    dealt = known.repartition(group).sortWithinPartitions(group, "_ord", *payload, *words)
    schema = known.drop("_start").schema
    fields = ", ".join([f"`{cluster}` int", "distance int", "rounds int", "_m array<bigint>"])
    out = T.StructType([*schema.fields, *T._parse_datatype_string(fields).fields])
    n_words, started = len(words), initial is not None  # tasks get no table, only whether there is one

    def fit(batches):
        for table, sizes in _whole_groups(batches, group):
            cells = np.stack([pc.fill_null(table.column(w), 0).to_numpy().astype(np.int64).view(np.uint64) for w in words], axis=1)
            at, starts_at = np.cumsum(sizes) - sizes, None
            if started:
                given = table.column("_start").take(pa.array(at)).combine_chunks()
                starts_at = given.flatten().to_numpy().view(np.uint64).reshape(len(sizes), k, n_words)
            limits = sizes if max_iter == "rows" else np.full(len(sizes), int(max_iter))
            clusters, modes, rounds = fit_batch(cells, sizes, n_features, starts_at, limits, k)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            own = modes[owner, clusters]
            distance = sum(np.bitwise_count(cells[:, j] ^ own[:, j]).astype(np.int32) for j in range(n_words))
            # a list on the first row of each group, null on the others
            begins = np.zeros(len(cells) + 1, np.int32)
            begins[at + 1] = k * n_words
            begins, missing = np.cumsum(begins, dtype=np.int32), np.ones(len(cells), bool)
            missing[at] = False
            lists = pa.ListArray.from_arrays(pa.array(begins), pa.array(modes.reshape(-1).view(np.int64)), mask=pa.array(missing))
            shown = table.select(schema.names)
            for name, col in ((cluster, pa.array(clusters.astype(np.int32))), ("distance", pa.array(distance.astype(np.int32))),
                              ("rounds", pa.array(rounds[owner].astype(np.int32))), ("_m", lists)):
                shown = shown.append_column(name, col)
            yield from shown.to_batches()

    return dealt.mapInArrow(fit, out)
