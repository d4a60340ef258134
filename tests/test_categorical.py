"""Columns with several values: dictionary, lanes, modes and k-modes against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import categorical as C
from cartlens.operators import kmodes as KM


def table(spark, groups, kinds):
    """Rows (g, pos, c0, ...) of tuples."""
    names = [f"c{i}" for i in range(len(kinds))]
    return spark.createDataFrame([(g, p, *r) for g, rows in groups for p, r in enumerate(rows)],
                                 "g long, pos long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))), names


def random_groups(rng, sizes, n_cols, n_values):
    out = []
    for g, n in enumerate(sizes):
        centres = rng.integers(0, n_values, (3, n_cols))
        rows = centres[rng.integers(0, 3, n)]
        noise = rng.random((n, n_cols)) < 0.2
        rows = np.where(noise, rng.integers(0, n_values, (n, n_cols)), rows)
        out.append((g, [tuple(int(x) for x in r) for r in rows]))
    return out


def mode(rows, n_cols, lowest=0):
    """Most frequent value of each column, the lowest on ties."""
    return tuple(min(c, key=lambda v: (-c[v], v)) if (c := Counter(r[i] for r in rows)) else lowest for i in range(n_cols))


def differ(a, b):
    return sum(x != y for x, y in zip(a, b))


def model(rows, k, max_iter, lowest):
    """Density seeds, then simultaneous rounds: clusters, modes, rounds."""
    n_cols = len(rows[0])
    counts = [Counter(r[i] for r in rows) for i in range(n_cols)]
    density = [sum(counts[i][r[i]] for i in range(n_cols)) for r in rows]
    seeds = [max(range(len(rows)), key=lambda p: (density[p], -p))]
    for _ in range(k - 1):
        seeds.append(max(range(len(rows)), key=lambda p: (density[p] * min(differ(rows[p], rows[s]) for s in seeds), -p)))
    modes, before, rounds = [rows[s] for s in seeds], None, 0
    while True:
        cl = [min(range(k), key=lambda c: (differ(r, modes[c]), c)) for r in rows]
        modes = [mode(own, n_cols) if (own := [r for r, x in zip(rows, cl) if x == c]) else tuple(lowest) for c in range(k)]
        rounds += 1
        if rounds >= max_iter or cl == before:
            return cl, modes, rounds
        before = cl


def test_codes_and_back(spark):
    df, names = table(spark, [(0, [(5, "b", None), (1, "a", 2.5), (5, None, 2.5)])], ["int", "string", "double"])
    codec = C.dictionary(df, names)
    assert codec.values == [[1, 5], [None, "a", "b"], [None, 2.5]] and codec.bits == 2
    coded = C.encode(df, codec, ["g", "pos"])
    back = coded.select("pos", *codec.decoded(dict(df.dtypes)))
    assert sorted(map(tuple, back.collect())) == [(0, 5, "b", None), (1, 1, "a", 2.5), (2, 5, None, 2.5)]
    with pytest.raises(ValueError, match="more than 2 values"):
        C.dictionary(df, names, max_values=2)
    other, _ = table(spark, [(0, [(7, "a", 2.5)])], ["int", "string", "double"])
    with pytest.raises(Exception, match="not in the dictionary"):
        C.encode(other, codec, ["g"]).collect()


@pytest.mark.parametrize("n_cols, n_values", [(1, 1), (5, 3), (40, 3), (70, 2), (9, 20)])
def test_modes_and_distances(spark, n_cols, n_values):
    rng = np.random.default_rng(n_cols)
    groups = random_groups(rng, [1, 2, 8, 31], n_cols, n_values)
    df, names = table(spark, groups, ["int"] * n_cols)
    codec = C.dictionary(df, names)
    assert len(codec.words) == -(-n_cols // (63 // codec.bits))
    coded = C.encode(df, codec, ["g", "pos"])
    want = {g: mode(rows, n_cols) for g, rows in groups}
    got = C.group_modes(coded, "g", codec).select("g", *codec.decoded(dict(df.dtypes))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
    modes = C.group_modes(coded, "g", codec).select("g", *[F.col(w).alias(f"m_{w}") for w in codec.words])
    away = coded.join(modes, "g").select("g", "pos", codec.distance(codec.words, [F.col(f"m_{w}") for w in codec.words]).alias("d"))
    assert {(r.g, r.pos): r.d for r in away.collect()} == {(g, p): differ(r, want[g]) for g, rows in groups for p, r in enumerate(rows)}


@pytest.mark.parametrize("k, n_cols, n_values, max_iter", [(2, 6, 3, "rows"), (3, 25, 3, 50), (2, 8, 5, 1), (2, 40, 4, 50)])
def test_fit_equals_a_plain_model(spark, k, n_cols, n_values, max_iter):
    rng = np.random.default_rng(10 * k + n_cols)
    groups = random_groups(rng, [6, 17, 33, 50], n_cols, n_values)
    df, names = table(spark, groups, ["int"] * n_cols)
    codec = C.dictionary(df, names)
    coded = C.encode(df, codec, ["g", "pos"])
    lowest = [v[0] for v in codec.values]
    want = {g: model(rows, k, len(rows) if max_iter == "rows" else max_iter, lowest) for g, rows in groups}
    for in_row in (1024, 0, 20):
        res = C.fit(coded, "g", [F.col("pos")], codec, k, max_iter, ["pos"], in_row=in_row)
        assert {(r.g, r.pos): (r.cluster, r.rounds) for r in res.assignments.collect()} == {
            (g, p): (c, want[g][2]) for g in want for p, c in enumerate(want[g][0])}
        got = {(r.g, r.cluster): tuple(r)[2:] for r in res.modes.select("g", "cluster", *codec.decoded(dict(df.dtypes))).collect()}
        for g, (cl, modes, _) in want.items():
            for c in range(k):
                assert got[g, c] == (modes[c] if c in cl else tuple(lowest))
        assert res.rounds == max(r for _, _, r in want.values())


def test_two_values_agree_with_the_binary_fit(spark):
    rng = np.random.default_rng(77)
    groups = random_groups(rng, [12, 40], 10, 2)
    df, names = table(spark, groups, ["int"] * 10)
    codec = C.Codec(names, [[0, 1]] * 10)
    coded = C.encode(df, codec, ["g", "pos"])
    initial = spark.createDataFrame([(g, c, v) for g in range(2) for c, v in ((0, 0b1111), (1, 0b1111100000))], "g long, cluster int, w0 long")
    a = C.fit(coded, "g", [F.col("pos")], codec, 2, 50, ["pos"], initial)
    b = KM.fit(coded, "g", [F.col("pos")], ["w0"], 10, payload=["pos"], initial=initial)
    key = lambda res: sorted((r.g, r.pos, r.cluster, r.distance, r.rounds) for r in res.assignments.collect())
    assert key(a) == key(b)
    assert sorted(map(tuple, a.modes.collect())) == sorted(map(tuple, b.modes.collect()))
