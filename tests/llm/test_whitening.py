"""Whitening against whole-number covariances in plain Python."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from cartlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, x string"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 1, "c", "n", "x") for i, v in enumerate(vectors)], SCHEMA)


def vectors(n=90, d=6, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d))
    return (rng.standard_normal((n, d)) @ mix).astype(np.float32).tolist()


def plain(rows, scale=64, offset=1_000_000):
    """(x of each row, n, S, exact covariance of the distinct x)."""
    xs = [[floor(scale * float(c)) + offset for c in v] for v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(xs[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n ** 3) for j in range(d)] for i in range(d)]
    return xs, n, s, v


def test_equals_plain_whole_numbers(spark):
    rows = vectors()
    rows += rows[:5] * 3                                                     # repeats count once
    got = whitening.whiten(table(spark, rows), components=4).collect()
    xs, n, s, v = plain(rows)
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == len(rows) * 4 and {r.component for r in got} == {1, 2, 3, 4}
    for r in got:
        x, k = xs[r.vec_id], r.component - 1
        assert r.n == n and int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s))
        want = (np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)]) @ u[:, k]) / np.sqrt(e[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        assert abs(r.explained - e[k] / e.sum()) < 1e-12 and r.identity_error < 1e-9


def test_identity_of_the_result(spark):
    rows = vectors(200, 5)
    got = whitening.whiten(table(spark, rows)).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (200, 5) and np.abs(np.cov(w.T, bias=True) - np.eye(5)).max() < 1e-9


@pytest.mark.parametrize("span", [10, 1 << 20, 1 << 38])
def test_sums_are_exact_for_any_size_of_numbers(span):
    rng = np.random.default_rng(span)
    x = rng.integers(-span, span, (50, 4))
    sums, n = [int(c) for c in x.sum(axis=0)], 1000 * 50
    c = whitening.centred(x, n, [s * 1000 for s in sums])
    exact = [[n * int(a) - 1000 * s for a, s in zip(r, sums)] for r in x]
    assert [[int(a) for a in r] for r in c] == exact
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    assert whitening.polarised(c) == [sum(r[i] ** 2 for r in exact) for i in range(4)] + [
        sum((r[i] + r[j]) ** 2 for r in exact) for i, j in pairs]
    assert whitening.squares(c, 1) == [sum(a * a for a in r) for r in exact]


def test_limbs_are_used_and_exact():
    c = np.array([[(1 << 46) - 5, -(1 << 46)], [3, (1 << 45) + 1]] * 100)
    assert whitening.squares(c, 0) == [sum(int(a) ** 2 for a in col) for col in c.T.tolist()]


def test_rows_that_take_no_part(spark):
    rows = vectors(30, 3)
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    got = whitening.whiten(table(spark, rows + odd)).collect()
    assert {r.vec_id for r in got} == set(range(30)) and {r.n for r in got} == {30}
    null_id = spark.createDataFrame([(None, v) for v in rows], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in whitening.whiten(null_id).collect()] == [None] * 90


def test_components_without_variance_do_not_exist(spark):
    flat = [[a, 2 * a, 5.0] for a in map(float, range(20))]                  # one direction only
    assert {r.component for r in whitening.whiten(table(spark, flat)).collect()} == {1}
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [[], []])).columns == whitening.NAMES


def test_query_casts_to_the_contract(spark):
    from cartlens.llm.queries import QUERIES
    got = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001")
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    assert got.count() == 500 * 16
