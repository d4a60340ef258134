"""Hard negatives against brute force, and how much the bounds spare."""

from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor string, block string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "r", "a", "b", "s") for i, v, x in rows], SCHEMA)


def brute(rows, every=10, scale=256, k=5):
    rows = [(i, [floor(scale * float(np.float32(c))) for c in v], x) for i, v, x in rows]
    out = []
    for at, (a, av, ax) in enumerate(rows):
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(av, v)), i, x) for j, (i, v, x) in enumerate(rows) if j != at]
        for neg_p, p, _ in sorted((s, i) + (0,) for s, i, x in scored if x == ax)[:k]:
            fits = sorted((s, i) for s, i, x in scored if x != ax and 80 * -neg_p <= 100 * -s <= 100 * -neg_p)[:k]
            out += [(a, p, r, i, -neg_p, -s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def clusters(n=240, d=8, spread=0.05, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, d))
    return [(i, [float(np.float32(c)) for c in v[i]], int(rng.integers(0, 3))) for i in range(n)]


def mined(df, every=10, **how):
    got = negatives.mine(df, F.col("vec_id") % every == 0, **how).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("how", [{}, {"block_anchors": 4, "cell_rows": 50}, {"block_anchors": 1}])
def test_equals_brute_force(spark, how):
    rows = clusters()
    assert mined(table(spark, rows).repartition(5), **how) == brute(rows)


def test_ties_repeats_and_a_hot_vector(spark):
    rows = clusters(60, spread=0.4)
    rows += [(100 + i, rows[0][1], i % 3) for i in range(40)]                # a third of all rows is one vector
    rows += [(10, rows[10][1], rows[10][2])] * 2                             # repeated rows
    assert mined(table(spark, rows)) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = clusters(40)
    d = len(rows[0][1])
    odd = [(None, rows[0][1], 1), (500, None, 1), (510, [], 1), (520, [None] * d, 1), (530, [nan] * d, 1), (540, [inf] * d, 1),
           (550, rows[0][1], None), (560, [1.0], 1)]
    assert mined(table(spark, rows + odd)) == brute(rows)


def test_negative_and_zero_scores_of_positives(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [-0.9, 0.0], 2), (5, [0.0, 1.0], 2)]
    assert mined(table(spark, rows)) == brute(rows) == [(0, 2, 1, 3, 0, 0), (0, 2, 2, 5, 0, 0)]


def test_large_components_are_scored_exactly(spark):
    rows = [(i, [float(np.float32(c)) * 100_000 for c in v], x) for i, v, x in clusters(60)]
    assert mined(table(spark, rows)) == brute(rows)


def test_empty_and_without_anchors(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(3, [1.0], 1), (7, [1.0], 2)])) == []
    assert mined(table(spark, [(0, [1.0], 1)])) == []


def test_tree_spans_with_true_lengths():
    v = np.random.default_rng(1).integers(-50, 50, (40, 5))
    tree = negatives.spanning_tree(v)
    seen = set()
    for node, parent, edge in tree:
        assert parent == -1 if not seen else parent in seen
        assert parent == -1 or abs(edge - np.linalg.norm(v[node] - v[parent])) < 1e-9
        seen.add(node)
    assert seen == set(range(40))


def test_bounds_spare_most_scores_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32)) * 200
    v = np.floor(centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 32))).astype(np.int64)
    lists = [[negatives.Best(5, None if i % 2 else 100_000)] for i in range(100)]
    block = negatives.Block(np.arange(100), rng.integers(0, 5, 100), v[:100], lists, False)
    ids, labels = np.arange(3000), rng.integers(0, 5, 3000)
    for at in range(0, 3000, 500):
        block.scan(ids[at:at + 500], ids[at:at + 500], labels[at:at + 500], v[at:at + 500])
    assert block.checked == 100 * 3000 and block.scored < block.checked // 3
    for i, (best,) in enumerate(block.lists):
        s = v @ v[i]
        some = np.flatnonzero((labels != block.labels[i]) & (s >= (best.low if best.low is not None else -np.inf)))
        assert best.ids.tolist() == some[np.lexsort((some, -s[some]))][:5].tolist()
