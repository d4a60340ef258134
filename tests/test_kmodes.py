"""k-modes inside one row per group against the rounds over all rows, and
density seeds against a NumPy model."""

import contextlib
import io

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlens.operators import kmodes as KM
from cartlens.operators import kmodes_rows as KR


def table(spark, groups, words):
    """Rows (g, pos, w...) of lists of bit patterns; words of 64 bits."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(g, i, *[signed(v >> 64 * j & (1 << 64) - 1) for j in range(words)]) for g, vs in groups for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g long, pos long, " + ", ".join(f"w{j} long" for j in range(words)))


def random_groups(rng, n_features, sizes):
    out = []
    for g, n in enumerate(sizes):
        centres = [int.from_bytes(rng.bytes(-(-n_features // 8)), "little") & (1 << n_features) - 1 for _ in range(3)]
        noise = lambda: sum(1 << int(b) for b in set(rng.integers(0, n_features, 3)))
        out.append((g, [centres[rng.integers(0, 3)] ^ (noise() if rng.random() < 0.8 else 0) for _ in range(n)]))
    return out


def result(res, words):
    names = [f"w{j}" for j in range(words)]
    return (sorted((r.g, r.pos, r.cluster, r.distance, r.rounds, *[r[w] for w in names]) for r in res.assignments.collect()),
            sorted((r.g, r.cluster, *[r[w] for w in names]) for r in res.modes.collect()), res.rounds)


@pytest.mark.parametrize("n_features, words, max_iter", [(8, 1, 50), (64, 1, "rows"), (73, 2, "rows"), (64, 1, 1), (63, 1, 2)])
def test_inside_rows_equals_rounds(spark, n_features, words, max_iter):
    rng = np.random.default_rng(n_features)
    groups = random_groups(rng, n_features, [1, 2, 3, 7, 8, 15, 16, 17, 40, 64, 100, 130])
    groups += [(50, [0] * 9), (51, [(1 << n_features) - 1] * 5), (52, [5] * 4 + [6] * 4)]  # equal rows, ties
    rows = table(spark, groups, words)
    names, how = [f"w{j}" for j in range(words)], {"max_iter": max_iter, "payload": ["pos"]}
    by_rounds = result(KM.fit(rows, "g", [F.col("pos")], names, n_features, in_row=0, **how), words)
    assert result(KM.fit(rows, "g", [F.col("pos")], names, n_features, **how), words) == by_rounds
    # both kinds of group in one fit: the limit lies between, and exactly at, sizes
    for limit in (16, 20):
        assert result(KM.fit(rows, "g", [F.col("pos")], names, n_features, in_row=limit, **how), words) == by_rounds


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 255), min_size=1, max_size=12), min_size=1, max_size=4), st.integers(1, 6))
def test_inside_rows_equals_rounds_on_any_rows(spark, groups, max_iter):
    rows = table(spark, list(enumerate(groups)), 1)
    how = {"max_iter": max_iter, "payload": ["pos"]}
    assert result(KM.fit(rows, "g", [F.col("pos")], ["w0"], 8, **how), 1) == result(
        KM.fit(rows, "g", [F.col("pos")], ["w0"], 8, in_row=0, **how), 1)


def test_supplied_modes_and_null_groups(spark):
    rng = np.random.default_rng(4)
    rows = table(spark, random_groups(rng, 12, [20, 30]), 1).unionByName(
        spark.createDataFrame([(None, 0, 1)], "g long, pos long, w0 long"))
    initial = spark.createDataFrame([(g, c, 7 << c) for g in range(2) for c in range(4)], "g long, cluster int, w0 long")
    how = {"k": 4, "payload": ["pos"], "initial": initial}
    a, b = (KM.fit(rows, "g", [F.col("pos")], ["w0"], 12, in_row=n, **how) for n in (1024, 0))
    assert a.assignments.dtypes == b.assignments.dtypes and a.modes.dtypes == b.modes.dtypes
    assert result(a, 1) == result(b, 1) and len(result(a, 1)[0]) == 50


def test_rounds_inside_rows_are_one_stage(spark):
    """One shuffle gathers the rows; seeds and all rounds follow in that stage, without Python."""
    rows = table(spark, [(g, list(range(g, g + 20))) for g in range(30)], 1)
    groups = KR.gathered(rows, "g", [F.col("pos")], ["w0"])
    done = KR.fitted(groups, ["w0"], 2, "size(_rows)", KR.planes_for(20), KR.seed_words(["w0"], 8, KR.planes_for(20)))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        done.explain()
    plan = buf.getvalue()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan
    assert plan.count("Project") <= 4


def test_counts_up_to_the_last_plane(spark):
    """Counts of a full row limit: more than half, exactly half, fewer."""
    n = 1023
    cells = [0b001 if i < 511 else 0b010 if i < 1022 else 0b111 for i in range(n)]  # 512, 512, 1 of 1023
    rows = table(spark, [(0, cells), (1, [0b01] * 512 + [0b10] * 512)], 1)
    groups = KR.gathered(rows, "g", [F.col("pos")], ["w0"])
    got = groups.select("g", F.expr(KR._mode("_rows", ["w0"], KR.planes_for(1024))).alias("m")).collect()
    assert {r.g: list(r.m) for r in got} == {0: [0b011], 1: [0]}


def numpy_seeds(rows, n_features, k):
    """Positions of the k seeds: densest first, then greatest density times distance to the nearest seed."""
    bits = np.array([[v >> i & 1 for i in range(n_features)] for v in rows])
    ones = bits.sum(axis=0)
    density = np.where(bits == 1, ones, len(rows) - ones).sum(axis=1)
    out = [int(np.argmax(density))]
    for _ in range(k - 1):
        away = np.min([(bits != bits[s]).sum(axis=1) for s in out], axis=0)
        out.append(int(np.argmax(density * away)))
    return out


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("n_features, words, rows_per_task", [(10, 1, 1 << 20), (73, 2, 1 << 20), (10, 1, 7)])
def test_density_seeds_equal_numpy(spark, k, n_features, words, rows_per_task):
    rng = np.random.default_rng(k)
    groups = random_groups(rng, n_features, [25, 40, 12])
    names = [f"w{j}" for j in range(words)]
    base = KM.laid_out(table(spark, groups, words), "g", [F.col("pos")], names, ["pos"], rows_per_task)
    assert ("_salt" in base.columns) == (rows_per_task == 7)
    got = KM.density_seeds(base, "g", [F.col("_ord")], names, n_features, k, ["pos"]).collect()
    assert sorted((r.g, r.seed, r.pos) for r in got) == sorted(
        (g, s, p) for g, vs in groups for s, p in enumerate(numpy_seeds(vs, n_features, k)))
    assert len({(r.g, *[r[w] for w in names]) for r in got}) == 3 * k       # distinct


def test_density_seeds_need_distinct_rows(spark):
    rows = table(spark, [(0, [1, 1, 2, 2])], 1)
    assert len(KM.density_seeds(rows, "g", [F.col("pos")], ["w0"], 4, 2).collect()) == 2
    with pytest.raises(Exception, match="fewer than 3 distinct rows"):
        KM.density_seeds(rows, "g", [F.col("pos")], ["w0"], 4, 3).collect()


@pytest.mark.parametrize("in_row", [1024, 0])
def test_fit_with_three_clusters(spark, in_row):
    """Without supplied modes: density seeds, then the rounds."""
    rng = np.random.default_rng(9)
    groups = random_groups(rng, 16, [60, 35])
    res = KM.fit(table(spark, groups, 1), "g", [F.col("pos")], ["w0"], 16, k=3, payload=["pos"], in_row=in_row)
    for g, vs in groups:
        bits = np.array([[v >> i & 1 for i in range(16)] for v in vs])
        modes, before = bits[numpy_seeds(vs, 16, 3)], None
        while True:
            cl = np.argmin([(bits != m).sum(axis=1) for m in modes], axis=0)
            modes = np.array([2 * bits[cl == c].sum(axis=0) > (cl == c).sum() for c in range(3)]).astype(int)
            if before is not None and (cl == before).all():
                break
            before = cl
        assert [r.cluster for r in res.assignments.where(F.col("g") == g).orderBy("pos").collect()] == cl.tolist()


@pytest.mark.parametrize("bits,words", [(8, 1), (64, 1), (73, 2)])
def test_batches_of_groups_equal_the_rounds_of_each(spark, bits, words):
    """Rounds over a batch of groups give what the expression over one group gives."""
    rng = np.random.default_rng(bits)
    sizes = np.array([1, 2, 7, 40, 3, 300, 5])
    cells = rng.integers(0, 2, (int(sizes.sum()), bits), dtype=np.uint8) & rng.integers(0, 2, (int(sizes.sum()), bits), dtype=np.uint8)
    cells[:1], cells[-5:] = 1, 0
    packed = np.zeros((len(cells), words), np.uint64)
    for i in range(bits):
        packed[:, i // 64] |= cells[:, i].astype(np.uint64) << np.uint64(i % 64)
    names, g = [f"w{j}" for j in range(words)], np.repeat(np.arange(len(sizes)), sizes)
    rows = [(int(g[i]), i, *[int(v) for v in packed[i].view(np.int64)]) for i in range(len(g))]
    df = spark.createDataFrame(rows, "g long, pos long, " + ", ".join(f"{w} long" for w in names))
    planes = KR.planes_for(300)
    groups = KR.gathered(df, "g", [F.col("pos")], names)
    done = KR.fitted(groups, names, 2, "size(_rows)", planes, KR.seed_words(names, bits, planes)).orderBy("g").collect()
    clusters, modes, rounds = KR.fit_batch(packed, sizes, bits, None, sizes, 2)
    assert clusters.tolist() == [c for r in done for c in r["_fit"]["cl"]]
    assert modes.reshape(len(sizes), -1).view(np.int64).tolist() == [r["_fit"]["m"] for r in done]
    assert rounds.tolist() == [r["_fit"]["rounds"] for r in done] and rounds.max() > 2
    again = KR.fit_batch(packed, sizes, bits, KR.seeds_of(packed, np.cumsum(sizes) - sizes, sizes, bits), sizes, 2)
    assert all((a == b).all() for a, b in zip(again, (clusters, modes, rounds)))


def test_batches_cut_no_group(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(KR, "BATCH", 10)
    g = np.repeat(np.arange(9), [3, 1, 25, 1, 4, 4, 2, 12, 1])
    parts = [pa.RecordBatch.from_pydict({"g": g[i:i + 4], "at": np.arange(len(g))[i:i + 4]}) for i in range(0, len(g), 4)]
    got = list(KR._whole_groups(iter(parts), "g"))
    assert [n for _, sizes in got for n in sizes] == [3, 1, 25, 1, 4, 4, 2, 12, 1] and len(got) > 2
    assert [i for t, _ in got for i in t.column("at").to_pylist()] == list(range(len(g)))
    assert all(t.num_rows == sizes.sum() for t, sizes in got) and list(KR._whole_groups(iter([]), "g")) == []
