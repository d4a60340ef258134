"""Properties: Hamming symmetric and 0 on self, packed equals array form,
MRR in [0, 1]."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlens.functions.bits import hamming, hamming_arrays, pack_columns

bits = st.lists(st.integers(0, 1), min_size=73, max_size=73)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(bits, bits), min_size=1, max_size=20))
def test_packed_equals_array_form(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<int>")
    cols_a = [F.col("a")[i] for i in range(73)]
    cols_b = [F.col("b")[i] for i in range(73)]
    wa, wb = pack_columns(cols_a), pack_columns(cols_b)
    out = df.select("id", hamming(wa, wb).alias("p"), hamming_arrays("a", "b").alias("q"),
                    hamming(wa, wa).alias("self"), hamming(wb, wa).alias("sym")).collect()
    for r in out:
        a, b = pairs[r["id"]]
        assert r["p"] == r["q"] == sum(x != y for x, y in zip(a, b))
        assert r["self"] == 0 and r["sym"] == r["p"]


def test_mrr_in_unit_interval(spark):
    import __spark_entry__ as E
    row = E.queries()["knn_mrr"](spark, "/root/testdata/sf0.001").collect()[0]
    assert 0.0 <= row["mrr"] <= 1.0


def test_kmodes_cost_never_rises(spark):
    """Total distance of rows to their own mode, after 1, 2, 3, 4 rounds."""
    from cartlens.operators import kmodes as KM
    from cartlens.operators import preference as PF
    from cartlens.plans import queries as Q
    rows = Q._long_rows(spark, "/root/testdata/sf0.001")
    costs = []
    for it in (1, 2, 3, 4):
        res = KM.fit(rows, "session_id", PF.newest_first(rows), Q.EMB_WORDS, 64, max_iter=it, payload=["item_id"])
        own = res.assignments.join(res.modes.withColumnRenamed("w0", "m0"), ["session_id", "cluster"])
        per = own.groupBy("session_id").agg(F.sum(F.bit_count(F.col("w0").bitwiseXOR(F.col("m0")))).alias("c"))
        costs.append({r["session_id"]: r["c"] for r in per.collect()})
    for a, b in zip(costs, costs[1:]):
        assert all(b[g] <= a[g] for g in a)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=60),
       st.lists(st.tuples(st.integers(0, 7), st.integers(1, 3)), min_size=0, max_size=20),
       st.integers(1, 6))
def test_one_pass_means_equal_the_stepwise_plan(spark, views, feats, max_len):
    """Length table, semi join, inner join, mean (the reference's steps, in
    pandas) equals the one-join one-aggregate plan, for random sessions with
    repeated views, featureless items and any length limit."""
    import pandas as pd
    from cartlens.operators.features import encode_features
    from cartlens.operators.sessions import session_feature_means
    cats = [1, 2, 3]
    s = pd.DataFrame(views, columns=["session_id", "item_id"])
    f = pd.DataFrame(feats, columns=["item_id", "feature_category_id"]) if feats else \
        pd.DataFrame({"item_id": pd.Series([], dtype="int64"), "feature_category_id": pd.Series([], dtype="int64")})
    wide = pd.crosstab(f["item_id"], f["feature_category_id"]).reindex(columns=cats, fill_value=0) \
        if len(f) else pd.DataFrame(columns=cats)
    wide.columns = [str(c) for c in wide.columns]
    lens = s.groupby("session_id")["item_id"].count()
    short = s[s["session_id"].isin(lens[lens <= max_len].index)]
    joined = short.merge(wide, left_on="item_id", right_index=True, how="inner")
    want = {sid: tuple(g[str(c)].mean() for c in cats) for sid, g in joined.groupby("session_id")}

    sdf = spark.createDataFrame(s, "session_id long, item_id long")
    fdf = spark.createDataFrame(f.astype("int64"), "item_id long, feature_category_id long") \
        .withColumn("feature_category_id", F.col("feature_category_id").cast("int"))
    got_rows = session_feature_means(sdf, encode_features(fdf, cats), [str(c) for c in cats], hi=max_len).collect()
    got = {r["session_id"]: tuple(r[str(c)] for c in cats) for r in got_rows}
    assert set(got) == set(want)
    for sid in want:
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[sid], want[sid]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 400)), min_size=1, max_size=80),
       st.integers(1, 30))
def test_bucketed_time_spent_equals_plain_window(spark, rows, rows_per_task):
    import datetime as dt
    from pyspark.sql import Window
    from cartlens.operators.sessions import time_spent
    t0 = dt.datetime(2024, 1, 1)
    data = [(s, i, t0 + dt.timedelta(seconds=m)) for s, i, m in rows]
    df = spark.createDataFrame(data, "session_id long, item_id long, date timestamp")
    w = Window.partitionBy("session_id").orderBy("date", "item_id")
    want = sorted((tuple(r) for r in df.select(
        "session_id", "item_id", "date",
        (F.timestamp_diff("MICROSECOND", F.col("date"), F.lead("date").over(w)) / 1e6).alias("t")).collect()),
                  key=repr)
    got = sorted((tuple(r) for r in time_spent(df, rows_per_task=rows_per_task).collect()), key=repr)
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40), st.lists(st.integers(0, 255), min_size=1, max_size=40),
       st.integers(1, 6), st.integers(1, 9), st.integers(1, 9))
def test_block_knn_equals_brute_force(spark, qv, cv, k, qblock, cblock):
    from cartlens.operators.distance import knn
    q = spark.createDataFrame([(i, v) for i, v in enumerate(qv)], "session_id long, w0 long")
    c = spark.createDataFrame([(i, v) for i, v in enumerate(cv)], "item_id long, w0 long")
    got = {tuple(r) for r in knn(q, c, k, ["w0"], query_block_rows=qblock, cand_block_rows=cblock).collect()}
    want = set()
    for qi, v in enumerate(qv):
        ranked = sorted((bin(v ^ w).count("1"), ci) for ci, w in enumerate(cv))[:k]
        want |= {(qi, r + 1, ci, d) for r, (d, ci) in enumerate(ranked)}
    assert got == want


def _kmodes_model(rows, nf, max_iter=50):
    """NumPy model of the rule for one group; rows newest first."""
    import numpy as np
    X = np.array([[(v >> i) & 1 for i in range(nf)] for v in rows])
    n, ones = len(X), X.sum(axis=0)
    c = 1 if X.sum() in (0, n * nf) else 2
    maj = (2 * ones > n).astype(int)
    q1 = (maj + np.arange(nf)) % 2 if c == 2 else np.zeros(nf, int)
    modes = []
    for q in (q1, 1 - q1):
        d = (X != q).sum(axis=1)
        modes.append(X[int(np.argmin(d))])          # first row wins ties
    modes = np.array(modes)
    prev = None
    for r in range(1, max_iter + 1):
        d = np.stack([(X != m).sum(axis=1) for m in modes], axis=1)
        assign = np.argmin(d, axis=1)               # lowest cluster wins ties
        modes = np.array([(2 * X[assign == k].sum(axis=0) > (assign == k).sum()).astype(int) for k in (0, 1)])
        if prev is not None and (assign == prev).all():
            break
        prev = assign
    return list(assign), [sum(int(b) << i for i, b in enumerate(m)) for m in modes]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255), min_size=1, max_size=12), min_size=1, max_size=3))
def test_kmodes_matches_numpy_model(spark, groups):
    import datetime as dt
    from cartlens.operators import kmodes as KM
    t0 = dt.datetime(2024, 1, 1)
    data = [(g, i, t0 - dt.timedelta(minutes=i), v) for g, rows in enumerate(groups) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, "g long, pos long, date timestamp, w0 long")
    res = KM.fit(df, "g", [F.col("pos")], ["w0"], 8, max_iter=50, payload=["pos"])
    got_a = {(r["g"], r["pos"]): r["cluster"] for r in res.assignments.collect()}
    got_m = {(r["g"], r["cluster"]): r["w0"] for r in res.modes.collect()}
    for g, rows in enumerate(groups):
        assign, modes = _kmodes_model(rows, 8)
        assert [got_a[(g, i)] for i in range(len(rows))] == assign
        assert [got_m[(g, c)] for c in (0, 1)] == modes
