"""Hand-made cases with known answers (FIXTURES.md, 'Hand-made cases')."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartlens.functions.scalar import band_fraction
from cartlens.operators import distance as D
from cartlens.operators import kmodes as KM
from cartlens.operators import profiles as PR
from cartlens.operators import recommend as RC
from cartlens.operators import sessions as S
from cartlens.operators.features import encode_features, pack_features

T0 = dt.datetime(2024, 1, 1)


def _ts(i):
    return T0 + dt.timedelta(minutes=i)


def _sessions(spark, rows):
    return spark.createDataFrame(rows, "session_id long, item_id long, date timestamp")


def test_threshold_is_inclusive(spark):
    # 5 joined rows, 2 with the category: mean 0.4 -> 1
    sess = _sessions(spark, [(1, i, _ts(i)) for i in range(5)])
    feats = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1)],
                                  "item_id long, feature_category_id int, feature_value_id int")
    enc = encode_features(feats, [1, 2])
    out = S.session_preferences(sess, enc, ["1", "2"]).collect()
    assert [(r["1"], r["2"]) for r in out] == [(1, 1)]
    means = S.session_feature_means(sess, enc, ["1", "2"]).collect()[0]
    assert means["1"] == pytest.approx(0.4)


def test_repeated_view_weighs_more(spark):
    sess = _sessions(spark, [(1, 10, _ts(0)), (1, 10, _ts(1)), (1, 11, _ts(2))])
    feats = spark.createDataFrame([(10, 1, 1), (11, 2, 1)], "item_id long, feature_category_id int, feature_value_id int")
    means = S.session_feature_means(sess, encode_features(feats, [1, 2]), ["1", "2"]).collect()[0]
    assert means["1"] == pytest.approx(2 / 3)


def test_featureless_item_denominators(spark):
    # A6 divides by joined rows (1), A7 by the list length (2)
    sess = _sessions(spark, [(1, 10, _ts(0)), (1, 99, _ts(1))])
    feats = spark.createDataFrame([(10, 1, 1)], "item_id long, feature_category_id int, feature_value_id int")
    means = S.session_feature_means(sess, encode_features(feats, [1]), ["1"]).collect()[0]
    assert means["1"] == pytest.approx(1.0)
    prof = PR.feature_profile(sess, feats, [1]).collect()[0]
    assert prof["share"] == pytest.approx(0.5)


def test_length_band_fractions(spark):
    df = spark.createDataFrame([(n,) for n in (19, 20, 30, 31, 50, 51, 100, 101)], "n int")
    got = [r[0] for r in df.select(band_fraction("n")).collect()]
    assert got == [None, 0.7, 0.7, 0.8, 0.8, 1.0, 1.0, None]


def _rows_kmodes(spark, vectors):
    data = [(1, i, _ts(100 - i), v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "session_id long, item_id long, date timestamp, w0 long")


def test_mode_tie_goes_to_zero(spark):
    rows = _rows_kmodes(spark, [0, 1])
    m = KM.group_mode(rows, "session_id", ["w0"], 1).collect()[0]
    assert m["w0"] == 0


def test_empty_cluster_gets_zero_vector_and_ties_go_to_cluster_0(spark):
    # identical rows: seeds are both that row, every row ties -> cluster 0,
    # cluster 1 is empty -> zero vector
    rows = _rows_kmodes(spark, [0b101, 0b101, 0b101])
    order = [-F.unix_micros(F.col("date")), F.col("item_id")]
    res = KM.fit(rows, "session_id", order, ["w0"], 3, max_iter=10, payload=["item_id"])
    assert {r["cluster"] for r in res.assignments.collect()} == {0}
    modes = {r["cluster"]: r["w0"] for r in res.modes.collect()}
    assert modes == {0: 0b101, 1: 0}


def test_kmodes_fixed_point(spark):
    rows = _rows_kmodes(spark, [0b1111, 0b1110, 0b0001, 0b0000, 0b1100, 0b0011])
    order = [-F.unix_micros(F.col("date")), F.col("item_id")]
    res = KM.fit(rows, "session_id", order, ["w0"], 4, payload=["item_id"])
    assigned = res.assignments.select("session_id", "item_id", "_ord", "w0", "cluster")
    again = KM.assign(assigned.drop("cluster"), res.modes, "session_id", ["w0"])
    a = {r["item_id"]: r["cluster"] for r in assigned.collect()}
    b = {r["item_id"]: r["cluster"] for r in again.collect()}
    assert a == b


def test_knn_k_larger_than_candidates_and_ties(spark):
    q = spark.createDataFrame([(1, 0b0000)], "session_id long, w0 long")
    c = spark.createDataFrame([(7, 0b0011), (5, 0b0101), (9, 0b0001)], "item_id long, w0 long")
    out = D.knn(q, c, 5, ["w0"]).orderBy("rank").collect()
    assert [(r["rank"], r["item_id"], r["distance"]) for r in out] == [(1, 9, 1), (2, 5, 2), (3, 7, 2)]


def test_knn_exclude_self(spark):
    c = spark.createDataFrame([(1, 0b1), (2, 0b11), (3, 0b111)], "item_id long, w0 long")
    q = c.withColumnRenamed("item_id", "session_id")
    out = D.knn(q, c, 1, ["w0"], exclude_self=True).orderBy("session_id").collect()
    assert [(r["session_id"], r["item_id"]) for r in out] == [(1, 2), (2, 1), (3, 2)]


def test_knn_many_blocks_equals_one_block(spark):
    vals = [(i, (i * 2654435761) % (1 << 20)) for i in range(300)]
    c = spark.createDataFrame(vals, "item_id long, w0 long")
    q = spark.createDataFrame(vals[:40], "session_id long, w0 long")
    one = {tuple(r) for r in D.knn(q, c, 7, ["w0"]).collect()}
    many = {tuple(r) for r in D.knn(q, c, 7, ["w0"], query_block_rows=7, cand_block_rows=23).collect()}
    assert one == many and len(one) == 40 * 7


def test_purchased_item_not_ranked_counts_zero(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20)], "session_id long, rank int, item_id long")
    targets = spark.createDataFrame([(1, 11), (2, 99)], "session_id long, item_id long")
    row = RC.mrr(ranked, targets).collect()[0]
    assert row["n_sessions"] == 2 and row["mrr"] == pytest.approx((1 / 2 + 0) / 2)


def test_vote_needs_strict_majority(spark):
    from cartlens.functions.scalar import majority_vote
    df = spark.createDataFrame([(5, 10), (6, 10)], "s int, n int")
    assert [r[0] for r in df.select(majority_vote("s", "n")).collect()] == [0, 1]


def test_pack_features_sets_bits(spark):
    feats = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, 70)], "item_id long, feature_category_id int")
    got = {r["item_id"]: (r["w0"], r["w1"]) for r in pack_features(feats, list(range(1, 74))).collect()}
    assert got == {1: (0b101, 0), 2: (0, 1 << 5)}


def test_time_spent_across_buckets_equals_plain_window(spark):
    # 3 sessions, one long; a tiny rows_per_task forces many time buckets
    rows = [(1, i % 7, _ts(i * 3 + (i % 4))) for i in range(200)] + \
           [(2, 5, _ts(1)), (2, 6, _ts(1)), (2, 1, _ts(9))] + [(3, 4, _ts(2))]
    sess = _sessions(spark, rows)
    from pyspark.sql import Window
    w = Window.partitionBy("session_id").orderBy("date", "item_id")
    want = {(r[0], r[1], r[2], r[3]) for r in sess.select(
        "session_id", "item_id", "date",
        (F.timestamp_diff("MICROSECOND", F.col("date"), F.lead("date").over(w)) / 1e6)).collect()}
    got = {(r[0], r[1], r[2], r[3]) for r in S.time_spent(sess, rows_per_task=7).collect()}
    assert got == want and len(got) == len(rows) - 0


def test_knn_shared_query_vectors_match_brute_force(spark):
    cands = [(i, (i * 40503) % 1024) for i in range(60)]
    queries = [(q, [0, 5, 1023][q % 3] if q < 90 else q * 7) for q in range(100)]   # hot vectors
    c = spark.createDataFrame(cands, "item_id long, w0 long")
    q = spark.createDataFrame(queries, "session_id long, w0 long")
    got = {tuple(r) for r in D.knn(q, c, 4, ["w0"], cand_block_rows=16).collect()}
    want = set()
    for qid, v in queries:
        ranked = sorted((bin(v ^ w).count("1"), cid) for cid, w in cands)[:4]
        want |= {(qid, rank + 1, cid, d) for rank, (d, cid) in enumerate(ranked)}
    assert got == want
    hist = {tuple(r) for r in D.distance_multiplicity(q, c, ["w0"], cand_block_rows=16).collect()}
    from collections import Counter
    want_h = {(qid, d, n) for qid, v in queries
              for d, n in Counter(bin(v ^ w).count("1") for _, w in cands).items()}
    assert hist == want_h


def test_kmodes_salting_does_not_change_results(spark):
    from cartlens.plans import queries as Q
    from cartlens.operators import preference as PF
    rows = Q._long_rows(spark, "/root/testdata/sf0.001")
    order = PF.newest_first(rows)

    def run(rpt):
        res = KM.fit(rows, "session_id", order, Q.EMB_WORDS, 64, max_iter="rows",
                     payload=["item_id", "date"], rows_per_task=rpt)
        a = {(r["session_id"], r["item_id"], r["date"], r["cluster"]) for r in res.assignments.collect()}
        m = {(r["session_id"], r["cluster"], r["w0"]) for r in res.modes.collect()}
        return a, m
    assert run(1 << 20) == run(3)


def test_time_spent_with_null_dates_keeps_every_row(spark):
    rows = [(1, 1, None), (1, 2, None), (1, 3, _ts(1)), (1, 4, _ts(5)), (2, 1, None)]
    sess = _sessions(spark, rows)
    out = S.time_spent(sess, rows_per_task=1).collect()
    assert len(out) == len(rows)
    got = {(r["session_id"], r["item_id"]): r["time_spent"] for r in out}
    assert got[(1, 3)] == 240.0 and got[(1, 4)] is None


def test_clustering_band_excludes_length_10(spark):
    from cartlens.operators import preference as PF
    sess = _sessions(spark, [(1, i, _ts(i)) for i in range(10)] + [(2, i, _ts(i)) for i in range(11)])
    packed = spark.createDataFrame([(i, i) for i in range(11)], "item_id long, w0 long")
    got = {r["session_id"] for r in PF.clustering_rows(sess, packed).collect()}
    assert got == {2}


def test_empty_cluster_gets_the_zero_vector(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([0b011, 0b001, 0b110])], "g long, pos long, w0 long")
    far = spark.createDataFrame([(1, 0, 0b011), (1, 1, 0b11111000)], "g long, cluster int, w0 long")
    res = KM.fit(rows, "g", [F.col("pos")], ["w0"], 8, max_iter=1, payload=["pos"], initial=far)
    assert {(r["cluster"], r["w0"]) for r in res.modes.collect()} == {(0, 0b011), (1, 0)}


def test_initial_modes_are_checked(spark):
    rows = spark.createDataFrame([(1, 0, 1)], "g long, pos long, w0 long")
    twice = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "g long, cluster int, w0 long")
    with pytest.raises(Exception, match="initial modes"):
        KM.fit(rows, "g", [F.col("pos")], ["w0"], 8, payload=["pos"], initial=twice)


def test_one_null_rule_for_any_number_of_payload_columns(spark):
    from cartlens.operators.features import clean_features
    rows = [(1, 5, None, 0), (1, 5, 5, 0), (2, 5, None, 0)]
    both = spark.createDataFrame(rows, "item_id long, feature_category_id int, v int, w int")
    assert sorted((r.item_id, r.v) for r in clean_features(both).collect()) == [(1, 5), (2, None)]
    assert sorted((r.item_id, r.v) for r in clean_features(both.drop("w")).collect()) == [(1, 5), (2, None)]


def test_views_without_a_date_come_last_in_both_orders(spark):
    from cartlens.operators import preference as PF
    sess = _sessions(spark, [(1, 1, None), (1, 2, _ts(1)), (1, 3, _ts(2))])
    by_key = [r.item_id for r in sess.orderBy(*PF.newest_first(sess)).collect()]
    by_recency = [r.item_id for r in S.recent_items(sess, 10).orderBy("recency").collect()]
    assert by_key == by_recency == [3, 2, 1]


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


CLOCK = ["2021-03-14 01:10:00", "2021-03-14 01:30:00", "2021-03-14 02:30:00", "2021-03-14 03:10:00", "2021-03-14 03:30:00"]


@pytest.mark.parametrize("rows_per_task", [1 << 20, 2, 1])
def test_zone_free_gaps_where_the_zone_jumps(spark, new_york, rows_per_task):
    """Dates without zone are subtracted on their own clock, with and without cutting."""
    sess = spark.createDataFrame([(1, i, t) for i, t in enumerate(CLOCK)], "session_id long, item_id long, date string") \
        .withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = {r.item_id: r.time_spent for r in S.time_spent(sess, rows_per_task=rows_per_task).collect()}
    assert got == {0: 1200.0, 1: 3600.0, 2: 2400.0, 3: 1200.0, 4: None}


def test_zone_free_order_where_the_zone_jumps(spark, new_york):
    from cartlens.operators import preference as PF
    sess = spark.createDataFrame([(1, i, t) for i, t in enumerate(CLOCK)], "session_id long, item_id long, date string") \
        .withColumn("date", F.col("date").cast("timestamp_ntz"))
    assert [r.item_id for r in sess.orderBy(*PF.newest_first(sess)).collect()] == [4, 3, 2, 1, 0]


@pytest.mark.parametrize("times", [[5] * 400, [5] * 399 + [10**6], list(range(400))])
def test_hot_sessions_are_cut_by_rows(spark, times):
    """Equal dates, one outlier, or even gaps: pieces stay near rows_per_task and gaps are those of the plain window."""
    sess = _sessions(spark, [(1, i, _ts(t)) for i, t in enumerate(times)] + [(2, 0, _ts(1)), (None, 1, _ts(2)), (None, 2, _ts(3))])
    got = sorted((r.session_id or -1, r.item_id, r.time_spent) for r in S.time_spent(sess, rows_per_task=50).collect() if r.time_spent is not None)
    plain = sorted((r.session_id or -1, r.item_id, r.time_spent) for r in S.time_spent(sess).collect() if r.time_spent is not None)
    assert got == plain and len(got) == 400
    hot = sess.where("session_id = 1").repartitionByRange(8, "session_id", "date", "item_id")
    assert max(r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()) <= 150


def test_clean_features_keeps_smallest_payload(spark):
    from cartlens.operators.features import clean_features
    one = spark.createDataFrame([(1, 5, 3), (1, 5, 2), (2, 5, 9)], "item_id long, feature_category_id int, v int")
    assert sorted(map(tuple, clean_features(one).collect())) == [(1, 5, 2), (2, 5, 9)]
    two = spark.createDataFrame([(1, 5, 2, "z"), (1, 5, 2, "a"), (1, 5, 3, "0")],
                                "item_id long, feature_category_id int, v int, w string")
    assert [tuple(r) for r in clean_features(two).collect()] == [(1, 5, 2, "a")]


def test_kmodes_three_clusters_from_supplied_modes(spark):
    vals = [0b11110000] * 4 + [0b00001111] * 3 + [0b10101010] * 2 + [0b11100000]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "g long, pos long, w0 long")
    init = spark.createDataFrame([(1, 0, 0b11110000), (1, 1, 0b00001111), (1, 2, 0b10101010)],
                                 "g long, cluster int, w0 long")
    res = KM.fit(rows, "g", [F.col("pos")], ["w0"], 8, k=3, payload=["pos"], initial=init)
    got = {r["pos"]: r["cluster"] for r in res.assignments.collect()}
    assert [got[i] for i in range(len(vals))] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 0]
    with pytest.raises(ValueError):
        KM.seeds(rows, "g", [F.col("pos")], ["w0"], 8, k=3)


@pytest.mark.parametrize("rows_per_task", [1 << 20, 5])
def test_cell_sums_equal_plain_sums(spark, rows_per_task):
    """Counts of several bits, two words, hot sessions spread or not, items without features, null keys and items."""
    import random
    from cartlens.operators.cells import cell_sums, cell_words, planes_of
    rng, cols = random.Random(3), [str(i) for i in range(70)]
    items = [(i, *[rng.choice([0, 0, 1, 2, 5]) for _ in cols]) for i in range(6)]
    views = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([0, 1, 2, 3, 4, 5, 9, None])) for _ in range(120)]
    enc = spark.createDataFrame(items, "item_id long, " + ", ".join(f"`{c}` long" for c in cols))
    sess = spark.createDataFrame(views, "session_id long, item_id long")
    planes = planes_of(enc, cols)
    assert planes == 3
    got = {r["session_id"]: r for r in cell_sums(sess, cell_words(enc, cols, planes), cols, "session_id", planes, rows_per_task).collect()}
    cells = {i: v for i, *v in items}
    for key in {k for k, _ in views}:
        own = [i for k, i in views if k == key]
        assert (got[key]["_n"], got[key]["_len"], got[key]["_joined"]) == (
            len(own), sum(i is not None for i in own), sum(i in cells for i in own))
        assert [got[key][c] for c in cols] == [sum(cells[i][j] for i in own if i in cells) for j in range(70)]
    assert len(got) == len({k for k, _ in views})


def test_profiles_are_compared_in_all_strata(spark, monkeypatch):
    """C15 has the strata 100, 20, 5 and 1."""
    from cartlens.plans import queries as Q
    lengths = (100, 20, 7, 5, 1)
    tables = {"event_sessions": spark.createDataFrame([(n, f"2020-01-01 00:{i % 60:02d}:00", i) for n in lengths for i in range(n)],
                                                      "session_id long, date string, item_id long"),
              "event_purchases": spark.createDataFrame([(n, 0) for n in lengths], "session_id long, item_id long"),
              "embedding_features": spark.createDataFrame([(0, Q.EMB_CATS[0], 1)], "item_id long, feature_category_id int, feature_value_id int")}
    for name, df in tables.items():
        monkeypatch.setattr(Q.X, name, lambda spark, sf_dir, df=df: df)
    got = Q.QUERIES["profile_comparison_strata"](spark, "").where(f"category = {Q.EMB_CATS[0]}").collect()
    assert sorted((r.session_id, r.length, r.consumed_share, r.purchased_share) for r in got) == [
        (n, n, 1 / n, 1.0) for n in (1, 5, 20, 100)]
