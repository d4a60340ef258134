"""Plan guards: no query is a cross product or a nested-loop join, and the
session filter of the event tables reaches the Parquet scan."""

import contextlib
import io

import pytest

from cartlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


KNN_QUERIES = {"knn_items", "knn_items_wide", "knn_mrr", "list_reciprocal", "distance_multiplicity", "distance_listing",
               "next_distance", "knn_items_indexed", "knn_items_wide_indexed"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product_and_no_row_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan            # no row-at-a-time Python UDF
    if "CoGroupsInPandas" in plan or "ArrowEvalPython" in plan:
        assert name in KNN_QUERIES                  # the one Arrow-batched kernel
    if "SortAggregate" in plan:                     # only the seed arg-min, over rows sorted already
        assert name in {"kmodes_seeds", "kmodes_assign", "kmodes_density_seeds"}, name


def test_event_filter_and_columns_pushed_to_scan(spark):
    plan = _plan(QUERIES["session_preferences"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), In(event_type, [click,view])]" in plan or \
           "In(event_type, [click,view])" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan


@pytest.fixture
def no_broadcast(spark):
    """Adaptive execution on, joins by shuffle: the plan a large input gets."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _above_rows(plan: str) -> list[list[str]]:
    """For every scan of the laid-out rows: the operators from it up to the next join or aggregate."""
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Scan ExistingRDD" in line and "_ord" in line:
            depth, chain = len(line) - len(line.lstrip(" :+-")), []
            for up in reversed(lines[:i]):
                d = len(up) - len(up.lstrip(" :+-"))
                if d < depth:
                    depth = d
                    chain.append(up.strip(" :+-").split(" ")[0].split("(")[0])
                    if "Join" in chain[-1] or "Aggregate" in chain[-1]:
                        break
            out.append(chain)
    return out


def _simple(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("rows_per_task", [1 << 20, 5])
def test_kmodes_rows_stay_put(spark, no_broadcast, rows_per_task):
    """Seeds, rounds and the final assignment read the laid-out rows without shuffling or sorting them."""
    from pyspark.sql import functions as F

    from cartlens.operators import kmodes as KM
    from cartlens.operators import preference as PF
    from cartlens.plans import queries as Q
    rows = Q._long_rows(spark, SF)
    words, n = Q.EMB_WORDS, len(Q.EMB_CATS)
    base = KM.laid_out(rows, "session_id", PF.newest_first(rows), words, ["item_id", "date"], rows_per_task)
    salted = "_salt" in base.columns
    assert salted == (rows_per_task == 5)
    seeds = KM.seeds(base, "session_id", [F.col("_ord")], words, n)
    rounds = KM._Rounds("session_id", words, n, 2, F.lit(50), salted, rows_per_task)
    start = rounds.start(KM._salts(base, "session_id", KM.modes_array(
        seeds.withColumnRenamed("seed", "cluster"), "session_id", words))).checkpoint()
    final = KM.fit(rows, "session_id", PF.newest_first(rows), words, n, rows_per_task=rows_per_task, in_row=0).assignments
    two = rounds.one(base, rounds.one(base, start))
    for df, scans in ((seeds, 2), (two, 2), (final, 1)):
        chains = _above_rows(_simple(df))
        assert len(chains) >= scans
        for chain in chains:
            assert "Exchange" not in chain and "Sort" not in chain, chain
    if not salted:  # rounds planned together: the first state is brought in, nothing else moves
        assert sum("Exchange" in line for line in _simple(two).splitlines()) == 1


def test_seed_search_has_no_exchange_on_a_distance(spark, no_broadcast):
    from cartlens.plans import queries as Q
    plan = _simple(Q.q_kmodes_seeds(spark, SF))
    assert "_d#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_knn_work_is_split(spark):
    """More than one block at sf0.1's size, none for a handful of rows."""
    from pyspark.sql import functions as F

    from cartlens.operators import distance as D
    q = spark.range(3000).select(F.col("id").alias("session_id"), F.xxhash64("id").alias("w0"))
    c = spark.range(2000).select(F.col("id").alias("item_id"), F.xxhash64("id", F.lit(1)).alias("w0"))
    out = D._cogroup_blocks(D._materialise(q), c, "session_id", "item_id", ["w0"], 1 << 20, 1 << 16, None)
    blocks = out.applyInPandas(lambda key, a, b: a.assign(n=len(a))[["n"]].head(1), "n long").count()
    assert blocks == min(spark.sparkContext.defaultParallelism, 6)


def test_checkpoint_in_place_leaves_the_session_alone(spark):
    """The layout is known to later plans; the caller's setting is never changed."""
    from pyspark.sql import functions as F

    from cartlens.runtime import checkpoint_in_place
    seen, put = [], type(spark.conf).set
    type(spark.conf).set = lambda self, *a: seen.append(a) or put(self, *a)
    try:
        rows = spark.range(500).withColumn("g", F.col("id") % 20).repartition(8, "g").sortWithinPartitions("g")
        kept = checkpoint_in_place(rows)
    finally:
        type(spark.conf).set = put
    assert not seen and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert "Exchange" not in _simple(kept.groupBy("g").count()) and kept.count() == 500


def test_sessions_are_computed_once(spark):
    """Preferences read their sessions several times, but compute them (a join of large tables, it may be) once."""
    from datetime import datetime

    from cartlens.functions.bits import word_names
    from cartlens.operators import preference as PF
    from cartlens.plans.inputs import session_words
    rows = [(s, i % 7, datetime(2026, 1, 1 + i)) for s, n in ((1, 4), (2, 25), (3, 3), (None, 2)) for i in range(n)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    plain = spark.createDataFrame(rows, "session_id long, item_id long, date timestamp")
    sessions = plain.mapInArrow(counted, plain.schema)
    features = spark.createDataFrame([(i, 1 + c, 1) for i in range(7) for c in range(5) if (i + c) % 3 == 0],
                                     "item_id long, feature_category_id int, feature_value_id int")
    got = session_words(sessions, features, range(1, 6))
    # the row without a session id is a short session of its own, and none to cluster
    assert sorted((r.session_id for r in got.collect()), key=str) == [1, 2, 3, None]
    assert seen.value == len(rows)
    vectors = spark.createDataFrame([(i, 1 << i % 5) for i in range(7)], "item_id long, w0 long")
    PF.fit_sessions(PF.clustering_rows(plain, vectors, lo=4).mapInArrow(counted, "session_id long, item_id long, date timestamp, w0 long"),
                    word_names(5), 5).assignments.collect()
    assert seen.value == len(rows) + 29
