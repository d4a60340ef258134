"""Scans and sinks: CSV with and without header, typed or all strings,
Parquet, schema from a category list, reuse of a saved table."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from cartlens.sources import (FEATURES_SCHEMA, feature_table_schema, read_csv, read_csv_no_header,
                              reuse_or_compute, write_table)


def _tmp():
    return tempfile.mkdtemp(prefix="cartlens-test-", dir="/tmp")


def test_csv_round_trip(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], FEATURES_SCHEMA)
    write_table(df.coalesce(1), f"{d}/f", fmt="csv")
    typed = read_csv(spark, f"{d}/f", schema=FEATURES_SCHEMA)
    assert typed.schema == FEATURES_SCHEMA and typed.count() == 2
    strings = read_csv(spark, f"{d}/f")
    assert all(isinstance(f.dataType, T.StringType) for f in strings.schema)
    inferred = read_csv(spark, f"{d}/f", infer=True)
    assert isinstance(inferred.schema["item_id"].dataType, T.IntegerType)
    raw = read_csv_no_header(spark, f"{d}/f")
    assert raw.columns[0] == "_c0" and raw.count() == 3


def test_parquet_and_reuse(spark):
    d = _tmp()
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "session_id")
    a = reuse_or_compute(spark, f"{d}/counts", compute)
    b = reuse_or_compute(spark, f"{d}/counts", compute)
    assert a.count() == b.count() == 5 and len(calls) == 1
    assert os.path.isdir(f"{d}/counts")


def test_feature_schema():
    s = feature_table_schema([1, 2, 10])
    assert s.names == ["session_id", "1", "2", "10"]
    assert not s["session_id"].nullable and s["10"].nullable


def test_file_jobs_match_the_in_memory_queries(spark):
    """Raw CSV tables -> clean -> encode -> preferences, all through files,
    equal the registered query on the same fixture."""
    import __spark_entry__ as E
    from cartlens.plans import jobs
    from cartlens.plans.inputs import EMB_CATS
    from cartlens.sources import fixtures as X
    sf = "/root/testdata/sf0.001"
    d = _tmp()
    write_table(X.embedding_features(spark, sf), f"{d}/item_features", fmt="csv")
    write_table(X.event_sessions(spark, sf), f"{d}/train_sessions", fmt="csv")
    jobs.clean_dataset(spark, f"{d}/item_features", f"{d}/clean")
    jobs.preprocess_features(spark, f"{d}/clean", f"{d}/encoded", EMB_CATS)
    jobs.preprocess_sessions(spark, f"{d}/train_sessions", f"{d}/encoded", f"{d}/prefs")
    got = read_csv(spark, f"{d}/prefs", infer=True)
    want = E.queries()["session_preferences"](spark, sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    jobs.sample(spark, f"{d}/train_sessions", f"{d}/encoded", f"{d}/sample")
    assert read_csv(spark, f"{d}/sample").count() >= 0


def test_file_analyses_match_the_queries(spark):
    import __spark_entry__ as E
    from cartlens.plans import jobs
    from cartlens.plans.inputs import EMB_CATS
    from cartlens.sources import fixtures as X
    sf = "/root/testdata/sf0.001"
    d = _tmp()
    write_table(X.event_sessions(spark, sf), f"{d}/sessions", fmt="csv")
    write_table(X.event_purchases(spark, sf).select("session_id", "item_id"), f"{d}/purchases", fmt="csv")
    write_table(X.embedding_features(spark, sf), f"{d}/features", fmt="csv")

    def same(a, b):
        return sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == \
               sorted(map(tuple, b.select(*sorted(b.columns)).collect()))
    assert same(jobs.popularity(spark, f"{d}/sessions", f"{d}/purchases", top=30), E.queries()["views_vs_purchases"](spark, sf))
    assert same(jobs.stratum_profiles(spark, f"{d}/sessions", f"{d}/purchases", f"{d}/features", EMB_CATS, 20),
                E.queries()["profile_comparison"](spark, sf))
    assert jobs.length_distribution(spark, f"{d}/sessions").count() == 15


def test_payload_and_large_ids_are_carried_through(spark):
    from cartlens.plans import jobs
    d = _tmp()
    raw = spark.createDataFrame([(3_000_000_000, 5, "red, dark"), (3_000_000_000, 5, "blue"), (2, 7, None)],
                                "item_id long, feature_category_id int, name string")
    write_table(raw, f"{d}/raw", fmt="csv")
    jobs.clean_dataset(spark, f"{d}/raw", f"{d}/clean")
    got = {(r.item_id, r.feature_category_id, r.name) for r in read_csv(spark, f"{d}/clean").collect()}
    assert got == {("3000000000", "5", "blue"), ("2", "7", None)}


def test_reuse_keeps_types_in_csv(spark):
    d = _tmp()
    compute = lambda: spark.createDataFrame([(1, 20)], "session_id long, nb_items long")
    for _ in range(2):
        assert reuse_or_compute(spark, f"{d}/c", compute, fmt="csv").schema.simpleString() == "struct<session_id:bigint,nb_items:bigint>"
    known = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("nb_items", T.LongType())])
    assert reuse_or_compute(spark, f"{d}/c", lambda: 1 / 0, fmt="csv", schema=known).collect()[0].nb_items == 20


def test_an_unfinished_folder_is_computed_again(spark):
    d = _tmp()
    compute = lambda: spark.range(100).repartition(4)
    reuse_or_compute(spark, f"{d}/t", compute)
    parts = [f for f in os.listdir(f"{d}/t") if f.startswith("part-")]
    for f in ["_SUCCESS", parts[0], parts[1]]:
        os.remove(f"{d}/t/{f}")
    assert reuse_or_compute(spark, f"{d}/t", compute).count() == 100


def test_cluster_and_recommendation_jobs(spark):
    """C4, C10, C11, C12 and S6 over files equal the operators on the same rows."""
    from cartlens.operators.features import wide_to_words
    from cartlens.plans import jobs, queries as Q
    from cartlens.plans.inputs import EMB_CATS, EMB_COLS, EMB_WORDS, emb_packed
    from cartlens.sources import fixtures as X
    sf, d = "/root/testdata/sf0.001", _tmp()
    write_table(X.embedding_features(spark, sf), f"{d}/features", fmt="csv")
    write_table(X.event_sessions(spark, sf), f"{d}/sessions", fmt="csv")
    write_table(X.last_purchases(spark, sf), f"{d}/purchases", fmt="csv")
    jobs.preprocess_features(spark, f"{d}/features", f"{d}/raw_encoded", EMB_CATS)
    jobs.clean_dataset(spark, f"{d}/features", f"{d}/clean")
    jobs.preprocess_features(spark, f"{d}/clean", f"{d}/encoded", EMB_CATS)

    def rows(df):
        return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    jobs.cluster_sessions(spark, f"{d}/sessions", f"{d}/encoded", f"{d}/long")
    assert rows(read_csv(spark, f"{d}/long")) == rows(Q.q_clustered_preferences(spark, sf))
    jobs.session_cluster_statistics(spark, f"{d}/sessions", f"{d}/purchases", f"{d}/encoded", f"{d}/stats")
    want = Q.q_cluster_statistics(spark, sf)
    got = {r.session_id: r for r in read_csv(spark, f"{d}/stats", schema=want.schema).collect()}
    for r in want.collect():
        assert tuple(got.pop(r.session_id)) == pytest.approx(tuple(r), rel=1e-5)
    assert not got
    jobs.recommend(spark, f"{d}/long", f"{d}/encoded", f"{d}/recommended", 10)
    words = wide_to_words(Q.q_clustered_preferences(spark, sf), EMB_COLS, ["session_id"])
    ranked = Q.D.knn(words, emb_packed(spark, sf), 10, EMB_WORDS)
    assert rows(read_csv(spark, f"{d}/recommended")) == rows(ranked)
    assert rows(jobs.evaluate(spark, f"{d}/recommended", f"{d}/purchases")) == rows(Q.RC.mrr(ranked, X.last_purchases(spark, sf)))
    first = rows(jobs.session_counts(spark, f"{d}/sessions", f"{d}/counts"))
    assert first == rows(jobs.session_counts(spark, f"{d}/nowhere", f"{d}/counts"))


def test_inference_sorts_only_the_first_rows_of_a_file(spark, tmp_path):
    """Rows past the sample are left out before the sort, whatever the size of the file."""
    from cartlens.sources import inference
    for name, cells in (("a.csv", range(4000)), ("b.csv", ["x", *range(50)]), ("c.csv", [1.5])):
        (tmp_path / name).write_text("".join(f"{c}\n" for c in ("cell", *cells)))
    text = inference.read_csv(spark, str(tmp_path))
    near = [(r["_file"].rsplit("/", 1)[1], r["cell"]) for r in inference.heads(text, 5).orderBy("_row").collect()]
    assert sorted(near) == sorted([*[("a.csv", str(i)) for i in range(5)], *[("b.csv", str(c)) for c in ("x", *range(4))], ("c.csv", "1.5")])
    assert inference.infer_schema(spark, str(tmp_path), 5).simpleString() == "struct<cell:string>"
    assert inference.infer_schema(spark, str(tmp_path / "a.csv"), 5).simpleString() == "struct<cell:int>"
