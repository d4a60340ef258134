"""Mergeable session sums, sessions stored by session, inferred CSV types, tables that know their input."""

import contextlib
import io
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.operators import session_store as SS
from cartlens.operators import sessions as S
from cartlens.operators.features import encode_features, wide_to_words
from cartlens.sources import files, fixtures, inference, stored

SF = "/root/testdata/sf0.001"
COLS = ["1", "2", "3", "4"]


def tmp():
    return tempfile.mkdtemp(prefix="cartlens-test-", dir="/tmp")


def sessions(spark, n=400):
    rows = [(i % 17, (i * i) % 23 if i % 11 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "session_id long, item_id long, t long").select(
        "session_id", "item_id", F.timestamp_seconds(F.col("t")).alias("date"))


def encoded(spark):
    return spark.createDataFrame([(i, i % 2, i // 2 % 2, i // 4 % 2, 1) for i in range(20)], "item_id long, " + ", ".join(f"`{c}` long" for c in COLS))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------ sums

@pytest.mark.parametrize("lane_bits", [21, 31, 63])
@pytest.mark.parametrize("n, by", [(1, ["item_id"]), (2, ["session_id"]), (5, ["item_id", "date"])])
def test_any_split_into_loads_gives_the_full_result(spark, lane_bits, n, by):
    s, e = sessions(spark), encoded(spark)
    layout = SS.SessionSums(COLS, lane_bits)
    assert len(layout.words) == -(-4 // (63 // lane_bits))
    parts = [layout.sums(p, e) for p in SS.loads(s, n, *by)]
    merged = layout.merged(*parts)
    assert rows(merged) == rows(layout.sums(s, e))
    assert rows(layout.means(merged, lo=3, hi=50)) == rows(S.session_feature_means(s, e, COLS, 3, 50))
    assert rows(layout.preferences(merged, hi=50)) == rows(S.session_preferences(s, e, COLS, hi=50))
    assert rows(layout.lengths(merged)) == rows(S.session_lengths(s))


def test_loads_are_saved_in_versions(spark):
    s, e, folder = sessions(spark), encoded(spark), f"{tmp()}/sums"
    layout = SS.SessionSums(COLS)
    assert layout.saved(spark, folder) is None
    for part in SS.loads(s, 4, "date"):
        last = layout.load(part, e, folder)
    assert rows(last) == rows(layout.sums(s, e)) == rows(layout.saved(spark, folder))
    assert sorted(os.listdir(folder)) == ["v-2", "v-3"]
    os.mkdir(f"{folder}/v-9")                                    # a load that failed leaves a version without its mark
    assert rows(layout.saved(spark, folder)) == rows(last)
    again = layout.load(s.limit(0), e, folder)
    assert rows(again) == rows(last)


def test_a_full_lane_is_an_error(spark):
    s = spark.createDataFrame([(1, 1, None)] * 9, "session_id long, item_id long, date timestamp")
    one = spark.createDataFrame([(1, 1, 1, 1, 1)], "item_id long, " + ", ".join(f"`{c}` long" for c in COLS))
    small = SS.SessionSums(COLS, lane_bits=3)
    with pytest.raises(Exception, match="lanes of 3 bits"):
        small.sums(s, one).collect()
    part = small.sums(s.limit(5), one)
    with pytest.raises(Exception, match="lanes of 3 bits"):
        small.merged(part, part).collect()
    assert rows(small.means(small.merged(part), hi=None)) == [(1, 1.0, 1.0, 1.0, 1.0)]


# ------------------------------------------------------------ stored by session

def plan_of(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def events(spark):
    return fixtures.event_sessions(spark, SF).select("session_id", "item_id", "date")


@pytest.mark.parametrize("rows_per_task", [1 << 20, 25])
def test_stored_sessions_give_the_same_results(spark, events, rows_per_task):
    kept = stored.store_by_session(events, f"t_same_{rows_per_task}", 8, f"{tmp()}/t", rows_per_task)
    try:
        assert (kept.hot is None) == (rows_per_task == 1 << 20)
        assert rows(kept.rows()) == rows(events)
        assert rows(kept.lengths()) == rows(S.session_lengths(events))
        assert rows(kept.in_band(5, 20)) == rows(S.sessions_in_band(events, 5, 20).select(*events.columns))
        assert rows(kept.time_spent(rows_per_task)) == rows(S.time_spent(events))
        assert rows(kept.recent_items(3)) == rows(S.recent_items(events, 3))
    finally:
        kept.drop()


def test_four_queries_without_an_exchange_on_session(spark, events):
    kept = stored.store_by_session(events, "t_plans", 8, f"{tmp()}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (kept.lengths(), kept.in_band(5, 20), kept.time_spent(), kept.recent_items(3)):
            plan = plan_of(df)
            assert "Exchange" not in plan and "Bucketed: true" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        kept.drop()


def test_rows_without_a_session_are_kept_apart(spark):
    s = spark.createDataFrame([(None, i, None) for i in range(50)] + [(1, 1, None)], "session_id long, item_id long, date timestamp")
    kept = stored.store_by_session(s, "t_null", 4, f"{tmp()}/t")
    try:
        assert kept.hot.count() == 50 and kept.bucketed.count() == 1
        assert rows(kept.lengths()) == rows(S.session_lengths(s))
    finally:
        kept.drop()


# ------------------------------------------------------------ inferred types

def csv(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_types_agree_with_full_inference(spark):
    d = f"{tmp()}/c"
    csv(d, "a.csv", "i,l,f,b,d,t,s,n\n1,1,1,true,2024-01-02,2024-01-02 03:04:05,x,\n-2,30000000000,2.5,False,2024-01-03,2024-01-02 03:04:06.5,2,\n")
    got = inference.read_inferred(spark, d)
    full = files.read_csv(spark, d, infer=True).schema
    want = {"i": "int", "l": "bigint", "f": "double", "b": "boolean", "d": "date", "t": "timestamp_ntz", "s": "string", "n": "string"}
    assert {f.name: f.dataType.simpleString() for f in got.rows.schema} == want
    assert {f.name: f.dataType.simpleString().replace("timestamp", "timestamp_ntz") for f in full} == want
    assert got.rows.count() == 2 and got.misfits.count() == 0


def test_every_file_is_seen_and_later_misfits_are_listed(spark):
    d = f"{tmp()}/c"
    csv(d, "a.csv", "k,v\n" + "".join(f"{i},{i}\n" for i in range(50)) + "51,late\n,53\n")
    csv(d, "b.csv", "k,v\n1.5,7\n")
    schema = inference.infer_schema(spark, d, rows_per_file=10)
    assert [f.dataType.simpleString() for f in schema] == ["double", "int"]
    got = inference.read_inferred(spark, d, rows_per_file=10)
    assert got.rows.count() == 52 and got.rows.where("k is null").collect()[0].v == 53
    bad = got.misfits.collect()
    assert [(r.k, r.v) for r in bad] == [("51", "late")] and bad[0].file.endswith("a.csv")
    # the whole file sampled: no misfit, wider type
    assert inference.infer_schema(spark, d, rows_per_file=100)["v"].dataType == T.StringType()


def test_lattice(spark):
    assert inference.merged("int", "double") == "double" and inference.merged("bigint", "int") == "bigint"
    assert inference.merged("date", "timestamp_ntz") == "timestamp_ntz" and inference.merged("int", "date") == "string"
    assert inference.merged(None, "boolean") == "boolean" and inference.merged("boolean", "int") == "string"
    names = [k for k, _ in inference.KINDS] + ["string"]
    for a in names:
        for b in names:
            assert inference.merged(a, b) == inference.merged(b, a)
            for c in names:
                assert inference.merged(inference.merged(a, b), c) == inference.merged(a, inference.merged(b, c))


def test_without_header_and_empty(spark):
    d = f"{tmp()}/c"
    csv(d, "a.csv", "1,x\n2,y\n")
    got = inference.read_inferred(spark, d, header=False)
    assert rows(got.rows) == [(1, "x"), (2, "y")]
    e = f"{tmp()}/e"
    csv(e, "a.csv", "a,b\n")
    got = inference.read_inferred(spark, e)
    assert got.rows.columns == ["a", "b"] and got.rows.count() == 0 and got.misfits.count() == 0


# ------------------------------------------------------------ reuse that knows its input

def test_reuse_follows_the_input(spark):
    d = tmp()
    source, saved = f"{d}/source", f"{d}/saved"
    spark.range(10).write.parquet(source)
    lengths = lambda: spark.read.parquet(source).groupBy((F.col("id") % 3).alias("g")).count()
    assert files.reuse_if_unchanged(spark, saved, lengths).agg(F.sum("count")).first()[0] == 10
    stamp = {f: os.stat(f"{saved}/{f}").st_mtime_ns for f in os.listdir(saved) if f.startswith("part")}
    files.reuse_if_unchanged(spark, saved, lengths)
    assert stamp == {f: os.stat(f"{saved}/{f}").st_mtime_ns for f in os.listdir(saved) if f.startswith("part")}  # not written again
    spark.range(10, 15).write.mode("append").parquet(source)                                                # the source grows
    assert files.reuse_if_unchanged(spark, saved, lengths).agg(F.sum("count")).first()[0] == 15
    other = lambda: spark.read.parquet(source).groupBy((F.col("id") % 5).alias("g")).count()
    assert files.reuse_if_unchanged(spark, saved, other).count() == 5                                       # another query
    time.sleep(1.1)
    spark.range(20, 35).write.mode("overwrite").parquet(source)                                             # files replaced
    assert files.reuse_if_unchanged(spark, saved, other).agg(F.sum("count")).first()[0] == 15
    os.remove(f"{saved}/_SUCCESS")                                                                        # the rest of a failed job
    assert files.reuse_if_unchanged(spark, saved, other).agg(F.sum("count")).first()[0] == 15


def test_manifest_does_not_depend_on_column_numbers(spark):
    d = f"{tmp()}/source"
    spark.range(5).write.parquet(d)
    a, b = (files.manifest_of(spark.read.parquet(d).select((F.col("id") + 1).alias("x"))) for _ in range(2))
    assert a == b and a["files"] >= 1
    assert files.manifest_of(spark.read.parquet(d).select((F.col("id") + 2).alias("x")))["plan"] != a["plan"]
    made = spark.createDataFrame([(1,)], "x int")                     # rows that no file or plan tells
    assert files.manifest_of(made)["plan"] != files.manifest_of(made)["plan"]


def test_session_counts_job_sees_new_rows(spark):
    from cartlens.plans import jobs
    d = tmp()
    spark.createDataFrame([(1, 1), (1, 2)], "session_id int, item_id int").selectExpr("*", "'2024-01-01' date").write.option("header", True).csv(f"{d}/s")
    assert jobs.session_counts(spark, f"{d}/s", f"{d}/c").collect()[0].nb_items == 2
    spark.createDataFrame([(1, 3)], "session_id int, item_id int").selectExpr("*", "'2024-01-01' date").write.mode("append").option("header", True).csv(f"{d}/s")
    assert jobs.session_counts(spark, f"{d}/s", f"{d}/c").collect()[0].nb_items == 3


# ------------------------------------------------------------ cells and strata

def test_cells_that_are_not_binary(spark):
    wide = spark.createDataFrame([(1, 1, 0), (2, None, 2)], "item_id long, a long, b long")
    assert rows(wide_to_words(wide, ["a", "b"], ["item_id"])) == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="neither 0 nor 1"):
        wide_to_words(wide, ["a", "b"], ["item_id"], binary=True).collect()
    assert rows(wide_to_words(wide.where("item_id = 1"), ["a", "b"], ["item_id"], binary=True)) == [(1, 1)]


def test_strata_in_one_pass_equal_one_by_one(spark):
    from cartlens.operators.profiles import profile_comparison
    s, bought = fixtures.event_sessions(spark, SF), fixtures.event_purchases(spark, SF)
    feats, cats = fixtures.embedding_features(spark, SF), fixtures.EMBEDDING_CATEGORIES
    lengths = sorted({r.nb_items for r in S.session_lengths(s).collect()})[:4]
    got = profile_comparison(s, bought, feats, cats, lengths)
    want = []
    for n in lengths:
        want += [(*r, n) for r in profile_comparison(s, bought, feats, cats, n).collect()]
    assert rows(got) == sorted(want, key=repr) and len(want) > 0
    assert encode_features(feats, cats).count() > 0
