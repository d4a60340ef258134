import pytest

from cartlens.llm import exactdedup
from tests.llm.brute import A_TO_Z, SCHEMA, clash, corpus


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(A_TO_Z), []).append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_groups_equal_brute_force(spark, parts):
    """Forty partitions make every group of copies hot, so it is salted and merged."""
    rows = corpus()
    got = exactdedup.exact_groups(clash(spark.createDataFrame(rows, SCHEMA)), partitions=parts).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == expected(rows)
    assert len(got) == len(rows)


def test_hot_group_is_salted_and_whole(spark):
    rows = [(i, "Hot Text" if i % 3 else f"own {i}", None, None, None) for i in range(600)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_groups(
        spark.createDataFrame(rows, SCHEMA).repartition(5), partitions=8).collect()}
    assert got == expected(rows)


def test_only_a_to_z_are_folded(spark):
    rows = [(1, "É", None, None, None), (2, "é", None, None, None), (3, "ABC é", None, None, None), (4, "abc é", None, None, None),
            (5, "İ", None, None, None), (6, "i̇", None, None, None), (7, "ΑΣ", None, None, None), (8, "ας", None, None, None)]
    got = {r.doc_id: r.keep_id for r in exactdedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_nulls_repeats_and_min(spark):
    rows = [(None, "a"), (5, "A"), (5, "a"), (2, "a"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exactdedup.exact_groups(df).collect()
    assert sorted((r.keep_id or -1, r.group_size) for r in got) == [(-1, 2)] * 2 + [(5, 4)] * 4
    assert sum(r.kept for r in got) == 2
    low = exactdedup.exact_groups(df, keep="min").where("kept and group_size = 4").collect()
    assert [(r.doc_id, r.keep_id) for r in low] == [(2, 2)]


def test_rows_that_stay_keep_all_columns(spark):
    df = clash(spark.createDataFrame(corpus(), SCHEMA))
    kept = exactdedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    want = sorted(i for i, (_, _, k) in expected(corpus()).items() if k)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exactdedup.exact_groups(empty).collect() == []
    assert exactdedup.drop_exact_copies(empty).collect() == []


def test_main_path_is_native(spark):
    plan = exactdedup.exact_groups(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
