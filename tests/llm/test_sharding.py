import zlib

import pytest

from cartlens.llm import sharding
from tests.llm.brute import SCHEMA, clash, corpus


def expected(rows, n):
    sized = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, before, out, slots = sum(s for _, s, _ in sized), 0, {}, {}
    for i, size, crc in sized:
        shard = min((2 * before + size) * n // (2 * total), n - 1)
        out[i] = (size, crc, shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


@pytest.mark.parametrize("n, parts", [(16, 5), (3, 1), (1, 8)])
def test_equals_plain_prefix_sums(spark, n, parts):
    rows = corpus()
    got = sharding.byte_shards(clash(spark.createDataFrame(rows, SCHEMA)).repartition(6), n, partitions=parts).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in got} == expected(rows, n)


def test_shards_are_near_equal(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50), None, None, None) for i in range(2000)], SCHEMA)
    sizes = [r["sum(size)"] for r in sharding.byte_shards(df, 16).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 51


def test_nulls_and_repeats(spark):
    rows = [(None, "b"), (None, None), (3, "cc"), (3, "cc"), (3, "a")]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert [(r.doc_id, r.size) for r in sorted(got, key=lambda r: r.slot)] == [(None, 1), (None, 2), (3, 2), (3, 3), (3, 3)]


def test_empty_table(spark):
    assert sharding.byte_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_main_path_is_native(spark):
    plan = sharding.byte_shards(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
