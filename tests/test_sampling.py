"""Samples of exact size: the same under any partitioning, and mergeable."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cartlens.operators import sampling as P
from cartlens.operators import sessions as S


def unit(key, seed=42):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0


def keyed(spark, n=500, parts=4):
    rows = [(i % 3, i) for i in range(n)] + [(0, i) for i in range(n, n + 300)]
    return spark.createDataFrame(rows, "stratum int, key long").repartition(parts), rows


def quota_table(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "stratum int, quota long")


def plain(rows, sizes, seed=42):
    out = set()
    for s, size in enumerate(sizes):
        out |= {(s, k) for k in sorted((k for t, k in rows if t == s), key=lambda k: (unit(k, seed), k))[:size]}
    return out


@pytest.mark.parametrize("buckets", [1, 7, 4096])
@pytest.mark.parametrize("sizes", [(10, 1, 0), (100, 37, 166), (10_000, 5, 5)])
def test_smallest_hashes_of_every_stratum(spark, buckets, sizes):
    df, rows = keyed(spark)
    got = {(r.stratum, r.key) for r in P.bottom_k(df, "key", quota_table(spark, sizes), buckets=buckets).collect()}
    assert got == plain(rows, sizes)


def test_any_partitioning_gives_the_same_sample(spark):
    q = quota_table(spark, (50, 20, 20))
    samples = [sorted(map(tuple, P.bottom_k(keyed(spark, parts=n)[0], "key", q, seed=7).collect())) for n in (1, 9)]
    assert samples[0] == samples[1] and len(samples[0]) == 90


def test_samples_merge(spark):
    df, rows = keyed(spark)
    q = quota_table(spark, (40, 30, 20))
    parts = [P.bottom_k(df.where(F.col("key") % 3 == i), "key", q) for i in range(3)]
    merged = P.merge_bottom_k(parts, "key", q)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, P.bottom_k(df, "key", q).collect()))


def test_quotas_add_up(spark):
    df, rows = keyed(spark)
    for size in (0, 1, 10, 333, 100_000):
        got = {r.stratum: (r.n, r.quota) for r in P.quotas(df, (0.7, 0.8, 1.0), size).collect()}
        weights = [w * got[i][0] for i, w in enumerate((0.7, 0.8, 1.0))]
        assert sum(q for _, q in got.values()) == min(size, int(sum(weights)))
        assert all(0 <= q <= n and abs(q - min(size, int(sum(weights))) * w / sum(weights)) <= 1 for (n, q), w in zip(
            [got[i] for i in range(3)], weights))


def test_ties_of_hashes_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(0, k, 0.25) for k in range(20)], "stratum int, key long, unit double")
    got = sorted(r.key for r in P.bottom_k(df, "key", quota_table(spark, (6,))).collect())
    assert got == list(range(6))


def test_sized_sample_of_sessions(spark):
    lengths = [10] * 30 + [25] * 40 + [40] * 30 + [80] * 20 + [200] * 5
    rows = [(s, i, None) for s, n in enumerate(lengths) for i in range(n)]
    sessions = spark.createDataFrame(rows, "session_id long, item_id long, date timestamp")
    encoded = spark.range(300).select(F.col("id").alias("item_id"), F.lit(1).cast("long").alias("1"))
    got = S.sample_sessions(sessions, encoded, ["1"], sample_size=20)
    sizes = {r.session_id: r["count"] for r in got.groupBy("session_id").count().collect()}
    assert len(sizes) == 20 and all(sizes[s] == lengths[s] for s in sizes) and set(sizes.values()) == {25, 40, 80}
    assert S.sample_sessions(sessions, encoded, ["1"], sample_size=10_000).select("session_id").distinct().count() == 28 + 24 + 20
    assert S.sample_sessions(sessions.limit(0), encoded, ["1"], sample_size=5).count() == 0
