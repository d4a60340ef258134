"""Multi-index k-NN against the block kernel and brute force, and the work it does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import distance as D
from cartlens.operators import hamming_index as H


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def table(spark, vectors, name, words=1):
    rows = [(i, *[signed(v >> 64 * j & (1 << 64) - 1) for j in range(words)]) for i, v in vectors]
    return spark.createDataFrame(rows, f"{name} long, " + ", ".join(f"w{j} long" for j in range(words)))


def clustered(rng, n, bits, centres, flips):
    c = [int.from_bytes(rng.bytes(16), "little") & (1 << bits) - 1 for _ in range(centres)]
    out = []
    for _ in range(n):
        v = c[rng.integers(0, centres)]
        for b in set(rng.integers(0, bits, flips)):
            v ^= 1 << int(b)
        out.append(v)
    return out


def sparse(rng, n, bits, ones):
    """Mostly zero vectors: every block has one content that most vectors share."""
    return [sum(1 << int(b) for b in set(rng.integers(0, bits, ones))) for _ in range(n)]


def brute(queries, candidates, k, same=False):
    out = set()
    for q, v in queries:
        near = sorted(((v ^ w).bit_count(), i) for i, w in candidates if not (same and i == q))[:k]
        out |= {(q, r, i, d) for r, (d, i) in enumerate(near, 1)}
    return out


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


CASES = {
    "random": (lambda rng: list(rng.integers(0, 1 << 16, 150).tolist()), 16, 1),
    "clustered": (lambda rng: clustered(rng, 200, 64, 12, 3), 64, 1),
    "sparse": (lambda rng: sparse(rng, 200, 73, 3), 73, 2),
    "one hot vector": (lambda rng: [5] * 90 + clustered(rng, 90, 32, 4, 2), 32, 1),
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("look_cost", [0.0, 1.0])
def test_equals_brute_force_and_the_block_kernel(spark, case, look_cost):
    make, bits, words = CASES[case]
    rng = np.random.default_rng(len(case))
    c, q = list(enumerate(make(rng))), list(enumerate(make(rng)[:60]))
    names = [f"w{j}" for j in range(words)]
    cands, queries = table(spark, c, "item_id", words), table(spark, q, "session_id", words)
    got = H.knn_indexed(queries, cands, 7, names, bits, look_cost=look_cost)
    assert got.neighbours.columns == ["session_id", "rank", "item_id", "distance"]
    want = rows(D.knn(queries, cands, 7, names))
    assert rows(got.neighbours) == want == brute(q, c, 7)
    work = got.work.collect()
    assert sorted(r.session_id for r in work) == [i for i, _ in q]
    assert look_cost > 0 or not any(r.scanned for r in work)


def test_few_candidates_are_looked_at(spark):
    """Near neighbours exist: the work is far below queries x candidates, and grows more slowly than the candidates."""
    rng = np.random.default_rng(1)
    share = []
    for n in (1000, 4000):
        c = list(enumerate(clustered(rng, n, 64, n // 20, 2)))
        q = [(i, v ^ 1 << int(rng.integers(0, 64))) for i, v in c[:50]]
        got = H.knn_indexed(table(spark, q, "session_id"), table(spark, c, "item_id"), 3, ["w0"], 64)
        assert rows(got.neighbours) == brute(q, c, 3)
        looked, scanned = got.work.agg(F.sum("looked"), F.sum(F.col("scanned").cast("int"))).first()
        assert scanned == 0
        share.append(looked / (50 * n))
    assert share[0] < 0.2 and share[1] < 0.5 * share[0]


def test_queries_without_near_neighbours_are_scanned(spark):
    rng = np.random.default_rng(2)
    c = [(i, int.from_bytes(rng.bytes(8), "little")) for i in range(500)]
    q = [(0, c[0][1]), (1, int.from_bytes(rng.bytes(8), "little"))]
    got = H.knn_indexed(table(spark, q, "session_id"), table(spark, c, "item_id"), 1, ["w0"], 64)
    assert rows(got.neighbours) == brute(q, c, 1)
    work = {r.session_id: r for r in got.work.collect()}
    assert not work[0].scanned and work[0].looked < 20 and work[1].scanned


def test_self_is_left_out(spark):
    rng = np.random.default_rng(3)
    c = list(enumerate(clustered(rng, 80, 32, 5, 2) + [9] * 20))
    df = table(spark, c, "item_id")
    got = H.knn_indexed(df.withColumnRenamed("item_id", "session_id"), df, 4, ["w0"], 32, exclude_self=True).neighbours
    assert rows(got) == brute(c, c, 4, same=True)


def test_small_and_empty_tables(spark):
    c, q = [(3, 1), (4, 2)], [(0, 1), (1, 1)]
    got = H.knn_indexed(table(spark, q, "session_id"), table(spark, c, "item_id"), 5, ["w0"], 8)
    assert rows(got.neighbours) == brute(q, c, 5)
    none = spark.createDataFrame([], "item_id long, w0 long")
    got = H.knn_indexed(table(spark, q, "session_id"), none, 5, ["w0"], 8)
    assert got.neighbours.collect() == [] and got.work.count() == 2
    nobody = none.withColumnRenamed("item_id", "session_id")
    assert H.knn_indexed(nobody, table(spark, c, "item_id"), 5, ["w0"], 8).neighbours.collect() == []


def test_blocks_share_the_features_by_entropy(spark):
    rng = np.random.default_rng(4)
    v = [(i, int(rng.integers(0, 256)) | 1 << 20) for i in range(300)]       # 8 features that tell, 24 that do not
    dealt = H.dealt_blocks(table(spark, v, "item_id"), 300, ["w0"], 32, blocks=4)
    assert sorted(i for f in dealt.features for i in f) == list(range(32))
    assert [sum(i < 8 for i in f) for f in dealt.features] == [2, 2, 2, 2]
    assert H.dealt_blocks(table(spark, v, "item_id"), 300, ["w0"], 32).masks == [[signed((1 << 32) - 1)]]


def test_pieces_of_hot_buckets(spark, monkeypatch):
    """A block content that most candidates share is split; results stay."""
    monkeypatch.setattr(H, "PIECE", 4)
    rng = np.random.default_rng(5)
    c, q = list(enumerate(sparse(rng, 120, 40, 3))), list(enumerate(sparse(rng, 20, 40, 3)))
    got = H.knn_indexed(table(spark, q, "session_id"), table(spark, c, "item_id"), 5, ["w0"], 40, look_cost=0.0)
    assert rows(got.neighbours) == brute(q, c, 5)


def test_weighed_candidates_count_each(spark):
    """Distances to equal candidates, by weight, are those to each of them."""
    from collections import Counter
    rng = np.random.default_rng(6)
    c = list(enumerate([7] * 200 + [1] * 50 + rng.integers(0, 255, 60).tolist()))
    q = list(enumerate(rng.integers(0, 255, 30).tolist()))
    cands = table(spark, c, "item_id")
    assert D.weighed_vectors(cands, ["w0"]).count() == len({v for _, v in c})
    got = rows(D.distance_multiplicity(table(spark, q, "session_id"), cands, ["w0"], cand_block_rows=8))
    assert got == {(i, d, n) for i, v in q for d, n in Counter((v ^ w).bit_count() for _, w in c).items()}


def test_changes_of_queries_are_not_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as few as their input; the many changes of a query must not be collected for that."""
    monkeypatch.setattr(H, "SENT", 4)
    monkeypatch.setattr(H, "CHANGES", 1 << 8)
    plans, frame = [], type(spark.range(1))
    original = frame.write.fget

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df)
    monkeypatch.setattr(frame, "write", property(write))
    rng = np.random.default_rng(7)
    c, q = list(enumerate(clustered(rng, 120, 32, 8, 2))), list(enumerate(clustered(rng, 20, 32, 8, 2)))
    got = rows(H.knn_indexed(table(spark, q, "session_id"), table(spark, c, "item_id"), 2, ["w0"], 32).neighbours)
    assert got == brute(q, c, 2)
    looked_up = [p for p in plans if "_bits" in p or "sequence(0" in p]
    assert looked_up and not any("BroadcastHashJoin" in p for p in looked_up)


def test_scan_compares_few_of_equal_candidates(spark, monkeypatch):
    """Only the k lowest ids of equal candidates are compared, so repeats of a vector are no work."""
    rng = np.random.default_rng(8)
    c = [(i, int(v)) for i, v in enumerate(rng.integers(0, 6, 400))] + [(5, 3), (5, 3)]
    q, seen, scan = list(enumerate(range(8))), [], D.scan

    def counted(queries, query_id, candidates, *args, **kwargs):
        seen.append(candidates.count())
        return scan(queries, query_id, candidates, *args, **kwargs)
    monkeypatch.setattr(D, "scan", counted)
    got = [tuple(r) for r in D.knn(table(spark, q, "session_id"), table(spark, c, "item_id"), 4, ["w0"]).collect()]
    want = [(i, r, j, d) for i, v in q for r, (d, j) in enumerate(sorted(((v ^ w).bit_count(), j) for j, w in c)[:4], 1)]
    assert sorted(got) == sorted(want) and seen == [4 * 6]


@pytest.mark.parametrize("blocks", [{}, {"query_block_rows": 5, "cand_block_rows": 30}])
def test_blocks_meet_if_partitions_are_not_coalesced(spark, blocks):
    """Both sides of a block go to the same partition, also where the tables are too large to be put into one."""
    rng = np.random.default_rng(9)
    c, q = list(enumerate(rng.integers(0, 1 << 16, 100).tolist())), list(enumerate(rng.integers(0, 1 << 16, 20).tolist()))
    cands, queries, key = table(spark, c, "item_id"), table(spark, q, "session_id"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert rows(D.knn(queries, cands, 3, ["w0"], **blocks)) == brute(q, c, 3)
        assert rows(H.knn_indexed(queries, cands, 3, ["w0"], 16, look_cost=100.0).neighbours) == brute(q, c, 3)
        counted = D.distance_multiplicity(queries, cands, ["w0"], **blocks).groupBy("session_id").agg(F.sum("multiplicity").alias("n"))
        assert {(r.session_id, r.n) for r in counted.collect()} == {(i, 100) for i, _ in q}
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("piece", [1 << 20, 30])
def test_look_ups_are_no_rows_of_a_table(spark, monkeypatch, piece):
    """What is written of a round is a row for each query and piece, however many changes are looked up and buckets found."""
    from pyspark.sql import DataFrameWriter
    monkeypatch.setattr(H, "PIECE", piece)
    sizes, plans, original = {}, {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plans[path.rsplit("/", 1)[1]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        original(self, path, *args, **kwargs)
        sizes[path.rsplit("/", 1)[1]] = spark.read.parquet(path).count()
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rng = np.random.default_rng(10)
    c, q = list(enumerate(clustered(rng, 120, 16, 4, 6))), list(enumerate(clustered(rng, 20, 16, 4, 6)))
    got = H.knn_indexed(table(spark, q, "session_id"), table(spark, c, "item_id"), 3, ["w0"], 16, look_cost=0.1, blocks=2)
    assert rows(got.neighbours) == brute(q, c, 3)
    pieces = -(-len({v for _, v in c}) // piece)
    looked, probes = got.work.agg(F.sum("looked"), F.sum("probes")).first()
    found = {name: n for name, n in sizes.items() if name.startswith("found-")}
    assert len(found) > 1 and max(found.values()) <= 20 * pieces < probes
    assert sum(found.values()) < looked and not any("_bits" in plans[name] for name in found)


@pytest.mark.parametrize("direct", [0, 22])
@pytest.mark.parametrize("features", [5, 16, 64, 70])
def test_buckets_by_any_number_of_features(monkeypatch, direct, features):
    """Found by table or by search, in one word or two: all rows with that content, and no others."""
    monkeypatch.setattr(H, "DIRECT", direct)
    rng = np.random.default_rng(features)
    vectors = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64) & np.uint64(0x8000_0000_0000_0007)
    some = sorted(rng.permutation(73)[:features].tolist())
    buckets, own = H.Buckets(vectors, some), H.content(vectors, some)
    asked = np.concatenate([own[:40], own[:40] ^ np.uint64(1)])
    hit, bucket = buckets.find(asked)
    got = {int(h): sorted(buckets.order[buckets.first[b]:buckets.first[b] + buckets.size[b]].tolist()) for h, b in zip(hit, bucket)}
    want = {i: [r for r in range(300) if (own[r] == a).all()] for i, a in enumerate(asked)}
    assert got == {i: r for i, r in want.items() if r}


def test_changes_come_once_each(monkeypatch):
    bits = np.uint64(1) << np.arange(7, dtype=np.uint64)[:, None]
    for at_once in (1 << 20, 3):
        monkeypatch.setattr(H, "AT_ONCE", at_once)
        for a in range(8):
            got = np.concatenate(list(H.changes(bits, a)))[:, 0].tolist()
            assert sorted(got) == [v for v in range(128) if v.bit_count() == a]
