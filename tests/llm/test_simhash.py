import random

import pytest

from cartlens.llm import simhash
from tests.llm import brute
from tests.llm.brute import SCHEMA, clash, corpus


@pytest.mark.parametrize("shard_rows", [1024, 4, 1])
def test_groups_equal_brute_force(spark, shard_rows):
    """Shards of one to four rows force every level of dealing again."""
    rows = corpus()
    got = simhash.near_groups(clash(spark.createDataFrame(rows, SCHEMA)), shard_rows=shard_rows).collect()
    fps = {i: brute.simhash(t) for i, t, *_ in rows}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute.components(fps)


@pytest.mark.parametrize("shard_rows", [1024, 16])
def test_links_between_dense_fingerprints(spark, shard_rows):
    """Chains of one- and two-bit steps, so that components are long."""
    rng, fps = random.Random(3), []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = simhash.near_links(df, 2, shard_rows)
    top = {r.a % 2**64: r.b % 2**64 for r in simhash.components(links).collect()}
    of = brute.components(dict(enumerate(fps)))
    groups, want = {}, {}
    for i, f in enumerate(fps):
        groups.setdefault(top.get(f, f), set()).add(f)
        want.setdefault(of[i], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(8) | rng.getrandbits(6) << 40 for _ in range(300)]
    for radius in (0, 1, 2, 5):
        tree, before = simhash.BKTree(), []
        for v in values:
            assert sorted(tree.near_then_add(v, radius)) == sorted(u for u in before if (u ^ v).bit_count() <= radius)
            before.append(v)


def test_blocks_cover_the_bits():
    for n in (2, 3, 5):
        blocks = simhash._blocks((1 << 64) - 1, n)
        assert sum(blocks) == (1 << 64) - 1 and max(b.bit_count() for b in blocks) - min(b.bit_count() for b in blocks) <= 1


def test_nulls_repeats_and_ties(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (None, None), (9, "")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (-1, 9), (3, 3), (7, 3), (7, 3), (9, 9)]
    alone = simhash.near_groups(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()
    assert alone[0].component_id is None


def test_rows_that_stay(spark):
    df = clash(spark.createDataFrame(corpus(), SCHEMA))
    kept = simhash.drop_near_copies(df)
    of = brute.components({i: brute.simhash(t) for i, t, *_ in corpus()})
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in of if of[i] == i)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_groups(empty).collect() == []
    assert simhash.drop_near_copies(empty).collect() == []


def test_query_equals_brute_force(spark):
    from cartlens.llm.queries import op8_simhash_bktree
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: brute.simhash(t) for i, t in texts.items()}
    of = brute.components(fps)
    got = op8_simhash_bktree(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", of[i]) for i in fps}
