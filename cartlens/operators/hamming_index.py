"""Exact k nearest neighbours in Hamming distance by multi-index hashing.

The features are dealt to ``m`` blocks.  If two vectors differ in at most
``m * (a + 1) - 1`` features, they differ in at most ``a`` features of some block, so a
table of the candidates by the content of each block finds every such pair by
looking up the query's block with all changes of at most ``a`` features.

1. Equal candidates become one row with their ``k`` smallest ids (more cannot
   be among the k nearest), equal queries one row; a vector that a third of all
   rows share counts once.
2. Features are dealt by how much they tell (entropy), so that blocks are
   alike, and there are about ``entropy / log2(candidates)`` blocks: a bucket then
   holds about one vector if features are independent.
3. Round ``a = 0, 1, ...``: the queries still open look up the changes of
   exactly ``a`` features.  First only the sizes of the buckets are added up: they are
   the candidates a query is about to look at.  Queries for which the look-ups would
   cost more than a scan of all candidates go to the block kernel
   (``distance.knn``) instead; the others look at their buckets, and keep the k
   nearest.  A pair is taken at one place only: the round of its least block
   distance, and the first block that has it.
4. A query is done when ``k`` candidates lie within the radius proven so far.

The candidates are dealt to pieces of bounded size by a hash of the whole vector, so
a hot block content is spread over tasks.  A piece and a block of queries meet in one
co-grouped task, which has the tables of the piece and makes the changes of its
queries, some at a time: only a sum or the ``k`` nearest of a query and piece leave it.
Changes and the pairs they find are never rows of a table, so that what is shuffled
and written grows with the queries and the candidates, not with the look-ups.
``work`` tells how many candidates each query looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.bits import WORD_BITS, quoted
from cartlens.operators import distance as D
from cartlens.runtime import checkpoint_dir, delete_folder, scratch_folder, ship_package

# Vectors of a piece of the index.
PIECE = 1 << 20
# Rows of a table up to which it is sent to every task; a larger one is joined by shuffles.
SENT = 1 << 16
# Look-ups of a task, about (some seconds), and the least worth a task of its own; look-ups at once in a task.
CHANGES = 1 << 27
CHANGES_WORTH_A_TASK = 1 << 20
AT_ONCE = 1 << 20
# Features of a block up to which its buckets are a table of all contents.
DIRECT = 22


@dataclass
class IndexedKnn:
    neighbours: DataFrame     # (query_id, rank, cand_id, distance)
    work: DataFrame           # (query_id, looked, probes, radius, scanned)


@dataclass
class Blocks:
    """The features of each block, and per block and word the mask of their bits."""

    features: list[list[int]]
    masks: list[list[int]]

    def longest(self) -> int:
        return max(map(len, self.features))


def collapsed(candidates: DataFrame, cand_id: str, words: Sequence[str], keep: int) -> DataFrame:
    """One row per distinct vector: ``(w..., _ids)``, its ``keep`` smallest ids
    in order.  Each task passes on at most ``keep`` rows of a vector."""
    order = Window.partitionBy(*words).orderBy("_id")
    first = candidates.select(*words, F.col(cand_id).alias("_id")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    return first.groupBy(*words).agg(F.sort_array(F.collect_list("_id")).alias("_ids"))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def dealt_blocks(vectors: DataFrame, n: int, words: Sequence[str], n_features: int, blocks: int | None = None) -> Blocks:
    """Features in blocks of like entropy.  One row of counts reaches the driver."""
    sums = [F.expr(f"coalesce(sum(shiftright({quoted(words[i // WORD_BITS])}, {i % WORD_BITS}) & 1), 0) as _o{i}") for i in range(n_features)]
    ones = vectors.agg(*sums).first()
    told = []
    for i in range(n_features):
        p = min(max(ones[i] / max(n, 1), 0.0), 1.0)
        told.append((0.0 if p in (0.0, 1.0) else -p * log2(p) - (1 - p) * log2(1 - p), i))
    m = blocks or round(sum(h for h, _ in told) / log2(max(n, 2)))
    m = max(1, min(m, n_features))
    features, total = [[] for _ in range(m)], [0.0] * m
    most = -(-n_features // m)
    for h, i in sorted(told, key=lambda x: (-x[0], x[1])):  # each to the block that tells least so far
        at = min((j for j in range(m) if len(features[j]) < most), key=lambda j: (total[j], len(features[j]), j))
        features[at].append(i)
        total[at] += h
    masks = [[signed(sum(1 << i % WORD_BITS for i in f if i // WORD_BITS == j)) for j in range(len(words))] for f in features]
    return Blocks([sorted(f) for f in features], masks)


def changes(bits: np.ndarray, a: int):
    """What changes exactly ``a`` of these features (a row of words each): rows of
    words to combine by XOR, some at a time; each set of features comes once."""
    if a == 0:
        yield np.zeros((1, bits.shape[1]), np.uint64)
    elif a == 1:
        yield bits
    elif comb(len(bits), a) <= AT_ONCE:
        out, last = bits, np.arange(len(bits))
        for _ in range(a - 1):  # positions rise
            before = [np.flatnonzero(last < p) for p in range(len(bits))]
            out = np.concatenate([out[some] ^ bits[p] for p, some in enumerate(before)])
            last = np.repeat(np.arange(len(bits)), [len(some) for some in before])
        yield out
    else:
        for p in range(len(bits) - a + 1):
            for rest in changes(bits[p + 1:], a - 1):
                yield rest ^ bits[p]


def content(vectors: np.ndarray, features: Sequence[int]) -> np.ndarray:
    """These features of every vector, one after the other in as few words as hold them."""
    out = np.zeros((len(vectors), -(-len(features) // WORD_BITS)), np.uint64)
    for p, f in enumerate(features):
        out[:, p // WORD_BITS] |= (vectors[:, f // WORD_BITS] >> np.uint64(f % WORD_BITS) & np.uint64(1)) << np.uint64(p % WORD_BITS)
    return out


class Buckets:
    """Rows by the content of some features: a row of ``order`` from ``first`` on, ``size`` of
    them, for each bucket.  The content of a few features is the bucket's number."""

    def __init__(self, vectors: np.ndarray, features: Sequence[int]):
        own, self.levels = content(vectors, features), []
        code = own[:, 0].astype(np.int64) if len(features) <= DIRECT else np.zeros(len(own), np.int64)
        for j in range(own.shape[1] if len(features) > DIRECT else 0):  # the words so far as one number without gaps
            known, at = np.unique(own[:, j], return_inverse=True)
            both, code = np.unique(code * len(known) + at, return_inverse=True)
            self.levels.append((known, both))
        self.order = np.argsort(code, kind="stable").astype(np.int32)
        self.size = np.bincount(code, minlength=0 if self.levels else 1 << len(features)).astype(np.int32)
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these contents there are, and the buckets of those."""
        if not self.levels:
            code = own[:, 0].astype(np.int64)
            hit = np.flatnonzero(self.size[code])
            return hit, code[hit]
        hit, code = np.arange(len(own)), np.zeros(len(own), np.int64)
        for j, (known, both) in enumerate(self.levels):
            at = np.minimum(np.searchsorted(known, own[hit, j]), len(known) - 1)
            some = np.flatnonzero(known[at] == own[hit, j])
            hit, code = hit[some], code[some] * len(known) + at[some]
            at = np.minimum(np.searchsorted(both, code), len(both) - 1)
            some = np.flatnonzero(both[at] == code)
            hit, code = hit[some], at[some]
        return hit, code


def look_ups(queries: np.ndarray, vectors: np.ndarray, blocks: Blocks, a: int):
    """The look-ups of all changes of ``a`` features of every block, some at a time: the
    block, its buckets, the first of the queries, their number of changes, and the contents (query by query)."""
    for j, features in enumerate(blocks.features):
        if a > len(features):
            continue
        buckets, own = Buckets(vectors, features), content(queries, features)
        bits = np.zeros((len(features), own.shape[1]), np.uint64)
        for p in range(len(features)):
            bits[p, p // WORD_BITS] = np.uint64(1 << p % WORD_BITS)
        for some in changes(bits, a):
            step = max(1, AT_ONCE // len(some))
            for at in range(0, len(queries), step):
                yield j, buckets, at, len(some), (own[at:at + step, None, :] ^ some[None, :, :]).reshape(-1, own.shape[1])


def bucket_sizes(queries: np.ndarray, vectors: np.ndarray, blocks: Blocks, a: int) -> np.ndarray:
    """How many vectors every query would look at."""
    out = np.zeros(len(queries), np.int64)
    for _, buckets, at, many, own in look_ups(queries, vectors, blocks, a):
        hit, bucket = buckets.find(own)
        out[at:at + len(own) // many] += np.bincount(hit // many, buckets.size[bucket], len(own) // many).astype(np.int64)
    return out


def nearest_found(queries: np.ndarray, vectors: np.ndarray, blocks: Blocks, a: int, keep: int):
    """Of the vectors that every query finds the ``keep`` nearest, of equal ones the first
    rows: (query, distance, row).  A vector is taken in the first block of least
    distance if this is ``a``."""
    best, waiting, size = tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0
    masks = [np.array(mask, np.int64).view(np.uint64) for mask in blocks.masks]

    def nearest():
        query, far, row = (np.concatenate(c) for c in zip(best, *waiting))
        order = np.lexsort((row, far, query))
        query, far, row = query[order], far[order], row[order]
        first = np.searchsorted(query, query)
        some = np.flatnonzero(np.arange(len(query)) - first < keep)
        return query[some], far[some], row[some]

    for j, buckets, at, many, own in look_ups(queries, vectors, blocks, a):
        hit, bucket = buckets.find(own)
        query, ends, at = at + hit // many, np.cumsum(buckets.size[bucket], dtype=np.int64), 0
        while at < len(query):  # pairs of about AT_ONCE at a time; a bucket has no more rows than a piece
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            many = buckets.size[bucket[at:to]].astype(np.int64)
            row = buckets.order[np.repeat(buckets.first[bucket[at:to]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            own = np.repeat(query[at:to], many)
            differ = queries[own] ^ vectors[row]
            per = [np.bitwise_count(differ & mask).sum(axis=1, dtype=np.int64) for mask in masks]
            taken = per[j] == a
            for i, d in enumerate(per):
                taken &= d > a if i < j else d >= a
            some = np.flatnonzero(taken)
            waiting.append((own[some], sum(per)[some], row[some]))
            size += len(some)
            if size > max(AT_ONCE, 2 * len(best[0])):
                best, waiting, size = nearest(), [], 0
            at = to
    return nearest()


def _words(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)


def _looked_up(queries: DataFrame, n_queries: int, known: DataFrame, look_ups: int, pieces: int, kernel, schema: str) -> DataFrame:
    """What ``kernel`` gives for the tables of every piece of the candidates and block of queries:
    ``queries`` has the ``_piece`` of each row.  ``look_ups``: of all queries in all pieces."""
    spark = queries.sparkSession
    ship_package(spark)
    tasks = max(-(-look_ups // CHANGES), min(spark.sparkContext.defaultParallelism, -(-look_ups // CHANGES_WORTH_A_TASK)))
    qb = max(1, min(max(-(-tasks // pieces), -(-n_queries // PIECE)), max(1, n_queries)))
    # as many partitions as groups: they are small, and would be put together by their size, not by their work
    parts = max(pieces * qb, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = queries.withColumn("_qb", F.pmod(F.xxhash64("_vid"), F.lit(qb)).cast("int")).repartition(parts, "_piece", "_qb")
    c = known.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).repartition(parts, "_piece", "_qb")
    return q.groupBy("_piece", "_qb").cogroup(c.groupBy("_piece", "_qb")).applyInArrow(kernel, schema)


def knn_indexed(queries: DataFrame, candidates: DataFrame, k: int, words: Sequence[str], n_features: int,
                query_id: str = "session_id", cand_id: str = "item_id", exclude_self: bool = False, look_cost: float = 1.0,
                blocks: int | None = None) -> IndexedKnn:
    """The ``k`` candidates nearest to every query (C11, T4, J6, W3), as
    ``distance.knn`` gives them: by (distance, candidate id), equal distances
    each take a place, fewer than k candidates are all returned.

    ``look_cost``: how many candidates a scan passes in the time of one
    look-up.  A query whose look-ups (probes of buckets and candidates in them)
    would cost more than the scan is scanned; the result is the same.  ``work`` has, for every query, the
    candidates ``looked`` at by look-up, the buckets probed (``probes``), the
    ``radius`` proven and whether it was ``scanned``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, words = queries.sparkSession, list(words)
    checkpoint_dir(spark)
    folder, keep = scratch_folder(spark, "knn"), k + (1 if exclude_self else 0)

    def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        (df.coalesce(parts) if parts else df).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    queries = written(queries.select(query_id, *words), "queries")
    vectors = written(queries.select(*words).distinct().withColumn("_vid", F.monotonically_increasing_id()), "vectors")
    known = written(collapsed(candidates, cand_id, words, keep), "candidates")
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_ids")), F.lit(0))).first()
    dealt = dealt_blocks(known, n, words, n_features, blocks)
    m, pieces = len(dealt.masks), max(1, -(-n // PIECE))
    index = known.withColumn("_piece", F.pmod(F.xxhash64(*words), F.lit(pieces)).cast("int"))
    q = vectors.select("_vid", *[F.col(w).alias(f"_q{i}") for i, w in enumerate(words)])
    state = written(q.select("*", F.lit(0).cast("bigint").alias("looked"), F.lit(0).cast("bigint").alias("probes"),
                             F.lit(-1).alias("radius"), F.lit(pieces).alias("_pieces")), "state-0")
    best, ended = None, []
    names = [f"_q{i}" for i in range(len(words))]
    ids = known.schema["_ids"].dataType.simpleString()

    def sizes_of(a: int):
        def sizes(q: pa.Table, c: pa.Table) -> pa.Table:
            found = bucket_sizes(_words(q, names), _words(c, words), dealt, a) if q.num_rows and c.num_rows else np.zeros(q.num_rows, np.int64)
            some = np.flatnonzero(found)
            return pa.table({"_vid": q.column("_vid").take(pa.array(some)), "_piece": q.column("_piece").take(pa.array(some)),
                             "_size": pa.array(found[some])})
        return sizes

    def nearest_of(a: int):
        def nearest(q: pa.Table, c: pa.Table) -> pa.Table:
            c = c.take(pc.sort_indices(c, [("_first", "ascending")], null_placement="at_start"))
            found = nearest_found(_words(q, names), _words(c, words), dealt, a, keep) if q.num_rows and c.num_rows else [np.zeros(0, np.int64)] * 3
            return pa.table({"_vid": q.column("_vid").take(pa.array(found[0])), "distance": pa.array(found[1].astype(np.int32)),
                             "_ids": c.column("_ids").take(pa.array(found[2]))})
        return nearest

    def met(df: DataFrame, other: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
        # said here, as Spark knows no sizes of what tasks of ours make
        return df.join(F.broadcast(other) if rows <= SENT else other.hint("merge"), on, how)

    a = 0
    while n and a <= dealt.longest():
        probes = sum(comb(len(f), a) for f in dealt.features)
        open_ = written(state.where(F.lit(n) >= look_cost * (F.col("probes") + F.col("looked") + probes)), f"open-{a}")
        ended.append(state.join(open_.select("_vid"), "_vid", "left_anti").withColumn("scanned", F.lit(True)))
        n_open = open_.count()
        if not n_open:
            state = open_
            break
        asking = open_.select("_vid", *names, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))
        found = written(_looked_up(asking, n_open, index.select(*words, "_piece"), n_open * probes * pieces, pieces, sizes_of(a),
                                   "_vid bigint, _piece int, _size bigint"), f"found-{a}")
        cost = open_.join(found.groupBy("_vid").agg(F.sum("_size").alias("_now")), "_vid", "left") \
            .withColumn("looked", F.col("looked") + F.coalesce("_now", F.lit(0))).drop("_now") \
            .withColumn("probes", F.col("probes") + probes)
        cost = written(cost.withColumn("scanned", F.lit(n) < look_cost * (F.col("looked") + F.col("probes"))), f"cost-{a}")
        # queries that would look at too much have not done so: they are scanned with what they had looked at before
        ended.append(open_.join(cost.where("scanned").select("_vid"), "_vid", "left_semi").withColumn("scanned", F.lit(True)))
        cheap = cost.where("not scanned").drop("scanned")
        some = met(found, cheap.select("_vid", *names), "_vid", n_open)
        rows, looks = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
        pairs = _looked_up(some.select("_vid", *names, "_piece"), rows, index.select(*words, "_piece", "_ids", F.get("_ids", 0).alias("_first")),
                           rows * probes + looks, pieces, nearest_of(a), f"_vid bigint, distance int, _ids {ids}")
        if best is not None:
            pairs = pairs.unionByName(best)
        order = Window.partitionBy("_vid").orderBy("distance", F.col("_ids")[0])
        best = written(pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r"), f"best-{a}")
        if a:
            delete_folder(spark, f"{folder}/best-{a - 1}")
        delete_folder(spark, f"{folder}/found-{a}")
        proven = m * (a + 1) - 1
        inside = best.where(F.col("distance") <= proven).groupBy("_vid").agg(F.sum(F.size("_ids")).alias("_in"))
        now = cheap.withColumn("radius", F.lit(proven)).join(inside, "_vid", "left") \
            .withColumn("_done", F.coalesce("_in", F.lit(0)) >= min(keep, total)).drop("_in")
        now = written(now, f"now-{a}")
        ended.append(now.where("_done").drop("_done").withColumn("scanned", F.lit(False)))
        state = now.where("not _done").drop("_done")
        a += 1
    ended.append(state.withColumn("scanned", F.lit(n > 0)))
    done = ended[0]
    for more in ended[1:]:
        done = done.unionByName(more)
    done = written(done, "done")
    # candidates to scan: at most ``keep`` of each vector
    slim = known.select(F.explode("_ids").alias(cand_id), *words)
    left = done.where("scanned").select("_vid", *[F.col(f"_q{i}").alias(w) for i, w in enumerate(words)])
    scanned = D.scan(left, "_vid", slim, cand_id, words, keep)
    near = scanned.select("_vid", F.col(cand_id).alias("_cid"), "distance")
    if best is not None:
        by_index = best.join(done.where("not scanned").select("_vid"), "_vid", "left_semi")
        near = near.unionByName(by_index.select("_vid", F.explode("_ids").alias("_cid"), "distance"))
    order = Window.partitionBy("_vid").orderBy("distance", "_cid")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    own = queries.join(vectors, words).drop(*words)
    out = own.join(near, "_vid").select(query_id, "rank", F.col("_cid").alias(cand_id), "distance")
    if exclude_self:
        again = Window.partitionBy(query_id).orderBy("distance", cand_id)
        out = out.where(~F.col(query_id).eqNullSafe(F.col(cand_id))).withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    return IndexedKnn(out, own.join(done.select("_vid", "looked", "probes", "radius", "scanned"), "_vid").drop("_vid"))
