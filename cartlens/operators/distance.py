"""Hamming distance, exact k nearest neighbours, distance multisets.

Vectors are packed bigint words (``cartlens.functions.bits``).

The k-NN never materialises query x candidate pairs as rows.  Queries and
candidates are hash-split into blocks of bounded size; every (query block,
candidate block) pair meets in one co-grouped task, where the distances of
the block are computed with vectorised XOR and popcount and only the k best
per query leave the task.  A final ``row_number() <= k`` per query merges the
blocks (at most k rows per candidate block per query).  This is the block
nested-loop k-NN join: exact, with memory per task bounded by the block
sizes and no broadcast of a table whose size grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.bits import WORD_BITS, hamming
from cartlens.runtime import checkpoint_dir, ship_package

# Distance-matrix cells computed at once inside a task (queries x candidates).
_CELLS_PER_BATCH = 1 << 22
# Distance cells per co-grouped task, and the least worth a task of its own.
# A task of 2^27 cells of one word takes about ten seconds.
_CELLS_PER_TASK = 1 << 27
_CELLS_WORTH_A_TASK = 1 << 20


def hamming_pairs(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
                  words: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """F1 on aligned pairs: join ``left`` and ``right`` on ``on`` and give the
    distance between their vectors (same word columns on both sides)."""
    on = [on] if isinstance(on, str) else list(on)
    l = left.select(*on, *keep, *[F.col(w).alias(f"_l{w}") for w in words])
    r = right.select(*on, *[F.col(w).alias(f"_r{w}") for w in words])
    return l.join(r, on, "inner").select(
        *on, *keep, hamming([f"_l{w}" for w in words], [f"_r{w}" for w in words]).alias("distance"))


def _blocks(n_rows: int, block_rows: int) -> int:
    return max(1, -(-n_rows // max(1, block_rows)))


def _to_u64(df: pd.DataFrame, words: Sequence[str]) -> np.ndarray:
    return np.ascontiguousarray(df[list(words)].to_numpy(dtype=np.int64)).view(np.uint64)


def _distances(qw: np.ndarray, cw: np.ndarray) -> np.ndarray:
    """Distance matrix, in the smallest type that holds the width."""
    d = np.zeros((qw.shape[0], cw.shape[0]), dtype=np.uint8 if qw.shape[1] * WORD_BITS < 256 else np.uint16)
    for j in range(qw.shape[1]):
        d += np.bitwise_count(qw[:, j:j + 1] ^ cw[None, :, j])
    return d


def _replicate(df: DataFrame, n: int, name: str) -> DataFrame:
    if n == 1:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _cogroup_blocks(queries: DataFrame, candidates: DataFrame, query_id: str, cand_id: str,
                    words: Sequence[str], query_block_rows: int, cand_block_rows: int,
                    n_candidates: int | None, carry: Sequence[str] = ()):
    """``queries`` is a checkpoint already; ``candidates`` is written once
    unless their number is given, since block sizes need the counts."""
    spark = queries.sparkSession
    ship_package(spark)
    nq, nc = queries.count(), n_candidates
    if nc is None:
        candidates = _materialise(candidates)
        nc = candidates.count()
    # candidate blocks bound the candidates held by one task; query blocks
    # bound the queries held by one task and split the work into tasks of
    # _CELLS_PER_TASK distances, and over all cores where it is worth it.
    # Shuffled rows: queries x cb + candidates x qb.
    cells = nq * nc
    tasks = max(-(-cells // _CELLS_PER_TASK), min(spark.sparkContext.defaultParallelism, -(-cells // _CELLS_WORTH_A_TASK)))
    cb = _blocks(nc, cand_block_rows)
    qb = max(1, min(max(_blocks(nq, query_block_rows), -(-tasks // cb)), max(1, nq)))
    # block numbers are ints on both sides: an int and a bigint of one value are hashed to different partitions
    q = queries.select(F.col(query_id).alias("_qid"), *words) \
               .withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(qb)).cast("int"))
    c = candidates.select(F.col(cand_id).alias("_cid"), *words, *carry) \
                  .withColumn("_cb", F.pmod(F.xxhash64("_cid"), F.lit(cb)).cast("int"))
    q = _replicate(q, cb, "_cb")
    c = _replicate(c, qb, "_qb")
    return q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb"))


def knn(queries: DataFrame, candidates: DataFrame, k: int, words: Sequence[str],
        query_id: str = "session_id", cand_id: str = "item_id", exclude_self: bool = False,
        query_block_rows: int = 1 << 20, cand_block_rows: int = 1 << 16,
        n_candidates: int | None = None) -> DataFrame:
    """The ``k`` candidates nearest to every query (C11, T4, W3):
    ``(query_id, rank, cand_id, distance)``, rank from 1.

    Order is (distance, candidate id): equal distances each take a place,
    the lower id first; fewer than k candidates return them all.  Of equal
    candidates only the k of lowest id can be among the nearest, so the work is
    distinct queries x distinct candidates (at most k times).  With
    ``exclude_self`` a query is not its own neighbour (ids compared)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    words = list(words)
    blocks = {"query_block_rows": query_block_rows, "cand_block_rows": cand_block_rows, "n_candidates": n_candidates}
    queries = _materialise(queries.select(query_id, *words))
    if exclude_self:
        return scan(queries, query_id, candidates, cand_id, words, k, True, **blocks)
    vecs = _distinct_vectors(queries, words)
    ranked = scan(vecs, "_vid", first_of_equal(candidates, cand_id, words, k), cand_id, words, k, **blocks)
    return _expand(queries, query_id, vecs, ranked, "_vid", words).select(query_id, "rank", cand_id, "distance")


def first_of_equal(candidates: DataFrame, cand_id: str, words: Sequence[str], k: int) -> DataFrame:
    """The ``k`` candidates of lowest id of every distinct vector.  Each task
    passes on at most ``k`` rows of a vector."""
    order = Window.partitionBy(*words).orderBy(F.col(cand_id).asc_nulls_last())
    return candidates.select(cand_id, *words).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def scan(queries: DataFrame, query_id: str, candidates: DataFrame, cand_id: str, words: Sequence[str], k: int,
         exclude_self: bool = False, query_block_rows: int = 1 << 20, cand_block_rows: int = 1 << 16,
         n_candidates: int | None = None) -> DataFrame:
    """The block kernel over a written table of queries, each on its own:
    ``(query_id, rank, cand_id, distance)``."""
    out_schema = T.StructType([T.StructField("_qid", queries.schema[query_id].dataType),
                               T.StructField("_cid", candidates.schema[cand_id].dataType),
                               T.StructField("distance", T.IntegerType())])

    def local_topk(_key, qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({"_qid": pd.Series([], dtype=qdf["_qid"].dtype if not qdf.empty else "int64"),
                                 "_cid": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="int32")})
        cdf = cdf.sort_values("_cid", kind="stable")
        cw, cids = _to_u64(cdf, words), cdf["_cid"].to_numpy()
        qw, qids = _to_u64(qdf, words), qdf["_qid"].to_numpy()
        n_c = len(cids)
        kk = min(k + (1 if exclude_self else 0), n_c)
        step = max(1, _CELLS_PER_BATCH // n_c)
        parts = []
        for s in range(0, len(qids), step):
            d = _distances(qw[s:s + step], cw)
            # (distance, candidate order) as one number
            key = d.astype(np.int32 if (int(d.max()) + 1) * n_c < 1 << 31 else np.int64) * n_c + np.arange(n_c)[None, :]
            if exclude_self:
                key[qids[s:s + step, None] == cids[None, :]] = np.iinfo(key.dtype).max
            idx = np.argpartition(key, kk - 1, axis=1)[:, :kk] if kk < n_c else \
                np.broadcast_to(np.arange(n_c), key.shape)
            rows = np.repeat(np.arange(idx.shape[0]), idx.shape[1])
            flat = idx.ravel()
            keep = key[rows, flat] != np.iinfo(key.dtype).max
            parts.append(pd.DataFrame({"_qid": qids[s:s + step][rows[keep]], "_cid": cids[flat[keep]],
                                       "distance": d[rows, flat][keep].astype(np.int32)}))
        return pd.concat(parts, ignore_index=True)

    grouped = _cogroup_blocks(queries, candidates, query_id, cand_id, words, query_block_rows, cand_block_rows, n_candidates)
    local = grouped.applyInPandas(local_topk, out_schema)
    w = Window.partitionBy("_qid").orderBy("distance", "_cid")
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select(F.col("_qid").alias(query_id), "rank", F.col("_cid").alias(cand_id), "distance"))


def _materialise(df: DataFrame) -> DataFrame:
    """Compute the query table once: it is read twice (its distinct vectors,
    then the join back to every query)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _distinct_vectors(queries: DataFrame, words: Sequence[str]) -> DataFrame:
    """Distinct query vectors with an id ``_vid``.  A vector shared by many
    queries (a hot vector) is scored once.  The ids are fixed by the
    checkpoint taken right away, so a recomputation cannot renumber them."""
    checkpoint_dir(queries.sparkSession)
    return (queries.select(*words).distinct()
                   .withColumn("_vid", F.monotonically_increasing_id())).checkpoint()


def _expand(queries: DataFrame, query_id: str, vecs: DataFrame, per_vector: DataFrame, vector_id: str,
            words: Sequence[str]) -> DataFrame:
    """Results per distinct vector back to every query holding it: the
    small side is keyed by the vector words, the join spreads a hot vector
    with AQE's skew split."""
    keyed = per_vector.join(vecs.withColumnRenamed("_vid", vector_id), vector_id).drop(vector_id)
    return queries.select(query_id, *words).join(keyed, list(words)).drop(*words)


def weighed_vectors(candidates: DataFrame, words: Sequence[str]) -> DataFrame:
    """Equal candidates as one: ``(w..., _weight, _cid)`` with how many there
    are and a number (a hash of the vector) that deals them to blocks.  A hot vector
    reaches its reducer as one row per task."""
    return (candidates.select(*words).groupBy(*words).agg(F.count(F.lit(1)).alias("_weight"))
                      .withColumn("_cid", F.xxhash64(*words)))


def distance_multiplicity(queries: DataFrame, candidates: DataFrame, words: Sequence[str],
                          query_id: str = "session_id", query_block_rows: int = 1 << 20,
                          cand_block_rows: int = 1 << 16) -> DataFrame:
    """Every distance value from a query to the candidates, with how many
    candidates lie at it (A12, T5): ``(query_id, distance, multiplicity)``.
    At most ``64 * words + 1`` rows per query; blocks add up by a sum.

    Equal queries are scored once and equal candidates are one weighted vector,
    so the work is distinct queries x distinct candidates, however many rows share a
    vector."""
    words = list(words)
    width = WORD_BITS * len(words) + 1

    def local_hist(_key, qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({"_qid": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="int32"),
                                 "multiplicity": pd.Series([], dtype="int64")})
        cw, weight = _to_u64(cdf, words), cdf["_weight"].to_numpy(dtype=np.int64)
        qw, qids = _to_u64(qdf, words), qdf["_qid"].to_numpy()
        step = max(1, _CELLS_PER_BATCH // len(cw))
        parts = []
        for s in range(0, len(qids), step):
            d = _distances(qw[s:s + step], cw)
            m = d.shape[0]
            cell = (d + np.int64(width) * np.arange(m)[:, None]).ravel()
            hist = np.bincount(cell, minlength=m * width).reshape(m, width)
            if weight.max() > 1:  # what the repeats add; a float sum is exact below 2^53
                more = np.bincount(cell, np.broadcast_to(weight - 1.0, d.shape).ravel(), m * width).reshape(m, width)
                hist = hist + more.astype(np.int64)
            r, v = np.nonzero(hist)
            parts.append(pd.DataFrame({"_qid": qids[s:s + step][r], "distance": v.astype(np.int32),
                                       "multiplicity": hist[r, v].astype(np.int64)}))
        return pd.concat(parts, ignore_index=True)

    queries = _materialise(queries.select(query_id, *words))
    vecs = _distinct_vectors(queries, words)
    weighed = _materialise(weighed_vectors(candidates, words))
    out_schema = T.StructType([T.StructField("_qid", T.LongType()), T.StructField("distance", T.IntegerType()),
                               T.StructField("multiplicity", T.LongType())])
    grouped = _cogroup_blocks(vecs, weighed, "_vid", "_cid", words, query_block_rows, cand_block_rows, weighed.count(), ["_weight"])
    hist = (grouped.applyInPandas(local_hist, out_schema)
                   .groupBy("_qid", "distance").agg(F.sum("multiplicity").alias("multiplicity")))
    return _expand(queries, query_id, vecs, hist, "_qid", words).select(query_id, "distance", "multiplicity")


def next_distance(multiset: DataFrame, query_id: str = "session_id") -> DataFrame:
    """In-order successor of each stored distance (T9): the next larger
    distinct value for the same query, null for the largest."""
    w = Window.partitionBy(query_id).orderBy("distance")
    return multiset.select(query_id, "distance", F.lead("distance").over(w).alias("next_distance"))


def distance_listing(multiset: DataFrame, query_id: str = "session_id") -> DataFrame:
    """The ascending listing of a query's distances, equal ones repeated (T5),
    run by run: ``(query_id, distance, first_position, last_position)``,
    positions from 1.  A run stands for its repeats, so a query has at most
    one row per distance value however many candidates there are."""
    w = Window.partitionBy(query_id).orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("multiplicity").over(w)
    return multiset.select(query_id, "distance", (last - F.col("multiplicity") + 1).alias("first_position"),
                           last.alias("last_position"))
