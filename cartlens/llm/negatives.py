"""Hard-negative mining with spanning-tree bounds over the anchors.

1. Rows become integer vectors in a table of the shared folder.
2. Anchors are dealt to blocks of bounded size, neighbours (by the signs of
   random projections) together.  Every block meets every group of rows in
   one cell; rows stream through a cell in slices, so a task holds a block of
   anchors, their lists and one slice.
3. Inside a cell the anchors of a block form a minimum spanning tree by
   distance.  A slice is scored against the root; walking down the tree,
   ``<child, x> = <parent, x> + <child - parent, x>`` lies within edge length
   times ``|x|`` of the parent's score, so the parent's scores (or bounds) give
   bounds for the child.  Only rows whose bounds overlap a window that can
   still change a list are scored again, and their bounds become exact.
4. First round: the window of an anchor is everything from its present k-th
   same-label score up.  The lists of all cells are merged into the positives.
   Second round: a window for each positive, from the lowest score allowed, or
   the present k-th score inside it, up to the positive's score.

Scores are whole numbers throughout.  Work is anchors x rows bound checks, and
at most as many products; nothing is collected but counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import map_arrow, slices
from cartlens.llm.vectors import matrix, scaled, usable, usual_length
from cartlens.runtime import scratch_folder

#: Components from here on (times the scale) count as not finite: 64 products stay below 2^62.
LIMIT = 1 << 28
# Rows of a slice; anchors of a block at most; rows streamed through a cell at most, about.
SLICE, BLOCK, CELL = 2048, 1024, 1 << 20

FOUND = "anchor long, place int, vec_id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's tree of the rows as ``(node, parent, edge length)``, parents
    first; the first is the root, the row nearest to the mean, parent -1."""
    v = vectors.astype(float)
    away = v - v.mean(axis=0)
    node = int(np.argmin(np.einsum("ij,ij->i", away, away)))
    near, parent, out = np.full(len(v), np.inf), np.full(len(v), -1), []
    left = np.ones(len(v), bool)
    for _ in range(len(v)):
        out.append((node, int(parent[node]), 0.0 if parent[node] < 0 else float(np.sqrt(near[node]))))
        left[node] = False
        step = v - v[node]
        step = np.einsum("ij,ij->i", step, step)
        closer = left & (step < near)
        near[closer], parent[closer] = step[closer], node
        node = int(np.argmin(np.where(left, near, np.inf)))
    return out


@dataclass
class Best:
    """The best rows of a window, by score (higher first) and id (smaller first)."""

    k: int
    low: int | None = None    # the window, both ends included; None: open
    high: int | None = None
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def floor(self) -> float:
        """The least score that can still enter the list."""
        if len(self.scores) == self.k:
            return int(self.scores[-1])
        return -np.inf if self.low is None else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = scores >= self.floor
        if self.high is not None:
            fits &= scores <= self.high
        if not fits.any():
            return
        ids, scores = np.concatenate([self.ids, ids[fits]]), np.concatenate([self.scores, scores[fits]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]


@dataclass
class Block:
    """The anchors of a cell, with their lists and their tree."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lists: list[list[Best]]
    same_label: bool          # candidates: rows of the anchor's label, or of any other
    checked: int = 0          # pairs whose bounds were looked at
    scored: int = 0           # pairs that were scored

    def __post_init__(self) -> None:
        # positives: one tree for each label, as only rows of that label matter to it
        groups = [np.flatnonzero(self.labels == x) for x in np.unique(self.labels)] if self.same_label else [np.arange(len(self.rows))]
        self.trees = []
        for members in groups:
            tree = spanning_tree(self.vectors[members])
            inner = {parent for _, parent, _ in tree}
            self.trees.append((members, [(node, parent, edge, node in inner) for node, parent, edge in tree]))

    def scan(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Let a slice of rows pass."""
        for members, tree in self.trees:
            some = np.flatnonzero(labels == self.labels[members[0]]) if self.same_label else np.arange(len(rows))
            if len(some):
                self._walk(members, tree, rows[some], ids[some], labels[some], vectors[some])

    def _walk(self, members, tree, rows, ids, labels, vectors) -> None:
        most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(self.vectors[members]).max(initial=0)))
        kind = float if most * most * vectors.shape[1] < 1 << 53 else np.int64  # exact either way
        v, a = vectors.astype(kind), self.vectors[members].astype(kind)
        norm = np.sqrt(np.einsum("ij,ij->i", vectors.astype(float), vectors.astype(float)))
        bounds = {}
        for node, parent, edge, inner in tree:
            anchor = members[node]
            if self.same_label:
                wanted = rows != self.rows[anchor]
            else:
                wanted = labels != self.labels[anchor]
            if parent < 0:
                low, high, again = np.empty(len(rows)), np.empty(len(rows)), np.arange(len(rows))
            else:
                low, high = bounds[parent]
                # slack for rounding in lengths and, where scores exceed 2^53, in the scores
                reach = norm * (edge * (1 + 1e-9)) + 1 + np.abs(low) * 1e-12 + np.abs(high) * 1e-12
                low, high = low - reach, high + reach
                overlaps = np.zeros(len(rows), bool)
                for best in self.lists[anchor]:
                    overlaps |= (high >= best.floor) if best.high is None else (high >= best.floor) & (low <= best.high)
                again = np.flatnonzero(overlaps & wanted)
            self.checked += len(rows)
            self.scored += len(again)
            if len(again):
                exact = (v if len(again) == len(v) else v[again]) @ a[node]
                low[again] = high[again] = exact
                use = wanted[again]
                for best in self.lists[anchor]:
                    best.add(ids[again][use], exact[use].astype(np.int64))
            if inner:
                bounds[node] = low, high

    def found(self) -> pa.RecordBatch:
        """(anchor, place of the list, vec_id, score) of every list."""
        parts = [(np.full(len(b.ids), row), np.full(len(b.ids), i, np.int32), b.ids, b.scores)
                 for row, lists in zip(self.rows, self.lists) for i, b in enumerate(lists)]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int32)] + 2 * [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "place", "vec_id", "score"])


def rows_of(rows: DataFrame, id_col: str, label_col: str, vector_col: str, is_anchor: Column, scale: int) -> DataFrame:
    """(vec_id, label, anchor, v) of the rows that take part."""
    some = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                       F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("_v"))
    return (some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("_v"), LIMIT / scale))
                .select("vec_id", "label", "anchor", scaled(F.col("_v"), scale).alias("v")))


def dealt_anchors(anchors: DataFrame, n: int, d: int, block: int) -> tuple[DataFrame, int]:
    """The anchors with a ``block`` of about ``block`` anchors, near ones
    together, and the number of blocks.  The signs of random projections are
    the code of an anchor; a code with too many anchors is split by their rows.
    One row per code reaches the driver, about one for each block."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / block)))))
    if not bits:
        return anchors.withColumn("block", F.lit(0)), 1
    planes = np.random.default_rng(7).standard_normal((bits, d))
    signs = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(w)) for w in plane]), lambda x, w: x * w), F.lit(0.0),
                         lambda total, x: total + x) > 0 for plane in planes]
    coded = anchors.withColumn("code", sum((s.cast("int") * (1 << b) for b, s in enumerate(signs)), F.lit(0)))
    first, at = [], 0
    for row in coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect():
        parts = -(-row["n"] // block)
        first.append((row["code"], at, parts))
        at += parts
    places = anchors.sparkSession.createDataFrame(first, "code int, first int, parts int")
    return (coded.join(places, "code").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
                 .drop("code", "first", "parts"), at)


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, d: int, same_label: bool, k: int) -> DataFrame:
    """The lists of every cell (block of anchors, group of rows)."""
    sent = ["cell", "kind", "row", "vec_id", "label", "v", "windows"]
    asked = anchors.withColumn("cell", F.explode(F.sequence(F.col("block") * groups, F.col("block") * groups + groups - 1))) \
                   .withColumn("kind", F.lit(0)).select(*sent)
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    shown = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * groups + group))) \
                .withColumn("kind", F.lit(1)).withColumn("windows", F.lit(None).cast("array<struct<low:bigint,high:bigint>>")).select(*sent)
    cells = blocks * groups
    dealt = asked.unionByName(shown).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "kind", "row")

    def search(batches):
        cell, held, block = None, [], None
        for batch in slices(batches, SLICE):
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "row", "vec_id", "label")}
            vectors = matrix(batch.column("v"), d)
            cuts = np.flatnonzero(np.diff(columns["cell"] * 2 + columns["kind"])) + 1
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
                if columns["cell"][at] != cell:
                    if block:
                        yield block.found()
                    cell, held, block = columns["cell"][at], [], None
                rows_, ids, labels = (columns[c][at:to] for c in ("row", "vec_id", "label"))
                if columns["kind"][at] == 0:
                    windows = batch.column("windows")[at:to].to_pylist()
                    held.append((rows_, labels, vectors[at:to], windows))
                    continue
                if not held:  # no anchor in this cell
                    continue
                if block is None:
                    a_rows, a_labels, a_vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
                    lists = [[Best(k)] if w is None else [Best(k, x["low"], x["high"]) for x in w] for h in held for w in h[3]]
                    block = Block(a_rows, a_labels, a_vectors, lists, same_label)
                block.scan(rows_, ids, labels, vectors[at:to])
        if block:
            yield block.found()

    return map_arrow(dealt, search, FOUND)


def _first(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every list of all cells, with their ``rank``."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         block_anchors: int = BLOCK, cell_rows: int = CELL) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each anchor and each of its ``positives`` best other
    rows of its label, the ``negatives`` best rows of other labels with ``low *
    positive_score <= 100 * negative_score <= high * positive_score`` (all, if
    there are fewer).  A score is the inner product of ``floor(scale * c)``;
    higher scores come first, ties by smaller id.

    Rows with a null id, a null label, a null vector or a component that is
    null, not finite or at least ``2^28 / scale`` take no part, nor do vectors
    of another length than the most common (the greater of two equally
    common).  Rows are told apart by their place in the table: repeated rows
    each count, as anchors, positives and negatives.  A positive with a negative
    score has no negatives, one with score 0 only those with score 0.  No
    anchors, or an empty table, give no rows.  Other columns are ignored.  The
    tables of rows and positives stay in the shared folder, as the result
    reads from them."""
    spark, path = rows.sparkSession, scratch_folder(rows.sparkSession, "negatives")
    some = rows_of(rows, id_col, label_col, vector_col, is_anchor, scale)
    # the numbers of the rows are fixed by writing them
    some.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    d = usual_length(table, "v")
    table = table.where(F.size("v") == d)
    n, n_anchors = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("anchor").cast("bigint")), F.lit(0))).first()
    if not d or not n_anchors:
        return spark.createDataFrame([], OUT)
    anchors, blocks = dealt_anchors(table.where("anchor"), n_anchors, d, block_anchors)
    groups = max(-(-n // cell_rows), min(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-n // SLICE)))
    table, anchors = table.select("row", "vec_id", "label", "v"), anchors.select("row", "block", "vec_id", "label", "v")
    no_window = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    best = _first(_cells(anchors.withColumn("windows", no_window), table, blocks, groups, d, True, positives), positives)
    best.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                F.col("score").alias("positive_score")).write.parquet(f"{path}/positives")
    found = spark.read.parquet(f"{path}/positives")
    # 100 * score from low * positive_score: rounded up; to high * positive_score: rounded down
    window = F.struct(F.col("place"), F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100L)) div 100)").alias("low"),
                      F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100").alias("high"))
    windows = found.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(window)).alias("_w")) \
                   .select("row", F.transform("_w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    negative = _first(_cells(anchors.join(windows, "row"), table, blocks, groups, d, False, negatives), negatives) \
        .select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negative.join(found, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
