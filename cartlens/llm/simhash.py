"""SimHash near-duplicates with BK-trees.

1. A 64-bit fingerprint of each whole text: the majority, bit by bit, of the
   XXH64 values of its word shingles.
2. Distinct fingerprints are dealt to shards.  Two fingerprints within
   ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits, so
   the shard of a fingerprint is (block, the bits in it) and every link lies
   inside some shard.  A shard above ``shard_rows`` is dealt again by blocks of
   the bits that are still free; after a few levels a shard can hold only the
   few values that its free bits allow, so no shard grows with the input.
3. Each shard builds a BK-tree (children keyed by their Hamming distance to
   the parent) and queries it for every member, following only edges within
   the radius.  The tree lives with its shard's rows; trees of all shards grow
   with the input and are not broadcast.  A shard returns its links as a
   spanning forest, at most one per member, never all pairs.
4. Components of the links by alternating large-star and small-star steps,
   checkpointed, until nothing changes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import checkpointed, map_arrow, partitions_of, slices, text_of

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned SimHash of a text: A-Z lower-cased, words split at ASCII white
    space, shingles of ``shingle_words`` words joined by a space, repeats
    included.  Fewer words: one shingle of them all; none: 0."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return _hash(joined)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    hashes = np.array([_hash(joined[a:b]) for a, b in zip(starts, ends[shingle_words - 1:].tolist())], dtype=">u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, tie, fp): ``fp`` is the fingerprint as a signed 64-bit value,
    ``tie`` a hash of the text that tells apart rows with the same id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"),
                       text_of(text_col).alias("text"))

    def of(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            fps = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(fps)], names=["doc_id", "tie", "fp"])

    return map_arrow(rows, of, "doc_id long, tie long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(free: int, n: int) -> list[int]:
    """Masks that split the bits of ``free`` into ``n`` blocks of near-equal width."""
    bits = [b for b in range(BITS) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // n:len(bits) * (i + 1) // n]) for i in range(n)]


class BKTree:
    """Values below a root; a child hangs at its Hamming distance to its parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Values of the tree within ``radius`` of ``value``, which is then added."""
        values, children, found = self.values, self.children, []
        values.append(value)
        children.append({})
        new = len(values) - 1
        if not new:
            return found
        stack = [0]
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(values[node])
            for edge, child in children[node].items():
                if -radius <= edge - d <= radius:
                    stack.append(child)
        node = 0
        while True:
            d = (values[node] ^ value).bit_count()
            child = children[node].get(d)
            if child is None:
                children[node][d] = new
                return found
            node = child


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``values``: (value, smallest linked value)."""
    tree, parent = BKTree(), {v: v for v in values}

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        for u in tree.near_then_add(v, radius):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(v, root(v)) for v in values if root(v) != v]


def _links_in_shards(shards: DataFrame, radius: int, parts: int) -> DataFrame:
    """Links of sorted shards (mask, key, fp); a shard is read from one partition in order."""
    placed = shards.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "fp")

    def of(batches):
        now, members = None, []

        def links():
            out = shard_links([m & (1 << BITS) - 1 for m in members], radius) if len(members) > 1 else []
            return [(_signed(a), _signed(b)) for a, b in out]

        for batch in batches:
            out = []
            for mask, key, fp in zip(*(batch.column(c).to_pylist() for c in ("mask", "key", "fp"))):
                if (mask, key) != now:
                    out += links()
                    now, members = (mask, key), []
                members.append(fp)
            yield _pairs(out)
        yield _pairs(links())

    return map_arrow(placed.select("mask", "key", "fp"), of, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def near_links(distinct: DataFrame, radius: int = 2, shard_rows: int = 1024, partitions: int | None = None) -> DataFrame:
    """Spanning links (a, b) of all distinct fingerprints ``fp`` within ``radius`` bits."""
    parts = partitions_of(distinct.sparkSession, partitions)
    todo, links = distinct.select("fp", F.lit(0).cast("long").alias("mask")), None
    masks = {0: _blocks((1 << BITS) - 1, radius + 1)}  # agreed bits -> blocks of the free bits
    while masks:
        per_mask = F.create_map(*[x for m, bs in masks.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(m | b)) for b in bs]))])
        dealt = (todo.select("fp", F.explode(per_mask[F.col("mask")]).alias("mask"))
                 .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
        counts = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = checkpointed(dealt.join(counts, ["mask", "key"]))
        masks = {m | b: _blocks(~(m | b) & (1 << BITS) - 1, radius + 1) for m, bs in masks.items() for b in bs}
        # a shard whose free bits allow few values is not dealt again
        masks = {m: bs for m, bs in masks.items() if 1 << (BITS - m.bit_count()) > 8 * shard_rows}
        again = F.col("n") > shard_rows
        again = again & F.col("mask").isin([_signed(m) for m in masks]) if masks else F.lit(False)
        found = _links_in_shards(rows.where(~again), radius, parts)
        links = found if links is None else links.unionByName(found)
        todo = rows.where(again).select("fp", "mask").distinct()
        if not masks or todo.isEmpty():
            break
    return links


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex ``a`` that is not the smallest of its component, with the smallest as ``b``."""
    def state(e):
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        return tuple(row)

    def stars(e: DataFrame, both: bool) -> DataFrame:
        # large star: larger neighbours to the smallest; small star: smaller ones to the smallest
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        if both:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = checkpointed(edges.where("a <> b").distinct())
    seen = state(now)
    while seen[0]:
        now = checkpointed(stars(stars(now, True), False))
        if (new := state(now)) == seen:
            break
        seen = new
    return now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                radius: int = 2, shard_rows: int = 1024, partitions: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``tie``, ``fp`` (signed), ``component_id``
    (smallest id reachable over links of at most ``radius`` bits) and
    ``component_tie`` (its ``tie``: the row that stands for the group is the one
    with both).

    A null text counts as empty; texts without words have fingerprint 0 and are
    linked like any other.  Null ids are passed over in the choice of the
    smallest unless a group has nothing else.  Rows repeated with one id each
    get a row.  A very long text is read whole; its shingles are hashed and
    counted as they come.  An empty table gives no rows.  Other columns are
    ignored.  The trees of a shard stay with its rows and are not broadcast, as
    all of them together grow with the input.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    distinct = checkpointed(rows.groupBy("fp").agg(first.alias("rep")))
    tops = components(near_links(distinct, radius, shard_rows, partitions))
    placed = distinct.join(tops.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("b", "fp").alias("top"))
    least = placed.groupBy("top").agg(F.min("rep").alias("rep"))
    named = placed.select("fp", "top").join(least, "top").select("fp", "rep")
    return rows.join(named, "fp").select(
        "doc_id", "tie", "fp", F.col("rep.doc_id").alias("component_id"), F.col("rep.tie").alias("component_tie"))


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                     radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stand for their groups, with all their columns.
    Rows repeated with one id and one text stay or go together.  Null and empty
    texts are one group (fingerprint 0); of a group the row with the smallest id stays, a null
    id only where there is no other.  Texts are compared whole.  An empty table gives no rows."""
    groups = near_groups(docs, id_col, text_col, shingle_words, radius)
    gone = groups.where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("component_tie"))))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie")).distinct()
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).cast("bigint").alias("_own_id"),
                         F.xxhash64(text_of(text_col)).alias("_own_tie"))
    same = F.col("_own_id").eqNullSafe(F.col("_gone_id")) & (F.col("_own_tie") == F.col("_gone_tie"))
    return marked.join(gone, same, "left_anti").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
