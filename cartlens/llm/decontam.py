"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as lower-cased letters and digits with single spaces
between them, so case, punctuation and line breaks do not hide a passage.
Benchmark items are cut into overlapping chunks.  A chunk of ``w`` characters
occurs in a document with at most ``e = floor(rate * w)`` edits only if it
shares at least ``w + 1 - q (e + 1)`` q-grams with it inside ``e + 1``
neighbouring diagonals (document position minus chunk position).  Shared
q-grams are counted in diagonal bands of width ``2 (e + 1)`` that overlap by
half, so every such run of diagonals lies whole in one band; bands that reach
the count within the chunk's length are regions, and each region is verified
by an edit-distance alignment restricted to its band.

Q-grams that very many chunks share (a common phrase) would give each
document a pair for every such chunk.  A chunk defers up to one less than its needed
count of its most common q-grams: a match must still share ``needed - deferred``
others, and only chunks that do have their deferred q-grams counted too.  So
the lemma holds, and the pairs of a document stay in proportion to its length.

Items too short for a chunk with edits are searched as whole words, without edits.

The documents are scanned once per block of benchmark items, one block at a
time.  A block has a bounded number of characters, which bounds the index
every task holds; the documents are never joined with anything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import map_arrow, slices, text_of
from cartlens.runtime import delete_folder, scratch_folder

CHUNK, RATE, Q, MIN_CHARS = 100, 0.1, 8, 40
# Chunks that share a q-gram from which on it can be deferred; pairs looked at at a time.
COMMON, PAIRS = 64, 1 << 21
# Benchmark characters indexed at a time.
BLOCK_CHARS = 4_000_000

_FILTER_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_alnum: list[np.ndarray] = []


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points compared, and the place of each in the text."""
    if not _alnum:
        _alnum.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000))
    low = text.lower()
    if len(low) != len(text):  # a few letters lower to two; keep places true
        low = "".join(c.lower()[0] for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = _alnum[0][codes]
    codes = np.where(kept, codes, 0x20)
    if len(codes):
        keep = kept.copy()
        keep[1:] |= kept[:-1]
        keep[0] = kept[0]
        at = np.flatnonzero(keep)
        return codes[at], at
    return codes, np.zeros(0, np.int64)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, wide = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for i in range(q):
        h = h * _MULTIPLIER + wide[i:n + i]
    return h ^ (h >> np.uint64(31))


def banded_distances(chunks: np.ndarray, docs: list[np.ndarray], firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a chunk (row of ``chunks``) and a document: the fewest
    edits that turn the chunk into a part of the document on diagonals ``first``
    to ``first + width - 1``, and the end of that part."""
    n, size = chunks.shape
    padded = np.full((n, size + width), -1, dtype=np.int32)
    for k, (doc, first) in enumerate(zip(docs, firsts.tolist())):
        low, high = max(first, 0), min(first + size + width, len(doc))
        if low < high:
            padded[k, low - first:high - first] = doc[low:high]
    row, step = np.zeros((n, width), np.int32), np.arange(width, dtype=np.int32)
    for i in range(size):
        new = row + (padded[:, i:i + width] != chunks[:, i:i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - step, axis=1) + step
    best = row.argmin(axis=1)
    return row[np.arange(n), best], firsts + size + best


@dataclass
class Index:
    """Q-gram index of the chunks of a block of benchmark items."""

    q: int
    item_ids: list
    item_of: np.ndarray
    chunks: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray
    gram_from: np.ndarray
    gram_chunk: np.ndarray
    gram_at: np.ndarray
    seen: np.ndarray
    first_need: np.ndarray      # of the q-grams that are not deferred
    late_from: np.ndarray       # deferred q-grams of each chunk: numbers and places
    late_gram: np.ndarray
    late_at: np.ndarray
    short: dict[int, list[tuple[int, np.ndarray]]]   # short items by length: (item, codes)

    @classmethod
    def build(cls, items: list[tuple], q: int, chunk: int, rate: float, min_chars: int, common: int = COMMON) -> Index:
        ids, chunks, item_of, short = [], [], [], {}
        for item_id, text in items:
            codes, _ = normalised(text or "")
            codes = codes[:-1] if len(codes) and codes[-1] == 0x20 else codes
            if not len(codes):
                continue
            ids.append(item_id)
            if len(codes) < min_chars:
                short.setdefault(len(codes), []).append((len(ids) - 1, codes))
                continue
            last = max(len(codes) - chunk, 0)
            for at in sorted({*range(0, last + 1, chunk // 2), last}):
                chunks.append(codes[at:at + chunk])
                item_of.append(len(ids) - 1)
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        edits = np.floor(rate * sizes).astype(np.int64)
        needed = np.maximum(sizes + 1 - q * (edits + 1), 1)
        hashes = [gram_hashes(c, q) for c in chunks]
        grams = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(chunks)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[grams >> np.uint64(64 - _FILTER_BITS)] = True
        distinct, number, times = np.unique(grams, return_inverse=True, return_counts=True)
        # of each chunk the most common q-grams are deferred, fewer than it needs
        order = np.lexsort((-times[number], owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], np.arange(len(chunks)))[owner[order]] if len(order) else order
        late = np.zeros(len(grams), bool)
        late[order] = (times[number[order]] > common) & (rank < needed[owner[order]] - 1)
        by_gram = np.flatnonzero(~late)
        by_gram = by_gram[np.argsort(number[by_gram], kind="stable")]
        by_chunk = np.flatnonzero(late)  # in order of chunks already
        return cls(q, ids, np.array(item_of, dtype=np.int64), chunks, edits, needed, sizes, distinct,
                   np.searchsorted(number[by_gram], np.arange(len(distinct) + 1)), owner[by_gram], place[by_gram], seen,
                   needed - np.bincount(owner[by_chunk], minlength=len(chunks)),
                   np.searchsorted(owner[by_chunk], np.arange(len(chunks) + 1)), number[by_chunk], place[by_chunk], short)

    def _pairs(self, low: np.ndarray, n: np.ndarray):
        """Numbers of postings, in pieces of about ``PAIRS``: (which q-gram of the text, posting)."""
        ends, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            many = n[at:to]
            yield np.repeat(np.arange(at, to), many), np.repeat(low[at:to] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = to

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, diagonal, document position) of the q-grams shared with a
        text, for the chunks that share enough of them; in order of position."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        gram = np.searchsorted(self.grams, hashes[at])
        known = gram < len(self.grams)
        at, gram = at[known], gram[known]
        known = self.grams[gram] == hashes[at]
        at, gram = at[known], gram[known]
        low = self.gram_from[gram]
        n = self.gram_from[gram + 1] - low
        pieces = self._pairs(low, n)
        if n.sum() <= PAIRS:  # one piece, kept
            pieces = list(pieces)
        counts = np.zeros(len(self.chunks), np.int64)
        for _, posting in pieces:
            counts += np.bincount(self.gram_chunk[posting], minlength=len(counts))
        wanted = counts >= self.first_need
        if not wanted.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        found = []
        for which, posting in pieces if isinstance(pieces, list) else self._pairs(low, n):
            keep = wanted[self.gram_chunk[posting]]
            found.append((self.gram_chunk[posting[keep]], at[which[keep]], self.gram_at[posting[keep]]))
        some = np.flatnonzero(wanted)
        much = self.late_from[some + 1] - self.late_from[some]
        if much.any():  # the deferred q-grams of these chunks, wherever the text has them
            by_gram = np.argsort(gram, kind="stable")
            ordered = gram[by_gram]
            late = np.repeat(self.late_from[some] - np.cumsum(much) + much, much) + np.arange(much.sum())
            start = np.searchsorted(ordered, self.late_gram[late], "left")
            times = np.searchsorted(ordered, self.late_gram[late], "right") - start
            owner = np.repeat(some, much)
            for which, spot in self._pairs(start, times):
                found.append((owner[which], at[by_gram[spot]], self.late_at[late[which]]))
        chunk, place, inside = (np.concatenate(c) for c in zip(*found))
        if len(found) > 1:
            keep = (np.bincount(chunk, minlength=len(self.chunks)) >= self.needed)[chunk]
            chunk, place, inside = chunk[keep], place[keep], inside[keep]
            order = np.argsort(place, kind="stable")
            chunk, place, inside = chunk[order], place[order], inside[order]
        return chunk, place - inside, place

    def short_hits(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, place) of the first whole-word occurrence of each short item."""
        out = []
        for size, items in self.short.items():
            if size > len(codes):
                continue
            hashes = gram_hashes(codes, size)
            edge = np.concatenate([[True], codes[:-1] == 0x20])[:len(hashes)]
            after = np.concatenate([codes[size:] == 0x20, [True]])
            spots = np.flatnonzero(edge & after)
            spots = spots[np.argsort(hashes[spots], kind="stable")]
            for item, own in items:
                h = gram_hashes(own, size)[0]
                low, high = np.searchsorted(hashes[spots], h, "left"), np.searchsorted(hashes[spots], h, "right")
                same = [int(p) for p in spots[low:high] if (codes[p:p + size] == own).all()]
                if same:
                    out.append((item, min(same)))
        return out

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(chunk, band) of the bands that meet the lemma."""
        chunk, diagonal, place = self.shared(codes)
        if not len(chunk):
            return []
        band = diagonal // (self.edits[chunk] + 1)
        chunk, place = np.repeat(chunk, 2), np.repeat(place, 2)
        band = np.stack([band, band - 1], axis=1).ravel()
        # bands are told apart by their number in the document, which is a key once chunks are spread
        key = chunk * (2 * len(codes) + 4096) + band + 2048
        cell = key & 0x3FFF
        some = (np.bincount(cell, minlength=0x4000)[cell]) >= self.needed[chunk]
        chunk, band, place, key = chunk[some], band[some], place[some], key[some]
        order = np.argsort(key, kind="stable")
        chunk, band, place, key = chunk[order], band[order], place[order], key[order]
        last = np.arange(len(key)) + self.needed[chunk] - 1
        i = np.flatnonzero(last < len(key))
        j = last[i]
        good = (key[i] == key[j]) & (place[j] - place[i] + self.q <= (self.sizes + self.edits)[chunk[i]])
        first = i[good][np.unique(key[i[good]], return_index=True)[1]]
        return list(zip(chunk[first].tolist(), band[first].tolist()))

    def leaks(self, texts: list[str], short: bool = True) -> list[list[tuple]]:
        """For each text: (item id, start, end, edits) of each item of which it
        holds a chunk, by the verified chunk with the fewest edits."""
        read = [normalised(t) for t in texts]
        by_shape: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, (codes, _) in enumerate(read):
            for c, band in self.regions(codes):
                by_shape.setdefault((len(self.chunks[c]), int(self.edits[c])), []).append((t, c, band))
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for (size, budget), found in by_shape.items():
            for at in range(0, len(found), 4096):
                some = found[at:at + 4096]
                edits, ends = banded_distances(
                    np.stack([self.chunks[c] for _, c, _ in some]).astype(np.int32), [read[t][0] for t, _, _ in some],
                    np.array([band * (budget + 1) for _, _, band in some]), 2 * (budget + 1))
                for (t, c, _), n, end in zip(some, edits.tolist(), ends.tolist()):
                    item, places = int(self.item_of[c]), read[t][1]
                    end = min(max(end, 1), len(places))
                    hit = (self.item_ids[item], int(places[max(end - size, 0)]), int(places[end - 1]) + 1, n)
                    # fewest edits, then the first place
                    if n <= budget and (item not in best[t] or (n, hit[1]) < (best[t][item][3], best[t][item][1])):
                        best[t][item] = hit
        if short and self.short:
            for t, (codes, places) in enumerate(read):
                for item, at in self.short_hits(codes):
                    size = next(len(c) for group in self.short.values() for i, c in group if i == item)
                    best[t][item] = (self.item_ids[item], int(places[at]), int(places[at + size - 1]) + 1, 0)
        return [[b[i] for i in sorted(b)] for b in best]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The benchmark in blocks of about ``block_chars`` characters."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), text_of(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]


def _indexes(docs, benchmark, id_col, text_col, q, chunk, rate, min_chars, block_chars):
    """The index of each block, broadcast; when the next is asked for, the one before is destroyed."""
    for items in _blocks(benchmark, id_col, text_col, block_chars):
        index = Index.build(items, q, chunk, rate, min_chars)
        if index.item_ids:
            shared = docs.sparkSession.sparkContext.broadcast(index)
            yield shared
            shared.unpersist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", q: int = Q, chunk: int = CHUNK,
               rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item of which the document holds a
    chunk within the edit budget: ``doc_id``, ``item_id``, ``start``, ``end``
    (code points of the document, the verified chunk) and ``edits``.  Of several chunks of an item the
    one with the fewest edits counts, then the first place.

    Items of fewer than ``min_chars`` compared characters are found as whole
    words without edits, at their first place.  Null items, and items without a letter or digit, are
    passed over; a null text holds nothing.  Texts are compared whole; the pairs looked at for a very long one are
    held ``PAIRS`` at a time.
    Items with one text each give a row, and so do repeated documents; an item
    repeated with the same id counts once for each row of it.  Empty tables
    give no rows.  Other columns are ignored.  The hits of each block of items
    are written to the shared folder, where the result reads them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, item_id long, start long, `end` long, edits int"
    folder, n = scratch_folder(spark, "leaks"), 0
    for index in _indexes(docs, benchmark, item_col, item_text_col, q, chunk, rate, min_chars, block_chars):
        map_arrow(rows, _finder(index), schema).write.mode("append").parquet(folder)
        n += 1
    return spark.read.schema(schema).parquet(folder) if n else spark.createDataFrame([], schema)


def _finder(index):
    def of(batches):
        for batch in slices(batches):
            found = index.value.leaks(batch.column("text").to_pylist())
            rows = [(doc_id, *leak) for doc_id, leaks in zip(batch.column("doc_id").to_pylist(), found) for leak in leaks]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32())],
                names=["doc_id", "item_id", "start", "end", "edits"])
    return of


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", q: int = Q, chunk: int = CHUNK, rate: float = RATE,
               min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark chunk, with all their columns.

    As in ``find_leaks``, but items below ``min_chars`` are no reason to drop a
    document: a few common words are no passage.  Rows with a null or empty text stay, and so
    do all rows of a table compared with an empty benchmark; repeated rows are judged each.  With several blocks of
    items the rows kept after each are written, so that one index is alive at a time."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    out, waiting, folder, n = docs, None, scratch_folder(spark, "kept"), 0

    def of(index):
        def keep(batches):
            for batch in slices(batches):
                leaks = index.value.leaks([t or "" for t in batch.column(at).to_pylist()], short=False)
                yield batch.filter(pa.array([not x for x in leaks], pa.bool_()))
        return keep

    for index in _indexes(docs, benchmark, item_col, item_text_col, q, chunk, rate, min_chars, block_chars):
        if waiting is not None:
            waiting.write.parquet(f"{folder}/{n}")
            out = spark.read.parquet(f"{folder}/{n}")
            if n:
                delete_folder(spark, f"{folder}/{n - 1}")
            n += 1
        waiting = map_arrow(out, of(index), docs.schema)
    return docs if waiting is None else waiting
