"""Language identification with bit-sliced n-gram filters.

Every language has a Bloom filter of the letter trigrams that are typical of
it.  The filters are bit-sliced: slot ``s`` of one array holds, in bit ``L``,
slot ``s`` of language ``L``'s filter, so one look-up of ``hashes`` slots and
an AND returns the mask of all languages that contain a trigram.  Beyond 64
languages there is one more such array for each 64.  A text's
hits per language are the popcounts of its masks; the share of hits expected
from false positives alone is taken off, and the largest share decides.

Trigrams are counted over all learning rows.  A trigram is typical of a
language if its share among the language's trigrams is at least ``min_share``
and at least ``ratio`` of its largest share in any language.  At most
``1 / min_share`` trigrams per language can pass, which bounds the model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import checkpointed, held_out, is_held_out, map_arrow, slices, text_of

UNKNOWN = "und"
# Languages of one array of masks.
WORD = 64
# Trigrams below which the lack of known ones is no evidence against a text, and the part of a
# language's own share of known trigrams that a longer text in it has at least.
MIN_GRAMS, LEAST_PART = 20, 0.3
# Bytes of texts whose trigrams are counted at a time.
COUNT_BYTES = 1 << 22
_SPACE = 0x20
# Odd multipliers of the filters' hash functions.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

_letters: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters (Unicode L*)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0][codes]


def trigrams(text: str) -> np.ndarray:
    """Letter trigrams of the lower-cased text, a space standing for each edge
    of a word, as integers; empty if the text has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter(codes)
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.concatenate([[_SPACE], np.where(letter, codes, _SPACE), [_SPACE]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
    return (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[1:-1] != _SPACE]


def _slots(grams: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
    g = grams.astype(np.uint64)
    g = g ^ (g >> np.uint64(29))
    return [(g * m) >> np.uint64(64 - bits) for m in _MULTIPLIERS[:hashes]]


@dataclass
class Model:
    """Bit-sliced filters of ``languages``, each filter's false-positive rate and
    the share of its language's trigrams that it holds (``coverage``).
    ``masks`` holds the first 64 languages, ``more`` an array for each 64 after them."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    hashes: int
    bits: int
    common: int
    more: list[np.ndarray] = field(default_factory=list)
    coverage: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def shares(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Of a text's trigrams the share in each language's filter, less false
        positives, and their number; None if the text is null or has no letter, or nothing was learned."""
        grams = trigrams(text or "")
        if not len(grams) or not self.languages:
            return None, len(grams)
        slots, hits = _slots(grams, self.hashes, self.bits), []
        for masks in (self.masks, *self.more):
            found = masks[slots[0]]
            for slot in slots[1:]:
                found = found & masks[slot]
            n = min(WORD, len(self.languages) - len(hits))
            hits += [np.count_nonzero(found >> np.uint64(i) & np.uint64(1)) for i in range(n)]
        hits = np.array(hits)
        return np.clip((hits / len(grams) - self.false_rate) / (1 - self.false_rate), 0, None), len(grams)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score).  ``und`` with score 0 if the text is null or has no
        letter, or nothing was learned.  If no language has more hits than its
        filter's false positives, the commonest language with score 0; of equal
        shares the first language by name."""
        share, _ = self.shares(text)
        if share is None:
            return UNKNOWN, 0.0
        if not share.any():
            return self.languages[self.common], 0.0
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum())

    def known(self, text: str | None) -> bool:
        """False for ``und``, and for a text of at least ``MIN_GRAMS`` trigrams
        whose best share is below ``LEAST_PART`` of that language's own: noise, or a
        language that was not learned."""
        share, n = self.shares(text)
        if share is None:
            return False
        best = int(share.argmax())
        return n < MIN_GRAMS or bool(share[best] > LEAST_PART * self.coverage[best])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          min_share: float = 1e-5, ratio: float = 0.2, hashes: int = 4, bits: int = 20) -> Model:
    """Filters from all rows with a text and a language whose id is not held out."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches):
        for batch in slices(batches, 1024, COUNT_BYTES):
            texts = batch.to_pandas()
            for lang, some in texts.groupby("lang")["text"]:
                grams, n = np.unique(trigrams(" ".join(some)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

    # written once: read for the totals and for the shares
    counts = checkpointed(map_arrow(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r["lang"]: r["total"] for r in sums.collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(1, np.uint64), np.zeros(0), hashes, bits, 0)
    if len(languages) <= WORD:
        total = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(totals[lang]))])
        shares = counts.withColumn("share", F.col("n") / total[F.col("lang")])
    else:
        shares = counts.join(sums, "lang").withColumn("share", F.col("n") / F.col("total"))
    typical = shares.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).where(
        (F.col("share") >= min_share) & (F.col("share") >= ratio * F.col("top")))
    chosen = typical.select("lang", "gram", "share").toPandas()  # at most 1 / min_share rows a language
    masks, false_rate = [np.zeros(1 << bits, np.uint64) for _ in range(0, len(languages), WORD)], []
    by_lang, held = dict(list(chosen.groupby("lang")["gram"])), chosen.groupby("lang")["share"].sum().to_dict()
    for i, lang in enumerate(languages):
        grams = by_lang[lang].to_numpy(np.int64) if lang in by_lang else np.zeros(0, np.int64)
        own = np.zeros(1 << bits, bool)
        for slot in _slots(grams, hashes, bits):
            own[slot] = True
        masks[i // WORD] |= own.astype(np.uint64) << np.uint64(i % WORD)
        false_rate.append(own.mean() ** hashes)
    common = max(range(len(languages)), key=lambda i: totals[languages[i]])
    return Model(languages, masks[0], np.array(false_rate), hashes, bits, common, masks[1:], np.array([held.get(x, 0.0) for x in languages]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    A null text, and a text without a letter, is ``und``; every other text gets
    a learned language, of equal shares the first by name.  All trigrams of a
    very long text are looked up at once.  Each row is judged by its text alone, so repeated rows
    get the same answer.  An empty table gives no rows.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def of(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            found = [shared.value.classify(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([is_held_out(i) for i in ids], pa.bool_()),
                 pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(rows, of, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a known language, with all their
    columns; the others are ``und`` (null texts, texts without a letter) or in no
    language the model knows.  Short texts stay unless they are ``und``; a text is judged whole, a
    repeated row each time.  An empty table gives no rows, and a model that learned nothing keeps none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def of(batches):
        for batch in slices(batches):
            keep = [shared.value.known(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, of, docs.schema)
