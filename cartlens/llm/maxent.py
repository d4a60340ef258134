"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words of a text and one end.  The outputs of the model are

* the head: the most frequent words, ``width`` to a class;
* the tail: the other listed words, one class;
* the rest: all other training words and one unknown word, one class.

``P(token | before) = P(class | before) * P(word | class, before)``.  Both
factors of a head word are log-linear in three features of the words before
it: the last word (bigram), the last two (trigram), and the last but one
(skip).  A feature is hashed to a row of weights, one for each class, or, inside a class,
one for each of its words.  With all weights zero both factors are the base
model ``(c + 1) / (N + V + 1)``; inside the tail and the rest words keep it.
So every probability is positive and they sum to 1 over the ``V`` training
words and the unknown word.

Training is by synchronous gradient rounds over all training tokens.  A task
adds up its part of the gradient, observed minus expected uses of every
weight, as whole numbers; the parts are summed by piece of the weights in
parallel, and every weight moves by ``rate * (observed - expected) / (observed
+ expected + damping)``.  The observed uses, and the expected ones of the first round
(the base model's), come with the encoding; in later rounds each token's
expected use is a draw from the model's own distribution at that place, which
has the right mean.

What is broadcast is the listed words (at most ``max_words``) and the weights;
both are parameters, not sizes of the corpus.  The counts of all other words
stay in a table and are joined to the few places that need them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import map_arrow, pieces_of, slices, summed, text_of, words_of
from cartlens.runtime import scratch_folder

END = b""
# Distinct words a task counts before it sends them on; tokens scored at a time; uses added up at a time.
WORDS, BATCH, USES = 1 << 19, 1 << 12, 1 << 20
# Buckets of counts, so many for each factor of two.
OCTAVE = 64
FEATURES = 3

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def training(doc_id: Column) -> Column:
    """True for the documents that are learned from: crc32 of the id as text,
    modulo 7, is not 2.  A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def token_counts(docs: DataFrame, text: Column) -> DataFrame:
    """(word, n): occurrences of every token, the end included."""
    def count(batches):
        seen = Counter()

        def counted():
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for words in words_of(text):
                    seen.update(words)
                seen[END] += 1
            if len(seen) >= WORDS:
                yield counted()
        if seen:
            yield counted()

    return map_arrow(docs.select(text.alias("text")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Outputs:
    """The listed words and what they are outputs of; ids are ranks by count."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int               # N
    distinct: int             # V
    width: int                # words of a head class
    max_classes: int

    def __post_init__(self) -> None:
        n, total = len(self.words), self.tokens + self.distinct + 1
        self.head = min(n, self.width * self.max_classes)
        self.classes = -(-self.head // self.width)
        self.mass = self.counts + 1.0
        self.rest = total - int(self.counts.sum()) - n           # of the rest: sum of c + 1, and 1 for the unknown word
        self.log_base = np.concatenate([np.log(self.mass / total), [0.0]])
        own = np.zeros((max(self.classes, 1), self.width))
        own.ravel()[:self.head] = self.mass[:self.head]
        per_class = np.concatenate([own.sum(axis=1)[:self.classes], [self.mass[self.head:].sum(), self.rest]])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_class = np.maximum(np.log(per_class / total), -1e30).astype(np.float32)
            inside = np.log(own / own.sum(axis=1, keepdims=True))
            tail = np.log(self.mass[self.head:] / max(per_class[self.classes], 1.0))
        self.log_word = np.where(np.isfinite(inside), inside, -1e30).astype(np.float32)
        self.log_inside = np.concatenate([np.zeros(self.head), tail, [0.0]])  # of tail words in their class

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.head, ids // self.width, np.where(ids < len(self.words), self.classes, self.classes + 1))


def outputs(counts: DataFrame, width: int, max_classes: int, max_words: int) -> tuple[Outputs, int]:
    """The most frequent words, in whole buckets of like counts, at most
    ``max_words``; and the lowest bucket among them.  What reaches the driver is
    these words and one row per bucket."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = sorted(((r["bucket"], r["size"]) for r in counts.groupBy(bucket(F.col("n")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    lowest, held = 1 << 30, 0
    for at, size in sizes:
        held += size
        if held > max_words:
            break
        lowest = at
    table = counts.where(bucket(F.col("n")) >= lowest).toArrow()
    words = sorted(zip(table.column("n").to_pylist(), table.column("word").to_pylist()), key=lambda p: (-p[0], p[1]))
    return Outputs([w for _, w in words], np.array([c for c, _ in words], np.int64), n, v, width, max_classes), lowest


def bucket(n: Column) -> Column:
    return F.floor(F.log2(n) * OCTAVE).cast("int")


@dataclass
class Weights:
    """Rows of weights: ``by_class`` (hashed feature, class), ``by_word`` (class
    and hashed feature, word of the class)."""

    by_class: np.ndarray
    by_word: np.ndarray

    @classmethod
    def zeros(cls, out: Outputs, class_bits: int, word_bits: int) -> Weights:
        return cls(np.zeros((1 << class_bits, out.classes + 2), np.float32),
                   np.zeros((max(out.classes, 1) << word_bits, out.width), np.float32))

    @property
    def size(self) -> int:
        return self.by_class.size + self.by_word.size

    def flat(self) -> np.ndarray:
        return np.concatenate([self.by_class.ravel(), self.by_word.ravel()])

    def moved(self, step: np.ndarray) -> Weights:
        cut = self.by_class.size
        return Weights(self.by_class + step[:cut].reshape(self.by_class.shape).astype(np.float32),
                       self.by_word + step[cut:].reshape(self.by_word.shape).astype(np.float32))


def contexts(texts: list[np.ndarray], listed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (text number, id, last word, last but one) of the tokens of texts;
    before a text stands the number after the last id."""
    start, held, size = listed + 1, [], 0
    for i, ids in enumerate(texts):
        padded = np.concatenate([[start, start], ids.astype(np.int64)])
        for at in range(0, len(ids), BATCH):
            to = min(at + BATCH, len(ids))
            held.append((np.full(to - at, i), padded[at + 2:to + 2], padded[at + 1:to + 1], padded[at:to]))
            size += to - at
            if size >= BATCH:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def hashed(last: np.ndarray, before: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of the bigram, trigram and skip feature."""
    a, b = last.astype(np.uint64) + np.uint64(1), before.astype(np.uint64) + np.uint64(1)
    keys = (a * _MIX[0], a * _MIX[1] ^ (b * _MIX[0] + _FOLD), b * _MIX[2])
    return [(((k ^ (k >> np.uint64(31))) * _FOLD) >> np.uint64(64 - bits)).astype(np.int64) for k in keys]


class Places:
    """The rows of weights that a batch of tokens uses."""

    def __init__(self, out: Outputs, ids: np.ndarray, last: np.ndarray, before: np.ndarray, class_bits: int, word_bits: int):
        self.cls = out.class_of(ids)
        self.class_rows = hashed(last, before, class_bits)
        self.at = np.flatnonzero(ids < out.head)
        self.head_class, self.word = self.cls[self.at], ids[self.at] % out.width
        base = self.head_class << word_bits
        self.word_rows = [base + r for r in hashed(last[self.at], before[self.at], word_bits)]


def used(places: Places, weights: Weights, cls: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Flat numbers of the weights that classes and words use at these places."""
    wide, cut = weights.by_class.shape[1], weights.by_class.size
    return [*[r * wide + cls for r in places.class_rows], *[cut + r * weights.by_word.shape[1] + word for r in places.word_rows]]


def powers(table: np.ndarray, rows: list[np.ndarray], offset: np.ndarray) -> np.ndarray:
    """exp of the logits; they stay small, as a round moves a weight by ``rate`` at most."""
    logits = table[rows[0]]
    for r in rows[1:]:
        logits += table[r]
    logits += offset
    return np.exp(logits, out=logits)


def drawn(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each row of weights a column, drawn in proportion."""
    up_to = np.cumsum(p, axis=1)
    at = rng.random(len(p), np.float32) * up_to[:, -1]
    return (up_to >= at[:, None]).argmax(axis=1)


class Tally:
    """Uses of every weight."""

    def __init__(self, size: int):
        self.total, self.held, self.n = np.zeros(size, np.int64), [], 0

    def add(self, numbers: list[np.ndarray]) -> None:
        self.held += numbers
        self.n += sum(map(len, numbers))
        if self.n >= USES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=len(self.total))
        self.held, self.n = [], 0

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        return pieces_of(self.total)


def log_probability(out: Outputs, weights: Weights, ids, last, before, class_bits: int, word_bits: int) -> np.ndarray:
    """Natural logs of the tokens' probabilities; of a token of the rest only its class's."""
    places = Places(out, ids, last, before, class_bits, word_bits)
    p = powers(weights.by_class, places.class_rows, out.log_class)
    logs = np.log(p[np.arange(len(ids)), places.cls] / p.sum(axis=1)).astype(float) + out.log_inside[np.minimum(ids, len(out.words))]
    if len(places.at):
        p = powers(weights.by_word, places.word_rows, out.log_word[places.head_class])
        logs[places.at] += np.log(p[np.arange(len(p)), places.word] / p.sum(axis=1))
    return logs


ROWS = ("piece int, uses binary, key long, doc_id long, held_out boolean, n_tokens long, ids binary, "
        "rest array<struct<word: binary, n: bigint>>")
_REST = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
_KINDS = pa.schema([("piece", pa.int32()), ("uses", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
                    ("n_tokens", pa.int64()), ("ids", pa.binary()), ("rest", _REST)])

_ranks: list[tuple[Outputs, dict[bytes, int]]] = []


def ranks(out: Outputs) -> dict[bytes, int]:
    """Number of every listed word, made once per worker for a broadcast."""
    if not _ranks or _ranks[0][0] is not out:
        _ranks[:] = [(out, {w: i for i, w in enumerate(out.words)})]
    return _ranks[0][1]


def encoded(docs: DataFrame, id_col: str, text_col: str, is_training: Column, shared, shape: tuple[int, int]) -> DataFrame:
    """One row per text: ids of its tokens, and its words of the rest with how
    often they occur; after them, from each task, the observed uses of all
    weights by its training texts, in pieces."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"),
                       (~is_training).alias("held_out"))

    def encode(batches):
        out = shared.value
        rank, listed = ranks(out), len(out.words)
        weights = Weights.zeros(out, *shape)
        key, tally = TaskContext.get().partitionId() << 33, Tally(weights.size)
        for batch in slices(batches):
            texts, rests = [], []
            for text in batch.column("text").to_pylist():
                ids, rest = [], Counter()
                for words in words_of(text):
                    numbers = np.fromiter(map(rank.get, words, repeat(listed)), np.uint32, len(words))
                    rest.update([words[i] for i in np.flatnonzero(numbers == listed)])
                    ids.append(numbers)
                end = rank.get(END, listed)
                rest.update([END] if end == listed else [])
                texts.append(np.concatenate([*ids, np.array([end], np.uint32)]))
                rests.append([{"word": w, "n": n} for w, n in rest.items()])
            learn = [ids for ids, away in zip(texts, batch.column("held_out").to_pylist()) if not away]
            for _, ids, last, before in contexts(learn, listed):
                places = Places(out, ids, last, before, *shape)
                tally.add(used(places, weights, places.cls, places.word))
            m = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(np.arange(key, key + m)), batch.column("doc_id"),
                 batch.column("held_out"), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary()),
                 pa.array(rests, _REST)], schema=_KINDS)
            key += m
        for piece, uses in tally.pieces():
            yield pa.RecordBatch.from_pylist([{"piece": piece, "uses": uses}], schema=_KINDS)

    return map_arrow(rows, encode, ROWS)


def expected(texts: DataFrame, shared_out, shared_weights, shape: tuple[int, int], seed: int) -> DataFrame:
    """(piece, uses): for each task the uses of all weights that the model
    expects at the places of the training tokens, one draw each."""
    def draw(batches):
        out, weights = shared_out.value, shared_weights.value
        tally = Tally(weights.size)
        for batch in slices(batches):
            rng = np.random.default_rng([seed, batch.column("key")[0].as_py()])
            for _, ids, last, before in contexts([np.frombuffer(raw, np.uint32) for raw in batch.column("ids").to_pylist()], len(out.words)):
                places = Places(out, ids, last, before, *shape)
                cls = drawn(powers(weights.by_class, places.class_rows, out.log_class), rng)
                word = drawn(powers(weights.by_word, places.word_rows, out.log_word[places.head_class]), rng)
                tally.add(used(places, weights, cls, word))
        for piece, uses in tally.pieces():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([uses], pa.binary())], names=["piece", "uses"])

    return map_arrow(texts, draw, "piece int, uses binary")


def expected_of_base(out: Outputs, weights: Weights, observed: np.ndarray) -> np.ndarray:
    """Expected uses while all weights are zero: the uses of a row, shared out as
    the base model does."""
    cut = weights.by_class.size
    rows, words = observed[:cut].reshape(weights.by_class.shape), observed[cut:].reshape(weights.by_word.shape)
    inside = np.repeat(np.exp(out.log_word), len(words) // len(out.log_word), axis=0)
    return np.concatenate([(rows.sum(axis=1, keepdims=True) * np.exp(out.log_class)).ravel(),
                           (words.sum(axis=1, keepdims=True) * inside).ravel()])


@dataclass
class Model:
    """A fitted model and the encoded texts it was fitted on."""

    out: Outputs
    weights: Weights
    shape: tuple[int, int]
    counts: DataFrame         # (word, n) of all training tokens
    lowest: int               # the lowest bucket of counts among the listed words
    texts: DataFrame          # (key, doc_id, held_out, n_tokens, ids, rest) of all rows


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_training: Column | None = None, rounds: int = 2,
          rate: float = 1.2, damping: float = 10.0, width: int = 64, classes: int = 32, max_words: int = 1 << 18,
          class_bits: int = 15, word_bits: int = 11) -> Model:
    """The model of all training rows (by default ``training`` of the id), and
    all rows encoded for ``score``.

    ``rounds`` gradient rounds; ``width * classes`` head words; ``2^class_bits``
    rows of class weights and ``2^word_bits`` rows of word weights per class.
    See ``score`` for nulls and odd rows."""
    spark = docs.sparkSession
    is_training = training(F.col(id_col)) if is_training is None else F.coalesce(is_training, F.lit(False))
    folder, shape = scratch_folder(spark, "maxent"), (class_bits, word_bits)
    token_counts(docs.where(is_training), text_of(text_col)).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    out, lowest = outputs(counts, width, classes, max_words)
    shared = spark.sparkContext.broadcast(out)
    encoded(docs, id_col, text_col, is_training, shared, shape).write.parquet(f"{folder}/texts")
    rows = spark.read.parquet(f"{folder}/texts")
    texts = rows.where("key is not null").drop("piece", "uses")
    weights = Weights.zeros(out, *shape)
    observed = summed(rows.where("piece is not null").select("piece", "uses"), weights.size)
    for k in range(rounds):
        if k == 0:
            wanted = expected_of_base(out, weights, observed)
        else:
            shared_weights = spark.sparkContext.broadcast(weights)
            wanted = summed(expected(texts.where("not held_out").select("key", "ids"), shared, shared_weights, shape, k), weights.size)
            shared_weights.unpersist()
        weights = weights.moved(rate * (observed - wanted) / (observed + wanted + damping))
    return Model(out, weights, shape, counts, lowest, texts)


def score(model: Model) -> DataFrame:
    """One row per row of the documents given to ``learn``: ``doc_id``,
    ``held_out`` (not learned from), ``n_tokens``, ``n_known`` (tokens that
    occur in training), ``train_tokens``, ``base_score`` and ``score``, the log10 probability of
    the whole text by the base model and by the model.

    A null or empty text is the end alone.  Rows with a null or repeated id are
    scored each.  Texts are cut into words a piece at a time and scored in
    batches of tokens, so a very long text needs its ids, not more.  Words of
    equal count are ranked by their bytes.  With no training rows every token
    is unknown and both scores are 0; an empty table gives no rows.  Other
    columns are ignored."""
    texts, out, shape = model.texts, model.out, model.shape
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((out, model.weights))
    n, total = len(out.words), out.tokens + out.distinct + 1
    ten = np.log(10)

    def run(batches):
        out, weights = shared.value
        for batch in slices(batches):
            ids_of = [np.frombuffer(raw, np.uint32) for raw in batch.column("ids").to_pylist()]
            m = len(ids_of)
            listed, base, own = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            for text, ids, last, before in contexts(ids_of, n):
                listed += np.bincount(text, ids < n, m).astype(np.int64)
                base += np.bincount(text, out.log_base[ids], m)
                own += np.bincount(text, log_probability(out, weights, ids, last, before, *shape), m)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "doc_id", "held_out", "n_tokens")], pa.array(listed), pa.array(base / ten), pa.array(own / ten)],
                names=["key", "doc_id", "held_out", "n_tokens", "listed", "base", "own"])

    scored = map_arrow(texts.select("key", "doc_id", "held_out", "n_tokens", "ids"), run,
                       "key long, doc_id long, held_out boolean, n_tokens long, listed long, base double, own double")
    # the words of the rest: their counts are joined, a text at a time they are summed
    unlisted = model.counts.where(bucket(F.col("n")) < model.lowest).select("word", F.col("n").alias("c"))
    rest = texts.where(F.size("rest") > 0).select("key", F.inline("rest")).join(unlisted, "word", "left")
    sums = rest.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).alias("logs"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("listed") + zero("known")).alias("n_known"),
        F.lit(out.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("logs") - zero("n") * float(np.log10(total))).alias("base_score"),
        (F.col("own") + zero("logs") - zero("n") * float(np.log10(out.rest))).alias("score"))
