"""Toxicity by maximum-scoring segments.

1. Learning uses labelled rows that are not held out, at most ``max_labelled``
   of them (chosen by a hash of the id), so the broadcast list of labels has a
   proven bound; every text is scored.
2. A word's features are the word and its prefixes of 4 to 6 letters, which
   carry over to other inflections.  A feature that more toxic texts hold than
   chance allows (binomial tail, corrected for the number of features tried)
   gets the log-odds of its counts under an informative Dirichlet prior, the
   pooled counts scaled to ``prior`` of their weight.  A word scores its best
   feature; every other word costs a small ``drift``, the log-odds of a neutral
   word.
3. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a
   text, so every toxic passage, not only the best one.
4. Segments are calibrated by extreme-value theory.  The scores are
   log-likelihood ratios, so lambda is 1, and K is fitted to the clean learning
   texts: a segment of score S in n words has E = K n exp(-S).  A text's
   statistic adds up the bits -ln E of its significant segments, and a logistic
   curve fitted to the learning texts turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import checkpointed, held_out, is_held_out, map_arrow, slices, text_of

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
_CACHE_WORDS = 500_000
# Sums closer than this are equal: a segment has no start that adds up to 0, whatever the rounding.
_EQUAL = 1e-9


def features(word: str) -> list[str]:
    """The word, and its prefixes marked with ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that scores ``drift`` (below
    0) everywhere but at ``hits`` (position, positive score), in linear time:
    (first position, last position, score)."""
    segments: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum through
    total, at = 0.0, 0
    for position, score in hits:
        total += drift * (position - at)
        at = position + 1
        new = (position, position, total, total + score)
        total += score
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= new[2] - _EQUAL:
                j -= 1
            if j < 0 or segments[j][3] >= new[3] - _EQUAL:
                segments.append(new)
                break
            new = (segments[j][0], new[1], segments[j][2], new[3])
            del segments[j:]
    return [(a, b, after - before) for a, b, before, after in segments]


@dataclass
class Model:
    """Feature log-odds, drift, K, and the logistic curve."""

    weights: dict[str, float]
    drift: float = -0.01
    k: float = 1.0
    slope: float = 1.0
    offset: float = -4.0
    _cache: dict[str, float] = field(default_factory=dict)

    def word_score(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments in words."""
        words, cache = WORD.findall(text.lower()), self._cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.word_score(w)
        scores = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        at = np.flatnonzero(scores)
        return len(words), maximal_segments(list(zip(at.tolist(), scores[at].tolist())), self.drift)

    def bits(self, n_words: int, scores: list[float]) -> float:
        """-ln E of the best segment, plus those of the other significant ones."""
        base = math.log(max(self.k * n_words, 1.0))
        own = sorted((s - base for s in scores), reverse=True)
        return own[0] + sum(b for b in own[1:] if b > 0) if own else -base

    def probability(self, bits: float) -> float:
        z = min(max(self.slope * bits + self.offset, -500.0), 500.0)
        return 1 / (1 + math.exp(-z))

    def passages(self, text: str, segments: list[tuple[int, int, float]], n_words: int) -> list[tuple]:
        """(start, end, score, E) of segments in code points of the lower-cased text."""
        if not segments:
            return []
        spans = [m.span() for m in WORD.finditer(text.lower())]
        return [(spans[a][0], spans[b][1], s, self.k * n_words * math.exp(-s)) for a, b, s in segments]


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """(doc_id, toxic) of the learning rows, about ``max_labelled`` at most; a
    document labelled twice is toxic if any label says so."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = rows.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_labelled)
    return known


def _count(texts: DataFrame, wanted) -> DataFrame:
    """(feature, n): texts that hold each feature (of ``wanted``, a broadcast set, if given)."""
    def of(batches):
        counts = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                own = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
                counts[""] += len(own)
                counts.update(own if wanted is None else own & wanted.value)
            if len(counts) > 500_000:
                yield _counter(counts)
                counts = Counter()
        yield _counter(counts)

    return map_arrow(texts, of, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _counter(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = 250_000, min_texts: int = 3, min_share: float = 0.0005,
          prior: float = 0.1, chance: float = 0.1) -> Model:
    """Fit the model.  A feature is tried if at least ``min_texts`` and
    ``min_share`` of the toxic learning texts hold it, which bounds their number."""
    spark = docs.sparkSession
    known = checkpointed(labelled_sample(labels, id_col, label_col, max_labelled))
    train = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).join(
        F.broadcast(known), "doc_id")  # at most max_labelled rows
    n_toxic = known.where("toxic = 1").count()
    if not n_toxic:
        return Model({})
    toxic = checkpointed(_count(train.where("toxic = 1").select("text"), None))
    least = max(min_texts, math.ceil(min_share * n_toxic))
    table = toxic.where((F.col("n") >= least) | (F.col("feature") == "")).toPandas().set_index("feature")["n"]
    n1 = int(table.pop("")) if "" in table.index else 0
    wanted = spark.sparkContext.broadcast(set(table.index))
    clean = _count(train.where("toxic = 0").select("text"), wanted).toPandas().set_index("feature")["n"]
    n0 = int(clean.get("", 0))
    y1 = table.to_numpy(float)
    y0 = clean.reindex(table.index).fillna(0).to_numpy(float)
    if not len(y1) or not n0:
        return Model({})
    both = y1 + y0
    share, base = y1 / both, n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = both * (share * np.log(share / base) + np.where(
            share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    alpha, strength = prior * both, prior * (n1 + n0)
    odds = (np.log(y1 + alpha) - np.log(n1 + strength - y1 - alpha)
            - np.log(y0 + alpha) + np.log(n0 + strength - y0 - alpha))
    chosen = (share > base) & (surprise >= math.log(len(y1) / chance)) & (odds > 1)
    weights = dict(zip(table.index[chosen], odds[chosen].tolist()))
    drift = -max(0.01, float(y1[chosen].sum()) / max(n1, 1) / (1 + len(PREFIXES)))
    model = Model(weights, drift=drift)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches):
        for batch in slices(batches):
            found = [shared.value.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([[s for *_, s in f[1]] for f in found], pa.list_(pa.float64()))],
                names=["toxic", "n_words", "scores"])

    scanned = checkpointed(map_arrow(train.select("text", "toxic"), scan, "toxic int, n_words long, scores array<double>"))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    fit = scanned.where("toxic = 0").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_words") * F.exp(-best)).alias("e")).first()
    model.k = fit["n"] / fit["e"] if fit["n"] and fit["e"] else 1.0
    # the statistic of each learning text, rounded to a quarter, counted by class: a small table
    base_of = F.log(F.greatest(F.lit(model.k) * F.col("n_words"), F.lit(1.0)))
    over = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.greatest(x - base_of, F.lit(0.0)))
    stat = best - base_of + over - F.greatest(best - base_of, F.lit(0.0))
    bins = scanned.groupBy((F.round(F.least(stat, F.lit(200.0)) * 4) / 4).alias("bits"), "toxic").agg(
        F.count(F.lit(1)).alias("n")).toPandas()
    model.slope, model.offset = _logistic(bins["bits"].to_numpy(float), bins["toxic"].to_numpy(float), bins["n"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted points, by damped Newton steps."""
    centre, scale = np.average(x, weights=n), max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-9)
    design, w = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1), np.zeros(2)

    def loss(w):
        z = design @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + ridge * w @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (n * (p - y)) + ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (probability
    that the text is toxic), ``predicted`` (1 from 0.5), ``n_words`` and
    ``passages`` (start, end, score, e_value of every maximal segment).

    A null text counts as empty; a text without words has no passage and the
    score of its empty statistic.  Without toxic learning rows nothing scores
    0.5.  Repeated rows each get a row.  A very long text is scanned whole, once
    from left to right.  Of equal sums the earlier segment starts.  An empty
    table gives no rows.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def of(batches):
        m = shared.value
        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            found = [m.scan(t) for t in texts]
            scores = [m.probability(m.bits(n, [s for *_, s in segments])) for n, segments in found]
            passages = [[dict(zip(("start", "end", "score", "e_value"), p)) for p in m.passages(t, segments, n)]
                        for t, (n, segments) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([is_held_out(i) for i in ids], pa.bool_()), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([n for n, _ in found], pa.int64()),
                 pa.array(passages, kind)], names=["doc_id", "held_out", "score", "predicted", "n_words", "passages"])

    return map_arrow(rows, of, "doc_id long, held_out boolean, score double, predicted int, n_words long, "
                               "passages array<struct<start:long,`end`:long,score:double,e_value:double>>")
