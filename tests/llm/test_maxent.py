"""The language model: exact counts and base scores, a true distribution, gradients, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import common, maxent
from tests.llm.brute import A_TO_Z, SCHEMA, clash, corpus

SMALL = {"width": 4, "classes": 3, "max_words": 30, "class_bits": 6, "word_bits": 4}


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z)) + [None]


def away(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_scores(rows):
    c = Counter(w for i, t, *_ in rows if not away(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, away(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t, *_ in rows]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("how", [SMALL, {**SMALL, "max_words": 0}, {}])
def test_counts_and_base_scores_are_exact(spark, how):
    rows = corpus()
    rows += [(None, "the the new", None, None, None), (3, "Twice Éé  x", None, None, None), (3, "Twice", None, None, None)]
    got = maxent.score(maxent.learn(clash(spark.createDataFrame(rows, SCHEMA)).repartition(4), rounds=2, **how))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    same([r[:6] for r in got], base_scores(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_without_rounds_the_score_is_the_base_score(spark):
    rows = corpus()
    for r in maxent.score(maxent.learn(spark.createDataFrame(rows, SCHEMA), rounds=0, **SMALL)).collect():
        assert math.isclose(r.score, r.base_score, rel_tol=1e-5)


def test_probabilities_sum_to_one(spark):
    """After training, over all training words and the unknown word, in any context."""
    model = maxent.learn(spark.createDataFrame(corpus(), SCHEMA), rounds=3, **SMALL)
    out, n = model.out, len(model.out.words)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    rest = sum(c + 1 for w, c in counts.items() if w not in set(out.words)) + 1
    assert out.rest == rest and len(counts) == out.distinct and sum(counts.values()) == out.tokens
    assert n <= SMALL["max_words"] and out.head == 12 and set(out.counts) >= {max(counts.values())}
    for last, before in [(0, 1), (n + 1, n + 1), (n, 3), (2, n)]:
        ids = np.arange(n + 1)
        logs = maxent.log_probability(out, model.weights, ids, np.full(n + 1, last), np.full(n + 1, before), *model.shape)
        assert abs(np.exp(logs).sum() - 1) < 1e-5
    assert np.abs(model.weights.by_class).max() > 0.1 and np.abs(model.weights.by_word).max() > 0.1


def test_scores_equal_a_plain_sum(spark):
    """The whole score from the model's weights, token by token."""
    rows = corpus()
    model = maxent.learn(spark.createDataFrame(rows, SCHEMA), rounds=2, **SMALL)
    out, n = model.out, len(model.out.words)
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    rank = {w: i for i, w in enumerate(out.words)}
    got = {r.doc_id: r.score for r in maxent.score(model).collect()}
    for i, t, *_ in rows[::7]:
        words = [b"" if w is None else w.encode() for w in tokens(t)]
        ids, total = [n + 1, n + 1] + [rank.get(w, n) for w in words], 0.0
        for k, w in enumerate(words):
            one = [np.array([ids[k + j]]) for j in (2, 1, 0)]
            total += maxent.log_probability(out, model.weights, *one, *model.shape)[0]
            if w not in rank:
                total += math.log((counts.get(w, 0) + 1) / out.rest)
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4)


def test_gradient_sums_equal_plain_sums(spark):
    rows = corpus(n=20)
    model = maxent.learn(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=0, **SMALL)
    texts = [np.frombuffer(r.ids, np.uint32) for r in model.texts.where("not held_out").collect()]
    want = np.zeros(model.weights.size, np.int64)
    for _, ids, last, before in maxent.contexts(texts, len(model.out.words)):
        places = maxent.Places(model.out, ids, last, before, *model.shape)
        for numbers in maxent.used(places, model.weights, places.cls, places.word):
            np.add.at(want, numbers, 1)
    shared = spark.sparkContext.broadcast(model.out)
    observed = common.summed(maxent.encoded(spark.createDataFrame(rows, SCHEMA).repartition(3), "doc_id", "text", maxent.training(
        F.col("doc_id")), shared, model.shape).where("piece is not null").select("piece", "uses"), model.weights.size)
    assert (observed == want).all()
    drawn = common.summed(maxent.expected(model.texts.where("not held_out").select("key", "ids"), shared, spark.sparkContext.broadcast(model.weights),
                                          model.shape, 1), model.weights.size)
    cut = model.weights.by_class.size
    shape = model.weights.by_class.shape
    assert (drawn[:cut].reshape(shape).sum(1) == want[:cut].reshape(shape).sum(1)).all()  # one draw for each use of a row
    base = maxent.expected_of_base(model.out, model.weights, want)
    gap = (drawn[:cut] - base[:cut]) / np.sqrt(base[:cut] + 1)
    assert abs(gap.mean()) < 0.05 and gap.std() < 1.3                                        # and on average the base model's


def test_held_out_texts_gain(spark):
    got = maxent.score(maxent.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).where("held_out") \
        .agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.05                                                 # log10 a token


def test_long_words_and_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 16)
    monkeypatch.setattr(maxent, "BATCH", 8)
    text = " ".join(["ab"] * 100 + ["x" * 100] + ["\t c\x0bd"] * 30)
    assert [w for ws in common.words_of(text) for w in ws] == re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    ids = np.arange(50, dtype=np.uint32)
    seen = list(maxent.contexts([ids, ids[:3], ids[:0]], 60))
    flat = [tuple(int(x) for x in row) for batch in seen for row in zip(*batch)]
    assert flat == [(0, i, i - 1 if i else 61, i - 2 if i > 1 else 61) for i in range(50)] + [(1, 0, 61, 61), (1, 1, 0, 61), (1, 2, 1, 0)]


def test_empty_tables(spark):
    assert maxent.score(maxent.learn(spark.createDataFrame([], SCHEMA), **SMALL)).collect() == []
    held = next(i for i in range(100) if away(i))
    got = maxent.score(maxent.learn(spark.createDataFrame([(held, "a b", "en", "s", 1)], SCHEMA), **SMALL)).collect()
    assert [tuple(r) for r in got] == [(held, True, 3, 0, 0, 0.0, 0.0)]
