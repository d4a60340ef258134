"""The pipeline against plain versions of its stages."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from cartlens.llm.tokens import BYTE_BPE, encoder, vocabulary
from tests.llm import brute
from tests.llm.brute import A_TO_Z, corpus, prose
from tests.llm.test_tokens import pieces_are_whole


def tables(folder, rows, bench):
    cols = list(zip(*rows)) or [()] * 5
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()),
                             "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()),
                             "n_chars": pa.array(cols[4], pa.int64())}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()),
                             "text": pa.array([b[1] for b in bench], pa.string())}), f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng, folder = random.Random(6), tmp_path_factory.mktemp("planted")
    bench = [(i, prose(rng, 40)) for i in range(5)]
    rows = corpus()
    rows += [(2000 + i, prose(rng, 60) + " " + bench[i % 5][1] + " " + prose(rng, 60), "en", "s", 1) for i in range(8)]
    tables(folder, rows, bench)
    return str(folder), rows, bench


def plain_stages(rows, bench):
    """Ids that each stage keeps."""
    known = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    known = {i: t for i, t in known.items() if i != 1009}  # a text in neither language, without any known trigram
    last = {}
    for i, t in known.items():
        last[t.translate(A_TO_Z)] = max(i, last.get(t.translate(A_TO_Z), i))
    exact = {i: known[i] for i in last.values()}
    of = brute.components({i: brute.simhash(t) for i, t in exact.items()})
    near = {i: t for i, t in exact.items() if of[i] == i}
    clean = {i: t for i, t in near.items() if not any(b in t for _, b in bench)}
    return [known, exact, near, clean]


def test_every_stage_equals_the_plain_one(spark, planted, tmp_path):
    folder, rows, bench = planted
    docs, schema = spark.read.parquet(f"{folder}/documents.parquet"), None
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, plain_stages(rows, bench))):
        out = stage(spark, docs, folder)
        schema = schema or docs.schema
        assert [f.name for f in out.schema] == [f.name for f in schema], name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r.doc_id: r.text for r in docs.collect()} == want, name


def test_run_packs_what_the_stages_keep(spark, planted):
    folder, rows, bench = planted
    e, kept = encoder(vocabulary(BYTE_BPE)), plain_stages(rows, bench)[-1]
    full = pieces_are_whole(corpus_pipeline.run(spark, folder).collect(), {i: [*e.whole(t), 1] for i, t in kept.items()}, 2048)
    assert full > 0.9


def test_stages_on_no_documents(spark, tmp_path):
    tables(tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_stay(spark):
    """On the given tables, only copies and documents with a benchmark passage go."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    seen = {}
    for i, t in docs.items():
        seen.setdefault(t.translate(A_TO_Z), []).append(i)
    fps = {i: brute.simhash(docs[i]) for i in (max(g) for g in seen.values())}
    of = brute.components(fps)
    assert kept == {i for i in fps if of[i] == i and not any(b in docs[i] for b in bench)}


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "packing"]


def test_null_ids_repeats_and_extra_columns(spark, tmp_path):
    """Rows without an id, rows repeated whole, and null texts go through every stage."""
    rows = [(None, "the water was right there and small", "en", None, None), (None, None, None, None, None),
            (5, "other things between the houses", "en", "s", 1), (5, "other things between the houses", "en", "s", 1),
            (5, "with that small thing from there was", "en", "s", 1), (6, "", "en", "s", 0), (7, "the other of that", None, None, None)]
    tables(tmp_path, rows, [(1, None), (None, "of water and small things")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs.selectExpr("*"), str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert got == sorted({(str(r[0]), r[1]) for r in rows if r[1]})
    e = encoder(vocabulary(BYTE_BPE))
    assert sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(len(e.whole(t)) + 1 for _, t in got)
