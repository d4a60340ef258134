"""Queries that SQL can express, against their DuckDB SQL; and what is registered."""

import duckdb
import pytest

import __spark_entry__ as E
from cartlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    assert {c: str(got[c].dtype) for c in cols} == {c: str(want[c].dtype) for c in cols}
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_all_operators_and_the_pipeline_are_registered():
    names = [k for k in E.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(ORACLE) <= set(E.oracle_sql())


def test_result_columns(spark):
    columns = {
        "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op4_byte_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op5_retrieval_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op8_simhash_bktree": ["doc_id", "fingerprint", "component_id"],
        "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op11_maxent_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
        "op13_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]}
    for name, want in columns.items():
        assert E.queries()[name](spark, "/root/testdata/sf0.001").columns == want
