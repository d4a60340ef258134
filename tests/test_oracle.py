"""Every registered query against its DuckDB SQL on sf0.01 (the driver's
correctness gate): same row count, same column names, same rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from cartlens.plans.oracle import ORACLE
from cartlens.plans.queries import QUERIES
from cartlens.sources.tables import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def _canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _canon(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


#: The work of an index, and rounds over cells of three values: held against plain models in
#: ``test_hamming_index.py`` and ``test_categorical.py``.
WITHOUT_SQL = {"knn_index_work", "kmodes_fit_values"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


SPARK_TYPES = {"bigint": "i64", "int": "i32", "double": "f64", "float": "f32", "string": "str",
               "timestamp_ntz": "ts", "timestamp": "ts"}
DUCK_TYPES = {"BIGINT": "i64", "INTEGER": "i32", "DOUBLE": "f64", "FLOAT": "f32", "VARCHAR": "str",
              "TIMESTAMP": "ts"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert {c: SPARK_TYPES.get(t, t) for c, t in sdf.dtypes} == \
           {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    got = sdf.toPandas()
    want = rel.df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "session_id"
    assert df.count() >= 0
