"""CSV and Parquet scans and sinks (the reference keeps every table as CSV).

Schemas are declared, never inferred, unless the caller asks for inference.
Whole folders are written and read back; no part file is renamed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cartlens.runtime import file_status, folder_exists, read_text, write_text

#: Beside ``_SUCCESS``; readers skip names that begin with an underscore.
MANIFEST = "_INPUTS"

SESSIONS_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType(), True),
    T.StructField("item_id", T.LongType(), True),
    T.StructField("date", T.TimestampType(), True),
])

PURCHASES_SCHEMA = SESSIONS_SCHEMA

FEATURES_SCHEMA = T.StructType([
    T.StructField("item_id", T.IntegerType(), True),
    T.StructField("feature_category_id", T.IntegerType(), True),
    T.StructField("feature_value_id", T.IntegerType(), True),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             infer: bool = False, header: bool = True) -> DataFrame:
    """CSV scan with a header.

    With ``schema`` the columns are typed without a pass over the data; with
    ``infer=True`` Spark samples the file to pick types; otherwise every
    column is a string, as in the notebook's reads.
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_no_header(spark: SparkSession, path: str,
                       schema: T.StructType | None = None) -> DataFrame:
    """CSV scan without a header (S3): columns are ``_c0, _c1, ...`` strings
    unless a schema names and types them."""
    return read_csv(spark, path, schema=schema, header=False)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                header: bool = True, partition_by: Sequence[str] = ()) -> None:
    """Write a whole folder (S4).  ``mode='errorifexists'`` matches the
    reference's default, where a second write to a folder fails."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", header).csv(path)
    else:
        writer.format(fmt).save(path)


def feature_table_schema(categories: Sequence, key: str = "session_id",
                         value_type: T.DataType = T.IntegerType()) -> T.StructType:
    """Schema of a wide feature table (S5): the key is a non-null int and
    every category is a nullable column named after the category."""
    fields = [T.StructField(key, T.IntegerType(), False)]
    fields += [T.StructField(str(c), value_type, True) for c in categories]
    return T.StructType(fields)


def schema_from_header(spark: SparkSession, path: str, key: str,
                       value_type: T.DataType = T.LongType()) -> T.StructType:
    """Schema of a saved wide feature table from its CSV header (S5): the
    first column is the key, every other column a category.  Only the header
    is looked at; the values are not scanned."""
    names = read_csv(spark, path).columns
    if names[:1] != [key]:
        raise ValueError(f"the first column of {path} is not {key}")
    return T.StructType([T.StructField(key, T.LongType(), True)]
                        + [T.StructField(c, value_type, True) for c in names[1:]])


def reuse_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                     fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read a derived table if it was saved before, else compute, save and
    read it back (S6).  The saved copy also cuts the lineage.

    A table counts as saved when its folder holds the ``_SUCCESS`` mark that
    the writer leaves at the end.  A folder without it is the rest of a job
    that failed; the table is computed again and written over it.  CSV keeps
    no types: it is read with ``schema``, or with the computed frame's."""
    done = folder_exists(spark, f"{path}/_SUCCESS")
    computed = None if done and (schema is not None or fmt != "csv") else compute()
    if not done:
        write_table(computed, path, fmt=fmt, mode="overwrite")
    if fmt == "csv":
        return read_csv(spark, path, schema=schema or computed.schema)
    return spark.read.format(fmt).load(path)


def manifest_of(df: DataFrame) -> dict:
    """What ``df`` is computed from and how: the number of its input files, a
    digest of each one's path, size and time, and a digest of the plan.

    Files are listed as Spark lists them for the scan, and asked for their
    state one by one; only digests are kept.  A plan's text is taken without the
    numbers that Spark gives to its columns, so the same query has the same digest in
    another session.  Rows that come from neither files nor the plan (made in the program, or
    checkpointed) cannot be told from others, so such a frame never has the same digest twice."""
    spark = df.sparkSession
    files = sorted(df.inputFiles())
    state = hashlib.sha256()
    for path in files:
        state.update(json.dumps([path, *file_status(spark, path)]).encode())
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    if re.search("LogicalRDD|ExternalRDD", plan):
        plan += uuid.uuid4().hex
    plan = re.sub(r"#-?\d+L?|@[0-9a-f]+|\[\d+\]", "", plan)
    return {"files": len(files), "inputs": state.hexdigest(), "plan": hashlib.sha256(plan.encode()).hexdigest()}


def reuse_if_unchanged(spark: SparkSession, path: str, compute: Callable[[], DataFrame], fmt: str = "parquet",
                       schema: T.StructType | None = None) -> DataFrame:
    """As ``reuse_or_compute``, but the saved table knows its input (S6): it is
    computed again, and written over, if an input file has come, gone or changed,
    or if the query is another one.

    The manifest of the input is taken before the table is computed and saved
    after it, so a file that changes meanwhile makes the table stale, never fresh.
    ``compute`` is called each time, to see what it would read; its frame
    must be lazy to save anything."""
    computed = compute()
    now = manifest_of(computed)
    place = f"{path}/{MANIFEST}"
    fresh = folder_exists(spark, f"{path}/_SUCCESS") and folder_exists(spark, place) and json.loads(read_text(spark, place)) == now
    if not fresh:
        write_table(computed, path, fmt=fmt, mode="overwrite")
        write_text(spark, place, json.dumps(now))
    if fmt == "csv":
        return read_csv(spark, path, schema=schema or computed.schema)
    return spark.read.format(fmt).load(path)
