"""Types of CSV columns from a bounded sample of every file.

Cells have a least type (``KINDS``), and two types a least common one: the type
of a column is that of its cells, merged.  The sample is the first
``rows_per_file`` rows of each file, so a file that is different is seen, and
what reaches the driver is one flag word per column.  Rows past the sample
may not fit: ``read_inferred`` reads every row as text, casts what fits and returns the
other rows as they are, with the file they are in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.bits import quoted
from cartlens.sources.files import read_csv

#: Kinds of cells in the order they are tried, with the SQL that tells them ({c}: the cell, trimmed).
KINDS = [
    ("int", "{c} rlike '^[+-]?[0-9]{{1,10}}$' and try_cast({c} as int) is not null"),
    ("bigint", "{c} rlike '^[+-]?[0-9]{{1,19}}$' and try_cast({c} as bigint) is not null"),
    ("double", "{c} rlike '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' and try_cast({c} as double) is not null"),
    ("boolean", "lower({c}) in ('true', 'false')"),
    ("date", "{c} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' and try_cast({c} as date) is not null"),
    ("timestamp_ntz", "{c} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}' and try_cast({c} as timestamp_ntz) is not null"),
]
TEXT = "string"
_WIDER = [("int", "bigint", "double"), ("date", "timestamp_ntz")]


def merged(a: str | None, b: str | None) -> str | None:
    """The least type that holds both; None (only missing cells) is below all."""
    if a is None or b is None or a == b:
        return a or b
    for chain in _WIDER:
        if a in chain and b in chain:
            return chain[max(chain.index(a), chain.index(b))]
    return TEXT


def _flag(name: str) -> str:
    """SQL text: the bit of a cell's kind; 0 for a missing cell."""
    cell = f"trim({quoted(name)})"
    kinds = " ".join(f"when {test.format(c=cell)} then {1 << i}" for i, (_, test) in enumerate(KINDS))
    return f"case when {quoted(name)} is null or {cell} = '' then 0 {kinds} else {1 << len(KINDS)} end"


def heads(text: DataFrame, rows_per_file: int) -> DataFrame:
    """The first ``rows_per_file`` rows of every piece (split) of a file, with ``_file`` and ``_row``,
    which rises in each.  A first pass, which parses no cell, finds the number of the first row
    of every piece, so no rows have to be sorted to find those near it."""
    piece = ["_file", "_start"]
    numbered = text.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                           F.monotonically_increasing_id().alias("_row"))
    first = numbered.groupBy(*piece).agg(F.min("_row").alias("_first"))  # one row per piece
    return numbered.join(F.broadcast(first), piece).where(F.col("_row") < F.col("_first") + rows_per_file).drop("_start", "_first")


def infer_schema(spark: SparkSession, path: str, rows_per_file: int = 1000, header: bool = True) -> T.StructType:
    """Types of the columns from the first ``rows_per_file`` rows of every file
    (all columns nullable).  A column with no cell in the sample is text."""
    text = read_csv(spark, path, header=header)
    names = text.columns
    order = Window.partitionBy("_file").orderBy("_row")
    sample = heads(text, rows_per_file).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rows_per_file)
    flags = sample.agg(*[F.expr(f"bit_or({_flag(n)}) as `_f{i}`") for i, n in enumerate(names)]).first()
    fields = []
    for i, name in enumerate(names):
        kind, seen = None, flags[i] or 0
        for bit, k in enumerate([*[k for k, _ in KINDS], TEXT]):
            if seen >> bit & 1:
                kind = merged(kind, k)
        fields.append(T.StructField(name, T._parse_datatype_string(kind or TEXT), True))
    return T.StructType(fields)


@dataclass
class Inferred:
    rows: DataFrame           # the rows that fit, typed
    misfits: DataFrame        # the others: their text by column, and the ``file`` they are in


def read_inferred(spark: SparkSession, path: str, rows_per_file: int = 1000, header: bool = True,
                  schema: T.StructType | None = None) -> Inferred:
    """A CSV scan (S1) typed by ``infer_schema`` (or a given schema).  A row is a
    misfit if some cell that is not missing cannot be cast; every row is in one of
    the two results.  A missing or blank cell is null, except in text columns, which keep their cells."""
    schema = schema or infer_schema(spark, path, rows_per_file, header)
    text = read_csv(spark, path, header=header).select("*", F.col("_metadata.file_path").alias("_file"))
    cast, bad = [], []
    for f in schema.fields:
        kind, cell = f.dataType.simpleString(), f"trim({quoted(f.name)})"
        if kind == TEXT:
            cast.append(quoted(f.name))
            continue
        # blank cells are missing; try_cast of the rest
        cast.append(f"try_cast(nullif({cell}, '') as {kind}) as {quoted(f.name)}")
        bad.append(f"(nullif({cell}, '') is not null and try_cast({cell} as {kind}) is null)")
    misfit = F.expr(" or ".join(bad)) if bad else F.lit(False)
    return Inferred(text.where(~misfit).selectExpr(*cast), text.where(misfit).select(*schema.names, F.col("_file").alias("file")))
