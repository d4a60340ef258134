"""Scans, sinks and the adapters that shape the driver tables into sessions,
purchases and item features."""

from cartlens.sources.tables import TABLES, table
from cartlens.sources.files import (
    feature_table_schema, read_csv, read_csv_no_header, reuse_or_compute, schema_from_header, write_table,
    SESSIONS_SCHEMA, PURCHASES_SCHEMA, FEATURES_SCHEMA,
)
from cartlens.sources import fixtures

__all__ = [
    "TABLES", "table", "feature_table_schema", "read_csv", "read_csv_no_header",
    "reuse_or_compute", "schema_from_header", "write_table", "SESSIONS_SCHEMA", "PURCHASES_SCHEMA",
    "FEATURES_SCHEMA", "fixtures",
]
