"""Readers and writers: CSV in, Parquet out."""

from riskmart.sources.column_types import infer_types
from riskmart.sources.csv_files import read_csv, scan_csv, typed
from riskmart.sources.ledger import Ledger, read_months
from riskmart.sources.partitions import read_partitions, write_partitions
from riskmart.sources.tables import (
    build_id,
    digest,
    exists,
    is_complete,
    is_current,
    list_files,
    materialize,
    read_mark,
    remove,
    shared_dir,
    write_mark,
    write_table,
)

__all__ = [
    "Ledger",
    "build_id",
    "digest",
    "exists",
    "infer_types",
    "is_complete",
    "is_current",
    "list_files",
    "materialize",
    "read_csv",
    "read_mark",
    "read_months",
    "read_partitions",
    "remove",
    "scan_csv",
    "shared_dir",
    "typed",
    "write_mark",
    "write_partitions",
    "write_table",
]
