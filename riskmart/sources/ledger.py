"""What a month-partitioned table holds and where it came from: months with their stored types and builds, raw files with the months that they fed.

The ledger is one small JSON file beside the table. Months being written are named in it before their data changes, so a run that breaks off
leaves a ledger that says which months to look at again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.sources.column_types import BOOLEAN, NUMBER, SPARK_TYPES, TEXT, WHOLE, merged
from riskmart.sources.partitions import PARTITION_KEYS
from riskmart.sources.tables import exists, read_text, write_text

Month = tuple[int, int]
LEDGER = "_ledger.json"
_KINDS = {"boolean": BOOLEAN, "bigint": WHOLE, "double": NUMBER, "string": TEXT}


def month_name(month: Month) -> str:
    return f"{month[0]:04d}-{month[1]:02d}"


def month_of(name: str) -> Month:
    year, month = name.rsplit("-", 1)
    return int(year), int(month)


def month_dir(path: str, month: Month) -> str:
    return f"{path}/year={month[0]}/month={month[1]}"


@dataclass
class Ledger:
    """``months``: stored types, build, rows and, for batches, kinds and digest. ``files``: length, time, kinds and rows by month."""

    columns: list[str] = field(default_factory=list)
    declared: dict[str, str] = field(default_factory=dict)
    months: dict[str, dict] = field(default_factory=dict)
    files: dict[str, dict] = field(default_factory=dict)
    pending: list[str] = field(default_factory=list)
    settings: str = ""

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Ledger | None:
        """The ledger in the folder ``path``; None if there is none."""
        text = read_text(spark, f"{path}/{LEDGER}")
        return None if text is None else cls(**json.loads(text))

    def write(self, spark: SparkSession, path: str) -> None:
        write_text(spark, f"{path}/{LEDGER}", json.dumps(asdict(self)))

    def add_columns(self, names: Iterable[str]) -> None:
        self.columns += [n for n in names if n not in self.columns and n not in PARTITION_KEYS]

    def evidence(self) -> dict[str, str]:
        """Kinds of the undeclared columns as all files, or else all months, have them."""
        return merged(u["kinds"] for u in (self.files or self.months).values())

    def types(self) -> dict[str, T.DataType]:
        """The type that each column is read as."""
        found = self.evidence()
        return {
            c: T._parse_datatype_string(self.declared[c]) if c in self.declared else SPARK_TYPES[found.get(c, "nothing")]
            for c in self.columns
        }

    def builds(self) -> dict[Month, str]:
        """Build of each month; a month whose write broke off has none."""
        return {month_of(m): found["build"] for m, found in self.months.items() if m not in self.pending}


def footer_types(spark: SparkSession, folder: str) -> dict[str, str]:
    """Stored types of a month by its files."""
    if not exists(spark, folder):
        return {}
    return {f.name: f.dataType.simpleString() for f in spark.read.parquet(folder).schema.fields}


def stored_kinds(types: Mapping[str, str], declared: Mapping[str, str]) -> dict[str, str]:
    return {c: _KINDS.get(t, TEXT) for c, t in types.items() if c not in declared}


def recover(spark: SparkSession, path: str, ledger: Ledger) -> None:
    """Take the stored types of months whose write broke off from their files; months without files go."""
    for name in ledger.pending:
        types = footer_types(spark, month_dir(path, month_of(name)))
        if types:
            ledger.months[name] = {"stored": types, "kinds": stored_kinds(types, ledger.declared), "build": uuid4().hex, "rows": None, "digest": None}
        else:
            ledger.months.pop(name, None)


def read_months(spark: SparkSession, path: str, ledger: Ledger, months: Iterable[Month] | None = None) -> DataFrame:
    """The table, or the given months of it, with every column as the type that all units agree on.

    Months stored under other types, or without some column, are read as they are stored and cast: one scan for each set of stored types.
    Only the folders of the wanted months are listed.
    """
    if ledger.pending:
        recover(spark, path, ledger)
    wanted = sorted(ledger.months) if months is None else sorted({month_name(m) for m in months} & set(ledger.months))
    groups: dict[tuple, list[str]] = {}
    for name in wanted:
        if ledger.months[name].get("rows") == 0:  # no folder
            continue
        stored = ledger.months[name]["stored"]
        groups.setdefault(tuple((c, stored[c]) for c in ledger.columns if c in stored), []).append(name)
    types = ledger.types()
    keys = [T.StructField(k, T.IntegerType()) for k in PARTITION_KEYS]
    frames = []
    for stored, names in groups.items():
        schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in stored] + keys)
        folders = [month_dir(path, month_of(n)) for n in names]
        frame, kept = spark.read.option("basePath", path).schema(schema).parquet(*folders), dict(stored)
        columns = []
        for c, kind in types.items():
            value = F.lit(None).cast(kind) if c not in kept else F.col(f"`{c}`")
            if c in kept and kept[c] != kind.simpleString():
                value = value.try_cast(kind)
            columns.append(value.alias(c))
        frames.append(frame.select(*columns, *PARTITION_KEYS))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField(c, k) for c, k in types.items()] + keys))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
