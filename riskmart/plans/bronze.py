"""Bronze: CSV files to Parquet partitioned by year and month."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.operators import metrics
from riskmart.operators.ingest import rejected_rows, valid_rows, with_calendar
from riskmart.schemas import DATE_COLUMNS, SOURCES
from riskmart.sources import (
    Ledger,
    digest,
    exists,
    list_files,
    read_mark,
    read_months,
    read_partitions,
    remove,
    scan_csv,
    shared_dir,
    typed,
    write_mark,
    write_partitions,
    write_table,
)
from riskmart.sources.column_types import NOTHING, SPARK_TYPES, agreed, counts, kinds, merged
from riskmart.sources.csv_files import CORRUPT, FILE, header
from riskmart.sources.ledger import Month, month_dir, month_name, month_of, recover
from riskmart.sources.partitions import PARTITION_KEYS, move_partitions

REJECTS = "rejects"
LEDGERS = "ledgers"
DISTRIBUTION = "metrics/partition_distribution"


def source_key(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, multi_line: bool = False
) -> str:
    """What a source is ingested from: its files with lengths and times, and how they are read."""
    return digest(list_files(spark, path), dict(types or {}), multi_line)


def read_source(
    spark: SparkSession, bronze_path: str, name: str, months: Iterable[Month] | None = None
) -> DataFrame:
    """A bronze table, or the given months of it, under the types that all its batches agree on."""
    ledger = Ledger.read(spark, f"{bronze_path}/{LEDGERS}/{name}")
    if ledger is None:  # written by other means
        return read_partitions(spark, f"{bronze_path}/{name}", months)
    return read_months(spark, f"{bronze_path}/{name}", ledger, months)


def _declared(name: str, types: Mapping[str, str] | None) -> dict[str, T.DataType]:
    """Types by schema and configuration; dates are dates in any source."""
    declared = {f.name: f.dataType for f in SOURCES.get(name, T.StructType()).fields}
    return declared | {c: T._parse_datatype_string(t) for c, t in (types or {}).items()}


def _stored_declared(declared: Mapping[str, T.DataType]) -> dict[str, str]:
    return {c: t.simpleString() for c, t in declared.items()} | {c: "date" for c in DATE_COLUMNS}


def _undeclared(columns: Iterable[str], declared: Mapping[str, T.DataType]) -> list[str]:
    return [c for c in columns if c not in declared and c not in (*PARTITION_KEYS, *DATE_COLUMNS, CORRUPT, FILE)]


def _refuse_malformed(staged: DataFrame, name: str, multi_line: bool) -> DataFrame:
    malformed = staged.filter(F.col(CORRUPT).isNotNull()).limit(1).collect()
    if malformed:
        raise ValueError(
            f"a record of source {name!r} has not as many fields as the header: {malformed[0][CORRUPT][:200]!r}"
            + ("" if multi_line else "; fields with line breaks need multi_line")
        )
    return staged.drop(CORRUPT)


def _measured(staged: DataFrame, ours: list[str], by: list[str]) -> list:
    """By month and ``by``: rows, a digest of their texts that does not depend on their order, and evidence of types."""
    calendar = with_calendar(staged.withColumns({f"text:{c}": F.col(f"`{c}`") for c in DATE_COLUMNS if c in staged.columns}))
    texts = [F.col(f"`{c}`") for c in sorted(set(calendar.columns) - {*DATE_COLUMNS, *PARTITION_KEYS, FILE, "snapshot_date_text"})]
    names = F.lit(",".join(sorted(set(staged.columns))))
    checks = [F.sum(F.xxhash64(F.lit(salt), names, *texts).cast("decimal(38,0)")).cast("string").alias(f"check{salt}") for salt in (1, 2)]
    return calendar.groupBy(*by, *PARTITION_KEYS).agg(F.count("*").alias("rows"), *checks, *counts(ours)).collect()


def _write_months(
    spark: SparkSession,
    calendar: DataFrame,
    path: str,
    ledger: Ledger,
    ledger_path: str,
    months: Mapping[str, dict],
    gone: Iterable[str] = (),
    staging: str | None = None,
) -> None:
    """Replace months of the table and say so in the ledger, before and after. ``gone`` have no rows any more.

    With ``staging`` the months lie there as they are to be, and are put in place. Columns without any evidence are not written, so that a later batch may decide what they are.
    """
    found = ledger.evidence()
    kept = [c for c in calendar.columns if c in ledger.declared or c in PARTITION_KEYS or found.get(c, NOTHING) != NOTHING]
    stored = {f.name: f.dataType.simpleString() for f in calendar.select(*kept).schema.fields if f.name not in PARTITION_KEYS}
    ledger.pending = sorted({*months, *gone})
    ledger.write(spark, ledger_path)
    if months and staging is not None:
        move_partitions(spark, staging, path, map(month_of, months))
    elif months:
        write_partitions(calendar.select(*kept), path)
    for name in gone:
        remove(spark, month_dir(path, month_of(name)))
        ledger.months.pop(name, None)
    for name, facts in months.items():
        ledger.months[name] = {"stored": stored, "build": uuid4().hex, **facts}
    ledger.pending = []
    ledger.write(spark, ledger_path)


def ingest_source(
    spark: SparkSession,
    name: str,
    path: str,
    bronze_path: str,
    multi_line: bool = False,
    types: Mapping[str, str] | None = None,
    work_path: str | None = None,
    refresh: bool = False,
) -> None:
    """Ingest a batch of one source: dated rows by month, this batch's others into ``rejects/<name>``.

    The text is parsed once, into a staging table in ``work_path``; types, months and rejects come from there. ``types`` declares columns
    that the schema does not, as SQL types; others have the type that this batch and the months that stay agree on. A month whose rows are those
    stored already is left as it is, unless ``refresh``. A record with more or fewer fields than the header fails the source. The mark beside the rejects
    comes last and names what was ingested. (Replacing single partitions leaves no success mark in the table itself.)
    """
    key = source_key(spark, path, types, multi_line)
    table, ledger_path = f"{bronze_path}/{name}", f"{bronze_path}/{LEDGERS}/{name}"
    staging = f"{work_path or shared_dir(spark)}/staging-{name}-{uuid4().hex}"
    try:
        write_table(scan_csv(spark, path, multi_line), staging)
        staged = _refuse_malformed(spark.read.parquet(staging), name, multi_line)
        declared = _declared(name, types)
        ledger = _batch_ledger(spark, table, ledger_path)
        ledger.declared |= _stored_declared(declared)
        ours = _undeclared(staged.columns, ledger.declared)
        measured = _measured(staged, ours, [])
        dated = {month_name((r.year, r.month)): r for r in measured if r.year is not None}
        stay = [m["kinds"] for n, m in ledger.months.items() if n not in dated]
        found = agreed([merged(stay), merged(kinds(ours, r) for r in measured)], ledger.declared)
        facts = {
            n: {"rows": r.rows, "digest": f"{r.rows} {r.check1} {r.check2}", "kinds": kinds(ours, r)} for n, r in dated.items()
        }
        changed = {n: f for n, f in facts.items() if refresh or ledger.months.get(n, {}).get("digest") != f["digest"]}
        undeclared = {c: SPARK_TYPES[found.get(c, NOTHING)] for c in ours}
        calendar = with_calendar(typed(staged, declared | undeclared))
        rows = valid_rows(calendar)
        ledger.add_columns(rows.columns)
        # what the batch shows decides the types of its months, before they are written
        ledger.months |= {n: {**ledger.months.get(n, {"stored": {}, "build": None}), "kinds": f["kinds"]} for n, f in facts.items()}
        if len(changed) < len(facts):
            rows = rows.filter(_in_months(changed))
        _write_months(spark, rows, table, ledger, ledger_path, changed)
        write_table(metrics.partition_distribution(calendar), f"{bronze_path}/{DISTRIBUTION}/{name}")
        rejects = f"{bronze_path}/{REJECTS}/{name}"
        write_table(rejected_rows(calendar), rejects)
        write_mark(spark, rejects, key)
    finally:
        remove(spark, staging)


def ingest_rows(spark: SparkSession, name: str, rows: DataFrame, bronze_path: str) -> None:
    """Ingest a batch of rows that are typed already; they replace the months that they have. Rows without ``snapshot_date`` are left out.

    The rows are worked out once, into months beside the table. These are measured there, and those that changed take the places of the table's own.
    """
    table, ledger_path = f"{bronze_path}/{name}", f"{bronze_path}/{LEDGERS}/{name}"
    staging = f"{table}-{uuid4().hex}"
    day = F.col("snapshot_date")
    dated = rows.drop(*PARTITION_KEYS).filter(day.isNotNull()).withColumns({"year": F.year(day), "month": F.month(day)})
    columns = [F.col(f"`{c}`") for c in dated.columns]
    checks = [F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).cast("string").alias(f"check{salt}") for salt in (1, 2)]
    try:
        write_partitions(dated, staging)
        measured = []
        if exists(spark, staging):  # no row, no folder
            staged = spark.read.schema(dated.schema).parquet(staging)
            measured = staged.groupBy(*PARTITION_KEYS).agg(F.count("*").alias("rows"), *checks).collect()
        ledger = _batch_ledger(spark, table, ledger_path)
        ledger.declared |= {f.name: f.dataType.simpleString() for f in dated.schema.fields if f.name not in PARTITION_KEYS}
        ledger.add_columns(dated.columns)
        facts = {month_name((r.year, r.month)): {"rows": r.rows, "digest": f"{r.rows} {r.check1} {r.check2}", "kinds": {}} for r in measured}
        changed = {n: f for n, f in facts.items() if ledger.months.get(n, {}).get("digest") != f["digest"]}
        _write_months(spark, dated, table, ledger, ledger_path, changed, staging=staging)
    finally:
        remove(spark, staging)


def _in_months(names: Iterable[str]) -> Column:
    return (F.col("year") * 12 + F.col("month")).isin([y * 12 + m for y, m in map(month_of, names)])


def _batch_ledger(spark: SparkSession, table: str, ledger_path: str) -> Ledger:
    """The ledger of a table that takes batches; of one without ledger, what its files say."""
    ledger = Ledger.read(spark, ledger_path)
    if ledger is None:
        ledger = Ledger()
        if exists(spark, table):
            found = spark.read.parquet(table).select(*PARTITION_KEYS).distinct().collect()  # folder names only
            ledger.pending = [month_name((r.year, r.month)) for r in found]
    if ledger.files:
        raise ValueError(f"{table} mirrors its raw files; batches can't be added to it")
    recover(spark, table, ledger)
    for found in ledger.months.values():
        ledger.add_columns(found["stored"])
    ledger.pending = []
    return ledger


def mirror_source(
    spark: SparkSession,
    name: str,
    path: str,
    bronze_path: str,
    multi_line: bool = False,
    types: Mapping[str, str] | None = None,
    work_path: str | None = None,
    refresh: bool = False,
) -> list[str]:
    """Make bronze what the raw files at ``path`` are now, and return the months that were rebuilt.

    The ledger knows each file's length, time and months. New and changed files are parsed; of the others only those that share a month with what changed or
    went, and only these months are written again. A month that no file has any more goes. Files may have different columns. Each is evidence of the types, so a column that is
    text in one file and numbers in another must be declared. Undated rows go to ``rejects/<name>``, partitioned by file, undeclared columns as text.
    """
    key = source_key(spark, path, types, multi_line)
    table, ledger_path, rejects = f"{bronze_path}/{name}", f"{bronze_path}/{LEDGERS}/{name}", f"{bronze_path}/{REJECTS}/{name}"
    now = {p: {"length": n, "time": t} for p, n, t in list_files(spark, path)}
    if not now:
        raise ValueError(f"source {name!r} has no files at {path}")
    declared = _declared(name, types)
    settings = digest(_stored_declared(declared), multi_line)
    ledger = Ledger.read(spark, ledger_path) or Ledger()
    if ledger.months and not ledger.files:
        raise ValueError(f"{table} was filled by batches; a mirror needs a folder of its own")
    if refresh or ledger.settings != settings:
        ledger = Ledger(months=ledger.months, files={p: f | {"time": None} for p, f in ledger.files.items()}, pending=ledger.pending)
    same = lambda p: p in ledger.files and all(ledger.files[p][k] == now[p][k] for k in ("length", "time"))
    changed = [p for p in now if not same(p)]
    removed = [p for p in ledger.files if p not in now]
    before = {m for p in (*changed, *removed) for m in ledger.files.get(p, {}).get("months", ())} | set(ledger.pending)
    staging = f"{work_path or shared_dir(spark)}/staging-{name}-{uuid4().hex}"
    try:
        parsed = _staged(spark, changed, f"{staging}/changed", name, multi_line)
        ledger.declared, ledger.settings = _stored_declared(declared), settings
        files = {p: f for p, f in ledger.files.items() if p not in removed and p not in changed}
        fresh = {p: {**now[p], "kinds": {}, "months": {}} for p in changed}
        for staged in parsed:
            ours = _undeclared(staged.columns, ledger.declared)
            by_name = {_plain(p): p for p in changed}
            for r in _measured(staged, ours, [FILE]):
                file = fresh[by_name[_plain(r[FILE])]]
                file["kinds"] = merged([file["kinds"], kinds(ours, r)])
                if r.year is not None:
                    file["months"][month_name((r.year, r.month))] = r.rows
        found = agreed([f["kinds"] for f in {**files, **fresh}.values()], ledger.declared)
        affected = before | {m for f in fresh.values() for m in f["months"]}
        others = [p for p, f in files.items() if affected & set(f["months"])]
        parsed_others = _staged(spark, others, f"{staging}/others", name, multi_line)
        undeclared = {c: SPARK_TYPES[k] for c, k in found.items()}
        calendars = [with_calendar(typed(s, declared | undeclared | {FILE: T.StringType()})) for s in (*parsed, *parsed_others)]
        ledger.files = files | fresh
        left = {m for f in ledger.files.values() for m in f["months"]}
        for c in calendars:
            ledger.add_columns(n for n in valid_rows(c).columns if n != FILE)
        months = {m: {"rows": sum(f["months"].get(m, 0) for f in ledger.files.values()), "kinds": {}} for m in affected & left}
        if calendars:
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [valid_rows(c).drop(FILE) for c in calendars])
            rows = rows.select(*[c for c in rows.columns if c not in PARTITION_KEYS], *PARTITION_KEYS).filter(_in_months(months))
            _write_months(spark, rows, table, ledger, ledger_path, months, affected - left)
        else:  # files went, and no other had their months
            _write_months(spark, spark.createDataFrame([], "year int, month int"), table, ledger, ledger_path, {}, affected - left)
        _mirror_rejects(spark, parsed, rejects, [*changed, *removed])
        distribution = [(*month_of(m), facts["rows"]) for m, facts in ledger.months.items()]
        write_table(spark.createDataFrame(distribution, "year int, month int, count long"), f"{bronze_path}/{DISTRIBUTION}/{name}")
        write_mark(spark, rejects, key)
    finally:
        remove(spark, staging)
    return sorted(affected)


def _plain(path: str) -> str:
    """A file's name however it is written: with one slash or three behind the scheme, with or without escapes."""
    scheme, _, rest = unquote(path).partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if rest else scheme


def _staged(spark: SparkSession, files: list[str], staging: str, name: str, multi_line: bool) -> list[DataFrame]:
    """The files parsed into one staging table per header."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        by_header.setdefault(tuple(header(spark, file, multi_line)), []).append(file)
    tables = []
    for i, same in enumerate(by_header.values()):
        write_table(scan_csv(spark, same, multi_line, with_file=True), f"{staging}-{i}")
        tables.append(_refuse_malformed(spark.read.parquet(f"{staging}-{i}"), name, multi_line))
    return tables


def _mirror_rejects(spark: SparkSession, parsed: list[DataFrame], rejects: str, files: list[str]) -> None:
    for file in files:
        remove(spark, f"{rejects}/file={digest(_plain(file))[:16]}")
    ids = spark.createDataFrame([(_plain(f), digest(_plain(f))[:16]) for f in files], "plain string, file string") if files else None
    for staged in parsed:
        texts = [F.col(f"`{c}`").cast("string").alias(c) for c in staged.columns if c != FILE]
        calendar = with_calendar(staged.select(*texts, F.col(FILE)))
        plain = F.regexp_replace(F.url_decode(F.replace(F.col(FILE), F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")
        undated = rejected_rows(calendar).withColumn("plain", plain).join(F.broadcast(ids), "plain").drop("plain", FILE)
        undated.write.mode("append").partitionBy("file").parquet(rejects)


def is_ingested(
    spark: SparkSession,
    name: str,
    path: str,
    bronze_path: str,
    multi_line: bool = False,
    types: Mapping[str, str] | None = None,
) -> bool:
    """Whether the files at ``path``, as they are now, have been ingested the same way."""
    mark = read_mark(spark, f"{bronze_path}/{REJECTS}/{name}")
    return bool(mark) and mark["key"] == source_key(spark, path, types, multi_line)


def source_builds(spark: SparkSession, names, bronze_path: str) -> list[tuple[str, str | None]]:
    return [(n, read_mark(spark, f"{bronze_path}/{REJECTS}/{n}").get("build")) for n in sorted(names)]


def ingest_bronze(
    spark: SparkSession,
    raw_paths: Mapping[str, str],
    bronze_path: str,
    multi_line: Mapping[str, bool] | bool = False,
    types: Mapping[str, Mapping[str, str]] | None = None,
    work_path: str | None = None,
    raw_mode: str = "batch",
    refresh: bool = False,
) -> None:
    """Ingest every source. One that fails does not stop the others; all failures are
    raised together at the end. ``multi_line`` is one setting or one per source."""
    ingest = {"batch": ingest_source, "mirror": mirror_source}[raw_mode]
    failures = []
    for name, path in raw_paths.items():
        lines = multi_line if isinstance(multi_line, bool) else multi_line.get(name, False)
        try:
            ingest(spark, name, path, bronze_path, lines, (types or {}).get(name), work_path, refresh)
        except Exception as error:
            error.add_note(f"source {name!r} at {path}")
            failures.append(error)
    if failures:
        raise ExceptionGroup("bronze ingest failed for some sources", failures)
