"""Silver month by month and gold customer by customer: only what a change reaches is built again.

Bronze gives each month a build. Silver knows which builds it was made from, so a run reads the months that changed: their keys and flagged customers replace the old
ones in small index tables beside silver. Customers that became flagged, or are no longer, bring back the other months in which they occur. All customers and
loans concerned, as they were before and are now, go to gold as a change set.

Gold holds what it has taken of these sets. From the new ones it follows shared loans to all customers whose rows may differ, builds these from the
months in which they occur, and keeps the others' rows. Change sets are written before what they describe is replaced, and a table is swapped whole, so a run that
breaks off is made good by the next.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.operators import metrics
from riskmart.operators.asof import asof_newest_first
from riskmart.operators.features import gold_features
from riskmart.operators.labels import label_store
from riskmart.operators.quality import CUSTOMER, ISSUE
from riskmart.operators.skew import splittable
from riskmart.plans.bronze import LEDGERS, read_source
from riskmart.plans.gold import build_gold, label_metrics
from riskmart.plans.silver import TABLES, clean_tables, flag_tables, may_broadcast, remove_by_size
from riskmart.plans.stored_history import read_history, update_history
from riskmart.sources import Ledger, digest, exists, read_months, remove, shared_dir, write_mark, write_partitions, write_table
from riskmart.sources.ledger import Month, month_dir, month_name, month_of
from riskmart.sources.partitions import PARTITION_KEYS
from riskmart.sources.tables import list_files, read_text, rename, write_text

KEYS, FLAGS, CHANGES = "index/keys", "index/flags", "changes"
#: Begins the name of a change set that stands for all customers and has no table.
EVERYBODY = "all-"
LOAN = "loan_id"
#: Marks the labels that replace stored ones.
DIFFERS = "_differs"
TAKEN, STATE = "_taken.json", "_state.json"


def has_ledgers(spark: SparkSession, path: str) -> bool:
    return all(exists(spark, f"{path}/{LEDGERS}/{name}") for name in TABLES)


def _key_columns(table: str) -> list[str]:
    return [CUSTOMER, LOAN] if table == "loan_daily" else [CUSTOMER]


def _index(spark: SparkSession, path: str, months: Iterable[Month] | None = None) -> DataFrame | None:
    """An index table or some months of it; None where it has none of them."""
    if not exists(spark, path):
        return None
    if months is None:
        folders = [path] if any(True for _ in _folders(spark, path)) else []
    else:
        folders = [f for f in (month_dir(path, m) for m in months) if exists(spark, f)]
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def _folders(spark: SparkSession, path: str):
    return (p for p, _, _ in list_files(spark, path) if "/year=" in p)


def _replace_months(spark: SparkSession, df: DataFrame, path: str, months: Iterable[Month]) -> None:
    """The given months of the table become what ``df`` has of them, which may be nothing."""
    for month in months:
        remove(spark, month_dir(path, month))
    write_partitions(df, path)


def _union(frames: Iterable[DataFrame | None]) -> DataFrame | None:
    found = [f for f in frames if f is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def _in(df: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is among ``keys``; a missing key is one like others."""
    wanted = splittable(keys.select(F.col(column).alias("wanted_key")))
    return df.join(wanted, F.col(column).eqNullSafe(F.col("wanted_key")), how)


def change_sets(spark: SparkSession, silver_path: str) -> list[str]:
    return json.loads(read_text(spark, f"{silver_path}/{CHANGES}/_sets.json") or "[]")


def _add_change_set(spark: SparkSession, silver_path: str, changed: DataFrame | None) -> None:
    if changed is None:
        return
    name = uuid4().hex
    write_table(changed.select(CUSTOMER, LOAN).distinct(), f"{silver_path}/{CHANGES}/{name}")
    _name_change_set(spark, silver_path, name)


def _name_change_set(spark: SparkSession, silver_path: str, name: str) -> None:
    write_text(spark, f"{silver_path}/{CHANGES}/_sets.json", json.dumps([*change_sets(spark, silver_path), name]))


def _with_loan(keys: DataFrame | None, like: DataFrame) -> DataFrame | None:
    if keys is None:
        return None
    loan = F.col(LOAN) if LOAN in keys.columns else F.lit(None)
    return keys.select(F.col(CUSTOMER).cast(like.schema[CUSTOMER].dataType).alias(CUSTOMER), loan.cast(like.schema[LOAN].dataType).alias(LOAN))


def update_silver(spark: SparkSession, bronze_path: str, silver_path: str, refresh: bool = False) -> dict[str, list[Month]]:
    """Bring silver up to date with bronze and return the months of each table that were built again."""
    sources = {n: Ledger.read(spark, f"{bronze_path}/{LEDGERS}/{n}") for n in TABLES}
    own = {n: Ledger.read(spark, f"{silver_path}/{LEDGERS}/{n}") for n in TABLES}
    first = all(ledger is None for ledger in own.values())
    for n in TABLES:
        if own[n] is None:  # built whole before, or never
            remove(spark, f"{silver_path}/{n}")
            own[n] = Ledger()
    builds = {n: sources[n].builds() for n in TABLES}
    stale, gone = {}, {}
    for n in TABLES:
        known = {month_of(m): f.get("source") for m, f in own[n].months.items() if m not in own[n].pending}
        stale[n] = sorted(m for m, b in builds[n].items() if refresh or known.get(m) != b)
        gone[n] = sorted({*map(month_of, own[n].months), *map(month_of, own[n].pending)} - set(builds[n]))
    flagged_path = f"{silver_path}/flagged"
    finished = read_text(spark, f"{silver_path}/{STATE}")
    if not any([*stale.values(), *gone.values()]) and finished == _state(own):
        return {n: [] for n in TABLES}

    like = read_source(spark, bronze_path, "loan_daily", [])
    touched = {n: [*stale[n], *gone[n]] for n in TABLES}
    if first:
        _name_change_set(spark, silver_path, f"{EVERYBODY}{uuid4().hex}")
    else:
        before = (_with_loan(_index(spark, f"{silver_path}/{KEYS}/{n}", touched[n]), like) for n in TABLES)
        _add_change_set(spark, silver_path, _union(before))
    fresh = {n: read_source(spark, bronze_path, n, stale[n]) for n in TABLES}
    for n, flagged_rows in flag_tables(fresh).items():
        bad = flagged_rows.filter(F.col(ISSUE) == 1).select(CUSTOMER, *PARTITION_KEYS).distinct()
        _replace_months(spark, bad, f"{silver_path}/{FLAGS}/{n}", touched[n])
    for n in TABLES:
        keys = fresh[n].select(*_key_columns(n), *PARTITION_KEYS).distinct()
        _replace_months(spark, keys, f"{silver_path}/{KEYS}/{n}", touched[n])
    if not first:
        now = (_with_loan(_index(spark, f"{silver_path}/{KEYS}/{n}", stale[n]), like) for n in TABLES)
        _add_change_set(spark, silver_path, _union(now))

    next_path = f"{silver_path}/flagged-next"
    flags = _union(_index(spark, f"{silver_path}/{FLAGS}/{n}") for n in flag_tables(fresh))
    none = like.select(CUSTOMER)
    write_table((none if flags is None else flags.select(CUSTOMER)).distinct(), next_path)
    flagged = spark.read.parquet(next_path)
    old = spark.read.parquet(flagged_path) if exists(spark, flagged_path) else none
    moved = old.unionByName(flagged).filter(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER).count().filter("count = 1").select(CUSTOMER)
    moved_path = f"{shared_dir(spark)}/moved-{uuid4().hex}"
    write_table(moved, moved_path)
    moved = spark.read.parquet(moved_path)
    if not first and not moved.isEmpty():
        _add_change_set(spark, silver_path, moved.withColumn(LOAN, F.lit(None).cast(like.schema[LOAN].dataType)))

    rebuilt = {}
    for n in TABLES:
        keys = _index(spark, f"{silver_path}/{KEYS}/{n}", sorted({*builds[n]} - {*stale[n]}))  # stale months are built anyway
        met = [] if keys is None else _in(keys, moved, CUSTOMER).select(*PARTITION_KEYS).distinct().collect()
        rebuilt[n] = sorted({*stale[n], *((r.year, r.month) for r in met)})
        if rebuilt[n] or gone[n]:
            _rebuild_months(spark, bronze_path, silver_path, n, own[n], builds[n], rebuilt[n], gone[n], flagged)
    write_table(flagged, flagged_path)
    _silver_metrics(spark, bronze_path, silver_path, own)
    for n in TABLES:
        write_mark(spark, f"{silver_path}/{n}", digest(sorted((m, f["build"]) for m, f in own[n].months.items())))
    write_text(spark, f"{silver_path}/{STATE}", _state(own))
    remove(spark, next_path)
    remove(spark, moved_path)
    return rebuilt


def _state(ledgers: Mapping[str, Ledger]) -> str:
    return digest([(n, sorted((m, f["build"]) for m, f in ledgers[n].months.items())) for n in TABLES])


def _rebuild_months(
    spark: SparkSession,
    bronze_path: str,
    silver_path: str,
    name: str,
    ledger: Ledger,
    builds: Mapping[Month, str],
    months: list[Month],
    gone: list[Month],
    flagged: DataFrame,
) -> None:
    path, ledger_path = f"{silver_path}/{name}", f"{silver_path}/{LEDGERS}/{name}"
    raw = {n: read_source(spark, bronze_path, n, months if n == name else []) for n in TABLES}
    rows = remove_by_size(spark, clean_tables(raw).tables[name], flagged)
    rows = rows.select(*[c for c in rows.columns if c not in PARTITION_KEYS], *PARTITION_KEYS)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name not in PARTITION_KEYS}
    ledger.pending = sorted(map(month_name, {*months, *gone}))
    ledger.write(spark, ledger_path)
    _replace_months(spark, rows, path, {*months, *gone})
    written = [f for f in (month_dir(path, m) for m in months) if exists(spark, f)]
    counted = spark.read.option("basePath", path).parquet(*written).groupBy(*PARTITION_KEYS).count().collect() if written else []
    n_rows = {(r.year, r.month): r["count"] for r in counted}
    ledger.declared = types
    ledger.columns = list(types)
    for m in gone:
        ledger.months.pop(month_name(m), None)
    for m in months:
        ledger.months[month_name(m)] = {"stored": types, "kinds": {}, "build": uuid4().hex, "source": builds[m], "rows": n_rows.get(m, 0)}
    ledger.pending = []
    ledger.write(spark, ledger_path)


def _silver_metrics(spark: SparkSession, bronze_path: str, silver_path: str, own: Mapping[str, Ledger]) -> None:
    """The counts that a whole build writes, from the indexes and ledgers."""
    flagged = spark.read.parquet(f"{silver_path}/flagged")
    keys = {n: _index(spark, f"{silver_path}/{KEYS}/{n}") for n in TABLES}
    write_table(metrics.flag_summary({n: k for n, k in keys.items() if k is not None}, flagged), f"{silver_path}/metrics/flag_summary")
    counts = []
    for n in TABLES:
        before = sum(f["rows"] or 0 for f in Ledger.read(spark, f"{bronze_path}/{LEDGERS}/{n}").months.values())
        after = sum(f["rows"] for f in own[n].months.values())
        if before:
            counts.append((n, before, after, before - after))
    schema = "table_name string, rows_before long, rows_after long, rows_removed long"
    write_table(spark.createDataFrame(counts, schema), f"{silver_path}/metrics/removal_counts")


def _parameters(config: Config) -> str:
    months = (config.prediction_months, config.label_window_months, config.max_loan_months)
    return digest(months, config.grain, config.history_end, config.plural_only)


def _swap(spark: SparkSession, df: DataFrame, path: str, files: Mapping[str, str]) -> None:
    """Write ``df`` beside ``path``, with small files that readers skip, and put it in its place."""
    fresh = f"{path}-{uuid4().hex}"
    write_table(df, fresh)
    for name, text in files.items():
        write_text(spark, f"{fresh}/{name}", text)
    remove(spark, path)
    rename(spark, fresh, path)


def affected_customers(spark: SparkSession, silver_path: str, changed: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """Customers whose gold rows may differ, and all whose rows are needed to build these, as tables below ``work``.

    A customer's labels and sums depend on the rows of all its loans, whoever else has them. Only loans of several customers, counting those that a change
    took them from, lead from one to another; so loans are shuffled once to find these, and they alone are followed.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    loans = _index(spark, f"{silver_path}/{KEYS}/loan_daily")
    first = changed.select(CUSTOMER).distinct()
    if loans is None:
        differ = kept(first, "differ")
        return differ, differ
    pairs = loans.select(CUSTOMER, LOAN).unionByName(changed.select(CUSTOMER, LOAN)).filter(F.col(LOAN).isNotNull())
    known, rows = F.count(CUSTOMER), F.count(F.lit(1))
    shared = pairs.groupBy(LOAN).agg((F.min(CUSTOMER) != F.max(CUSTOMER)).alias("differ"), ((known > 0) & (known < rows)).alias("some_missing"))
    # stored, so that Spark knows how few they are before it joins all pairs with them
    shared_loans = kept(shared.filter("differ or some_missing").select(LOAN), "shared_loans")
    shared_pairs = kept(_in(pairs, shared_loans, LOAN).distinct(), "shared")

    def spread(customers: DataFrame) -> DataFrame:
        own = _in(shared_pairs, customers, CUSTOMER).select(LOAN).distinct()
        return customers.unionByName(_in(shared_pairs, own, LOAN).select(CUSTOMER)).distinct()

    differ = kept(spread(first), "differ")
    return differ, kept(spread(differ), "needed")


def _narrowed(spark: SparkSession, df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of the stored ``customers``, or all rows where the list is too long to broadcast: joins with these customers' labels leave the others out later."""
    return _in(df, customers, CUSTOMER) if may_broadcast(spark, customers) else df


def _without(spark: SparkSession, old: DataFrame, differ: DataFrame, path: str) -> DataFrame:
    """Rows of a stored table without some customers. Where their list is too long to broadcast, those who stay are listed at ``path``; they may be few."""
    if may_broadcast(spark, differ):
        return _in(old, differ, CUSTOMER, "left_anti")
    write_table(_in(old.select(CUSTOMER).distinct(), differ, CUSTOMER, "left_anti"), path)
    return _in(old, spark.read.parquet(path), CUSTOMER)


def _latest(
    spark: SparkSession, config: Config, table: str, labels: DataFrame, needed: DataFrame, like: DataFrame
) -> DataFrame:
    """Snapshots in force, from the newest months back."""
    path = f"{config.silver_path}/{table}"
    ledger = Ledger.read(spark, f"{config.silver_path}/{LEDGERS}/{table}")
    months = [month_of(m) for m, f in ledger.months.items() if f["rows"]]
    read = lambda wanted: _narrowed(spark, read_months(spark, path, ledger, wanted), needed)
    found = asof_newest_first(read, months, labels, config.history_end)
    return found if found is not None else like.limit(0)


def update_gold(spark: SparkSession, config: Config, refresh: bool = False) -> bool:
    """Bring label store and feature matrix up to date with silver; whether anything was built.

    Other parameters than those of the stored tables build them whole.
    """
    sets = change_sets(spark, config.silver_path)
    state = json.loads(read_text(spark, f"{config.gold_path}/{TAKEN}") or "{}")
    taken_sets = state.get("sets", [])
    if refresh or state.get("parameters") != _parameters(config) or any(s.startswith(EVERYBODY) and s not in taken_sets for s in sets):
        build_gold(spark, config, refresh=True)
        write_text(spark, f"{config.gold_path}/{TAKEN}", json.dumps({"parameters": _parameters(config), "sets": sets}))
        return True
    new = [s for s in sets if s not in taken_sets]
    if not new:
        return False
    work = f"{shared_dir(spark)}/gold-{uuid4().hex}"
    changed = reduce(DataFrame.unionByName, [spark.read.parquet(f"{config.silver_path}/{CHANGES}/{s}") for s in new])
    differ, needed = affected_customers(spark, config.silver_path, changed, work)
    update_history(spark, config.silver_path)
    tables, days = {}, {}
    for n in TABLES:
        keys = _index(spark, f"{config.silver_path}/{KEYS}/{n}")
        met = [] if keys is None else _in(keys, needed, CUSTOMER).select(*PARTITION_KEYS).distinct().collect()
        ledger = Ledger.read(spark, f"{config.silver_path}/{LEDGERS}/{n}")
        months = [(r.year, r.month) for r in met]
        tables[n] = _narrowed(spark, read_months(spark, f"{config.silver_path}/{n}", ledger, months), needed)
        if (history := read_history(spark, config.silver_path, n, months)) is not None:
            days[n] = _narrowed(spark, history, needed)
    labels = label_store(tables["loan_daily"], config.prediction_months, config.label_window_months, config.max_loan_months)
    # what replaces stored rows is marked while it is narrow; the others' labels count for loans that they share
    replaced = differ.select(F.col(CUSTOMER).alias("differing"), F.lit(True).alias(DIFFERS))
    marked = needed.select(F.col(CUSTOMER).alias("wanted_key")).join(replaced, F.col("wanted_key").eqNullSafe(F.col("differing")), "left")
    labels = labels.join(splittable(marked.drop("differing")), F.col(CUSTOMER).eqNullSafe(F.col("wanted_key"))).drop("wanted_key")
    write_table(labels, f"{work}/labels")
    labels = spark.read.parquet(f"{work}/labels")
    if config.grain == "customer":
        for n in ("attributes", "financials"):
            tables[n] = _latest(spark, config, n, labels, needed, tables[n])
    tables["loan_daily"] = days.get("loan_daily", tables["loan_daily"])  # sums by day are enough from here on
    gold = gold_features(
        labels,
        **tables,
        grain=config.grain,
        history_end=config.history_end,
        plural_only=config.plural_only,
        click_days=days.get("clickstream"),
    )
    mark = json.dumps({"build": uuid4().hex, "key": digest("increment", sets)})
    taken = json.dumps({"parameters": _parameters(config), "sets": sets})
    for path, part, files in ((config.label_path, labels, {}), (config.gold_path, gold, {TAKEN: taken})):
        old = spark.read.parquet(path)
        part = part.filter(DIFFERS).drop(DIFFERS)
        part = part.select(*(F.col(c).cast(old.schema[c].dataType).alias(c) if c in old.columns else c for c in part.columns))
        whole = _without(spark, old, differ, f"{work}/stay-{uuid4().hex}").unionByName(part, allowMissingColumns=True)
        _swap(spark, whole, path, {"_build.json": mark, **files})
    label_metrics(spark, config, spark.read.parquet(config.label_path))
    remove(spark, work)
    return True
