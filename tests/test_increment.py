"""Silver month by month and gold customer by customer equal what a whole build gives."""

import datetime as dt
import glob
import random
from dataclasses import replace

import pytest
from conftest import values
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.plans import increment as I
from riskmart.plans.bronze import ingest_rows
from riskmart.plans.gold import build_gold
from riskmart.plans.increment import update_gold, update_silver
from riskmart.plans.silver import TABLES, build_silver, read_silver
from riskmart.schemas import CLICK_FEATURES, FINANCIAL_CATEGORIES, FINANCIAL_NUMBERS

SCHEMAS = {
    "attributes": "Customer_ID string, Name string, Age string, SSN string, Occupation string, snapshot_date date",
    "financials": "Customer_ID string, "
    + ", ".join(f"{c} string" for c in (*FINANCIAL_NUMBERS, *FINANCIAL_CATEGORIES, "Credit_History_Age"))
    + ", snapshot_date date",
    "loan_daily": "loan_id string, Customer_ID string, loan_start_date date, loan_amt double, due_amt double, paid_amt double, "
    "overdue_amt double, snapshot_date date",
    "clickstream": "Customer_ID string, " + ", ".join(f"{c} double" for c in CLICK_FEATURES) + ", snapshot_date date",
}
MONTHS = [(2023, m) for m in range(1, 6)]


def rows_of(month, seed=0, bad=()):
    """A month of all tables. Loans are shared by neighbours, some ids are missing."""
    rng = random.Random(f"{month}{seed}")
    day = lambda: dt.date(*month, rng.randrange(1, 28))
    out = {n: [] for n in TABLES}
    for i in rng.sample(range(12), 7):
        c = None if i == 11 else f"C{i}"
        ssn = "bad" if c in bad else "123-45-6789"
        out["attributes"].append((c, f"N{i}", "30_", ssn, "Cook", day()))
        out["financials"].append((c, *[str(rng.randrange(100))] * 7, "Good", "NM", "High", "3 Years and 2 Months", day()))
        out["clickstream"].append((c, *[float(rng.randrange(50))] * len(CLICK_FEATURES), day()))
        start = dt.date(2023, 1 + i % 3, 3)
        for loan in {f"L{i}", f"L{i // 2}s", None if i == 5 else f"L{i}"}:
            out["loan_daily"].append((loan, c, start, 9.0, 5.0, float(rng.randrange(9)), float(rng.randrange(3) == 0), day()))
    return out


class Feed:
    """Months given to bronze one after the other, and what a whole build makes of them."""

    def __init__(self, spark, root):
        self.spark, self.root, self.months, self.wholes = spark, root, {}, 0
        self.config = Config.under(f"{root}/own", label_window_months=2, max_loan_months=6)

    def give(self, months):
        self.months |= months
        for name in TABLES:
            rows = [r for m in months.values() for r in m[name]]
            ingest_rows(self.spark, name, self.spark.createDataFrame(rows, SCHEMAS[name]), self.config.bronze_path)

    def update(self, config=None):
        rebuilt = update_silver(self.spark, self.config.bronze_path, self.config.silver_path)
        return rebuilt, update_gold(self.spark, config or self.config)

    def check(self, config=None):
        config, self.wholes = config or self.config, self.wholes + 1
        root = f"{self.root}/whole{self.wholes}"
        whole = replace(config, **{f"{k}_path": f"{root}/{k}" for k in ("bronze", "silver", "label", "gold")})
        for name in TABLES:
            rows = [r for m in self.months.values() for r in m[name]]
            ingest_rows(self.spark, name, self.spark.createDataFrame(rows, SCHEMAS[name]), whole.bronze_path)
        build_silver(self.spark, whole.bronze_path, whole.silver_path)
        build_gold(self.spark, whole)
        own, other = read_silver(self.spark, config.silver_path), read_silver(self.spark, whole.silver_path)
        for name in TABLES:
            assert texts(own[name]) == texts(other[name].select(*own[name].columns)), name
        read = self.spark.read.parquet
        assert texts(read(config.label_path)) == texts(read(whole.label_path))
        assert texts(read(config.gold_path)) == texts(read(whole.gold_path).select(*read(config.gold_path).columns))
        for metric in ("flag_summary", "removal_counts"):
            assert texts(read(f"{config.silver_path}/metrics/{metric}")) == texts(read(f"{whole.silver_path}/metrics/{metric}"))


def texts(df):
    rounded = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(rounded, r)) for r in df.collect())


@pytest.fixture
def feed(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.give({m: rows_of(m, bad=("C3",)) for m in MONTHS[:3]})
    feed.update()
    return feed


def test_new_and_corrected_months_and_changing_flags(spark, feed):
    assert feed.update() == ({n: [] for n in TABLES}, False)
    feed.give({MONTHS[3]: rows_of(MONTHS[3])})
    rebuilt, built = feed.update()
    assert built and all(r == [MONTHS[3]] for r in rebuilt.values())  # nobody's flag changed
    feed.give({MONTHS[1]: rows_of(MONTHS[1], 7, bad=("C1", "C2")), MONTHS[0]: rows_of(MONTHS[0])})
    rebuilt, _ = feed.update()
    assert len(rebuilt["clickstream"]) > 2  # months of customers that became flagged, or no longer are
    feed.check()


def test_months_that_did_not_change_are_not_read(spark, feed):
    for path in glob.glob(f"{feed.config.bronze_path}/*/year=2023/month=[12]/*.parquet"):
        with open(path, "wb") as file:
            file.write(b"not to be read")
    feed.give({MONTHS[3]: rows_of(MONTHS[3])})
    rebuilt, built = feed.update()
    assert built and set(map(tuple, rebuilt.values())) == {(MONTHS[3],)}
    assert {r.month for r in read_silver(spark, feed.config.silver_path)["attributes"].select("month").distinct().collect()} == {1, 2, 3, 4}


def test_a_run_that_breaks_off_is_made_good(spark, feed, monkeypatch):
    feed.give({MONTHS[3]: rows_of(MONTHS[3], bad=("C4",)), MONTHS[0]: rows_of(MONTHS[0], 3)})
    for place in ("_rebuild_months", "_silver_metrics", "_swap"):  # one after the other
        with monkeypatch.context() as m:
            calls = []
            real = getattr(I, place)

            def broken(*a, real=real, calls=calls):
                calls.append(1)
                if len(calls) == 2 or real.__name__ == "_silver_metrics":
                    raise OSError("lost")
                return real(*a)

            m.setattr(I, place, broken)
            with pytest.raises(OSError, match="lost"):
                feed.update()
    feed.update()
    feed.check()


def test_other_parameters_build_gold_whole(spark, feed):
    changed = replace(feed.config, grain="loan", prediction_months=2)
    assert feed.update(changed)[1]
    feed.give({MONTHS[4]: rows_of(MONTHS[4])})
    assert feed.update(changed)[1]
    feed.check(changed)
    assert values(spark.read.parquet(f"{changed.label_path}_metrics/label_distribution").groupBy().sum("n_loans"))[0][0] > 0


def test_a_list_of_customers_too_long_to_broadcast_moves_no_wide_rows(spark, feed, monkeypatch):
    plans, real = [], I._swap

    def seen(spark, df, *a):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(spark, df, *a)

    monkeypatch.setattr(I, "_swap", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        feed.give({MONTHS[3]: rows_of(MONTHS[3], bad=("C4",)), MONTHS[1]: rows_of(MONTHS[1], 7)})
        feed.update()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plans[-1].split("\n")
    part = next(i for i, line in enumerate(lines) if line.startswith("+- "))
    assert "Join Inner" in next(line for line in lines[part:] if "Join " in line)  # the features' own join comes last
    feed.check()


def test_typed_rows_are_worked_out_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        made.add(1)
        return i

    days = F.date_add(F.lit("2023-01-20").cast("date"), (F.col("id") % 20).cast("int")).alias("snapshot_date")
    rows = spark.range(100).select(seen("id").alias("loan_id"), days)
    ingest_rows(spark, "loans", rows, str(tmp_path))
    assert made.value == 100
    assert values(I.read_source(spark, str(tmp_path), "loans"), "loan_id") == [(i,) for i in range(100)]
    ingest_rows(spark, "loans", rows.filter("loan_id < 0"), str(tmp_path))  # a batch without rows
    assert I.read_source(spark, str(tmp_path), "loans").count() == 100
    assert not [p for p in glob.glob(f"{tmp_path}/*") if "loans-" in p]


def test_a_first_silver_lists_no_customers_and_builds_gold_whole(spark, feed):
    assert not glob.glob(f"{feed.config.silver_path}/changes/*/*.parquet")
    for path in (feed.config.bronze_path, feed.config.silver_path):
        I.remove(spark, path)
    feed.months = {}
    feed.give({MONTHS[4]: rows_of(MONTHS[4], 5)})
    assert feed.update()[1]
    feed.check()  # customers of the silver before are gone
    assert feed.update() == ({n: [] for n in TABLES}, False)


@pytest.mark.parametrize("seed", range(3))
def test_customers_that_a_change_reaches(spark, tmp_path, seed):
    rng = random.Random(seed)
    loans = [None, *(f"L{i}" for i in range(30))]
    pairs = [(rng.choice([None, *range(25)]), loan) for loan in loans for _ in range(rng.choice((1, 1, 1, 3)))]
    changed = rng.sample([p for p in pairs if p[1]], 2) + [(99, "L7"), (24, None)]  # L7 has lost a customer
    rows = [(c, loan, 2023, m) for c, loan in pairs for m in rng.sample((1, 2, 3), 2)]
    silver = f"{tmp_path}/silver"
    I.write_partitions(spark.createDataFrame(rows, "Customer_ID long, loan_id string, year int, month int"), f"{silver}/{I.KEYS}/loan_daily")

    def spread(customers, more=()):
        own = {loan for c, loan in pairs if loan and c in customers} | {loan for loan in more if loan}
        return customers | {c for c, loan in pairs if loan in own}

    near = spread({c for c, _ in changed}, [loan for _, loan in changed])
    found = I.affected_customers(spark, silver, spark.createDataFrame(changed, "Customer_ID long, loan_id string"), f"{tmp_path}/work")
    for df, wanted in zip(found, (near, spread(near)), strict=True):
        assert sorted(map(str, (r[0] for r in df.collect()))) == sorted(map(str, wanted))
