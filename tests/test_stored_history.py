"""Aggregates from day tables that batches were added to equal those of all rows at once."""

import datetime as dt
import random

import pytest

from riskmart.operators import history as H
from riskmart.plans import stored_history as S
from riskmart.schemas import CLICK_FEATURES


def texts(df):
    rounded = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(rounded, r)) for r in df.select(*sorted(df.columns)).collect())


def clicks(seed, n=150):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.2 else 1e6 + rng.randrange(1000) / 7
    return [
        (rng.choice(["a", "b", "c", None]), dt.date(2023, rng.randrange(1, 4), rng.randrange(1, 6)), *[value() for _ in CLICK_FEATURES])
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def parts(spark):
    schema = "Customer_ID string, snapshot_date date, " + ", ".join(f"{c} double" for c in CLICK_FEATURES)
    return [spark.createDataFrame(clicks(i, 150 if i < 3 else 4), schema).cache() for i in range(4)]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(c, f"L{i}", dt.date(2023, 1 + i % 3, 3 + i), 0) for c in "abcd" for i in range(5)]
    return spark.createDataFrame(rows, "Customer_ID string, loan_id string, prediction_date date, label int")


@pytest.mark.parametrize("grain", ["customer", "loan"])
def test_moments_of_several_batches(spark, parts, labels, tmp_path, grain):
    path = str(tmp_path / "days")
    for i, part in enumerate(parts):
        assert S.add_click_days(spark, path, part, str(i))
    assert S.add_click_days(spark, path, parts[0], "0") == []  # counted already
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    days = S.read_days(spark, path)
    assert days.count() == days.select("Customer_ID", "day").distinct().count()
    assert texts(H.clickstream_agg_of_days(days, labels, grain)) == texts(H.clickstream_agg(whole, labels, grain))


def test_a_batch_touches_its_months_only_and_counts_once(spark, tmp_path, monkeypatch):
    schema = "loan_id string, Customer_ID string, snapshot_date date, paid_amt double, due_amt double, overdue_amt double"
    row = lambda month, paid: ("L1", "a", dt.date(2023, month, 5), paid, 10.0, None)
    path = str(tmp_path / "days")
    give = lambda batch, *rows: S.add_loan_days(spark, path, spark.createDataFrame(rows, schema), batch)
    assert give("1", row(1, 1.0), row(2, 2.0)) == [(2023, 1), (2023, 2)]
    for file in (tmp_path / "days" / "year=2023" / "month=1").glob("*.parquet"):
        kept = file.read_bytes()
        file.write_bytes(b"not to be read")
    assert give("2", row(2, 5.0), row(3, 7.0)) == [(2023, 2), (2023, 3)]
    file.write_bytes(kept)
    crc = file.with_name(f".{file.name}.crc")
    crc.unlink(missing_ok=True)
    with monkeypatch.context() as m:
        m.setattr(S, "write_partitions", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            give("3", row(2, 100.0))
    give("3", row(2, 100.0))
    give("4", row(3, 0.5))
    found = {r.snapshot_date.month: (r.paid_amt, r.due_amt, r.overdue_amt) for r in S.read_days(spark, path).collect()}
    assert found == {1: (1.0, 10.0, None), 2: (107.0, 30.0, None), 3: (7.5, 20.0, None)}
    assert not list(tmp_path.glob("days-*"))


def test_a_batch_of_loan_rows_is_summed_once(spark, tmp_path, monkeypatch):
    rows = [("L1", "a", dt.date(2023, 1, 5), 1.0, 2.0, None), ("L1", "a", dt.date(2023, 1, 5), 4.0, 8.0, 1.0)]
    daily = spark.createDataFrame(rows, "loan_id string, Customer_ID string, snapshot_date date, paid_amt double, due_amt double, overdue_amt double")
    calls = []
    monkeypatch.setattr(S, "loan_days", lambda df: calls.append(df) or H.loan_days(df))
    S.add_loan_days(spark, str(tmp_path), daily.withColumn("loan_amt", daily.due_amt), "1")
    assert len(calls) == 1
    assert [tuple(r) for r in S.read_days(spark, str(tmp_path)).collect()] == [("L1", "a", dt.date(2023, 1, 5), 5.0, 10.0, 1.0)]
