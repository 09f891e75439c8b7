import datetime as dt
import random

import pytest
from conftest import day, values

from riskmart.operators import asof

SNAPSHOTS = "Customer_ID int, snapshot_date date, v string"
LABELS = "loan_id int, Customer_ID int, prediction_date date"


def frames(spark, snapshots, labels):
    return (
        spark.createDataFrame([(c, day(d), v) for c, d, v in snapshots], SNAPSHOTS),
        spark.createDataFrame([(l, c, day(d)) for l, c, d in labels], LABELS),
    )


@pytest.fixture
def example(spark):
    snapshots = [
        (1, "2023-01-01", "old"),
        (1, "2023-03-01", "tie a"),
        (1, "2023-03-01", "tie b"),
        (1, "2023-05-01", "later"),
        (2, "2023-04-01", "on the day"),
        (3, "2023-09-01", "too late"),
        (4, None, "undated"),
        (None, "2023-01-01", "nobody"),
    ]
    labels = [(10, 1, "2023-02-01"), (11, 1, "2023-04-01"), (20, 2, "2023-04-01"), (30, 3, "2023-04-01")]
    labels += [(40, 4, "2023-04-01"), (50, None, "2023-04-01"), (60, 5, "2023-04-01")]
    return frames(spark, snapshots, labels)


def test_customer_grain_takes_the_latest_day_of_any_prediction_and_keeps_ties(example):
    expected = [(1, day("2023-03-01"), "tie a"), (1, day("2023-03-01"), "tie b"), (2, day("2023-04-01"), "on the day")]
    for method in (asof.asof_latest, asof.asof_max_rejoin, asof.asof_running_max):
        assert values(method(*example)) == expected


def test_loan_grain_never_sees_later_snapshots(example):
    assert values(asof.asof_latest(*example, grain="loan"), "Customer_ID", "prediction_date", "v") == [
        (1, day("2023-02-01"), "old"),
        (1, day("2023-04-01"), "tie a"),
        (1, day("2023-04-01"), "tie b"),
        (2, day("2023-04-01"), "on the day"),
    ]


def test_exclusive_end_leaves_out_the_prediction_day(example):
    for grain in ("customer", "loan"):
        assert (2, "on the day") not in values(asof.asof_latest(*example, grain, "exclusive"), "Customer_ID", "v")
        assert (1, "tie a") in values(asof.asof_latest(*example, grain, "exclusive"), "Customer_ID", "v")


def test_random_snapshots_match_pairing(spark):
    rng = random.Random(3)
    start = dt.date(2023, 1, 1)

    def customer():
        return rng.choice([0, rng.randrange(20)])

    snapshots = spark.createDataFrame(
        [(customer(), start + dt.timedelta(rng.randrange(50)), str(i)) for i in range(300)], SNAPSHOTS
    )
    labels = spark.createDataFrame(
        [(i, customer(), start + dt.timedelta(rng.randrange(50))) for i in range(60)], LABELS
    )
    snapshots.createOrReplaceTempView("snapshots")
    labels.createOrReplaceTempView("predictions")
    for grain, extra in {"customer": "", "loan": ", p.prediction_date"}.items():
        expected = spark.sql(
            f"""select s.* {extra.replace('p.', 'l.')} from snapshots s join (
                    select s.Customer_ID{extra}, max(s.snapshot_date) latest
                    from snapshots s join predictions p on s.Customer_ID = p.Customer_ID
                    where s.snapshot_date <= p.prediction_date group by s.Customer_ID{extra}) l
                on s.Customer_ID = l.Customer_ID and s.snapshot_date = l.latest"""
        )
        assert values(asof.asof_latest(snapshots, labels, grain)) == values(expected)
    assert values(asof.asof_running_max(snapshots, labels)) == values(asof.asof_max_rejoin(snapshots, labels))
