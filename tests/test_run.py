"""CSV files to models, checking each layer."""

import dataclasses
import datetime as dt
import os
import random
import shutil

import pytest
from conftest import values

from riskmart import __main__ as command
from riskmart.config import Config
from riskmart.operators import metrics, model
from riskmart.plans import bronze
from riskmart.plans import run as R
from riskmart.plans.run import run
from riskmart.plans.silver import read_bronze, read_silver
from riskmart.schemas import CLICK_FEATURES, FINANCIAL_NUMBERS
from riskmart.sources import build_id, is_complete, tables

CUSTOMERS, BAD = 60, {"C3", "C7", "C11"}


def text(date):
    return f"{date.day}/{date.month}/{date.year}"


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    (root / "data").mkdir()
    rng = random.Random(5)
    lines = {
        "features_attributes": ["Customer_ID,Name,Age,SSN,Occupation,snapshot_date"],
        "features_financials": [
            "Customer_ID," + ",".join(FINANCIAL_NUMBERS)
            + ",Credit_Mix,Payment_of_Min_Amount,Payment_Behaviour,Credit_History_Age,snapshot_date"
        ],
        "lms_loan_daily": ["loan_id,Customer_ID,loan_start_date,loan_amt,due_amt,paid_amt,overdue_amt,snapshot_date"],
        "feature_clickstream": ["Customer_ID," + ",".join(CLICK_FEATURES) + ",snapshot_date"],
    }
    for i in range(CUSTOMERS):
        customer, start = f"C{i}", dt.date(2023, 1 + i % 6, 5)
        known = text(start - dt.timedelta(20))
        age = "-500" if customer == "C3" else f"{20 + i}_"
        ssn = "#F%$D@*&8" if customer == "C7" else "123-45-6789"
        lines["features_attributes"].append(f"{customer},N {i},{age},{ssn},{rng.choice(['_______', 'Lawyer', 'Cook'])},{known}")
        numbers = ",".join(f"{rng.randrange(1, 5000)}.5_" for _ in FINANCIAL_NUMBERS)
        lines["features_financials"].append(f"{customer},{numbers},{rng.choice(['_', 'Good'])},NM,High,{i} Years and 2 Months,{known}")
        bad_payer = rng.random() < 0.5
        for month in range(5):
            due = start + dt.timedelta(30 * month)
            paid = -1 if customer == "C11" and month == 2 else 100
            overdue = 50 if bad_payer and month == 3 else 0
            lines["lms_loan_daily"].append(f"L{i},{customer},{text(start)},500,100,{paid},{overdue},{text(due)}")
        for _ in range(3):
            clicks = ",".join(str(rng.randrange(100) + 100 * bad_payer) for _ in CLICK_FEATURES)
            lines["feature_clickstream"].append(f"{customer},{clicks},{known}")
    lines["feature_clickstream"].append("C1," + "1," * len(CLICK_FEATURES) + "2023-01-01")
    for name, content in lines.items():
        (root / "data" / f"{name}.csv").write_text("\n".join(content) + "\n")
    return Config.under(str(root))


@pytest.fixture(scope="module")
def result(spark, config):
    return run(spark, config)


def test_bronze_holds_the_dated_rows_by_month(spark, config, result):
    bronze = read_bronze(spark, config.bronze_path)
    assert bronze["loan_daily"].count() == CUSTOMERS * 5
    assert bronze["clickstream"].count() == CUSTOMERS * 3
    assert spark.read.parquet(f"{config.bronze_path}/rejects/clickstream").count() == 1
    assert values(metrics.partition_distribution(bronze["attributes"]))[0] == (2022, 12, 10)
    assert set(read_bronze(spark, config.bronze_path, [(2023, 1)])["attributes"].select("month").distinct().collect()[0]) == {1}


def test_silver_has_no_flagged_customer(spark, config, result):
    flagged = spark.read.parquet(f"{config.silver_path}/flagged")
    assert {r.Customer_ID for r in flagged.collect()} == BAD
    silver = read_silver(spark, config.silver_path)
    for df in silver.values():
        assert not BAD & {r.Customer_ID for r in df.select("Customer_ID").distinct().collect()}
    counts = {r.table_name: r.rows_removed for r in metrics.removal_counts(read_bronze(spark, config.bronze_path), flagged).collect()}
    assert counts == {"attributes": 3, "financials": 3, "loan_daily": 15, "clickstream": 9}
    summary = metrics.flag_summary(read_bronze(spark, config.bronze_path), flagged).first()
    assert (summary.n_flagged, summary.n_customers, summary.flagged_percent) == (3, CUSTOMERS, 5.0)


def test_gold_has_a_row_per_loan(spark, config, result):
    labels, gold = spark.read.parquet(config.label_path), spark.read.parquet(config.gold_path)
    assert labels.count() == gold.count() == CUSTOMERS - len(BAD)
    assert gold.filter("hist_total_due is null or fe_1_mean is null or DTI is null").count() == 0
    assert 5 < labels.filter("label = 1").count() < CUSTOMERS - 5


def test_models_are_saved_and_the_clicks_give_the_label_away(spark, config, result):
    assert result.models["random_forest"].auc > 0.9
    assert result.train.count() + result.test.count() == CUSTOMERS - len(BAD)
    assert result.importance.first().feature.startswith("fe_")
    assert is_complete(spark, f"{config.model_path}/random_forest_pipeline/fingerprint")


def test_counts_are_stored_beside_the_layers(spark, config, result):
    stored = spark.read.parquet(f"{config.silver_path}/metrics/flag_summary").first()
    assert (stored.n_flagged, stored.n_customers, stored.flagged_percent) == (3, CUSTOMERS, 5.0)
    removed = spark.read.parquet(f"{config.silver_path}/metrics/removal_counts").collect()
    assert {r.table_name: r.rows_removed for r in removed}["loan_daily"] == 15
    months = spark.read.parquet(f"{config.bronze_path}/metrics/partition_distribution/attributes")
    assert values(months)[0] == (2022, 12, 10)
    labels = spark.read.parquet(f"{config.label_path}_metrics/label_distribution").collect()
    assert sum(r.n_loans for r in labels) == CUSTOMERS - len(BAD)
    assert spark.read.parquet(f"{config.label_path}_metrics/shared_loans").first()[0] == 0


def test_unchanged_run_builds_nothing(spark, config, result, monkeypatch):
    def built(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(tables, "write_table", built)
    monkeypatch.setattr(bronze, "write_table", built)
    monkeypatch.setattr(model, "fit", built)
    again = run(spark, config)
    assert {n: t.auc for n, t in again.models.items()} == {n: t.auc for n, t in result.models.items()}
    with pytest.raises(AssertionError, match="built again"):
        run(spark, config, split="random")  # other training rows


def test_changed_parameters_and_files_are_built_again(spark, config, result, tmp_path):
    root = str(tmp_path)
    shutil.copytree(os.path.dirname(os.path.dirname(config.raw_paths["attributes"])), root, dirs_exist_ok=True)
    own = Config.under(root)
    R.run_bronze(spark, own)
    R.run_silver(spark, own)
    R.run_gold(spark, own)
    first = build_id(spark, own.gold_path)
    R.run_gold(spark, own)
    assert build_id(spark, own.gold_path) == first
    changed = dataclasses.replace(own, grain="loan", prediction_months=3)
    R.run_gold(spark, changed)
    labels = spark.read.parquet(own.label_path)
    assert build_id(spark, own.gold_path) != first
    assert {r.prediction_date.month for r in labels.select("prediction_date").distinct().collect()} == {4, 5, 6, 7, 8, 9}
    with open(own.raw_paths["clickstream"], "a") as file:
        file.write("C1," + "1," * len(CLICK_FEATURES) + "2/1/2023\n")
    before = spark.read.parquet(f"{own.silver_path}/clickstream").count()
    R.run_bronze(spark, changed)
    R.run_silver(spark, changed)
    assert spark.read.parquet(f"{own.silver_path}/clickstream").count() == before + 1


def test_command_line_reaches_every_parameter(spark, config, result):
    root = os.path.dirname(os.path.dirname(config.raw_paths["attributes"]))
    line = "--stage gold --grain loan --history-end exclusive --prediction-months 2 --label-window-months 6"
    line += " --max-loan-months 9 --test-last-n-months 1 --any-unit-form --exclude year month --multi-line attributes"
    args = command.parser().parse_args([root, *line.split(), "--column-type", "financials", "Rate", "double"])
    own = command.config_of(args)
    assert (own.grain, own.history_end, own.plural_only, own.exclude) == ("loan", "exclusive", False, ("year", "month"))
    assert (own.prediction_months, own.label_window_months, own.max_loan_months, own.test_last_n_months) == (2, 6, 9, 1)
    assert own.multi_line == {"attributes": True} and own.column_types == {"financials": {"Rate": "double"}}
    for stage in ("bronze", "silver", "gold"):
        assert command.start(spark, command.parser().parse_args([root, "--stage", stage])) is None
    found = command.start(spark, command.parser().parse_args([root, "--stage", "model"]))
    assert found.models.keys() == result.models.keys()


def test_config_checks_its_options():
    with pytest.raises(ValueError, match="grain"):
        Config({}, grain="month")
    with pytest.raises(ValueError, match="history_end"):
        Config({}, history_end="never")
    for option in ("raw_mode", "median"):
        with pytest.raises(ValueError, match=option):
            Config({}, **{option: "other"})
    args = command.parser().parse_args(["root", "--raw-mode", "mirror", "--median", "exact"])
    assert (command.config_of(args).raw_mode, command.config_of(args).median) == ("mirror", "exact")
