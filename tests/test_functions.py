import pytest
from conftest import day
from pyspark.sql import functions as F

from riskmart.functions import (
    blank_placeholders,
    float_or_null,
    int_or_null,
    month_key,
    na_to_null,
    parse_day_month_year,
    ratio,
    without_underscores,
)
from riskmart.operators.features import credit_history_months


def apply(spark, cases, function, kind="string"):
    rows = [(i, text) for i, text in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").withColumn("y", function(F.col("x")))
    return {cases[r.i]: r.y for r in df.collect()}


def test_dates_are_strict_day_month_year(spark):
    good = {
        "13/02/2023": "2023-02-13",
        "1/2/2023": "2023-02-01",
        " 01/02/2023\t": "2023-02-01",
        " 01/02/2023\n": "2023-02-01",
        "29/02/2024": "2024-02-29",
        "11/04/2262": "2262-04-11",
        "22/09/1677": "1677-09-22",
    }
    bad = [
        "31/02/2023",
        "29/02/2023",
        "01/02/23",
        "2023-01-01",
        "01/02/2023 00:00",
        "001/02/2023",
        "13/13/2023",
        "31/12/9999",
        "12/04/2262",
        "21/09/1677",
        "",
        "nan",
        None,
    ]
    expected = {k: day(v) for k, v in good.items()} | dict.fromkeys(bad)
    assert apply(spark, list(expected), parse_day_month_year) == expected


def test_missing_tokens(spark):
    expected = {"NA": None, "": None, "null": None, "n/a": None, "<NA>": None, None: None}
    expected |= {"NM": "NM", " sp ": " sp ", " NA": " NA", "0": "0"}
    assert apply(spark, list(expected), na_to_null) == expected


def test_age_text_to_int(spark):
    expected = {"25_": 25, "_25": 25, "23.0": 23, "23.9": 23, "-500": -500, "-1.5": -1, " 7 ": 7, ".5": 0}
    expected |= dict.fromkeys(["abc", "", "99999999999", "99999999999.5", "1e3", "12d", "1.2.3", None])
    assert apply(spark, list(expected), lambda c: int_or_null(without_underscores(c))) == expected


def test_text_to_float32(spark):
    expected = {"__10000__": 10000.0, "12_3": 123.0, "16777217": 16777216.0, "-0.5": -0.5}
    expected |= dict.fromkeys(["x", "", None])
    assert apply(spark, list(expected), lambda c: float_or_null(without_underscores(c))) == expected


def test_placeholders_are_matched_trimmed_and_others_kept_untrimmed(spark):
    expected = {"_______": None, " _ ": None, " Lawyer ": " Lawyer ", "\t_": "\t_", None: None}
    assert apply(spark, list(expected), lambda c: blank_placeholders(c, ("_______", "_"))) == expected


@pytest.mark.parametrize(
    "plural_only, singular", [(True, {"1 Year and 2 Months": 2, "3 Years and 1 Month": 36}), (False, {"1 Year and 2 Months": 14, "3 Years and 1 Month": 37})]
)
def test_credit_history(spark, plural_only, singular):
    expected = {"10 Years and 9 Months": 129, "5 Years": 60, "7  Months": 7, "": 0, "NA": 0, None: 0} | singular
    assert apply(spark, list(expected), lambda c: credit_history_months(c, plural_only)) == expected


def test_ratio_has_no_zero_division(spark):
    assert apply(spark, [0.0, 4.0, None], lambda c: ratio(F.lit(2), c), "double") == {0.0: None, 4.0: 0.5, None: None}


def test_month_key_takes_dates_and_iso_texts(spark):
    expected = {"2023-01-31": "2023-01", "31/01/2023": None, None: None}
    assert apply(spark, list(expected), month_key) == expected
    df = spark.createDataFrame([(day("2023-12-05"),)], "x date")
    assert df.select(month_key(F.col("x"))).first()[0] == "2023-12"
