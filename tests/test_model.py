import math

import pytest
from conftest import day, values
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskmart.operators import model as M
from riskmart.operators.splits import hash_split, oot_split, prediction_months
from riskmart.plans.modelling import split, train_models
from riskmart.sources import digest


def dated(spark, *dates):
    return spark.createDataFrame([(i, day(d)) for i, d in enumerate(dates)], "loan_id int, prediction_date date")


MONTHS = ("2023-01-05", "2023-02-05", "2023-03-05", "2023-04-05", "2023-05-05")


def test_last_months_are_the_test_set_and_undated_rows_in_neither(spark):
    df = dated(spark, *MONTHS, "2023-05-31", None)
    train, test = oot_split(df, 3)
    assert values(train, "loan_id") == [(0,), (1,)]
    assert values(test, "loan_id") == [(2,), (3,), (4,), (5,)]
    assert train.columns == test.columns == df.columns
    assert values(prediction_months(df))[0] == ("2023-01",)


def test_split_needs_a_training_month(spark):
    with pytest.raises(ValueError, match="no training data"):
        split(dated(spark, *MONTHS[:3]))
    with pytest.raises(ValueError, match="split"):
        split(dated(spark, *MONTHS), "other")


@pytest.mark.parametrize("columns", [["loan_id"], ["loan_id", "prediction_date"]])
def test_split_without_dates_is_random(spark, columns):
    df = dated(spark, *[None] * 500).select(*columns)
    train, test = split(df)
    assert train.count() + test.count() == 500 and 60 < test.count() < 140


def test_hash_split_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "loan_id")
    one, other = (hash_split(x, "loan_id")[0] for x in (df.coalesce(1), df.repartition(7)))
    assert values(one) == values(other)
    train, test = hash_split(df, "loan_id")
    assert train.intersect(test).count() == 0 and train.union(test).count() == 1000


@pytest.fixture(scope="module")
def gold(spark):
    key = F.col("id")
    return spark.range(600).select(
        (key % 50).cast("string").alias("Customer_ID"),
        key.alias("loan_id"),
        F.add_months(F.lit("2023-01-05").cast("date"), (key % 6).cast("int")).alias("prediction_date"),
        ((key * 7919 % 101) > 50).cast("int").alias("label"),
        F.lit("n").alias("Name"),
        F.when(key % 10 != 0, F.concat(F.lit("job "), (key % 4).cast("string"))).alias("Occupation"),
        F.when(key % 9 != 0, (key * 7919 % 101).cast("float")).alias("income"),
        (key % 13).cast("int").alias("year"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(None).cast("string").alias("no_text"),
        F.lit(float("nan")).alias("not_a_number"),
    )


def test_feature_columns_by_type(gold):
    assert M.feature_columns(gold) == (["Occupation", "no_text"], ["income", "year", "empty", "not_a_number"])
    assert M.feature_columns(gold, exclude=["year", "Occupation", "no_text"]) == ([], ["income", "empty", "not_a_number"])


def test_columns_without_values_are_left_out(gold):
    columns = M.feature_columns(gold)
    assert M.trainable_columns(gold, *columns) == (["Occupation"], ["income", "year"])
    assert ("Occupation", "categorical", 540) in values(M.feature_presence(gold, *columns))


def test_unknown_model_type():
    with pytest.raises(ValueError, match="unsupported"):
        M.create_pipeline([], ["x"], "perceptron")


def test_stage_order():
    names = [type(s).__name__ for s in M.create_pipeline(["a"], ["b"], "random_forest").getStages()]
    assert names == ["StringIndexer", "OneHotEncoder", "Imputer", "VectorAssembler", "RandomForestClassifier"]


def test_missing_and_unseen_categories_are_all_zeros(spark):
    stages = M.create_pipeline(["c"], ["x"]).getStages()[:2]
    train = spark.createDataFrame([("b", 1.0), ("b", 1.0), ("a", 2.0), (None, 3.0)], "c string, x double")
    test = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("new", 1.0), (None, 1.0)], "c string, x double")
    indexer = stages[0].fit(train)
    encoder = stages[1].fit(indexer.transform(train))
    vectors = encoder.transform(indexer.transform(test)).select("c", vector_to_array("c_ohe").alias("v"))
    assert {r.c: r.v for r in vectors.collect()} == {"b": [1.0, 0.0], "a": [0.0, 1.0], "new": [0.0, 0.0], None: [0.0, 0.0]}


def test_imputer_takes_the_lower_median_and_fills_nan(spark):
    rows = [(x,) for x in (1.0, 3.0, 4.0, 5.0, None, float("nan"))]
    df = spark.createDataFrame(rows, "x double")
    filled = Imputer(inputCols=["x"], outputCols=["x"], strategy="median").fit(df).transform(df)
    assert values(filled) == [(1.0,), (3.0,), (3.0,), (3.0,), (4.0,), (5.0,)]


@pytest.fixture(scope="module")
def trained(spark, gold, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    return path, train_models(spark, gold, path)


def test_models_learn_an_obvious_label(trained):
    _, result = trained
    assert set(result.models) == set(M.MODELS)
    assert all(0.8 < t.auc <= 1.0 for t in result.models.values())


def test_importances_belong_to_columns_and_add_up(spark, trained, gold):
    _, result = trained
    rows = result.importance.collect()
    assert {r.feature for r in rows} == {"Occupation", "income", "year"}
    assert rows[0].feature == "income"
    assert math.isclose(sum(r.importance for r in rows), 1.0, rel_tol=1e-9)
    forest = result.models["random_forest"].model
    assert M.feature_importance(spark, forest, gold, top=1).collect() == rows[:1]
    assert M.feature_importance(spark, result.models["logistic_regression"].model, gold) is None


def test_saved_model_is_used_only_for_the_same_features(spark, gold, trained, monkeypatch):
    path, result = trained
    saved = f"{path}/random_forest_pipeline"

    def unfitted(*_):
        raise AssertionError("fitted again")

    monkeypatch.setattr(M, "fit", unfitted)
    pipeline = M.create_pipeline(["Occupation"], ["income", "year"], "random_forest")
    rows = digest("", "time", 3)
    loaded = M.fit_or_load(spark, pipeline, result.train, saved, data_key=rows)
    same = M.score(loaded, result.test).select("loan_id", "default_probability")
    assert values(same) == values(M.score(result.models["random_forest"].model, result.test), "loan_id", "default_probability")
    fewer = M.create_pipeline(["Occupation"], ["income"], "random_forest")
    with pytest.raises(AssertionError, match="fitted again"):
        M.fit_or_load(spark, fewer, result.train, saved, data_key=rows)
    with pytest.raises(AssertionError, match="fitted again"):
        M.fit_or_load(spark, pipeline, result.train, saved, data_key=digest("", "random", 3))


def test_fitting_on_stored_vectors_gives_the_pipelines_model(spark, gold, tmp_path):
    pipeline = M.create_pipeline(["Occupation"], ["income", "year"])
    ours = M.fit(spark, pipeline, gold, str(tmp_path / "vectors"))
    theirs = pipeline.fit(gold)
    assert not (tmp_path / "vectors").exists()
    assert [type(s) for s in ours.stages] == [type(s) for s in theirs.stages]
    for a, b in zip(ours.stages[-1].coefficients, theirs.stages[-1].coefficients, strict=True):
        assert math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-6)


def test_pipeline_without_categories(spark, gold):
    model = M.create_pipeline([], ["income", "year"]).fit(gold)
    assert M.area_under_roc(model, gold) > 0.8
