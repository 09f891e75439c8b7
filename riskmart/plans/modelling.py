"""Model stage: split, fit or load, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskmart.config import TEST_LAST_N_MONTHS
from riskmart.operators import model as M
from riskmart.operators.selection import exact_quantiles
from riskmart.operators.splits import hash_split, oot_split, prediction_months
from riskmart.sources import digest

SPLITS = ("time", "random")


class Trained(NamedTuple):
    model: PipelineModel
    auc: float


class Modelling(NamedTuple):
    models: dict[str, Trained]
    importance: DataFrame
    train: DataFrame
    test: DataFrame


def split(
    gold: DataFrame, by: str = "time", last_n_months: int = TEST_LAST_N_MONTHS
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. Without any prediction date a time split becomes a random one;
    with too few months to leave a training set it is an error."""
    if by not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {by!r}")
    keys = [c for c in ("Customer_ID", "loan_id") if c in gold.columns]
    if by == "random" or "prediction_date" not in gold.columns:
        return hash_split(gold, *keys)
    months = prediction_months(gold).limit(last_n_months + 1).count()
    if months == 0:
        return hash_split(gold, *keys)
    if months <= last_n_months:
        raise ValueError(f"{months} prediction months leave no training data before the last {last_n_months}")
    return oot_split(gold, last_n_months)


def train_models(
    spark: SparkSession,
    gold: DataFrame,
    model_path: str,
    by: str = "time",
    last_n_months: int = TEST_LAST_N_MONTHS,
    exclude: Sequence[str] = (),
    refresh: bool = False,
    data_key: str = "",
    work_path: str | None = None,
    median: str = "approximate",
) -> Modelling:
    """Fit (or load) and evaluate both models. ``gold`` should be a stored table, since fitting
    reads it several times, and ``data_key`` its build id. With ``median`` exact, missing numbers are the training rows' exact medians."""
    gold = M.numbers_of_truth_values(gold)
    train, test = split(gold, by, last_n_months)
    categorical, numeric = M.trainable_columns(train, *M.feature_columns(gold, exclude))
    medians = exact_quantiles(train, numeric) if median == "exact" else None
    rows = digest(data_key, by, last_n_months)
    models = {}
    for model_type in M.MODELS:
        pipeline = M.create_pipeline(categorical, numeric, model_type, medians)
        path = f"{model_path}/{model_type}_pipeline"
        fitted = M.fit_or_load(spark, pipeline, train, path, refresh, rows, work_path)
        models[model_type] = Trained(fitted, M.area_under_roc(fitted, test))
    importance = M.feature_importance(spark, models["random_forest"].model, train)
    return Modelling(models, importance, train, test)
