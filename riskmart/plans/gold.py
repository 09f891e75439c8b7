"""Gold: label store and feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskmart.config import Config
from riskmart.operators import metrics
from riskmart.operators.features import gold_features
from riskmart.operators.labels import label_store
from riskmart.plans.silver import read_silver, silver_builds
from riskmart.sources import build_id, digest, materialize


def build_label_store(spark: SparkSession, config: Config, refresh: bool = False) -> DataFrame:
    """Label store of the silver loans, with its label balance and shared loans in ``metrics`` beside the gold table."""
    months = (config.prediction_months, config.label_window_months, config.max_loan_months)

    def build() -> DataFrame:
        return label_store(read_silver(spark, config.silver_path)["loan_daily"], *months)

    key = digest(months, build_id(spark, f"{config.silver_path}/loan_daily"))
    labels = materialize(spark, build, config.label_path, refresh, key)
    label_metrics(spark, config, labels, refresh)
    return labels


def label_metrics(spark: SparkSession, config: Config, labels: DataFrame, refresh: bool = False) -> None:
    """Label balance and shared loans, stored beside the labels."""
    below = digest(build_id(spark, config.label_path))
    for name, measure in (
        ("label_distribution", metrics.label_distribution),
        ("shared_loans", metrics.shared_loans),
    ):
        materialize(
            spark, lambda measure=measure: measure(labels), f"{config.label_path}_metrics/{name}", refresh, below
        )


def build_gold(spark: SparkSession, config: Config, refresh: bool = False) -> DataFrame:
    """Feature matrix on top of the stored label table, which several features read."""
    labels = build_label_store(spark, config, refresh)

    def build() -> DataFrame:
        tables = read_silver(spark, config.silver_path)
        return gold_features(
            labels,
            **tables,
            grain=config.grain,
            history_end=config.history_end,
            plural_only=config.plural_only,
        )

    key = digest(
        [config.grain, config.history_end, config.plural_only],
        build_id(spark, config.label_path),
        silver_builds(spark, config.silver_path),
    )
    return materialize(spark, build, config.gold_path, refresh, key)
