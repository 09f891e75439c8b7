"""The whole run, layer by layer, or one layer of it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from riskmart.config import Config
from riskmart.plans.bronze import ingest_bronze, is_ingested, source_builds
from riskmart.plans.gold import build_gold
from riskmart.plans.increment import has_ledgers, update_gold, update_silver
from riskmart.plans.modelling import Modelling, train_models
from riskmart.plans.silver import build_silver
from riskmart.sources import build_id, digest

STAGES = ("bronze", "silver", "gold", "model")


def run_bronze(spark: SparkSession, config: Config, refresh: bool = False) -> None:
    """Ingest the sources whose files are new, changed, or to be read in another way."""

    def done(name: str, path: str) -> bool:
        lines, types = config.multi_line.get(name, False), config.column_types.get(name)
        return is_ingested(spark, name, path, config.bronze_path, lines, types)

    pending = {n: p for n, p in config.raw_paths.items() if refresh or not done(n, p)}
    ingest_bronze(
        spark,
        pending,
        config.bronze_path,
        config.multi_line,
        config.column_types,
        config.work_path,
        config.raw_mode,
        refresh,
    )


def run_silver(spark: SparkSession, config: Config, refresh: bool = False) -> None:
    """Month by month where bronze has ledgers, whole where it was written by other means."""
    if has_ledgers(spark, config.bronze_path):
        update_silver(spark, config.bronze_path, config.silver_path, refresh)
        return
    key = digest(source_builds(spark, config.raw_paths, config.bronze_path))
    build_silver(spark, config.bronze_path, config.silver_path, refresh, key)


def run_gold(spark: SparkSession, config: Config, refresh: bool = False) -> None:
    """Customer by customer where silver was built month by month."""
    if has_ledgers(spark, config.silver_path):
        update_gold(spark, config, refresh)
    else:
        build_gold(spark, config, refresh)


def run_model(
    spark: SparkSession, config: Config, split: str = "time", refresh: bool = False
) -> Modelling:
    return train_models(
        spark,
        spark.read.parquet(config.gold_path),
        config.model_path,
        split,
        config.test_last_n_months,
        config.exclude,
        refresh,
        build_id(spark, config.gold_path) or "",
        config.work_path,
        config.median,
    )


def run(spark: SparkSession, config: Config, split: str = "time", refresh: bool = False) -> Modelling:
    """Bronze to models. A layer is read instead of built if it was built from the same inputs by the same parameters."""
    run_bronze(spark, config, refresh)
    run_silver(spark, config, refresh)
    run_gold(spark, config, refresh)
    return run_model(spark, config, split, refresh)
