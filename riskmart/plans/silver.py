"""Silver: cleaned tables without the rows of flagged customers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from riskmart.operators import metrics, quality
from riskmart.plans.bronze import LEDGERS, read_source
from riskmart.schemas import SOURCES
from riskmart.sources import Ledger, build_id, digest, materialize, read_months, remove

TABLES = tuple(SOURCES)


class Cleaned(NamedTuple):
    """Cleaned tables before removal, and the customers to remove."""

    tables: dict[str, DataFrame]
    flagged: DataFrame


def flag_tables(bronze: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that rules judge, cleaned, with a flag per row."""
    return {
        "attributes": quality.flag_attributes(quality.clean_attributes(bronze["attributes"])),
        "financials": quality.flag_financials(quality.clean_financials(bronze["financials"])),
        "loan_daily": quality.flag_loans(bronze["loan_daily"]),
    }


def clean_tables(bronze: Mapping[str, DataFrame]) -> Cleaned:
    """Apply the cleaning and quality rules. Clickstream is neither cleaned nor flagged."""
    attributes, financials, loan_daily = flag_tables(bronze).values()
    tables = {
        "attributes": attributes.drop("age_flag", "ssn_flag", quality.ISSUE),
        "financials": financials.drop(quality.ISSUE),
        "loan_daily": loan_daily.drop(quality.ISSUE),
        "clickstream": bronze["clickstream"],
    }
    return Cleaned(tables, quality.flagged_customers(attributes, financials, loan_daily))


def may_broadcast(spark: SparkSession, stored: DataFrame) -> bool:
    """Whether Spark broadcasts a stored table, by its size, to join it."""
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def remove_by_size(spark: SparkSession, df: DataFrame, flagged: DataFrame) -> DataFrame:
    """Without the flagged customers of a stored table: joined whole if it may be broadcast, else met by possible members only."""
    if may_broadcast(spark, flagged):
        return quality.remove_flagged(df, flagged)
    return quality.remove_flagged_split(df, flagged, flagged.count())


def remove_flagged_customers(
    tables: Mapping[str, DataFrame], flagged: DataFrame
) -> dict[str, DataFrame]:
    return {name: quality.remove_flagged(df, flagged) for name, df in tables.items()}


def read_bronze(
    spark: SparkSession, bronze_path: str, months: Iterable[tuple[int, int]] | None = None
) -> dict[str, DataFrame]:
    wanted = None if months is None else list(months)
    return {name: read_source(spark, bronze_path, name, wanted) for name in TABLES}


def read_silver(spark: SparkSession, silver_path: str) -> dict[str, DataFrame]:
    """The silver tables, whether they were built whole or month by month."""
    tables = {}
    for name in TABLES:
        path = f"{silver_path}/{name}"
        ledger = Ledger.read(spark, f"{silver_path}/{LEDGERS}/{name}")
        tables[name] = spark.read.parquet(path) if ledger is None else read_months(spark, path, ledger)
    return tables


def build_silver(
    spark: SparkSession, bronze_path: str, silver_path: str, refresh: bool = False, key: str | None = None
) -> dict[str, DataFrame]:
    """Clean, flag and remove; finished tables of the same ``key`` are kept unless ``refresh``.

    The flagged ids are written once and read back, so the rules run once rather than once
    per table, and Spark knows the ids' size when it chooses the join. Counts of flagged customers and removed rows are
    written to ``metrics`` beside the tables.
    """
    remove(spark, f"{silver_path}/{LEDGERS}")  # from here on the tables are whole ones
    bronze = read_bronze(spark, bronze_path)
    cleaned = clean_tables(bronze)
    flagged_path = f"{silver_path}/flagged"
    flagged = materialize(spark, lambda: cleaned.flagged, flagged_path, refresh, key)
    after = None if key is None else digest(key, build_id(spark, flagged_path))
    silver, failures = {}, []
    for name, df in remove_flagged_customers(cleaned.tables, flagged).items():
        try:
            silver[name] = materialize(spark, lambda df=df: df, f"{silver_path}/{name}", refresh, after)
        except Exception as error:
            error.add_note(f"silver table {name!r}")
            failures.append(error)
    if failures:
        raise ExceptionGroup("some silver tables were not written", failures)
    for name, build in {
        "flag_summary": lambda: metrics.flag_summary(bronze, flagged),
        "removal_counts": lambda: metrics.removal_counts(bronze, flagged),
    }.items():
        materialize(spark, build, f"{silver_path}/metrics/{name}", refresh, after)
    return silver


def silver_builds(spark: SparkSession, silver_path: str) -> list[str | None]:
    return [build_id(spark, f"{silver_path}/{name}") for name in sorted(TABLES)]
