"""CSV scan by column name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions import na_to_null

#: Column of ``scan_csv`` that holds a record whose field count is not the header's.
CORRUPT = "_corrupt_record"
#: Column with the file that a record is from, where asked for.
FILE = "_file"


def header(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> list[str]:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path).columns


def scan_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, with_file: bool = False
) -> DataFrame:
    """All columns as text, missing-value tokens as NULL, and malformed records in ``_corrupt_record``.

    Only the header line is looked at for the layout. Files stay splittable unless ``multi_line`` (line breaks inside quotes) is asked for;
    without it, a quoted line break leaves records with a wrong number of fields. ``with_file`` adds the file of each record as ``_file``.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = header(spark, path, multi_line)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = (
        reader.schema(schema)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    file = [F.col("_metadata.file_path").alias(FILE)] if with_file else []
    return raw.select(*(na_to_null(F.col(f"`{n}`")).alias(n) for n in names), CORRUPT, *file)


def _try(text: Column, wanted: T.DataType) -> Column:
    if isinstance(wanted, T.StringType):
        return text
    return text.try_cast(wanted)


def typed(raw: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Text columns as the given types; text that does not fit is NULL, a column without a type stays text."""
    return raw.select(*(_try(F.col(f"`{n}`"), types.get(n, T.StringType())).alias(n) for n in raw.columns))


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Read CSV files by column name; text that does not fit its declared type is NULL.

    Columns may come in any order, declared ones may be absent, and undeclared ones pass through as text. See ``scan_csv`` for line breaks.
    """
    raw = scan_csv(spark, path, multi_line).drop(CORRUPT)
    return typed(raw, {field.name: field.dataType for field in schema.fields})
