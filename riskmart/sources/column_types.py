"""Types of columns that nobody declares, as evidence that grows from batch to batch.

A column without values is no evidence. Whole numbers are numbers, and numbers or truth values beside other text are text. What units of a source (batches,
months or files) show is merged along this order, so a unit may be replaced or go without the others being read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTHING, BOOLEAN, WHOLE, NUMBER, TEXT = "nothing", "boolean", "whole", "number", "text"

# The texts of truth values, and the forms of numbers.
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
WHOLE_FORM = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_FORM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

#: A column that never has a value is read as empty numbers.
SPARK_TYPES = {
    NOTHING: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    WHOLE: T.LongType(),
    NUMBER: T.DoubleType(),
    TEXT: T.StringType(),
}


def covering(a: str, b: str) -> str:
    """The narrowest kind that holds the values of both."""
    if a == b or b == NOTHING:
        return a
    if a == NOTHING:
        return b
    return NUMBER if {a, b} == {WHOLE, NUMBER} else TEXT


def merged(units: Iterable[Mapping[str, str]]) -> dict[str, str]:
    found: dict[str, str] = {}
    for unit in units:
        for name, kind in unit.items():
            found[name] = covering(found.get(name, NOTHING), kind)
    return found


def agreed(units: Iterable[Mapping[str, str]], declared: Iterable[str] = ()) -> dict[str, str]:
    """As ``merged``, but a column that is text in one unit and something else in another is an error, unless it is declared."""
    found: dict[str, str] = {}
    free = set(declared)
    for unit in units:
        for name, kind in unit.items():
            before = found.get(name, NOTHING)
            found[name] = covering(before, kind)
            if found[name] == TEXT and NOTHING not in (before, kind) and before != kind and name not in free:
                raise ValueError(f"column {name!r} is {before} in one batch and {kind} in another; declare its type")
    return found


def _others(name: str, fits: Column) -> Column:
    text = F.col(f"`{name}`")
    return F.count(F.when(text.isNotNull() & ~fits, 1))


def counts(names: Sequence[str]) -> list[Column]:
    """One aggregate per text column: its values, and those that are no truth values, whole numbers and numbers."""

    def of(name: str) -> Column:
        text = F.col(f"`{name}`")
        whole = text.rlike(WHOLE_FORM) & F.trim(text).try_cast("bigint").isNotNull()
        number = text.rlike(NUMBER_FORM) & F.trim(text).try_cast("double").isNotNull()
        return F.struct(
            F.count(text).alias("present"),
            _others(name, text.isin(*TRUTH)).alias("not_boolean"),
            _others(name, whole).alias("not_whole"),
            _others(name, number).alias("not_number"),
        )

    return [of(name).alias(f"c{i}") for i, name in enumerate(names)]


def kinds(names: Sequence[str], row) -> dict[str, str]:
    """Kinds by column from a row with the fields that ``counts`` made."""

    def kind(found) -> str:
        if not found.present:
            return NOTHING
        for name, misses in ((BOOLEAN, found.not_boolean), (WHOLE, found.not_whole), (NUMBER, found.not_number)):
            if not misses:
                return name
        return TEXT

    return {name: kind(row[f"c{i}"]) for i, name in enumerate(names)}


def infer_types(raw: DataFrame, names: list[str]) -> dict[str, T.DataType]:
    """Types of text columns by one aggregation over all rows."""
    if not names:
        return {}
    found = kinds(names, raw.agg(*counts(names)).first())
    return {name: SPARK_TYPES[kind] for name, kind in found.items()}
