"""How text filters overlap: what every order of applying them removes at every step.

A document is the set of filters that it fails, so the whole corpus is at most 32 counts for each part of it. A walk over all subsets of the filters in
Gray-code order toggles one filter at a time: it keeps, for each cell of documents failing the same filters, how many active filters it
fails, and the running number of survivors, to which a cell is lost when its counter leaves zero and returns when it
reaches zero again. The 32 numbers of survivors are all that is needed: a step of an order is a difference of two of them.

Documents are only counted: no text leaves its task, a group of copies meets as digests that are combined before they are sent, and each part comes to the walk as one
row of at most 32 cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.components import store

#: The filters by letter; the n-th sets bit n of a mask.
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
#: The filters' limits.
LEAST_WORDS = 100
DISTINCT_SHARE = 80
CAPITAL_SHARE = 10
SYMBOLS = "[#$%&*|]"

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> dict[str, Column]:
    """Of the filters that look at one text alone: whether it fails. Words are maximal runs without ASCII white space."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_SHARE * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, mask, n)``: rows counted by id, part and failed filters; bit 4, E, is set for copies of a text of a smaller id.

    A null text is an empty one and a null part the empty string. A row with a null id is no copy, and no row is a copy of it; rows
    that repeat an id are not copies of each other. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    one_text = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in failures(F.col("text")).items()))
    mask = sum((F.col(k).cast("int") * (1 << i) for i, k in enumerate(LETTERS[:4])), F.lit(0))
    rows = one_text.select("id", "part", "digest", mask.alias("mask"))
    rows = store(rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "failed")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter(F.col("id").isNotNull())
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return marked.select("id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "n")


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and mask, those labelled of quality, and those labelled toxic.

    An id with several label rows counts as good or toxic if any of them says so. Label rows without id are left out.
    """
    marks = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    of_mark = {k: F.sum(F.col("n") * F.coalesce(F.col(k), F.lit(0))).cast("long").alias(k) for k in ("good", "toxic")}
    return failed.join(marks, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *of_mark.values())


def survivors(counts: np.ndarray) -> np.ndarray:
    """From counts by part, mask and kind, how many are left when a subset of filters is active: by part, subset and kind."""
    masks = np.arange(32)
    failing = np.zeros(32, np.int64)
    alive = counts.sum(axis=1)
    left = np.empty_like(counts)
    left[:, 0] = alive
    for step in range(1, 32):
        subset = step ^ (step >> 1)
        toggled = step & -step
        touched = masks[(masks & toggled) > 0]
        if subset & toggled:
            lost = touched[failing[touched] == 0]
            failing[touched] += 1
            alive = alive - counts[:, lost].sum(axis=1)
        else:
            failing[touched] -= 1
            alive = alive + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        left[:, subset] = alive
    return left


def shapley(left: np.ndarray) -> np.ndarray:
    """Documents that each filter removes, summed over all orders; ``left`` is of one part and kind."""
    k = len(LETTERS)
    total = np.zeros(k, np.int64)
    for f in range(k):
        for before in range(1 << k):
            if not before >> f & 1:
                size = before.bit_count()
                total[f] += factorial(size) * factorial(k - 1 - size) * (left[before] - left[before | 1 << f])
    return total


def steps_of(part: str, left: np.ndarray) -> Iterator[tuple]:
    """Every step of every order as differences of survivors."""
    n, every = left[:, 0], len(left) - 1
    removed_in_all = shapley(n)
    for order in permutations(range(len(LETTERS))):
        active = 0
        for step, f in enumerate(order, 1):
            then = active | 1 << f
            gone = left[active] - left[then]
            failing = n[0] - n[1 << f]
            unique = n[every ^ 1 << f] - n[every]
            name = "".join(LETTERS[i] for i in order)
            yield (part, name, step, n[then], gone[0], failing - gone[0], unique, gone[1], gone[2], removed_in_all[f])
            active = then


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """600 rows per part: the 120 orders of the five filters, and the five steps of each.

    ``kept`` are left after the step; ``removed`` go in it; ``redundant`` fail its filter but went earlier; ``unique_fails`` fail no other filter;
    ``good_lost`` and ``toxic_lost`` are those of the removed with such a label; ``shapley`` is what its filter removes summed over all orders.
    See ``failed_filters`` and ``cells`` for nulls, repeated rows and labels. An empty table has no parts and gives no rows.
    """
    grouped = (
        cells(failed_filters(docs, id_col, text_col, part_col), labels, id_col)
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 32
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch["part"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                counts = np.zeros((1, 32, len(COUNTS)), np.int64)
                for cell in found:
                    counts[0, cell["mask"]] = [cell[k] for k in COUNTS]
                rows = list(zip(*steps_of(part, survivors(counts)[0]), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                names = [c.split()[0] for c in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    return grouped.mapInArrow(walk, RESULT)
