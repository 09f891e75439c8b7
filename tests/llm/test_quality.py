import random
import zlib

import pytest
from llm.conftest import by_row, prose
from pyspark.sql import functions as F

from riskmart.llm import quality as Q

SETTINGS = Q.Settings(max_rows=500, steps=8000)


def labelled_texts(n):
    rng = random.Random(9)
    for i in range(n):
        good, text = rng.random() < 0.7, prose(rng, rng.randrange(20, 120))
        kind = rng.randrange(3)
        if not good:
            text = text.upper() if kind == 0 else " | ".join(text.split()) if kind == 1 else " ".join([text.split()[0]] * 60)
        yield i, text, int(good)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(labelled_texts(700)), "doc_id long, text string, quality int").repartition(4).cache()


@pytest.fixture(scope="module")
def model(table):
    labels = table.select("doc_id", "quality").withColumn("toxic", F.lit(0))
    return Q.fit(table.select("doc_id", "text"), labels, SETTINGS)


def test_held_out_rows_are_told_apart(table, model):
    scored = Q.score(table, model).withColumn("held_out", Q.is_held_out("doc_id")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    held = [r for r in scored if r.held_out]
    assert len(held) > 120 and sum((r.score >= 0.7) == r.quality for r in held) / len(held) > 0.97


def test_nothing_is_learned_from_held_out_rows_and_row_order(spark, table, model):
    flipped = table.withColumn("quality", F.when(Q.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit(table.repartition(3).select("doc_id", "text"), flipped.select("doc_id", "quality"), SETTINGS)
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_awkward_rows(docs, no_docs, model, rows):
    scored = Q.score(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    found = {r.doc_id: r.score for r in scored.collect()}
    assert len({found[i] for i in range(3)}) == 1 and all(0 <= s <= 1 for s in found.values())
    assert by_row(Q.keep(docs, model), "doc_id") == by_row(scored.filter("score >= 0.7"), "doc_id")
    assert Q.score(no_docs, model).count() == 0 and Q.keep(docs, model).columns == docs.columns
    with pytest.raises(ValueError, match="score"):
        Q.score(scored, model)


def test_labels_that_say_nothing(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs, empty)
    assert set(Q.score(docs, model).toPandas().score) == {0.5} or model.bias == 0
    odd = spark.createDataFrame([(None, 1), (20, None), (21, 7), (22, 1), (22, 0), (25, 1)], "doc_id long, quality int")
    sample = Q.labelled(docs, odd, Q.Settings(), "doc_id", "text", "quality")
    assert {(r.id, r.label) for r in sample} <= {(22, 0), (25, 1)}
