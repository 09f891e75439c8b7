"""Fixtures of the training-data tests: a session whose workers know the package, and awkward texts."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from riskmart.llm.ship import ship  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


WORDS = "time day world life hand part child eye place work week case point number group problem fact".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_texts(seed=3, copies=30):
    """Nulls, empty and blank texts, other scripts, a very long one, exact and near copies with a hot group."""
    rng = random.Random(seed)
    base, passage = prose(rng, 150), prose(rng, 60)
    texts = [None, "", " \n\t ", "a", "one two three", "é" * 300, "日本語の文章です。" * 40, "🙂 " * 90, "x" * 1000]
    texts += [base] * 5
    for _ in range(copies):  # near copies of each other
        words = base.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(12)]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += ["Again and again. " * 80, "Tom's cats'll say 'we've' <|endoftext|> been\n\n  there 'twas", "one TWO three four five six"]
    texts.append(prose(rng, 30_000))
    return texts


@pytest.fixture(scope="session")
def texts():
    return awkward_texts()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """The texts over many partitions, with a repeated row, a null id and columns whose names clash with inner ones."""
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[-3], (None, "nobody's text, twelve words long, nobody's text, twelve words long, nobody's")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"id": F.lit("clash"), "n": F.col("doc_id") * 2, "ids": F.lit(1.5), "score_": F.lit(None).cast("int")})
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def by_row(df, *columns):
    """Rows as sorted tuples, nulls first."""
    found = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(found, key=lambda r: [(v is not None, str(v)) for v in r])


def in_order(found):
    return sorted(found, key=lambda r: [(v is not None, str(v)) for v in r])
