"""The stages against brute force, and every registered query on the given tables."""

import duckdb
import pytest
from llm import brute
from llm.conftest import by_row, in_order
from pyspark.sql import functions as F

import corpus_pipeline as P
from riskmart.llm import quality, queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def shown(table, columns):
    return sorted(repr(tuple(r.values())) for r in table.select(columns).to_pylist())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_what_sql_gives(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR).toArrow()
    assert got.num_rows > 0
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).to_arrow_table()
        assert sorted(want.column_names) == sorted(got.column_names)
        assert shown(got, sorted(got.column_names)) == shown(want, sorted(got.column_names))
        assert all(got.schema.field(c).type == want.schema.field(c).type for c in got.column_names)


def stage(spark, docs, k):
    return P.STAGES[k][1](spark, docs, SF_DIR)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_follow_each_other_and_match_brute_force(spark, documents):
    good = stage(spark, documents, 0).cache()
    model = quality.fit(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert by_row(good, "doc_id") == by_row(quality.score(documents, model).filter("score >= 0.7"), "doc_id")
    one = stage(spark, good, 1).cache()
    least = {c for _, n, c in brute.jaccard_components(pairs(good)) if n}
    assert {r.doc_id for r in one.collect()} == least and one.count() == len(least)
    cut = stage(spark, one, 2).cache()
    want = {d: n - removed for d, n, removed, *_ in brute.repeats(pairs(one), keep="first")}
    for r in cut.select("doc_id", "n_chars", F.length("text").alias("n"), F.octet_length("text").alias("b")).collect():
        assert 0 <= r.b - want[r.doc_id] <= 30 and r.n_chars == r.n  # characters cut in part stay whole
    clean = stage(spark, cut, 3).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = {d for d, *_, contaminated in brute.contamination(pairs(cut), items) if contaminated}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in pairs(cut)} - hit and hit
    ids = stage(spark, clean, 4)
    assert by_row(ids, "doc_id", "decoded_sha256") == in_order([(d, brute.sha(t.encode())) for d, t in pairs(clean)])
    assert all(s.columns == documents.columns for s in (good, one, cut, clean))
    assert by_row(P.run(spark, SF_DIR)) == by_row(ids)


def test_every_stage_takes_awkward_and_empty_tables(spark, docs, no_docs):
    for name, f in P.STAGES:
        out = f(spark, docs, SF_DIR)
        assert out.count() <= docs.count() and f(spark, no_docs, SF_DIR).count() == 0, name
        if name != "token_ids":
            assert out.columns == docs.columns
