"""Dictionaries, quantiles, areas and removals that no single task or driver sees whole."""

import math
import random

import pytest
from conftest import day, values
from pyspark.sql import functions as F

from riskmart.operators import asof, dictionary, model, quality, selection
from riskmart.operators.running import totals_before
from riskmart.plans.silver import remove_by_size
from riskmart.sources import read_partitions, write_partitions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_totals_are_those_of_one_ordered_list(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, n long").repartition(5)
    found = {r.k: r.n_before for r in totals_before(df, [F.desc("k")], ["n"], "g").collect()}
    for g in ("a", "b", None):
        total = 0
        for _, k, n in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
            assert found[k] == total
            total += n
    assert totals_before(df.limit(0), [F.asc("k")], ["n"]).count() == 0


def test_dictionary_numbers_as_the_pipeline_does(spark):
    rng = random.Random(3)
    kinds = ["b", "a", "c", "é", "", " ", "a ", None]
    rows = [(i, rng.choice(kinds), None if i % 9 == 0 else f"k{i % 40:02d}", f"own{i:05d}", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x string, y string, own string, none string").repartition(4)
    columns = ["x", "y", "own"]
    known = dictionary.category_dictionary(df, [*columns, "none"])
    indexer = model.create_pipeline(columns, []).getStages()[0].fit(df)
    expected = {r.id: (r.x_idx, r.y_idx, r.own_idx) for r in indexer.transform(df).collect()}
    found = dictionary.indexed(df, known, [*columns, "none"]).collect()
    assert {r.id: (r.x_idx, r.y_idx, r.own_idx) for r in found} == expected
    assert {r.none_idx for r in found} == {0.0} and dictionary.dictionary_sizes(known, ["none", "own"]) == {"none": 0, "own": 400}
    later = spark.createDataFrame([("new", 1), (None, 2), ("a", 3)], "x string, id int")
    assert {r.id: r.x_idx for r in dictionary.indexed(later, known, ["x"]).collect()}[1] == 7.0
    slots = dictionary.sparse_slots(dictionary.indexed(df, known, columns), ["id"], dictionary.dictionary_sizes(known, columns), ["id"])
    assert slots.filter("id = 9").count() == len([v for v in (rows[9][1], rows[9][2], rows[9][3], 9) if v is not None])


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = random.Random(7)
    columns = {
        "spread": [rng.lognormvariate(0, 30) for _ in range(3000)],
        "equal": [5.0] * 2990 + [float(i) for i in range(10)],
        "gaps": [None if i % 3 else float(rng.randrange(100)) for i in range(3000)],
        "edges": [float("inf"), float("-inf"), float("nan"), *[-rng.random() for _ in range(2997)]],
        "none": [None] * 3000,
        "nan": [float("nan")] * 3000,
    }
    schema = ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema).repartition(4)
    found = selection.exact_quantiles(df, list(columns), q, accuracy=100)
    for c, v in columns.items():
        known = sorted(x for x in v if x is not None and not math.isnan(x))
        assert found[c] == (known[max(1, math.ceil(q * len(known))) - 1] if known else None), c


def test_pipeline_with_exact_medians(spark, tmp_path):
    rows = [(float(i) if i % 2 else None, float("nan") if i % 5 == 0 else i * 1.0, "x`y", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "`a b` double, n double, k string, label int")
    medians = selection.exact_quantiles(df, ["a b", "n"])
    assert medians == {"a b": 19.0, "n": 19.0}
    fitted = model.fit_or_load(spark, model.create_pipeline(["k"], ["a b", "n"], medians=medians), df, str(tmp_path / "m"))
    prepared = model.score(fitted, df)
    assert prepared.count() == 40 and dict(df.dtypes)["n"] == "double"
    first = fitted.transform(df.filter("label = 0").limit(1)).first()
    assert list(first.features)[-2:] == [19.0, 19.0]
    flags = spark.createDataFrame([(True, 1), (None, 2)], "b boolean, i int")
    assert dict(model.numbers_of_truth_values(flags).dtypes) == {"b": "double", "i": "int"}


def test_area_counts_ties_as_one_half(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *[rng.randrange(30) / 7] * 9]), rng.choice([0, 1, 1, None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(5)
    known = [r for r in rows if None not in r]
    wins = sum((p > n) + (p == n) / 2 for p, a in known if a == 1 for n, b in known if b == 0)
    found = model.exact_area_of_scores(df).first()
    n_pos = sum(a for _, a in known)
    assert (found.positives, found.negatives) == (n_pos, len(known) - n_pos)
    assert abs(found.area_under_roc - wins / (n_pos * (len(known) - n_pos))) < 1e-12
    assert model.exact_area_of_scores(df.filter("label = 1")).first().area_under_roc is None
    assert model.exact_area_of_scores(df.limit(0)).first()[:] == (None, 0, 0)


def test_clean_rows_are_not_shuffled(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).selectExpr("if(id % 3 = 0, 7, id) as Customer_ID", "id as n").union(spark.sql("select cast(null as long), -1L"))
    flagged = spark.range(0, 40_000, 10).selectExpr("cast(id as int) as Customer_ID").union(spark.sql("select 7"))
    flagged.write.parquet(str(tmp_path / "flagged"))
    flagged = spark.read.parquet(str(tmp_path / "flagged"))
    expected = values(quality.remove_flagged(rows, flagged).groupBy().sum("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for n in (4000, 1):  # a filter that is far too small only sends more rows to the exact join
            split = quality.remove_flagged_split(rows, flagged, n)
            assert values(split.groupBy().sum("n")) == expected
        lines = plan(quality.remove_flagged_split(rows, flagged, 4000))
        clean = lines.split("Union")[1].split("SortMergeJoin")[0]
        assert "BroadcastHashJoin" in clean and "ShuffleExchange" not in clean and "Exchange hashpartitioning" not in clean.split("BroadcastExchange")[0]
        assert "bit_or" in plan(remove_by_size(spark, rows, flagged))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "bit_or" not in plan(remove_by_size(spark, rows, flagged))
    assert values(remove_by_size(spark, rows, flagged).groupBy().sum("n")) == expected


def test_old_months_stay_unread_once_all_customers_are_answered(spark, tmp_path):
    rows = [("a", day(f"2023-{m:02d}-{d:02d}"), m * 100 + d) for m in range(1, 9) for d in (3, 3, 20)]
    rows += [("b", day("2023-07-30"), 1), ("c", day("2023-06-02"), 2), (None, day("2023-06-02"), 3), ("late", day("2023-08-30"), 4)]
    df = spark.createDataFrame(rows, "Customer_ID string, snapshot_date date, v int").withColumns({"year": F.year("snapshot_date"), "month": F.month("snapshot_date")})
    path = str(tmp_path / "months")
    write_partitions(df, path)
    labels = [("a", day("2023-07-10")), ("a", day("2023-05-01")), ("b", day("2023-08-01")), ("c", day("2023-08-02")), ("late", day("2023-02-01"))]
    labels = spark.createDataFrame(labels, "Customer_ID string, prediction_date date")
    seen = []

    def read(months):
        seen.extend(months)
        return read_partitions(spark, path, months)

    months = [(2023, m) for m in range(1, 9)]
    for end in ("inclusive", "exclusive"):
        some = labels.filter("Customer_ID != 'late'")
        seen.clear()
        found = asof.asof_newest_first(read, months, some, end)
        assert values(found, "Customer_ID", "v") == values(asof.asof_max_rejoin(df, some, end), "Customer_ID", "v")
        assert seen == [(2023, 8), (2023, 7), (2023, 6)]
    found = asof.asof_newest_first(read, months, labels)  # one customer has no snapshot before its prediction
    assert values(found, "Customer_ID", "v") == values(asof.asof_max_rejoin(df, labels), "Customer_ID", "v")
    assert asof.asof_newest_first(read, months, labels.limit(0)) is None
