import pytest
from conftest import day, values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.operators import ingest, metrics
from riskmart.plans.bronze import ingest_bronze
from riskmart.sources import (
    is_complete,
    materialize,
    read_csv,
    read_partitions,
    shared_dir,
    write_partitions,
    write_table,
)

SCHEMA = T.StructType(
    [T.StructField("a", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("gone", T.StringType())]
)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_columns_go_by_name_and_missing_tokens_are_null(spark, tmp_path):
    path = write(tmp_path / "x.csv", "n,extra,a", "1.5,NA,NM", "NaN,<NA>, sp ", 'oops,7,"say ""hi"", then"', ",null,NA")
    df = read_csv(spark, path, SCHEMA)
    assert df.dtypes == [("n", "double"), ("extra", "string"), ("a", "string")]
    assert values(df, "n", "extra", "a") == [
        (None, None, None),
        (None, None, " sp "),
        (None, "7", 'say "hi", then'),
        (1.5, None, "NM"),
    ]


def test_csv_with_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "x.csv", "n,a", '1,"two', 'lines"')
    assert values(read_csv(spark, path, SCHEMA, multi_line=True), "a") == [("two\nlines",)]


def test_csv_files_with_different_headers_are_an_error(spark, tmp_path):
    write(tmp_path / "1.csv", "n,a", "1,x")
    write(tmp_path / "2.csv", "a,n", "x,1")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), SCHEMA).collect()


def test_calendar_replaces_partition_columns_and_splits_rows(spark):
    rows = [("13/02/2023", 1999), ("31/02/2023", 1), (None, 1)]
    df = ingest.with_calendar(spark.createDataFrame(rows, "snapshot_date string, year int"))
    assert values(ingest.valid_rows(df)) == [(day("2023-02-13"), 2023, 2)]
    assert values(ingest.rejected_rows(df)) == [(None,), ("31/02/2023",)]
    assert values(metrics.partition_distribution(df)) == [(2023, 2, 1)]


def test_without_a_snapshot_date_every_row_is_rejected(spark):
    df = ingest.with_calendar(spark.createDataFrame([("a",)], "x string"))
    assert ingest.valid_rows(df).count() == 0 and ingest.rejected_rows(df).count() == 1


def dated(spark, *rows):
    return spark.createDataFrame(list(rows), "v string, year int, month int")


def test_a_batch_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "t")
    write_partitions(dated(spark, ("jan", 2023, 1), ("feb", 2023, 2)), path)
    for _ in range(2):
        write_partitions(dated(spark, ("new feb", 2023, 2), ("mar", 2023, 3)), path)
    assert values(spark.read.parquet(path)) == [("jan", 2023, 1), ("mar", 2023, 3), ("new feb", 2023, 2)]
    assert len(list((tmp_path / "t" / "year=2023" / "month=2").glob("*.parquet"))) == 1
    assert values(read_partitions(spark, path, [(2023, 1), (2022, 2)]), "v") == [("jan",)]
    plan = read_partitions(spark, path, [(2023, 1)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_a_hot_month_is_written_by_several_tasks(spark, tmp_path):
    key = F.col("id")
    df = spark.range(0, 200_000, 1, 8).select(
        key, F.rand(1).alias("x"), F.lit(2023).alias("year"), F.when(key % 50 > 5, 1).otherwise(key % 50).cast("int").alias("month")
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        write_partitions(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / "year=2023" / "month=1").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_failing_source_does_not_stop_the_others(spark, tmp_path):
    good = write(tmp_path / "good.csv", "loan_id,snapshot_date", "a,01/02/2023", "b,2023")
    out = str(tmp_path / "bronze")
    with pytest.raises(ExceptionGroup) as raised:
        ingest_bronze(spark, {"gone": str(tmp_path / "gone.csv"), "loan_daily": good}, out)
    assert len(raised.value.exceptions) == 1 and "gone" in raised.value.exceptions[0].__notes__[0]
    assert values(spark.read.parquet(f"{out}/loan_daily"), "loan_id", "year", "month") == [("a", 2023, 2)]
    assert values(spark.read.parquet(f"{out}/rejects/loan_daily"), "loan_id", "snapshot_date_text") == [("b", "2023")]


def test_ingest_types_and_empty_rejects(spark, tmp_path):
    path = write(tmp_path / "c.csv", "Customer_ID,fe_1,snapshot_date", "a,1,01/02/2023", "b,x,02/02/2023")
    out = str(tmp_path / "bronze")
    ingest_bronze(spark, {"clickstream": path}, out)
    assert spark.read.parquet(f"{out}/rejects/clickstream").count() == 0
    assert values(spark.read.parquet(f"{out}/clickstream"), "Customer_ID", "fe_1") == [("a", 1.0), ("b", None)]


def test_only_a_finished_write_counts(spark, tmp_path):
    path = tmp_path / "t"
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path.mkdir()
    (path / "part-0.parquet").write_text("left over")
    assert not is_complete(spark, str(path))
    assert materialize(spark, build, str(path)).count() == 3
    assert materialize(spark, build, str(path)).count() == 3
    assert len(built) == 1
    materialize(spark, build, str(path), refresh=True)
    assert len(built) == 2


def test_write_table_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(3), path)
    write_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_intermediate_tables_go_below_the_checkpoint_dir(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert spark.sparkContext.applicationId in folder
    if before:
        assert folder.startswith(before)
