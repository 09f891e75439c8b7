"""Types of undeclared columns, malformed records, and where intermediate tables go."""

import pytest
from conftest import values

from riskmart.operators import model as M
from riskmart.plans.bronze import ingest_bronze, ingest_source, is_ingested
from riskmart.sources import infer_types, read_partitions, scan_csv, shared_dir, tables


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_types_are_what_all_values_are(spark, tmp_path):
    path = write(
        tmp_path / "x.csv",
        "whole,real,text,none,big,date",
        "1,1.5,a,,99999999999999999999,1/1/2023",
        " -2 ,NA,7,NA,1,2/1/2023",
        ",1e3,8,null,2,3/1/2023",
    )
    raw = scan_csv(spark, path).drop("_corrupt_record")
    found = {n: t.simpleString() for n, t in infer_types(raw, raw.columns).items()}
    assert found == {"whole": "bigint", "real": "double", "text": "string", "none": "double", "big": "double", "date": "string"}


def test_undeclared_numbers_are_numeric_features_and_do_not_widen_the_vector(spark, tmp_path):
    for n in (20, 60):
        lines = [f"C{i},{i / 7:.6f},{'x' if i % 2 else 'y'},{1 + i % 28}/3/2023" for i in range(n)]
        path = write(tmp_path / f"{n}.csv", "Customer_ID,Utilization,Group,snapshot_date", *lines)
        ingest_source(spark, "financials", path, str(tmp_path / f"bronze{n}"))
        df = read_partitions(spark, str(tmp_path / f"bronze{n}/financials"))
        assert dict(df.dtypes)["Utilization"] == "double"
        categorical, numeric = M.feature_columns(df)
        assert categorical == ["Group"] and "Utilization" in numeric
        pipeline = M.create_pipeline(categorical, numeric)
        prepared = pipeline.getStages()[:-1]
        for stage in prepared:
            df = (stage.fit(df) if hasattr(stage, "fit") else stage).transform(df)
        assert len(df.first().features) == 2 + len(numeric)


def test_later_batches_keep_the_stored_type(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    first = write(tmp_path / "1.csv", "Customer_ID,extra,snapshot_date", "a,1.5,1/1/2023")
    whole = write(tmp_path / "2.csv", "Customer_ID,extra,snapshot_date", "a,2,1/2/2023")
    words = write(tmp_path / "3.csv", "Customer_ID,extra,snapshot_date", "a,two,1/3/2023")
    ingest_source(spark, "attributes", first, bronze)
    ingest_source(spark, "attributes", whole, bronze)
    assert values(read_partitions(spark, f"{bronze}/attributes"), "extra") == [(1.5,), (2.0,)]
    with pytest.raises(ValueError, match="declare its type"):
        ingest_source(spark, "attributes", words, bronze)
    ingest_source(spark, "attributes", words, bronze, types={"extra": "double"})
    assert values(read_partitions(spark, f"{bronze}/attributes"), "extra") == [(None,), (1.5,), (2.0,)]


def test_records_of_a_wrong_length_fail_the_source(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    broken = write(tmp_path / "b.csv", "Customer_ID,Name,snapshot_date", 'C1,"line', 'break",1/1/2023', "C2,x,1/1/2023")
    longer = write(tmp_path / "l.csv", "Customer_ID,snapshot_date", "C1,1/1/2023,more")
    for path in (broken, longer):
        with pytest.raises(ValueError, match="as many fields"):
            ingest_source(spark, "attributes", path, bronze)
        assert not is_ingested(spark, "attributes", path, bronze)
    ingest_bronze(spark, {"attributes": broken}, bronze, multi_line={"attributes": True})
    stored = read_partitions(spark, f"{bronze}/attributes")
    assert values(stored, "Customer_ID", "Name") == [("C1", "line\nbreak"), ("C2", "x")]


def test_text_is_parsed_once(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "x.csv", "Customer_ID,snapshot_date", "a,1/1/2023", "b,never")
    scans = []
    from riskmart.plans import bronze

    monkeypatch.setattr(bronze, "scan_csv", lambda *a: scans.append(a) or scan_csv(*a))
    bronze.ingest_source(spark, "attributes", path, str(tmp_path / "bronze"), work_path=str(tmp_path / "work"))
    assert len(scans) == 1
    plan = bronze.typed(scan_csv(spark, path), {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    assert not list((tmp_path / "work").glob("*"))


def test_intermediate_tables_need_a_shared_folder_off_a_local_master(spark, monkeypatch):
    assert [tables.is_local(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "yarn")] == [True, True, False, False]
    monkeypatch.setattr(tables, "is_local", lambda master: False)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(spark)
