"""Types over batches, and bronze as a mirror of its raw files."""

import os

import pytest
from conftest import values

from riskmart.plans import bronze as B
from riskmart.plans.bronze import ingest_bronze, ingest_source, mirror_source, read_source
from riskmart.sources import Ledger
from riskmart.sources import column_types as C


def write(path, *lines):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def batch(tmp_path, name, column, *rows):
    return write(tmp_path / f"{name}.csv", f"Customer_ID,{column},snapshot_date", *rows)


def ledger(spark, bronze, name):
    return Ledger.read(spark, f"{bronze}/ledgers/{name}")


def test_kinds_form_an_order():
    kinds = [C.NOTHING, C.BOOLEAN, C.WHOLE, C.NUMBER, C.TEXT]
    for a in kinds:
        assert C.covering(a, a) == C.covering(a, C.NOTHING) == C.covering(C.NOTHING, a) == a
        for b in kinds:
            assert C.covering(a, b) == C.covering(b, a)
            for c in kinds:
                assert C.covering(C.covering(a, b), c) == C.covering(a, C.covering(b, c))
    assert C.covering(C.WHOLE, C.NUMBER) == C.NUMBER and C.covering(C.BOOLEAN, C.WHOLE) == C.TEXT
    with pytest.raises(ValueError, match="declare its type"):
        C.agreed([{"a": C.TEXT}, {"a": C.NOTHING}, {"a": C.WHOLE}])
    assert C.agreed([{"a": C.TEXT}, {"a": C.WHOLE}], ["a"]) == {"a": C.TEXT}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_an_empty_column_is_no_evidence_and_whole_numbers_widen(spark, tmp_path, order):
    bronze = str(tmp_path / "bronze")
    batches = [("a,,1/1/2023", "b,NA,2/1/2023"), ("a,5,1/2/2023",), ("a,5.5,1/3/2023",)]
    for i in order:
        ingest_source(spark, "attributes", batch(tmp_path, i, "extra", *batches[i]), bronze)
    df = read_source(spark, bronze, "attributes")
    assert dict(df.dtypes)["extra"] == "double"
    assert values(df, "extra") == [(None,), (None,), (5.0,), (5.5,)]
    assert values(read_source(spark, bronze, "attributes", [(2023, 2)]), "extra", "month") == [(5.0, 2)]


def test_text_after_an_empty_column_and_a_column_that_comes_late(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    ingest_source(spark, "attributes", batch(tmp_path, 1, "extra", "a,,1/1/2023"), bronze)
    assert dict(read_source(spark, bronze, "attributes").dtypes)["extra"] == "double"
    ingest_source(spark, "attributes", batch(tmp_path, 2, "extra", "a,abc,1/2/2023"), bronze)
    ingest_source(spark, "attributes", batch(tmp_path, 3, "late", "a,True,1/3/2023", "b,,2/3/2023", "c,false,3/3/2023"), bronze)
    ingest_source(spark, "attributes", batch(tmp_path, 4, "extra", "a,,1/4/2023"), bronze)
    df = read_source(spark, bronze, "attributes")
    assert dict(df.dtypes)["extra"] == "string" and dict(df.dtypes)["late"] == "boolean"
    assert values(df, "extra", "late") == [(None, None)] * 3 + [(None, False), (None, True), ("abc", None)]


def test_only_months_that_stay_are_evidence(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    ingest_source(spark, "attributes", batch(tmp_path, 1, "extra", "a,abc,1/1/2023"), bronze)
    with pytest.raises(ValueError, match="declare its type"):
        ingest_source(spark, "attributes", batch(tmp_path, 2, "extra", "a,7,1/2/2023"), bronze)
    assert values(read_source(spark, bronze, "attributes"), "extra") == [("abc",)]  # nothing was written
    ingest_source(spark, "attributes", batch(tmp_path, 3, "extra", "a,7,1/1/2023"), bronze)
    assert dict(read_source(spark, bronze, "attributes").dtypes)["extra"] == "bigint"


def test_a_source_that_no_schema_knows_takes_several_batches(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    for month in (1, 2, 3):
        ingest_source(spark, "orders", batch(tmp_path, month, "n", f"a,{month},1/{month}/2023"), bronze)
    df = read_source(spark, bronze, "orders")
    assert dict(df.dtypes)["snapshot_date"] == "date" and values(df, "n", "month") == [(1, 1), (2, 2), (3, 3)]


def test_months_whose_rows_are_as_before_keep_their_build(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    path = batch(tmp_path, 1, "n", "a,1,1/1/2023", "b,2,1/2/2023", "b,3,x")
    ingest_source(spark, "attributes", path, bronze)
    before = ledger(spark, bronze, "attributes").builds()
    path = batch(tmp_path, 1, "n", "b,2,1/2/2023", "c,4,1/3/2023", "a,1,1/1/2023")
    ingest_source(spark, "attributes", path, bronze)
    after = ledger(spark, bronze, "attributes").builds()
    assert {m for m in after if after[m] != before.get(m)} == {(2023, 3)}
    ingest_source(spark, "attributes", path, bronze, refresh=True)
    assert not set(ledger(spark, bronze, "attributes").builds().values()) & set(after.values())
    assert values(read_source(spark, bronze, "attributes"), "Customer_ID", "n") == [("a", 1), ("b", 2), ("c", 4)]


def test_a_table_without_ledger_is_taken_over(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    ingest_source(spark, "orders", batch(tmp_path, 1, "n", "a,1,1/1/2023"), bronze)
    for name in os.listdir(f"{bronze}/ledgers/orders"):
        os.remove(f"{bronze}/ledgers/orders/{name}")
    ingest_source(spark, "orders", batch(tmp_path, 2, "n", "a,2.5,1/2/2023"), bronze)
    assert values(read_source(spark, bronze, "orders"), "n", "month") == [(1.0, 1), (2.5, 2)]


def files(tmp_path, **content):
    for name, rows in content.items():
        write(tmp_path / "raw" / f"{name}.csv", "Customer_ID,n,snapshot_date", *rows)
    return str(tmp_path / "raw" / "*.csv")


@pytest.fixture
def mirrored(spark, tmp_path):
    path = files(tmp_path, a=["a,1,1/1/2023", "a,2,1/2/2023"], b=["b,1,9/2/2023"], c=["c,1,1/3/2023", "c,0,never"])
    bronze = str(tmp_path / "bronze")
    assert mirror_source(spark, "orders", path, bronze) == ["2023-01", "2023-02", "2023-03"]
    return path, bronze


def test_changed_added_and_removed_files(spark, tmp_path, mirrored, monkeypatch):
    path, bronze = mirrored
    before = ledger(spark, bronze, "orders").builds()
    scans = []
    scan = B.scan_csv
    monkeypatch.setattr(B, "scan_csv", lambda s, p, *a, **k: scans.extend(p) or scan(s, p, *a, **k))
    files(tmp_path, a=["a,5,1/1/2023"], d=["d,7,1/4/2023", "d,8,nowhere"])  # leaves February
    assert mirror_source(spark, "orders", path, bronze) == ["2023-01", "2023-02", "2023-04"]
    assert sorted(os.path.basename(p) for p in scans) == ["a.csv", "b.csv", "d.csv"]  # b shares February with a
    assert values(read_source(spark, bronze, "orders"), "Customer_ID", "n", "month") == [("a", 5, 1), ("b", 1, 2), ("c", 1, 3), ("d", 7, 4)]
    after = ledger(spark, bronze, "orders").builds()
    assert {m for m in after if after[m] == before.get(m)} == {(2023, 3)}
    os.remove(tmp_path / "raw" / "c.csv")
    assert mirror_source(spark, "orders", path, bronze) == ["2023-03"]
    assert values(read_source(spark, bronze, "orders"), "month") == [(1,), (2,), (4,)]
    assert not os.path.exists(f"{bronze}/orders/year=2023/month=3")
    rejects = spark.read.parquet(f"{bronze}/rejects/orders")
    assert values(rejects, "Customer_ID", "n", "snapshot_date_text") == [("d", "8", "nowhere")]
    distribution = spark.read.parquet(f"{bronze}/metrics/partition_distribution/orders")
    assert values(distribution) == [(2023, 1, 1), (2023, 2, 1), (2023, 4, 1)]
    assert mirror_source(spark, "orders", path, bronze) == []


def test_types_and_headers_of_files(spark, tmp_path, mirrored):
    path, bronze = mirrored
    write(tmp_path / "raw" / "e.csv", "snapshot_date,n,Customer_ID,more", "1/5/2023,2.5,e,x", "2/5/2023,NA,e,")
    assert mirror_source(spark, "orders", path, bronze) == ["2023-05"]
    df = read_source(spark, bronze, "orders")
    assert dict(df.dtypes)["n"] == "double" and values(df.filter("Customer_ID = 'e'"), "n", "more") == [(None, None), (2.5, "x")]
    files(tmp_path, f=["f,word,1/6/2023"])
    with pytest.raises(ValueError, match="declare its type"):
        mirror_source(spark, "orders", path, bronze)
    assert mirror_source(spark, "orders", path, bronze, types={"n": "string"})[-1] == "2023-06"
    assert values(read_source(spark, bronze, "orders"), "n")[-1] == ("word",)
    os.remove(tmp_path / "raw" / "e.csv")
    os.remove(tmp_path / "raw" / "f.csv")
    mirror_source(spark, "orders", path, bronze)
    assert dict(read_source(spark, bronze, "orders").dtypes)["n"] == "bigint"  # the evidence went with the files


def test_a_broken_write_is_made_good(spark, tmp_path, mirrored, monkeypatch):
    path, bronze = mirrored
    files(tmp_path, a=["a,9,1/1/2023", "a,9,1/2/2023"])
    with monkeypatch.context() as m:
        m.setattr(B, "write_partitions", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            mirror_source(spark, "orders", path, bronze)
    assert ledger(spark, bronze, "orders").pending == ["2023-01", "2023-02"]
    assert not B.is_ingested(spark, "orders", path, bronze)
    assert read_source(spark, bronze, "orders").count() == 4
    assert mirror_source(spark, "orders", path, bronze) == ["2023-01", "2023-02"]
    assert values(read_source(spark, bronze, "orders"), "Customer_ID", "n") == [("a", 9), ("a", 9), ("b", 1), ("c", 1)]


def test_modes_do_not_mix(spark, tmp_path, mirrored):
    path, bronze = mirrored
    with pytest.raises(ValueError, match="mirrors"):
        ingest_source(spark, "orders", path, bronze)
    ingest_source(spark, "clicks", path, bronze)
    with pytest.raises(ValueError, match="batches"):
        mirror_source(spark, "clicks", path, bronze)
    with pytest.raises(ExceptionGroup) as raised:
        ingest_bronze(spark, {"none": str(tmp_path / "none.csv")}, bronze, raw_mode="mirror")
    assert "no files" in str(raised.value.exceptions[0])
