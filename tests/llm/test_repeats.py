import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from llm.conftest import by_row, in_order
from pyspark.sql import functions as F

from riskmart.llm import repeats as R

COLUMNS = ("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "size(spans)", "sha2(kept, 256)")


def short(rows):
    return [(d, t) for d, t in rows if len(t or "") < 20_000]


@pytest.fixture(scope="module")
def some(docs):
    return docs.filter("coalesce(length(text), 0) < 20000")


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length", [200, 64])
def test_bytes_removed_are_those_of_brute_force(some, rows, keep, length):
    if keep == "first":  # rows that repeat an id are told apart by no order that both know
        some = some.filter("doc_id is not null").drop_duplicates(["doc_id"])
        rows = [(d, t) for d, t in dict(rows).items() if d is not None]
    found = by_row(R.repeated_spans(some, keep, length, chunk_bytes=9000).selectExpr(*COLUMNS))
    assert found == in_order(brute.repeats(short(rows), length, keep))
    assert any(r[2] for r in found)


def test_spread_anchors_change_nothing(some, rows, monkeypatch):
    want = by_row(R.repeated_spans(some, "first", chunk_bytes=9000).selectExpr(*COLUMNS))
    monkeypatch.setattr(R, "ANCHOR_STRETCHES", 2)
    assert by_row(R.repeated_spans(some, "first", chunk_bytes=9000).selectExpr(*COLUMNS)) == want


def test_a_table_twice_is_all_copies(some, rows):
    one = some.coalesce(1)
    twice = short(rows) * 2
    for keep in ("none", "first"):
        found = by_row(R.repeated_spans(one.union(one), keep).selectExpr(*COLUMNS))
        if keep == "none":
            assert found == in_order(brute.repeats(twice))
        else:  # the later of two equal rows loses all that the first keeps of its repeated strings
            want = brute.repeats(twice, keep="first")
            assert sum(r[2] for r in found) == sum(r[2] for r in want)


def test_texts_stay_texts_and_rows_stay(docs, no_docs):
    cut = R.remove_repeats(docs, "none")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    lengths = {r.doc_id: r.n for r in cut.select("doc_id", F.length("text").alias("n")).collect()}
    assert lengths[0] is None and lengths[1] == 0 and lengths[5] < 300
    assert R.remove_repeats(no_docs).count() == R.repeated_spans(no_docs).count() == 0
    with pytest.raises(ValueError, match="keep"):
        R.repeated_spans(docs, "last")


def test_longest_earlier_match_needs_a_smaller_position_in_the_run():
    position = np.array([5, 2, 9, 1, 7, 3])
    common = np.array([False, True, True, False, True, True])
    assert R.previous_smaller(position).tolist() == [-1, -1, 1, -1, 3, 3]
    assert R.longest_previous(position, common).tolist() == [True, False, True, False, True, True]


def test_anchors_do_not_depend_on_the_size_of_a_text():
    grams = np.random.default_rng(2).integers(0, 1 << 40, 9000, dtype=np.uint64) << np.uint64(24)
    grams[100:900] = grams[5000:5800]
    width = 169
    n = len(grams) - width + 1
    found = R.anchors(grams, n, width, bits=10)  # pieces of 855 places
    hashes = (grams >> np.uint64(10)).tolist()
    assert found.tolist() == [min(range(i, i + width), key=lambda k: (hashes[k], k)) for i in range(n)]
    part = R.anchors(grams[4990:5900], 910 - width + 1, width, bits=10) + 4990
    assert (part == found[4990 : 4990 + len(part)]).all()


@pytest.mark.parametrize("keep", ["none", "first"])
def test_a_very_long_text_and_shorter_ones_share_passages(spark, keep):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = [prose(60) for _ in range(6)]
    long = " ".join(part + " " + prose(1500) for part in shared) + shared[0]
    rows = [(9, long), *[(i, prose(30) + part + prose(20)) for i, part in enumerate(shared)], (7, long[:500]), (20, "short")]
    assert len(long) > 60_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = by_row(R.repeated_spans(df, keep, chunk_bytes=9000).selectExpr(*COLUMNS))
    assert found == in_order(brute.repeats(rows, keep=keep))


def test_text_ids_are_ordered_by_their_value(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(f"doc-{i}", text) for i in range(8)] + [(None, text)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    kept = {r.doc_id for r in R.remove_repeats(df).filter("length(text) > 200").collect()}
    assert kept == {"doc-0"}
    assert R.remove_repeats(df, "none").filter("length(text) > 200").count() == 0


def test_chunks_hold_their_own_rows_only():
    texts = pa.array(["x" * 1000] * 3000)
    whole = pa.record_batch([pa.array(range(3000), pa.int64()), texts], ["_order", "_text"])
    sizes, rows = [], 0
    for chunk in R.chunks(iter([whole]), 200_000):
        held = {b.address for batch in chunk.batches for c in batch.columns for b in c.buffers() if b is not None}
        theirs = {b.address for c in whole.columns for b in c.buffers() if b is not None}
        sizes.append(sum(batch.get_total_buffer_size() for batch in chunk.batches))
        rows += chunk.n
        assert not held & theirs
    assert rows == 3000 and max(sizes) < 1_200_000  # one slice, not the batch of 3 MB


def test_anchors_are_dealt_evenly_over_the_routes():
    data = np.random.default_rng(5).integers(97, 123, 1_000_000, dtype=np.uint8)
    found = R.stretches(data, np.arange(0, 1_000_001, 2_000))
    shares = np.diff(R._route_edges(np.sort(found["anchor"]), 50)) / len(found["anchor"])
    assert shares.min() > 0.015 and shares.max() < 0.025
