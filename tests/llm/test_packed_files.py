"""Packed rows written as binary files and read back."""

import os
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import by_row

from riskmart.llm import pack, packed_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COLUMNS = ["block", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]


@pytest.fixture(scope="module")
def packed(spark, docs, tmp_path_factory):
    """Packed once, so that every reading meets the same rows."""
    path = str(tmp_path_factory.mktemp("packed") / "rows")
    pack.pack(docs, RANKS, row_tokens=64, block_tokens=4000).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def out(tmp_path):
    return f"file://{tmp_path}/packed"


def test_what_is_read_is_what_was_packed(spark, packed, out):
    parts = packed_files.write(packed, out, row_tokens=64, part_bytes=20_000)
    found = packed_files.read(spark, out)
    assert found.columns == COLUMNS and by_row(found) == by_row(packed.select(*COLUMNS))
    assert found.schema["doc_ids"].dataType == packed.schema["doc_ids"].dataType
    rows, entries = packed.collect(), parts.collect()
    assert len(entries) > 1
    assert sum(e.n_rows for e in entries) == len(rows)
    assert sum(e.n_segments for e in entries) == sum(len(r.doc_ids) for r in rows)
    assert sum(e.n_tokens for e in entries) == sum(r.n_tokens for r in rows)


def test_files_are_plain_arrays(spark, packed, out):
    want = {(bytes(r.ids), tuple(r.cu_seqlens), tuple(r.position_resets)) for r in packed.collect()}
    found = set()
    for e in packed_files.write(packed, out, row_tokens=64).collect():
        file = f"{out.removeprefix('file://')}/data/{e.part}"
        matrix = np.memmap(f"{file}.ids", "<u2", "r").reshape(-1, 64)
        ends, resets = np.fromfile(f"{file}.cu_seqlens", "<i4"), np.fromfile(f"{file}.position_resets", "<i4")
        starts = [*np.flatnonzero(ends == 0), len(ends)]  # no segment is empty, so 0 begins a row
        assert len(matrix) == e.n_rows == len(starts) - 1 and len(resets) == e.n_segments
        for i, row in enumerate(matrix):
            cu = ends[starts[i] : starts[i + 1]]
            found.add((row.tobytes(), tuple(cu.tolist()), tuple(resets[starts[i] - i : starts[i + 1] - i - 1].tolist())))
    assert found == want


def test_no_rows(spark, no_docs, out):
    assert packed_files.write(pack.pack(no_docs, RANKS), out).count() == 0
    found = packed_files.read(spark, out)
    assert found.count() == 0 and found.columns == COLUMNS


def test_ids_of_any_type_and_large_vocabularies(spark, out):
    docs = spark.createDataFrame([("a", "one two"), (None, "three"), ("a", "one two"), ("e", None)], "doc_id string, text string")
    rows = pack.pack(docs.coalesce(1), RANKS, row_tokens=8, pad_id=1 << 20)
    packed_files.write(rows, out, row_tokens=8, pad_id=1 << 20)
    found = packed_files.read(spark, out)
    assert by_row(found) == by_row(rows)
    assert found.first().ids[-4:] == (1 << 20).to_bytes(4, "little")
    pieces = sorted(r.doc_id or "" for r in pack.unpack(found, 8).collect())
    assert pieces == ["", "a", "a"]


def test_a_lost_attempt_leaves_nothing_that_is_read(spark, packed, out):
    packed_files.write(packed, out, row_tokens=64)
    folder = Path(out.removeprefix("file://")) / "data"
    for section in packed_files.SECTIONS:  # what a task leaves that was ended while it wrote
        (folder / f"lost-0.{section}").write_bytes(b"half a row")
    assert by_row(packed_files.read(spark, out)) == by_row(packed.select(*COLUMNS))


def test_a_failed_run_is_no_result(spark, packed, out):
    def fail(batches):
        yield from batches
        raise RuntimeError("lost on the way")

    with pytest.raises(Exception, match="lost on the way"):
        packed_files.write(packed.mapInArrow(fail, packed.schema), out, row_tokens=64)
    with pytest.raises(FileNotFoundError, match="not written to the end"):
        packed_files.read(spark, out)
    with pytest.raises(FileExistsError):
        packed_files.write(packed, out, row_tokens=64)


@pytest.mark.parametrize("section", packed_files.SECTIONS)
def test_damage_is_seen(spark, packed, out, section):
    entry = packed_files.write(packed, out, row_tokens=64).first()
    file = f"{out.removeprefix('file://')}/data/{entry.part}.{section}"
    with open(file, "r+b") as f:
        f.seek(os.path.getsize(file) // 2)
        old = f.read(1)
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([old[0] ^ 255]))
    with pytest.raises(Exception, match="is not what was written"):
        packed_files.read(spark, out).collect()
