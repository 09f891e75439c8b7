"""Packed rows as binary files that a training job maps into memory, and back.

Each task writes the packed rows that it makes to files of its own, four to a part:

* ``.ids``: the matrix of token ids, row by row, little-endian;
* ``.cu_seqlens``: 0 and the ends of each row's segments, rows end to end, as little-endian 32-bit integers;
* ``.position_resets``: where each row's position ids start from 0 again, likewise;
* ``.rows``: an Arrow stream with each row's block, number, tokens in use, documents and offsets; the number of documents tells how many
  resets a row has, and one more is its number of cumulative lengths.

Names are unique to the attempt of a task. A part is named by the manifest, a table which the same tasks give and Spark commits, so a lost or repeated attempt leaves
files that nothing names. ``layout.json`` comes last; a folder without it isn't finished. No file list passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from riskmart.llm.pack import ROW_TOKENS

#: Bytes of ids at which a part is closed.
PART_BYTES = 32_000_000
LAYOUT, DATA, MANIFEST = "layout.json", "data", "manifest"
SECTIONS = ("ids", "cu_seqlens", "position_resets", "rows")
_INT = np.dtype("<i4")
_ENTRY = "part string, n_rows long, n_segments long, n_tokens long, " + ", ".join(f"{s}_bytes long, {s}_sha256 string" for s in SECTIONS)
_ROW = ("block", "row", "n_tokens", "doc_ids", "doc_offsets")
_ROWS = (
    "block string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<{key}>, doc_offsets array<int>"
)


class _Section:
    """A file written in pieces, with its length and digest."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.sink, self.size, self.sha = fs.open_output_stream(path), 0, hashlib.sha256()

    def write(self, data) -> int:
        data = bytes(data)
        self.sink.write(data)
        self.sha.update(data)
        self.size += len(data)
        return len(data)

    # what pyarrow asks of a file that it writes a stream to
    closed = False

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.sink.close()


class _Part:
    """The four files of a part while they are written."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, name: str, schema: pa.Schema):
        self.name, self.n_rows, self.n_segments, self.n_tokens = name, 0, 0, 0
        self.files = {s: _Section(fs, f"{folder}/{name}.{s}") for s in SECTIONS}
        self.stream = pa.ipc.new_stream(pa.PythonFile(self.files["rows"], "w"), schema)

    def add(self, batch: pa.RecordBatch) -> None:
        for row in batch.column("ids"):
            self.files["ids"].write(row.as_buffer())
        for s in ("cu_seqlens", "position_resets"):
            flat = batch.column(s).flatten().to_numpy(zero_copy_only=False)
            self.files[s].write(flat.astype(_INT).tobytes())
        self.stream.write_batch(batch.select(_ROW))
        self.n_rows += batch.num_rows
        self.n_segments += len(batch.column("doc_ids").flatten())
        self.n_tokens += int(batch.column("n_tokens").to_numpy(zero_copy_only=False).sum())

    def close(self) -> dict:
        self.stream.close()
        entry = {"part": self.name, "n_rows": self.n_rows, "n_segments": self.n_segments, "n_tokens": self.n_tokens}
        for s, file in self.files.items():
            file.close()
            entry |= {f"{s}_bytes": file.size, f"{s}_sha256": file.sha.hexdigest()}
        return entry


def _write_parts(batches: Iterator[pa.RecordBatch], out: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(out)
    attempt, part, n = uuid.uuid4().hex, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if part is None:
            part = _Part(fs, f"{root}/{DATA}", f"{attempt}-{n}", batch.select(_ROW).schema)
            n += 1
        part.add(batch)
        if part.files["ids"].size >= part_bytes:
            yield pa.RecordBatch.from_pylist([part.close()], schema=_entry_schema())
            part = None
    if part is not None:
        yield pa.RecordBatch.from_pylist([part.close()], schema=_entry_schema())


def _entry_schema() -> pa.Schema:
    return pa.schema([(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in _ENTRY.split(", ")])


def write(
    packed: DataFrame, out: str, row_tokens: int = ROW_TOKENS, pad_id: int = 0, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Write the rows of ``pack`` below ``out``, a URI that all executors reach; returns the manifest, one row per part.

    ``row_tokens`` and ``pad_id`` are those given to ``pack``. ``out`` must be new. No rows give a manifest without parts. Documents' ids may be null or repeat, and may
    be of any type that Spark hands over as Arrow. An error leaves a folder without a layout, which ``read`` refuses.
    """
    spark = packed.sparkSession
    fs, new_path = _file_system(spark, out), spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(new_path(out)):
        raise FileExistsError(f"{out} is there already")
    fs.mkdirs(new_path(f"{out}/{DATA}"))
    key = packed.schema["doc_ids"].dataType.elementType.simpleString()
    packed.mapInArrow(lambda batches: _write_parts(batches, out, part_bytes), _ENTRY).write.parquet(f"{out}/{MANIFEST}")
    layout = {"row_tokens": row_tokens, "pad_id": pad_id, "byte_order": "little", "doc_id": key, "sections": SECTIONS}
    stream = fs.create(new_path(f"{out}/{LAYOUT}.tmp"), True)
    stream.write(bytearray(json.dumps(layout, indent=1).encode()))
    stream.close()
    if not fs.rename(new_path(f"{out}/{LAYOUT}.tmp"), new_path(f"{out}/{LAYOUT}")):
        raise OSError(f"the layout of {out} can't be put in place")
    return manifest(spark, out)


def _file_system(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The parts with their rows, segments, tokens, and the size and SHA-256 of each file."""
    return spark.read.schema(_ENTRY).parquet(f"{out}/{MANIFEST}")


def layout(spark: SparkSession, out: str) -> dict:
    """Row length, padding and type of document ids; an error if the folder was not finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{LAYOUT}")
    if not _file_system(spark, out).exists(path):
        raise FileNotFoundError(f"{out} has no layout: it was not written to the end")
    return json.loads(spark.read.text(f"{out}/{LAYOUT}", wholetext=True).first().value)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The rows that were written, with the columns of ``pack``; every file must have the length and digest that the manifest states.

    A task reads a part at a time.
    """
    row_tokens, key = (layout(spark, out)[k] for k in ("row_tokens", "doc_id"))
    parts = manifest(spark, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        for batch in batches:
            for entry in batch.to_pylist():
                yield from _read_part(fs, f"{root}/{DATA}", entry, row_tokens)

    spread = parts.repartition(max(1, parts.count()))
    return spread.mapInArrow(run, _ROWS.format(key=key))


def _read_part(fs: pyarrow.fs.FileSystem, folder: str, entry: dict, row_tokens: int) -> Iterator[pa.RecordBatch]:
    data = {}
    for s in SECTIONS:
        with fs.open_input_stream(f"{folder}/{entry['part']}.{s}") as source:
            data[s] = source.read()
        if len(data[s]) != entry[f"{s}_bytes"] or hashlib.sha256(data[s]).hexdigest() != entry[f"{s}_sha256"]:
            raise ValueError(f"{entry['part']}.{s} is not what was written")
    width = len(data["ids"]) // entry["n_rows"]
    if width % row_tokens:
        raise ValueError(f"{entry['part']}.ids does not hold rows of {row_tokens} ids")
    flat = {s: np.frombuffer(data[s], _INT) for s in ("cu_seqlens", "position_resets")}
    at = {"ids": 0, "cu_seqlens": 0, "position_resets": 0}
    for rows in pa.ipc.open_stream(data["rows"]):
        n = rows.num_rows
        segments = np.concatenate([[0], np.cumsum(rows.column("doc_ids").value_lengths().to_numpy(zero_copy_only=False))])
        lists = {}
        for s, starts in (("cu_seqlens", segments + np.arange(n + 1)), ("position_resets", segments)):
            values = flat[s][at[s] : at[s] + starts[-1]]
            lists[s] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
            at[s] += int(starts[-1])
        ids = [data["ids"][i : i + width] for i in range(at["ids"], at["ids"] + n * width, width)]
        at["ids"] += n * width
        columns = {"ids": pa.array(ids, pa.binary()), **lists, **{c: rows.column(c) for c in _ROW}}
        names = ["block", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
