"""Byte-level BPE by a global shuffle of distinct words, and decoding by the table of token bytes.

Texts are cut into pre-tokens, in chunks of many texts. A chunk sends each of its distinct words once, packed into one row per
bucket of words. A bucket unites the words of all chunks, encodes every distinct word once, and answers each chunk with the ids of its words in
the order asked. The chunk's positions, which never leave it as rows, then put the ids in order.

A chunk is named by a digest of its distinct words. Requests and positions are made by two passes over the input; if an input were
read in other chunks the second time, the answers would be missing and the job would fail, not give other ids. Chunks with the same
words share their answers. A frequent word costs a bucket one entry per chunk, however often it occurs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.pretokens import pretokens

U64 = np.uint64
#: Text of a chunk. More means fewer repeated words in the shuffle, and more memory in a task.
CHUNK_BYTES = 8_000_000
CHANGED = "the input was read in other chunks the second time; store it before encoding"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=1)
def _encoding(path_digest: str, ranks: tuple) -> tiktoken.Encoding:
    return tiktoken.Encoding(path_digest, pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


def pack(array: np.ndarray) -> bytes:
    """Compressed bytes of an array, one plane per byte of its items."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches one behind the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class Chunk:
    """Distinct words of many texts, in the order of their hashes, and where they stand."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.size = 0
        self.hashes, self.lengths, self.bytes, self.counts, self.words = [], [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = T.flat(batch.column("text"))
        starts, of_text = pretokens(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = T.stretch(T.running_bytes(data), starts, ends)
        distinct, first = np.unique(hashes, return_index=True)
        self.ids.append(batch.column("id"))
        self.size += len(data)
        self.counts.append(np.diff(of_text).astype(np.uint32))
        self.words.append(hashes)
        self.hashes.append(distinct)
        self.lengths.append((ends - starts)[first])
        self.bytes.append(gather(data, starts[first], self.lengths[-1]))

    def close(self) -> None:
        hashes, lengths = np.concatenate(self.hashes), np.concatenate(self.lengths)
        places = np.cumsum(lengths) - lengths
        self.distinct, first = np.unique(hashes, return_index=True)
        self.length = lengths[first].astype(np.uint32)
        self.text = gather(np.concatenate(self.bytes), places[first], self.length.astype(np.int64))
        digest = hashlib.sha256(self.length.tobytes())
        digest.update(self.text.tobytes())
        self.name = digest.digest()[:16]

    def requests(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Bucket, lengths and bytes of the words in it. A bucket is a range of hashes."""
        edges = bucket_edges(self.distinct, buckets)
        places = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        for b in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[b], edges[b + 1]
            words = zstandard.ZstdCompressor(level=3).compress(self.text[places[lo] : places[hi]].tobytes())
            yield b, pack(self.length[lo:hi]), words

    def positions(self) -> np.ndarray:
        return np.concatenate([np.searchsorted(self.distinct, w).astype(np.uint32) for w in self.words])


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    limits = np.array([(b << 64) // buckets for b in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]]).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    chunk = Chunk()
    for whole in batches:
        for batch in T.slices(whole, "text"):
            chunk.add(batch)
            if chunk.size >= size:
                chunk.close()
                yield chunk
                chunk = Chunk()
    if chunk.ids:
        chunk.close()
        yield chunk


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


REQUEST = pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary())])
ANSWER = pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())])


def encode(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, and ``ids``, the token ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Rows are carried by position, so ids may repeat or be null; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    vocabulary = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = source.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, chunk_bytes):
            for bucket, lengths, words in chunk.requests(buckets):
                yield _rows(REQUEST, [chunk.name], [bucket], [lengths], [words])
            T.release()

    def answer(requests: pa.Table) -> pa.Table:
        T.release()
        encoding = _encoding("bpe", tuple(vocabulary.value.items()))
        known: dict[bytes, list[int]] = {}
        out, seen = [], set()
        for r in range(requests.num_rows):
            chunk = requests["chunk"][r].as_py()
            if chunk in seen:
                continue
            seen.add(chunk)
            lengths = unpack(requests["lengths"][r].as_py(), np.uint32)
            words = zstandard.ZstdDecompressor().decompress(requests["words"][r].as_py())
            counts, ids, end = [], [], 0
            for length in lengths.tolist():
                word = words[end : (end := end + length)]
                if (found := known.get(word)) is None:
                    found = known[word] = encoding.encode_ordinary(word.decode())
                counts.append(len(found))
                ids += found
            out.append((chunk, requests["bucket"][r].as_py(), pack(np.array(counts, np.uint32)), pack(np.array(ids, np.uint32))))
        return pa.Table.from_batches([_rows(ANSWER, *zip(*out, strict=True))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, chunk_bytes):
            ids = pa.concat_arrays(chunk.ids)
            with pa.BufferOutputStream() as sink:
                table = pa.table({"id": ids, "n": np.concatenate(chunk.counts)})
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table)
                rows = sink.getvalue().to_pybytes()
            yield _rows(PLACES, [chunk.name], [rows], [pack(chunk.positions())])
            T.release()

    def join(placed: pa.Table, answers: pa.Table) -> pa.Table:
        T.release()
        if not placed.num_rows:
            raise ValueError(CHANGED)
        order = np.argsort(answers["bucket"].to_numpy())
        counts = [unpack(answers["counts"][i].as_py(), np.uint32) for i in order.tolist()]
        ids = [unpack(answers["ids"][i].as_py(), np.uint32) for i in order.tolist()]
        counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        places, out = np.cumsum(counts) - counts, []
        for r in range(placed.num_rows):
            rows = pa.ipc.open_stream(placed["rows"][r].as_py()).read_all().combine_chunks()
            words = unpack(placed["positions"][r].as_py(), np.uint32)
            if len(words) and words.max() >= len(counts):
                raise ValueError(CHANGED)
            ends = np.cumsum(rows["n"].to_numpy(), dtype=np.int64)
            for lo in range(0, rows.num_rows, 200):
                hi = min(lo + 200, rows.num_rows)
                first = ends[lo - 1] if lo else 0
                part = words[first : ends[hi - 1]]
                sizes = counts[part]
                tokens = gather(ids, places[part], sizes).astype("<u4")
                edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends[lo:hi] - first])]
                values = pa.Array.from_buffers(
                    pa.binary(), hi - lo, [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(tokens)]
                )
                out.append(pa.RecordBatch.from_arrays([rows["id"].combine_chunks()[lo:hi], values], names=["id", "ids"]))
        return pa.Table.from_batches(out)

    requests = source.mapInArrow(ask, "chunk binary, bucket int, lengths binary, words binary")
    answers = requests.groupBy("bucket").applyInArrow(answer, "chunk binary, bucket int, counts binary, ids binary")
    placed = source.mapInArrow(place, "chunk binary, rows binary, positions binary")
    joined = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, f"id {key}, ids binary")
    return joined.withColumnRenamed("id", id_col)


PLACES = pa.schema([("chunk", pa.binary()), ("rows", pa.binary()), ("positions", pa.binary())])


def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens by id, end to end, and n + 1 offsets; an id without token has none."""
    ranks = read_ranks(ranks_path)
    by_id = {i: t for t, i in ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _decoded(column: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes | None]:
    data, offsets = table
    for value in column:
        if not value.is_valid:
            yield None
            continue
        ids = np.frombuffer(value.as_buffer(), "<u4").astype(np.int64)
        yield gather(data, offsets[ids], offsets[ids + 1] - offsets[ids]).tobytes()


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with one more column: the tokens' bytes. Null ids give null; an id out of the vocabulary is an error."""
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = pa.array(list(_decoded(batch.column(place), table.value)), pa.binary())
            schema = batch.schema.append(pa.field(bytes_col, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], schema=schema)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{bytes_col}` binary")


def digest(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Of each row of ``encode``: id, number of tokens, and SHA-256 of the ids and of the bytes that they decode to.

    The same as ``decode`` and digests of its columns, without sending the decoded texts back to the JVM.
    """
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            size = [len(x.as_buffer()) // 4 for x in ids]
            ids_digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in ids]
            decoded_digest = [hashlib.sha256(x).hexdigest() for x in _decoded(ids, table.value)]
            columns = [batch.column(id_col), pa.array(size, pa.int64()), pa.array(ids_digest), pa.array(decoded_digest)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            T.release()

    key = encoded.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded.select(id_col, "ids").mapInArrow(run, schema)
