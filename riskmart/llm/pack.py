"""Packing of token sequences into rows of fixed length, ready for training.

Each task tokenizes its documents and packs them in blocks of many documents. A document longer than a row is split into pieces of the row's length and a rest, in order and
without loss. Pieces go by falling length, each into the open row with the least room that still takes it (best fit decreasing). Rooms are counted
by size, and a segment tree over the sizes finds the smallest room that is large enough in logarithmic time; so the pass is bound by the block, and no shuffle is needed.

A packed row holds the token ids (padded), the cumulative lengths of its segments, and for each segment its document and the offset at which the piece
starts there; position ids start again at each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.bpe import PATTERN, read_ranks

ROW_TOKENS = 2048
#: Tokens of one block that a task packs at a time.
BLOCK_TOKENS = 1_500_000


class Rooms:
    """Numbers of open rows by room left, under a segment tree that finds the smallest room of at least a size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and number of the row that fits best, taken out; None if no row has so much room."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2  # up, until a subtree to the right holds rows
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def split(length: int, capacity: int) -> list[tuple[int, int]]:
    """Offset and length of the pieces of a sequence."""
    return [(a, min(capacity, length - a)) for a in range(0, length, capacity)]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each row, for items of 1 to ``capacity``; equal lengths go in the order given."""
    rooms, rows = Rooms(capacity), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        if (found := rooms.take(size)) is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        if room > size:
            rooms.put(room - size, row)
    return rows


_SCHEMA = (
    "block string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<{key}>, doc_offsets array<int>"
)


def pack(
    docs: DataFrame,
    ranks_path: str,
    row_tokens: int = ROW_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packed rows: block and row number, tokens in use, and

    * ``ids``: ``row_tokens`` ids as little-endian unsigned 16-bit integers (32-bit if the vocabulary needs it), padded by ``pad_id``;
    * ``cu_seqlens``: 0 and the end of each segment;
    * ``position_resets``: where position ids start from 0 again, the starts of the segments;
    * ``doc_ids``, ``doc_offsets``: the document of each segment, and the token of it at which the segment starts.

    Documents without tokens (null or empty texts) are in no row. Ids may repeat or be null; segments keep them. Each row of ``docs`` is split
    and packed by itself; other columns are ignored.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    kind = np.dtype("<u2") if max(ranks.values()) < 1 << 16 and pad_id < 1 << 16 else np.dtype("<u4")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        task, block = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[np.ndarray] = []
        held, id_type = 0, None

        def packed() -> Iterator[pa.RecordBatch]:
            pieces = [(d, a, n) for d, t in enumerate(tokens) for a, n in split(len(t), row_tokens)]
            rows = best_fit_decreasing(np.array([n for *_, n in pieces], np.int64), row_tokens)
            for lo in range(0, len(rows), 256):
                out = {name: [] for name in ("used", "ids", "ends", "docs", "offsets")}
                for row in rows[lo : lo + 256]:
                    segments = [pieces[i] for i in row]
                    matrix = np.full(row_tokens, pad_id, kind)
                    ends = np.cumsum([0, *(n for *_, n in segments)]).tolist()
                    for (d, a, n), at in zip(segments, ends, strict=False):
                        matrix[at : at + n] = tokens[d][a : a + n]
                    out["used"].append(ends[-1])
                    out["ids"].append(matrix.tobytes())
                    out["ends"].append(ends)
                    out["docs"].append([ids[d] for d, *_ in segments])
                    out["offsets"].append([a for _, a, _ in segments])
                n = len(out["used"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{task}-{block}"] * n),
                        pa.array(np.arange(lo, lo + n, dtype=np.int32)),
                        pa.array(out["used"], pa.int32()),
                        pa.array(out["ids"], pa.binary()),
                        pa.array(out["ends"], pa.list_(pa.int32())),
                        pa.array([e[:-1] for e in out["ends"]], pa.list_(pa.int32())),
                        pa.array(out["docs"], pa.list_(id_type)),
                        pa.array(out["offsets"], pa.list_(pa.int32())),
                    ],
                    names=["block", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
                )

        for whole in batches:
            id_type = whole.schema.field("id").type
            for batch in T.slices(whole, "text"):
                for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    tokens.append(np.array(encoding.encode_ordinary(text), kind))
                    ids.append(id_)
                    held += len(tokens[-1])
                    if held >= block_tokens:
                        yield from packed()
                        ids, tokens, held, block = [], [], 0, block + 1
        if tokens:
            yield from packed()

    return source.mapInArrow(run, _SCHEMA.format(key=key))


def unpack(rows: DataFrame, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """The segments of packed rows: document, offset in it, and ids as in ``pack``; by offset they give each document back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                size, ends = len(row["ids"]) // row_tokens, row["cu_seqlens"]
                for i, (doc, offset) in enumerate(zip(row["doc_ids"], row["doc_offsets"], strict=True)):
                    out.append({"doc_id": doc, "doc_offset": offset, "ids": row["ids"][ends[i] * size : ends[i + 1] * size]})
            kind = batch.schema.field("doc_ids").type.value_type
            fields = [("doc_id", kind), ("doc_offset", pa.int32()), ("ids", pa.binary())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    key = rows.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, doc_offset int, ids binary")
