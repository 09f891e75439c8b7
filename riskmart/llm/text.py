"""Vectorised work on the UTF-8 bytes of many texts at once, for use inside Arrow tasks.

Texts of a batch lie end to end in one byte array with n + 1 offsets; a null text is an empty one.
Hashes of any stretch come from one running sum of ``value[byte] * B**position`` modulo 2**64: the
difference of two sums, shifted back by a power of B's inverse, depends on the stretch's bytes only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts of a batch are handled in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C53 | 3  # 3 modulo 8, so that base - 1 has one factor 2
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths.astype(np.int64)) // size
    edges = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(int(start), int(end - start))
    release()


def release() -> None:
    """Give freed memory back to the system, so that waiting workers hold little of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a task that gives back what it held when it has ended: the worker then waits, beside those of the next stage."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def released_group(run: Callable[[pa.Table], pa.Table | None]):
    """The same for a function of one group's rows."""

    def whole(rows: pa.Table) -> pa.Table | None:
        out = run(rows)
        release()
        return out

    return whole


def released_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table | None]):
    """The same for a function of the rows of two sides."""

    def whole(left: pa.Table, right: pa.Table) -> pa.Table | None:
        out = run(left, right)
        release()
        return out

    return whole


def own_copy(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows without the batch that they are a slice of, which may be many times their size."""
    return pa.ipc.read_record_batch(batch.serialize(), batch.schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(length, base, U64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    length = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
    return _powers(length)


def running(values: np.ndarray) -> np.ndarray:
    """Running sums, one more than values, from which ``stretch`` takes hashes."""
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * powers(len(values))[0][: len(values)], out=sums[1:])
    return sums


def running_bytes(data: np.ndarray) -> np.ndarray:
    return running(_VALUES[data])


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches; equal content gives equal hashes wherever it lies."""
    inverse = powers(len(sums))[1]
    lengths = (ends - starts).astype(U64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + lengths * U64(0xA24BAED4963EE407))


def grams(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` items from each position that has so many; document ends are not seen."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, U64)
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n])


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes inside a text, and n + 1 offsets into these."""
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(inside):
        edges = offsets[(offsets > 0) & (offsets < len(inside))]
        before[0] = after[-1] = False
        before[edges] = after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, 0 for one without any."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_table(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words set apart by ASCII white space, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = ~byte_table([0x20, *range(0x09, 0x0E)])
ALPHANUMERIC = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
