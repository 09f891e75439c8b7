"""Benchmark decontamination: find passages of test items in training texts and take them out.

Both sides are read as words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters.
A window is ``WINDOW`` consecutive words of a benchmark item; an item with fewer words, but some, is one
window. A word of a document is hit if it lies inside any occurrence of a window.

The windows' 64-bit hashes are broadcast as one sorted array while the documents' windows stream past; a hit
is verified by its words before it counts. The broadcast is bounded by ``max_windows``: a larger benchmark is
cut into blocks of whole items of at most about so many windows, each block is scanned by itself, and hits are united per
document. No document is shuffled while one block is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T

WINDOW = 10
#: Windows of one broadcast block: hashes, words and items of so many fit beside a task.
MAX_WINDOWS = 500_000
_FILTER_BITS = 20


def words_of(data: np.ndarray, offsets: np.ndarray):
    lower = T.LOWER[data]
    return lower, *T.word_spans(lower, offsets, T.ALPHANUMERIC)


def word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return T.stretch(T.running_bytes(lower), starts, ends)


class WindowSet:
    """Hash set of the windows of some benchmark items, with what is needed to verify a hit."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        by_length: dict[int, dict[int, dict[bytes, set]]] = {}
        data, offsets = T.flat(pa.array([t for _, t in items], pa.string()))
        lower, starts, ends, of_item = words_of(data, offsets)
        hashes = word_hashes(lower, starts, ends)
        for k, (item, _) in enumerate(items):
            first, last = of_item[k], of_item[k + 1]
            width = min(window, last - first)
            if not width:
                continue
            found = by_length.setdefault(int(width), {})
            keys = T.grams(T.running(hashes[first:last]), width)
            for i, key in enumerate(keys.tolist(), start=first):
                words = b" ".join(lower[starts[j] : ends[j]].tobytes() for j in range(i, i + width))
                found.setdefault(key, {}).setdefault(words, set()).add(item)
        self.words = by_length
        self.filters = {}
        for width, found in by_length.items():
            keys = np.sort(np.fromiter(found, np.uint64, len(found)))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.filters[width] = (keys, bits)

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Words, hit flags, and per text the set of items found."""
        lower, starts, ends, of_text = words_of(data, offsets)
        hit = np.zeros(len(starts), bool)
        items: dict[int, set] = {}
        if len(starts):
            hashes = word_hashes(lower, starts, ends)
            sums, text = T.running(hashes), T.owners(of_text)
            for width, (keys, bits) in self.filters.items():
                windows = T.grams(sums, width)
                at = np.flatnonzero(bits[windows & np.uint64((1 << _FILTER_BITS) - 1)])
                at = at[text[at] == text[at + width - 1]]
                place = np.minimum(np.searchsorted(keys, windows[at]), len(keys) - 1)
                for i in at[keys[place] == windows[at]].tolist():
                    words = b" ".join(lower[starts[j] : ends[j]].tobytes() for j in range(i, i + width))
                    if (found := self.words[width][int(windows[i])].get(words)) is not None:
                        hit[i : i + width] = True
                        items.setdefault(int(text[i]), set()).update(found)
        return starts, ends, of_text, hit, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_windows: int):
    """Items in blocks of at most ``max_windows`` windows, or of one item with more."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for row in rows.toLocalIterator():
        n = len(row.text or "") // 2 + 1  # words need a character each and one between
        if block and size + n > max_windows:
            yield WindowSet(block, window)
            block, size = [], 0
        block.append((row.item, row.text))
        size += n
    yield WindowSet(block, window)


def _spans(starts, ends, of_text, hit, k: int, base: int) -> list[tuple[int, int]]:
    """Byte ranges of the runs of hit words of text ``k``."""
    first, last = of_text[k], of_text[k + 1]
    flags = np.concatenate([[False], hit[first:last], [False]])
    edges = np.flatnonzero(np.diff(flags.astype(np.int8)))
    return [(int(starts[first + a] - base), int(ends[first + b - 1] - base)) for a, b in edges.reshape(-1, 2)]


SCAN_SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: id, word count, hit words, items found, and byte ranges of the hits.

    A null text has no words. A benchmark row without id counts as a source of hits but is in no item list.
    Repeated documents, ids and items are judged row by row; other columns of both sides are ignored, whatever their
    names. An empty table on either side gives no rows, or no hits.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key_type = source.schema["id"].dataType.simpleString()
    parts = []
    for windows in _blocks(benchmark, item_col, item_text_col, window, max_windows):
        shared = spark.sparkContext.broadcast(windows)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in T.slices(whole, "text"):
                    data, offsets = T.flat(batch.column("text"))
                    starts, ends, of_text, hit, items = shared.value.scan(data, offsets)
                    n_hit = T.sums_by_text(hit, of_text)
                    spans = [
                        _spans(starts, ends, of_text, hit, k, offsets[k]) if n_hit[k] else []
                        for k in range(batch.num_rows)
                    ]
                    named = [sorted(x for x in items.get(k, ()) if x is not None) for k in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id"),
                            pa.array(np.diff(of_text), pa.int64()),
                            pa.array(n_hit, pa.int64()),
                            pa.array(named, pa.list_(pa.string())),
                            pa.array(
                                [[{"start": a, "end": b} for a, b in s] for s in spans],
                                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                            ),
                        ],
                        names=["id", "n_words", "n_hit", "items", "spans"],
                    )

        parts.append((source, find))
    schema = f"id {key_type}, {SCAN_SCHEMA}"
    if len(parts) == 1:
        return parts[0][0].mapInArrow(parts[0][1], schema).withColumnRenamed("id", id_col)
    return _united(source, [f for _, f in parts], schema).withColumnRenamed("id", id_col)


def _united(source: DataFrame, finds: list, schema: str) -> DataFrame:
    """Every block scanned in turn over each batch; hits of a row are united before they leave the task."""

    def find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                found = [pa.Table.from_batches(list(f(iter([batch])))).to_pylist() for f in finds]
                data, offsets = T.flat(batch.column("text"))
                _, starts, ends, of_text = words_of(data, offsets)
                rows = []
                for k, row in enumerate(zip(*found, strict=True)):
                    first, last = of_text[k], of_text[k + 1]
                    hit = np.zeros(last - first, bool)
                    for span in (s for r in row for s in r["spans"]):
                        a = np.searchsorted(starts[first:last] - offsets[k], span["start"])
                        b = np.searchsorted(ends[first:last] - offsets[k], span["end"])
                        hit[a : b + 1] = True
                    spans = _spans(starts[first:last], ends[first:last], [0, last - first], hit, 0, offsets[k])
                    rows.append(
                        row[0]
                        | {
                            "n_hit": int(hit.sum()),
                            "items": sorted(set().union(*(r["items"] for r in row))),
                            "spans": [{"start": a, "end": b} for a, b in spans],
                        }
                    )
                yield from pa.Table.from_pylist(rows, schema=ARROW_SCAN.insert(0, batch.schema.field("id"))).to_batches()

    return source.mapInArrow(find_all, schema)


ARROW_SCAN = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` without contaminated rows, or with the hit spans cut out of their texts (``mode="spans"``).

    Columns and their order stay. Rows without hits, null and empty texts among them, stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    blocks = [
        spark.sparkContext.broadcast(b)
        for b in _blocks(benchmark, item_col, item_text_col, window, max_windows)
    ]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            named = pa.RecordBatch.from_arrays(whole.columns, names=[str(i) for i in range(whole.num_columns)])
            for batch in T.slices(named, str(place)):
                data, offsets = T.flat(batch.column(place))
                hit = None
                for block in blocks:
                    starts, ends, of_text, more, _ = block.value.scan(data, offsets)
                    hit = more if hit is None else hit | more
                n_hit = T.sums_by_text(hit, of_text)
                if mode == "documents":
                    batch = batch.filter(pa.array(n_hit == 0))
                elif n_hit.any():
                    texts = batch.column(place).to_pylist()
                    for k in np.flatnonzero(n_hit).tolist():
                        raw, kept, at = data[offsets[k] : offsets[k + 1]].tobytes(), [], 0
                        for a, b in _spans(starts, ends, of_text, hit, k, offsets[k]):
                            kept.append(raw[at:a])
                            at = b
                        texts[k] = b"".join([*kept, raw[at:]]).decode()
                    batch = batch.set_column(place, str(place), pa.array(texts, batch.column(place).type))
                yield pa.RecordBatch.from_arrays(batch.columns, schema=whole.schema)

    return docs.mapInArrow(clean, docs.schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The checked form of ``scan``: counts, and a digest of the items in string order."""
    return scanned.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
