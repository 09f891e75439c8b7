"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the smallest of its inner s-mers, by hash, is the first or the last. Whether it is depends on
the k-mer alone, not on what stands around it, so the same passage has the same anchors in every text. A fingerprint holds the
``anchors`` smallest distinct anchor hashes of a text with the place of each one's first occurrence, in order of place. A text too short for a k-mer
is an anchor as a whole.

Two texts are compared by the share of the anchors common to both among all of their union. Common anchors count as far as they
stand in the same order in both, so shuffled passages count once. From this share J of overlap to union the likeness is 2J / (1 + J), the overlap to the mean size.
Where only fingerprints are at hand, ``likeness`` estimates J from the smallest anchors of the union.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.sources import shared_dir

K, S, ANCHORS = 16, 8, 48


def syncmers(data: np.ndarray, k: int = K, s: int = S) -> np.ndarray:
    """Places of the closed syncmers of a byte array; text borders inside it are not seen."""
    inner = T.grams(T.running_bytes(data), s)
    width = k - s + 1
    n = len(inner) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, reach = inner, 1  # least of the next ``reach`` s-mers, by doubling
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[width - reach : width - reach + n])
    return np.flatnonzero((least == inner[:n]) | (least == inner[width - 1 : width - 1 + n]))


def all_anchors(texts: list[bytes], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct syncmer hashes of each text in their order, and the place of each one's first occurrence; the empty text has none."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    places = syncmers(data, k, s)
    inside = np.searchsorted(offsets, places, "right") == np.searchsorted(offsets, places + k, "left")
    places = places[inside]
    hashes = T.stretch(T.running_bytes(data), places, places + k)
    edges, out = np.searchsorted(places, offsets), []
    for i, text in enumerate(texts):
        a, b = edges[i], edges[i + 1]
        if a == b:
            whole = [int.from_bytes(hashlib.sha256(text).digest()[:4]) << 32] if text else []
            out.append((np.array(whole, T.U64), np.zeros(len(whole), np.int64)))
            continue
        distinct, first = np.unique(hashes[a:b], return_index=True)
        out.append((distinct, places[a:b][first] - offsets[i]))
    return out


def shown(hashes: np.ndarray, places: np.ndarray, anchors: int = ANCHORS) -> str:
    """The fingerprint of a text with these anchors: 32 bits of the smallest hashes."""
    head = slice(0, anchors + 16)
    short, first = np.unique(hashes[head] >> T.U64(32), return_index=True)
    if len(short) <= anchors:
        head = slice(None)
        short, first = np.unique(hashes >> T.U64(32), return_index=True)
    if not len(short):
        return ""
    places = np.minimum.reduceat(places[head], first)[:anchors]
    order = np.argsort(places)
    return ":".join(f"{h:08x}.{p:x}" for h, p in zip(short[:anchors][order].tolist(), places[order].tolist(), strict=True))


def fingerprints(texts: list[bytes], k: int = K, s: int = S, anchors: int = ANCHORS) -> list[str]:
    """``hash.place`` of each anchor in hexadecimal digits, joined by colons; the empty text has none."""
    return [shown(*found, anchors) for found in all_anchors(texts, k, s)]


def parse(fingerprint: str) -> dict[int, int]:
    """Place by anchor hash, in order of place."""
    return {int(h, 16): int(p, 16) for h, p in (x.split(".") for x in fingerprint.split(":") if x)}


def likeness(a: dict[int, int], b: dict[int, int], anchors: int = ANCHORS) -> float:
    if a.keys() == b.keys():
        return 1.0
    sample = set(sorted(a.keys() | b.keys())[:anchors])
    j = rising([b[h] for h in a if h in sample and h in b]) / len(sample)
    return 2 * j / (1 + j)


def rising(places: list[int]) -> int:
    """Length of the longest rising subsequence."""
    tails: list[int] = []
    for p in places:
        at = bisect_left(tails, p)
        tails[at : at + 1] = [p]
    return len(tails)


def full_likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Likeness of two texts from all of their anchors, as ``all_anchors`` has them; two empty texts are alike."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    places = b[1][at_b][np.argsort(a[1][at_a])]
    in_order = len(common) if (places[1:] > places[:-1]).all() else rising(places.tolist())
    j = in_order / (len(a[0]) + len(b[0]) - len(common))
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judge(rows: list[tuple], following: list[str]) -> list[dict]:
    """Results of ``rows`` (id, text), each with the text that follows it."""
    changed = [edited(t, f) for (_, t), f in zip(rows, following, strict=True)]
    n = len(rows)
    found = all_anchors([t.encode() for t in [t for _, t in rows] + changed + following])
    return [
        {
            "id": rows[i][0],
            "n_chars": len(rows[i][1]),
            "edited_sha256": hashlib.sha256(changed[i].encode()).hexdigest(),
            "fingerprint": shown(*found[i]),
            "edited_fingerprint": shown(*found[n + i]),
            "near_edited": full_likeness(found[i], found[n + i]),
            "near_next": full_likeness(found[i], found[2 * n + i]),
        }
        for i in range(n)
    ]


_RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_ROWS, _BYTES = 200, 1_000_000  # of one step inside a task


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_col: str = "fingerprint") -> DataFrame:
    """One row per row of ``docs``: id and fingerprint. Null texts count as empty ones."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                marks = fingerprints([(t or "").encode() for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.string())], names=["id", "mark"])

    key = source.schema["id"].dataType.simpleString()
    marked = source.mapInArrow(run, f"id {key}, mark string")
    return marked.select(F.col("id").alias(id_col), F.col("mark").alias(fingerprint_col))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of the text to its edited one and to the next, from all anchors.

    The next row is the one that follows by id, after the last the first; rows of one id go by a hash of the text, null ids come
    first, and a row alone follows itself. Null texts count as empty; two empty texts are alike, an empty one is unlike any other.

    Rows are sorted by range, with compressed texts. Each task knows all neighbours but that of its last row, which
    it hands on with its first row: two texts per task, joined by the tasks' numbers.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    key = source.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([zip_(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), packed], names=["id", "tie", "packed"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        held, schema = 0, None

        def result(done: list[dict]) -> pa.RecordBatch:
            fields = [("id", schema.field("id").type), *_FIELDS]
            return pa.RecordBatch.from_pylist(done, schema=pa.schema(fields))

        first = True
        for batch in batches:
            schema = batch.schema
            for id_, packed in zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                text = unzip(packed).decode()
                if first:
                    yield result([{"id": id_, "part": part, "edge": "first", "text": text}])
                    first = False
                rows.append((id_, text))
                held += len(text)
                if len(rows) > _ROWS or (held > _BYTES and len(rows) > 1):
                    yield result(_judge(rows[:-1], [t for _, t in rows[1:]]))
                    rows, held = rows[-1:], len(text)
        if rows:
            if len(rows) > 1:
                yield result(_judge(rows[:-1], [t for _, t in rows[1:]]))
            yield result([{"id": rows[-1][0], "part": part, "edge": "last", "text": rows[-1][1]}])

    tied = source.withColumn("tie", F.xxhash64("text"))
    packed = tied.mapInArrow(pack, f"id {key}, tie long, packed binary")
    ordered = packed.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    judged = ordered.mapInArrow(judge, f"id {key}, {_RESULT}, part int, edge string, text string")
    path = f"{shared_dir(spark)}/fingerprints-{uuid4().hex}"
    judged.write.parquet(path)
    judged = spark.read.parquet(path)
    edges = judged.filter(F.col("edge").isNotNull()).select("id", "part", "edge", "text")
    parts = sorted(r.part for r in edges.filter(F.col("edge") == "first").select("part").collect())  # one number per task
    links = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    lasts = edges.filter(F.col("edge") == "last").select("id", "part", "text").join(links, "part")
    firsts = edges.filter(F.col("edge") == "first").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))

    def judge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fields = [("id", batch.schema.field("id").type), *_FIELDS[:-3]]
                done = _judge([(row["id"], row["text"])], [row["next_text"]])
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema(fields))

    pairs = lasts.join(firsts, "next_part").select("id", "text", "next_text")
    across = pairs.mapInArrow(judge_edges, f"id {key}, {_RESULT}")
    inside = judged.filter(F.col("edge").isNull()).drop("part", "edge", "text")
    return inside.unionByName(across).withColumnRenamed("id", id_col)


_FIELDS = [
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
    ("part", pa.int32()),
    ("edge", pa.string()),
    ("text", pa.string()),
]
