"""Quality classifier by supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words and the character n-grams of its words, each
hashed to a bucket with a learned vector. A document is the mean of its features' vectors; a linear layer and a
softmax over the two classes follow. Vectors and layer are trained together by numpy stochastic gradient
descent on a bounded sample of labelled rows. A pair of equal words counts as one feature whatever the word, so that texts that
repeat one word are told from others.

Scores are linear in the mean, so fitted vectors are folded into one number per bucket: the difference of the class
logits. Scoring then is one pass over the documents, without a shuffle; the broadcast model has ``buckets`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskmart.llm import text as T

U64 = np.uint64
#: An Arrow slice with its features; smaller than elsewhere, since a byte gives several features.
SLICE_BYTES = 500_000


@dataclass(frozen=True)
class Settings:
    """``max_rows`` labelled rows are the bounded sample to learn from."""

    max_rows: int = 2000
    buckets: int = 1 << 17
    dimensions: int = 8
    char_grams: tuple[int, ...] = (3, 4)
    steps: int = 12_000
    rate: float = 0.6
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature and the text that it belongs to."""
    starts, ends, of_text = T.word_spans(data, offsets, T.NOT_SPACE)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = T.owners(of_text)
    sums = T.running_bytes(data)
    words = T.stretch(sums, starts, ends)
    same = text[1:] == text[:-1]
    pairs = np.where(words[1:] == words[:-1], U64(1), T.mix(words[:-1] * U64(3) + words[1:]))[same]
    parts, owner = [words, pairs], [text, text[1:][same]]
    of_byte = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.flatnonzero(T.NOT_SPACE[data])  # the bytes of words, as many as of_byte
    for n in settings.char_grams:
        whole = at + n <= ends[of_byte]
        parts.append(T.stretch(sums, at[whole], at[whole] + n) + U64(n))
        owner.append(text[of_byte[whole]])
    return (np.concatenate(parts) % U64(settings.buckets)).astype(np.int64), np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    """One weight per bucket, and the bias: their mean plus the bias is the logit of class 1."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        bucket, owner = features(data, offsets, self.settings)
        total = np.bincount(owner, self.weights[bucket], n)
        mean = total / np.maximum(np.bincount(owner, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def train(texts: list[str | None], classes: list[int], settings: Settings) -> Model:
    """Gradient descent over one text at a time, with a rate falling to zero.

    With one class only, every score leans to that class; without rows it is one half.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.dimensions)) / settings.dimensions
    layer = np.zeros((settings.dimensions, 2))
    bias = np.zeros(2)
    samples = []
    for text in texts:
        data, offsets = T.flat(pa.array([text], pa.string()))
        bucket, count = np.unique(features(data, offsets, settings)[0], return_counts=True)
        samples.append((bucket.astype(np.int32), (count / max(count.sum(), 1)).astype(np.float32)))
    rounds = -(-settings.steps // len(samples)) if samples else 0
    order = [k for _ in range(rounds) for k in rng.permutation(len(samples))]
    for done, k in enumerate(order):
        bucket, share = samples[k]
        rate = settings.rate * (1 - done / len(order))
        mean = share @ vectors[bucket]
        logits = mean @ layer + bias
        p = np.exp(logits - logits.max())
        error = p / p.sum()
        error[classes[k]] -= 1
        back = layer @ error
        layer -= rate * np.outer(mean, error)
        bias -= rate * 0.1 * error
        # shares are small: a step is scaled so that it moves the text's mean by a share of the rate
        vectors[bucket] -= rate * np.outer(share / max(float(share @ share), 1e-9) * 0.05, back)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]), settings)


def is_held_out(id_col: str):
    """Rows never learned from: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled(
    docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str
) -> list:
    """The sample: the rows with the lowest hashes of their ids that have a label and are not held out.

    An id with several labels counts with the lowest one; labels that are not 0 or 1 and null ids are left out.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
        .filter(~is_held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    # twice as many ids as rows are wanted, since some labels may have no document
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = known.orderBy(order, "id").limit(2 * settings.max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "id")  # at most 2 * max_rows ids
        .orderBy(order, "id", "text")
        .limit(settings.max_rows)
        .collect()
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    settings = settings or Settings()
    rows = labelled(docs, labels, settings, id_col, text_col, label_col)
    return train([r.text for r in rows], [r.label for r in rows], settings)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of class 1.

    Texts are scored whole. Null and empty texts, and those of white space only, get the score of the bias alone. Other
    columns, whatever their names, are carried along; only ``text_col`` decides.
    """
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            named = pa.RecordBatch.from_arrays(whole.columns, names=[str(i) for i in range(whole.num_columns)])
            for batch in T.slices(named, str(place), SLICE_BYTES):
                scores = pa.array(shared.value.scores(*T.flat(batch.column(place))), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, scores], schema=whole.schema.append(pa.field(score_col, pa.float64()))
                )

    if score_col in docs.columns:
        raise ValueError(f"the documents have a column {score_col} already")
    return docs.mapInArrow(T.released(run), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with their columns as they are."""
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            named = pa.RecordBatch.from_arrays(whole.columns, names=[str(i) for i in range(whole.num_columns)])
            for batch in T.slices(named, str(place), SLICE_BYTES):
                good = shared.value.scores(*T.flat(batch.column(place))) >= threshold
                batch = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(batch.columns, schema=whole.schema)

    return docs.mapInArrow(T.released(run), docs.schema)
