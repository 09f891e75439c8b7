"""Token counts of whole texts by a compiled transducer, without making the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.transducer import Transducer, Vocabulary


@lru_cache(maxsize=1)
def compiled(tokenizer_json: str) -> Transducer:
    """Kept by the Python worker from task to task."""
    return Transducer(Vocabulary(tokenizer_json))


def count_batch(batch: pa.RecordBatch, column: str, transducer: Transducer) -> np.ndarray:
    """Tokens of each row's text. An added token's own text counts one and splits what lies around it."""
    data, offsets = T.flat(batch.column(column))
    added = transducer.vocabulary.added
    whole = data.tobytes() if added else b""
    if not any(a in whole for a in added):
        return transducer.counts(data, offsets)
    split = re.compile(b"|".join(re.escape(a) for a in added))
    edges, extra = [], np.zeros(len(offsets) - 1, np.int64)
    pieces, owner = [], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = split.split(whole[a:b])
        extra[k] = len(parts) - 1
        pieces += parts
        owner += [k] * len(parts)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    counts = transducer.counts(np.frombuffer(b"".join(pieces), np.uint8), edges)
    np.add.at(extra, owner, counts)
    return extra


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, bytes, tokens, and whether the tokens exceed ``limit``.

    Null and empty texts have no bytes and no tokens. Ids are only carried along, so they may repeat or be null; other
    columns are ignored. The vocabulary file is read by the driver and broadcast; its size is that of the file.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(vocabulary.value)
        for whole in batches:
            for batch in T.slices(whole, "text"):
                n_bytes = np.diff(T.flat(batch.column("text"))[1])
                n_tokens = count_batch(batch, "text", transducer)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(x) for x in (n_bytes, n_tokens, n_tokens > limit))],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    key = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"id {key}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
