"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.brute import sha
from llm.conftest import by_row, in_order
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskmart.llm import bpe, pack, text, token_counts
from riskmart.llm.pretokens import pretokens
from riskmart.llm.transducer import Transducer, Vocabulary

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(docs, rows, no_docs):
    counted = token_counts.token_counts(docs, JSON)
    tokenizer = Tokenizer.from_file(JSON)
    want = []
    for doc, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((doc, len((t or "").encode()), n, n > 1024))
    assert by_row(counted, "doc_id", "n_bytes", "n_tokens", "over_limit") == in_order(want)
    assert token_counts.token_counts(no_docs, JSON).count() == 0


PIECES = ["'s", "'ll", "'", "a", "B", "é", " ", "  ", "\n", "\t", "1", "٣", "!", "日", "😀", "'ve", "\u3000", "the", "ing"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), min_size=1, max_size=8), st.integers(1, 40))
def test_transducer_on_any_chunks(texts, chunk):
    data, offsets = text.flat(text.pa.array(texts, text.pa.string()))
    want = [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts]
    assert TRANSDUCER.counts(data, offsets, chunk).tolist() == want


with open(JSON, encoding="utf-8") as _file:
    TRANSDUCER = Transducer(Vocabulary(_file.read()))
TOKENIZER = Tokenizer.from_file(JSON)


def test_a_full_table_is_compiled_anew(monkeypatch):
    own = Transducer(TRANSDUCER.vocabulary)
    monkeypatch.setattr("riskmart.llm.transducer.MAX_STATES", 10)
    for t in ("a longer sentence than that", "another one, of other words"):
        data, offsets = text.flat(text.pa.array([t], text.pa.string()))
        assert own.counts(data, offsets).tolist() == [len(TOKENIZER.encode(t).ids)]


def test_pretokens_lie_without_gaps():
    data, offsets = text.flat(text.pa.array(["a  b", "", None, "c's"], text.pa.string()))
    starts, of_text = pretokens(data, offsets)
    assert starts.tolist() == [0, 1, 2, 4, 5] and of_text.tolist() == [0, 3, 3, 3, 5]


def test_ids_are_the_librarys_and_decode_to_the_texts(docs, rows, library, no_docs):
    encoded = bpe.encode(docs, RANKS, chunk_bytes=5000)
    want = []
    for doc, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((doc, len(ids) // 4, sha(ids), sha((t or "").encode())))
    assert by_row(bpe.digest(encoded, RANKS)) == in_order(want)
    columns = ("doc_id", (F.octet_length("ids") / 4).cast("int"), F.sha2("ids", 256), F.sha2("decoded", 256))
    assert by_row(bpe.decode(encoded, RANKS).select(*columns)) == in_order(want)
    assert bpe.encode(no_docs, RANKS).count() == 0


def test_an_input_that_changes_between_the_passes_is_an_error(docs):
    def change(batches):
        for batch in batches:
            texts = [f"{t} {os.urandom(4).hex()}" for t in batch.column("text").to_pylist()]
            yield text.pa.RecordBatch.from_arrays([batch.column("doc_id"), text.pa.array(texts)], names=["doc_id", "text"])

    moving = docs.select("doc_id", "text").mapInArrow(change, "doc_id long, text string")
    with pytest.raises(Exception, match="other chunks"):
        bpe.encode(moving, RANKS).collect()


def test_packed_rows_hold_every_token_once(docs, rows, library, no_docs):
    packed = pack.pack(docs, RANKS, row_tokens=64, block_tokens=4000).cache()
    for r in packed.collect():
        assert r.n_tokens == r.cu_seqlens[-1] <= 64 and len(r.ids) == 128
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.position_resets)
        assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :]) <= {0}
    pieces = {}
    for s in pack.unpack(packed, 64).collect():
        pieces.setdefault(s.doc_id, []).append((s.doc_offset, s.ids))
    want = {}
    for doc, t in rows:
        if t:
            ids = np.array(library.encode_ordinary(t), "<u2").tobytes()
            want.setdefault(doc, []).extend((a // 2, ids[a : a + 128]) for a in range(0, len(ids), 128))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    assert pack.pack(no_docs, RANKS).count() == 0
    full = packed.agg(F.sum("n_tokens") / (64 * F.count(F.lit(1)))).first()[0]
    assert full > 0.95


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_decreasing(lengths):
    rows, plain = pack.best_fit_decreasing(np.array(lengths, np.int64), 30), []
    for size in sorted(lengths, reverse=True):  # the same with a plain search
        fitting = [r for r in plain if sum(r) + size <= 30]
        (max(fitting, key=sum) if fitting else plain.append([]) or plain[-1]).append(size)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(sum(lengths[i] for i in r) for r in rows) == sorted(map(sum, plain))
