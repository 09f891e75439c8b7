"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

Every string of ``length`` bytes that starts at two places counts as repeated; matches never cross documents. In suffix order, equal beginnings are neighbours. For a suffix,
the nearest suffixes above and below that start earlier in the corpus (previous and next smaller positions) give its longest earlier match, so a later
copy is told from the first one; the same with positions from behind tells whether a string has a later copy.

One suffix array of the whole corpus would not fit a machine, so suffixes are dealt by content. The anchor of a string is its 32-byte gram of smallest hash; equal
strings have equal anchors at the same place. Neighbouring strings share anchors, so a run of them, a stretch of at most ``2 * length - 32`` bytes, is handled as one.

1. Each chunk of documents sends its distinct stretches as (anchor, stretch) hashes and learns which anchors and which stretches occur elsewhere.
   Most stretches are done here: their anchor occurs once, or their whole text does elsewhere.
2. A stretch whose anchor also occurs in another stretch is sent with its text. The suffixes of such stretches are ordered per route of anchors;
   a frequent anchor is spread over several routes, each of which takes a share of the suffixes by hash.
3. Each chunk covers the bytes of the strings found, and cuts them.

Chunks are named by digest; documents travel compressed, beside their chunk's answers. A copy costs a route one entry per chunk, however often it occurs there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.bpe import gather, pack, unpack
from riskmart.llm.components import store
from riskmart.operators.running import totals_before

U64 = np.uint64
LENGTH = 200
GRAM = 32
CHUNK_BYTES = 6_000_000
#: Routes of stretches with texts per shuffle partition; more of them make the groups that a task orders smaller.
TEXT_ROUTES = 4
#: Stretches of one anchor that one route takes.
ANCHOR_STRETCHES = 20_000
COPIED, MIXED, FIRST = 1, 2, 4
_PLACE_BITS = 24


def anchors(grams: np.ndarray, n: int, width: int, bits: int = _PLACE_BITS) -> np.ndarray:
    """Place of the first gram of smallest hash among the ``width`` grams from each of ``n`` places.

    Hashes are compared by all but their last ``bits`` bits, which hold the place. A longer input is gone through in pieces that have room for theirs, so the
    choice does not depend on a text's size or position.
    """
    found, step = np.empty(n, np.int64), (1 << bits) - width
    for first in range(0, n, step):
        m = min(step, n - first)
        part = grams[first : first + m + width - 1]
        least, reach = (part >> U64(bits) << U64(bits)) | np.arange(len(part), dtype=U64), 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:m], least[width - reach : width - reach + m])
        found[first : first + m] = (least & U64((1 << bits) - 1)).astype(np.int64) + first
    return found


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of ``length``-byte strings with one anchor: text, first string, number of strings, hash of anchor and of the run's bytes.

    An anchor's own hash is the least of many, so nearly all of them are small; it is mixed once more, for ranges of it to be equal shares.
    """
    empty = {k: np.empty(0, np.int64) for k in ("text", "start", "count")}
    if len(data) < length:
        return empty | {k: np.empty(0, U64) for k in ("anchor", "name")}
    sums = T.running_bytes(data)
    grams = T.grams(sums, GRAM)
    n = len(data) - length + 1
    anchor = anchors(grams, n, length - GRAM + 1)
    sizes = np.diff(offsets)
    inside = np.zeros(n + 1, np.int8)  # strings that lie in one text
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    begin = np.zeros(n, bool)
    begin[offsets[:-1][long]] = True
    begin[1:] |= anchor[1:] != anchor[:-1]
    begin[1:] |= valid[1:] & ~valid[:-1]
    start = np.flatnonzero(begin & valid)
    if not len(start):
        return empty | {k: np.empty(0, U64) for k in ("anchor", "name")}
    text = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), offsets[text + 1] - length + 1)
    name = T.stretch(sums, start, end - 1 + length)
    return {"text": text, "start": start - offsets[text], "count": end - start, "anchor": T.mix(grams[anchor[start]]), "name": name}


class Chunk:
    """Documents of a chunk and, on demand, their stretches."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []
        self.size = self.n = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(T.own_copy(batch))
        self.size += len(T.flat(batch.column("_text"))[0])
        self.n += batch.num_rows

    def name(self) -> bytes:
        digest = hashlib.sha256()
        for batch in self.batches:
            data, offsets = T.flat(batch.column("_text"))
            digest.update(offsets.tobytes())
            digest.update(data.tobytes())
            digest.update(batch.column("_order").to_numpy().tobytes())
        return digest.digest()[:16]

    def rows(self) -> bytes:
        with pa.BufferOutputStream() as sink:
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, self.batches[0].schema, options=options) as writer:
                for batch in self.batches:
                    writer.write_batch(batch)
            return sink.getvalue().to_pybytes()


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    chunk = Chunk()
    for whole in batches:
        for batch in T.slices(whole, "_text"):
            chunk.add(batch)
            if chunk.size >= size or chunk.n >= 100_000:
                full, chunk = chunk, Chunk()
                yield full
                del full
    if chunk.n:
        yield chunk


class Stretches:
    """The stretches of a chunk in order of place, and its distinct ones in order of (anchor, name)."""

    def __init__(self, batches: list[pa.RecordBatch], length: int):
        parts, row = [], 0
        order = []
        for batch in batches:
            found = stretches(*T.flat(batch.column("_text")), length)
            order.append(batch.column("_order").to_numpy()[found["text"]])
            found["text"] = found["text"] + row
            row += batch.num_rows
            parts.append(found)
        for key in ("text", "start", "count", "anchor", "name"):
            setattr(self, key, np.concatenate([p[key] for p in parts]))
        self.order = np.concatenate(order)
        # first by place within the chunk, so that the first of equal ones is the earliest
        by_place = np.lexsort((self.start, self.text, self.order))
        rank = np.lexsort((np.argsort(by_place), self.name, self.anchor))
        new = np.ones(len(rank), bool)
        new[1:] = (self.anchor[rank[1:]] != self.anchor[rank[:-1]]) | (self.name[rank[1:]] != self.name[rank[:-1]])
        self.first = rank[new]
        self.of = np.empty(len(rank), np.int64)
        self.of[rank] = np.cumsum(new) - 1
        self.copies = np.bincount(self.of, minlength=len(self.first))


_PACKED = pa.schema([("route", pa.int64()), ("chunk", pa.binary()), *((c, pa.binary()) for c in "abcdef")])
_PACKED_DDL = "route long, chunk binary, a binary, b binary, c binary, d binary, e binary, f binary"


def _packed(*row) -> pa.RecordBatch:
    row = (*row, *[None] * (len(_PACKED) - len(row)))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED, strict=True)], schema=_PACKED)


def _no_rows() -> pa.Table:
    return _PACKED.empty_table()


def _route_edges(anchors: np.ndarray, routes: int) -> np.ndarray:
    limits = np.array([(r << 64) // routes for r in range(1, routes)], U64)
    return np.concatenate([[0], np.searchsorted(anchors, limits), [len(anchors)]])


def _ask(batches: Iterator[pa.RecordBatch], routes: int, size: int, length: int) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, size):
        found, name = Stretches(chunk.batches, length), chunk.name()
        anchor = found.anchor[found.first]
        edges = _route_edges(anchor, routes)
        for r in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[r], edges[r + 1])
            own = found.first[part]
            copies = np.minimum(found.copies[part], 2).astype(np.uint8)
            yield _packed(
                r, name, pack(anchor[part]), pack(found.name[own]), pack(copies), pack(found.order[own].astype(np.int64))
            )
        del found, chunk  # before the next chunk is read
        T.release()


def _answer(asked: pa.Table) -> pa.Table:
    """What each chunk needs to know of its stretches: flags, and over how many routes the anchor is spread."""
    T.release()
    chunk = asked["chunk"].to_pylist()
    parts = [[unpack(asked[c][i].as_py(), t) for i in range(len(chunk))] for c, t in zip("abcd", (U64, U64, np.uint8, np.int64), strict=True)]
    sizes = [len(x) for x in parts[0]]
    anchor, name, copies, order = (np.concatenate(p) for p in parts)
    tie = np.repeat(np.argsort(np.argsort(chunk)), sizes)  # chunks in the order of their names
    rank = np.lexsort((tie, order, name, anchor))
    new_anchor, new = np.ones(len(rank), bool), np.ones(len(rank), bool)
    new_anchor[1:] = anchor[rank[1:]] != anchor[rank[:-1]]
    new[1:] = new_anchor[1:] | (name[rank[1:]] != name[rank[:-1]])
    group = np.cumsum(new) - 1
    total = np.bincount(group, copies[rank])
    distinct = np.bincount((np.cumsum(new_anchor) - 1)[new])[np.cumsum(new_anchor) - 1]
    flags = np.empty(len(rank), np.uint8)
    flags[rank] = COPIED * (total[group] > 1) + MIXED * (distinct > 1) + FIRST * new
    spread = np.empty(len(rank), np.uint32)
    spread[rank] = -(-distinct // ANCHOR_STRETCHES)
    ends, out = np.cumsum(sizes), []
    for i, c in enumerate(chunk):
        part = slice(ends[i] - sizes[i], ends[i])
        out.append(_packed(asked["route"][i].as_py(), c, pack(flags[part]), pack(spread[part])))
    return pa.Table.from_batches(out)


def _hold(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, size):
        held = _packed(0, chunk.name(), chunk.rows())
        del chunk
        yield held
        del held
        T.release()


def _read(blob: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(blob))


def _chunk_flags(answers: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags and spread of a chunk's distinct stretches. Chunks of equal content are answered each; the first of them may be any."""
    flags, spread = {}, {}
    for i, route in enumerate(answers["route"].to_pylist()):
        found = unpack(answers["a"][i].as_py(), np.uint8)
        flags[route] = flags[route] | found if route in flags else found
        spread[route] = unpack(answers["b"][i].as_py(), np.uint32)
    order = sorted(flags)
    all_flags = np.concatenate([np.empty(0, np.uint8), *(flags[r] for r in order)])
    if len(all_flags) != n:
        raise ValueError("the input was read in other chunks the second time; store it first")
    return all_flags, np.concatenate([np.empty(0, np.uint32), *(spread[r] for r in order)])


def _send_texts(held: pa.Table, answers: pa.Table, routes: int, length: int) -> pa.Table:
    """The chunk with its flags, and the texts of its mixed stretches by route."""
    T.release()
    out = []
    for i in range(min(held.num_rows, 1)):  # chunks with one name are equal; each row is kept below
        batches = _read(held["a"][i].as_py())
        found = Stretches(batches, length)
        flags, spread = _chunk_flags(answers, len(found.first))
        for j in range(held.num_rows):  # of equal chunks only one has first copies
            own_flags = flags if j == 0 else flags & np.uint8(255 - FIRST)
            out.append(_packed(-1, held["chunk"][j].as_py(), held["a"][j].as_py(), pack(own_flags)))
        mixed = np.flatnonzero(flags & MIXED)
        own = found.first[mixed]
        data, offsets, row = [], [], 0
        for batch in batches:
            d, o = T.flat(batch.column("_text"))
            data.append(d)
            offsets.append(o[:-1] + row)
            row += len(d)
        data, offsets = np.concatenate(data), np.concatenate(offsets)
        begin, size = offsets[found.text[own]] + found.start[own], found.count[own] + length - 1
        entry = np.repeat(np.arange(len(mixed)), spread[mixed])
        salt = np.arange(len(entry)) - np.repeat(np.cumsum(spread[mixed]) - spread[mixed], spread[mixed])
        route = (T.mix(found.anchor[own][entry] + salt.astype(U64)) % U64(routes)).astype(np.int64)
        for r in np.unique(route).tolist():
            at = np.flatnonzero(route == r)
            e = entry[at]
            zipped = zstandard.ZstdCompressor(level=1).compress(gather(data, begin[e], size[e]).tobytes())
            salts = np.stack([salt[at], spread[mixed][e]], axis=1).astype(np.uint32).reshape(-1)
            where = np.stack([found.order[own][e], found.text[own][e], found.start[own][e]], axis=1).astype(np.int64).reshape(-1)
            out.append(
                _packed(
                    r, held["chunk"][0].as_py(), zipped, pack(size[e].astype(np.uint32)), pack(mixed[e].astype(np.uint32)),
                    pack(found.name[own][e]), pack(salts), pack(where),
                )
            )
    return pa.Table.from_batches(out) if out else _no_rows()


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, or -1; by pointer jumping."""
    at = np.arange(-1, len(values) - 1)
    while True:
        go = np.flatnonzero(at >= 0)
        go = go[values[at[go]] >= values[go]]
        if not len(go):
            return at
        at[go] = at[at[go]]


def longest_previous(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether each suffix has an earlier one among those that share its beginning.

    ``position`` is by suffix order, ``common[i]`` tells whether suffix i begins like suffix i - 1. The longest earlier match of a suffix is with
    its previous or next smaller position, so it is long enough if one of the two lies in the same run of common beginnings.
    """
    run = np.cumsum(~common)
    before = previous_smaller(position)
    after = len(position) - 1 - previous_smaller(position[::-1])[::-1]
    found = (before >= 0) & (run[before] == run)
    inside = after < len(position)
    found[inside] |= run[after[inside]] == run[inside]
    return found


def _resolve(texts: pa.Table, length: int, earlier_only: bool) -> pa.Table:
    """For each mixed stretch of one route, the strings of it that occur in another one too (or earlier)."""
    T.release()
    names = texts["chunk"].to_pylist()
    types = {"b": np.uint32, "c": np.uint32, "d": U64, "e": np.uint32, "f": np.int64}
    columns = {c: [unpack(x.as_py(), t) for x in texts[c]] for c, t in types.items()}
    n_of = [len(x) for x in columns["b"]]
    size, entry, name = (np.concatenate(columns[c]) for c in "bcd")
    salt, where = np.concatenate(columns["e"]).reshape(-1, 2), np.concatenate(columns["f"]).reshape(-1, 3)
    chunk = np.repeat(np.argsort(np.argsort(names)), n_of)
    # One stretch stands for all of its name and salt: the earliest.
    rank = np.lexsort((where[:, 2], where[:, 1], chunk, where[:, 0], salt[:, 0], name))
    new = np.ones(len(rank), bool)
    new[1:] = (name[rank[1:]] != name[rank[:-1]]) | (salt[rank[1:], 0] != salt[rank[:-1], 0])
    chosen = np.sort(rank[new])
    place = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8) for x in texts["a"]])
    sums = T.running_bytes(data)
    count = size[chosen].astype(np.int64) - (length - 1)
    owner = np.repeat(np.arange(len(chosen), dtype=np.int32), count)
    inner = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    begin = place[chosen][owner] + inner
    hashes = T.stretch(sums, begin, begin + length)
    del sums
    keep = hashes % salt[chosen, 1].astype(U64)[owner] == salt[chosen, 0].astype(U64)[owner]
    by_hash = np.sort(hashes)
    same = by_hash[1:][by_hash[1:] == by_hash[:-1]]
    if len(same):  # a string that occurs once ends no search
        keep &= same[np.minimum(np.searchsorted(same, hashes), len(same) - 1)] == hashes
    else:
        keep[:] = False
    owner, inner, begin, hashes = owner[keep], inner[keep], begin[keep], hashes[keep]
    head = np.zeros(len(begin), U64)
    for i in range(8):  # first eight bytes in their order, then the string as a whole
        head = (head << U64(8)) | data[begin + i].astype(U64)
    who = chosen[owner]
    at = np.lexsort((where[who, 2] + inner, where[who, 1], chunk[who], where[who, 0]))
    position = np.empty(len(at), np.int64)
    position[at] = np.arange(len(at))
    suffix = np.lexsort((position, hashes, head))
    common = np.zeros(len(suffix), bool)
    common[1:] = hashes[suffix[1:]] == hashes[suffix[:-1]]
    repeated = longest_previous(position[suffix], common)
    if not earlier_only:  # the same with positions from behind: a later match
        repeated |= longest_previous(len(position) - 1 - position[suffix], common)
    hit = suffix[repeated]
    flags = np.zeros(int(place[-1]), bool)  # by first byte of the string
    flags[begin[hit]] = True
    chosen_of = np.empty(len(rank), np.int64)
    chosen_of[rank] = rank[new][np.cumsum(new) - 1]
    out, first = [], 0
    for i, n in enumerate(n_of):
        own = np.arange(first, first + n)
        first += n
        count_i = size[own].astype(np.int64) - (length - 1)
        found = flags[gather_index(place[chosen_of[own]], count_i)]
        out.append(_packed(texts["route"][i].as_py(), names[i], pack(entry[own]), pack(count_i.astype(np.uint32)), pack(np.packbits(found))))
    return pa.Table.from_batches(out)


def gather_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _covered(held: pa.Table, answers: pa.Table, length: int, earlier_only: bool):
    """Of each batch of the chunk: its rows, bytes, offsets, and whether each byte is covered."""
    T.release()
    for i in range(held.num_rows):
        batches = _read(held["a"][i].as_py())
        found = Stretches(batches, length)
        flags = unpack(held["b"][i].as_py(), np.uint8)
        all_of = (flags & COPIED) > 0  # of the distinct stretches, those whose strings are all repeated
        place = np.concatenate([[0], np.cumsum(found.count[found.first])])
        some = np.zeros(int(place[-1]), bool)
        for j in range(answers.num_rows):
            entry = unpack(answers["a"][j].as_py(), np.uint32).astype(np.int64)
            count = unpack(answers["b"][j].as_py(), np.uint32).astype(np.int64)
            bits = np.unpackbits(unpack(answers["c"][j].as_py(), np.uint8), count=int(count.sum())).astype(bool)
            some[gather_index(place[entry], count)[bits]] = True
        whole = all_of[found.of]
        if earlier_only:  # the first of its kind keeps what has no earlier copy in another stretch
            first = np.zeros(len(found.of), bool)
            first[found.first] = (flags & FIRST) > 0
            whole = ~first
        row = 0
        for batch in batches:
            data, offsets = T.flat(batch.column("_text"))
            lo, hi = np.searchsorted(found.text, [row, row + batch.num_rows])
            count = found.count[lo:hi]
            repeated = some[gather_index(place[found.of[lo:hi]], count)] | np.repeat(whole[lo:hi], count)
            begin = gather_index(offsets[found.text[lo:hi] - row] + found.start[lo:hi], count)[repeated]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + length, -1)
            yield batch, data, offsets, np.cumsum(change[:-1]) > 0
            row += batch.num_rows


def _spans(covered: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Maximal covered runs of each text, relative to its first byte."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].view(np.int8), [0]])))
        yield edges.reshape(-1, 2)


def _prepared(docs: DataFrame, id_col: str, text_col: str, others: list[str], earlier_only: bool) -> DataFrame:
    """Order, text and other columns by number. Whole ids are their own order; others are ranked by a range sort where the first copy counts."""
    names = {text_col: "_text"} | {c: f"_{i}" for i, c in enumerate(others)}
    numbered = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(names[c]) for c in others))
    own_id, last = F.col(names[id_col]), F.lit((1 << 63) - 1)
    kind = docs.schema[id_col].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        order = F.coalesce(own_id.cast("long"), last)
    elif not earlier_only:
        order = F.coalesce(F.xxhash64(own_id), last)
    else:
        ids = numbered.select(own_id.alias("_id")).filter("_id is not null").distinct().withColumn("_one", F.lit(1).cast("long"))
        ranks = totals_before(ids, [F.asc("_id")], ["_one"]).select("_id", F.col("_one_before").alias("_rank"))
        numbered = numbered.join(ranks, own_id == F.col("_id"), "left")
        order = F.coalesce("_rank", last)
    return numbered.select(order.alias("_order"), "_text", *(names[c] for c in others))


def _resolved(source: DataFrame, length: int, earlier_only: bool, chunk_bytes: int):
    routes = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = source.mapInArrow(T.released(lambda b: _ask(b, routes, chunk_bytes, length)), _PACKED_DDL)
    answers = asked.groupBy("route").applyInArrow(T.released_group(_answer), _PACKED_DDL)
    held = source.mapInArrow(T.released(lambda b: _hold(b, chunk_bytes)), _PACKED_DDL)
    sent = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        T.released_cogroup(lambda h, a: _send_texts(h, a, TEXT_ROUTES * routes, length)), _PACKED_DDL
    )
    sent = store(sent, "stretches")
    texts = sent.filter("route >= 0").groupBy("route")
    found = texts.applyInArrow(T.released_group(lambda t: _resolve(t, length, earlier_only)), _PACKED_DDL)
    return sent.filter("route < 0").groupBy("chunk").cogroup(found.groupBy("chunk"))


def repeated_spans(
    docs: DataFrame,
    keep: str = "none",
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (maximal runs of bytes to remove) and ``kept``, the other bytes.

    ``keep="none"`` covers every string of ``length`` bytes that also starts anywhere else; ``keep="first"`` leaves the first copy, by id, then place. What is
    repeated is judged on the input. Null and empty texts have no bytes; texts shorter than ``length`` have no spans. Rows
    that repeat an id or a whole row are places of their own. Other columns are ignored.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    key = docs.schema[id_col].dataType.simpleString()
    earlier_only = keep == "first"
    source = _prepared(docs, id_col, text_col, [id_col], earlier_only)

    def cut(held: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for batch, data, offsets, covered in _covered(held, answers, length, earlier_only):
            edges = np.concatenate([[0], np.cumsum(~covered)])[offsets]
            kept = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[~covered])]
            )
            spans = [[{"start": int(a), "end": int(b)} for a, b in s] for s in _spans(covered, offsets)]
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            out.append(
                pa.RecordBatch.from_arrays(
                    [batch.column("_0"), pa.array(np.diff(offsets)), spans, kept], names=["id", "n_bytes", "spans", "kept"]
                )
            )
        return pa.Table.from_batches(out) if out else None

    schema = f"id {key}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    grouped = _resolved(source, length, earlier_only, chunk_bytes)
    return grouped.applyInArrow(T.released_cogroup(cut), schema).withColumnRenamed("id", id_col)


def remove_repeats(
    docs: DataFrame,
    keep: str = "first",
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``docs`` with the repeated strings cut out of the texts; columns and rows stay, null texts stay null.

    Characters of which only some bytes are covered are kept whole, so texts stay valid.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    others = [c for c in docs.columns if c != text_col]
    earlier_only = keep == "first"
    source = _prepared(docs, id_col, text_col, others, earlier_only)

    def cut(held: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for batch, data, offsets, covered in _covered(held, answers, length, earlier_only):
            if covered.any():
                # a character goes if all of its bytes do
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                full = np.minimum.reduceat(covered.view(np.int8), lead) > 0
                covered = np.repeat(full, np.diff(np.append(lead, len(data))))
                edges = np.concatenate([[0], np.cumsum(~covered)])[offsets]
                text = pa.Array.from_buffers(
                    pa.string(), batch.num_rows, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[~covered])]
                )
                text = pa.compute.if_else(batch.column("_text").is_null(), None, text)
            else:
                text = batch.column("_text").cast(pa.string())
            columns = [batch.column(f"_{i}") for i in range(len(others))]
            out.append(pa.RecordBatch.from_arrays([text, *columns], names=["_text", *(f"_{i}" for i in range(len(others)))]))
        return pa.Table.from_batches(out) if out else None

    ddl = ", ".join(["_text string", *(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))])
    cut_rows = _resolved(source, length, earlier_only, chunk_bytes).applyInArrow(T.released_cogroup(cut), ddl)
    names = {text_col: "_text"} | {c: f"_{i}" for i, c in enumerate(others)}
    return cut_rows.select(*(F.col(names[c]).alias(c) for c in docs.columns))
