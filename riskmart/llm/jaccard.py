"""N-gram Jaccard join by vertical partitioning.

A document is the set of its 5-word shingles, as 48-bit hashes; equal sets are one class from the start. Two classes link when their Jaccard similarity
reaches 0.75.

*Counts.* The hash order of all shingles is cut into fragments. Each chunk of documents sends a fragment its distinct shingles with their counts, packed, and learns their
document frequencies. A class can only link if at least 75 % of its shingles occur in other documents too; the others are done here, and
of the rest only the shared shingles go on.

*Candidates.* Shingles are ordered by frequency, then hash. Linked sets share a shingle of their prefixes in this order, so the documents of a block, those with
the same prefix shingle, are candidates. A shingle's place in the order bounds the overlap, which excludes most pairs.

*Components.* Not all candidates are needed for them: in each of ``ROUNDS`` rounds a class meets only one hub of each of its blocks, and pairs
inside one component are skipped as their outcome can't change any component. What then remains between different components of a block is compared in full, so the
components are exact, while a group of n near copies costs about n comparisons a round. The sets of the candidates are cut into fragments again; fragments of a pair
meet by hub, partial overlaps are counted per fragment, and summed per pair. A hub with many partners is salted. ``components_only`` ends here.

*Links.* Linked classes are in one component, so all links are found by counting every pair of classes inside each component whose sizes allow a link. Its
classes are dealt by size into bands and by hash into tiles. Two tiles meet once per fragment and give a matrix of partial overlaps, and the matrices are summed
over the fragments. Links stay packed, one row per two tiles, until they are counted or listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from riskmart.llm import text as T
from riskmart.llm.bpe import pack, unpack
from riskmart.llm.components import components, store

U64 = np.uint64
SHINGLE = 5
#: Similarity of at least 75 / 100.
PERCENT = 75
BITS = 48
CHUNK_BYTES = 8_000_000
FRAGMENTS = 4
ROUNDS = 1
#: Partners of a hub that one task compares.
PARTNERS = 2000
#: Classes, and their shingles, of one tile.
TILE = 1000
TILE_SHINGLES = 2_000_000
#: A little over 100 / PERCENT, so that linked sets lie in one band of sizes or in neighbouring ones.
BAND = 1.34
#: Shingles that two tiles compare at once.
COLUMNS = 2048


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs, ordered by text and shingle. Fewer words than ``width`` are one shingle as a whole."""
    lower = T.LOWER[data]
    starts, ends, of_text = T.word_spans(lower, offsets, T.NOT_SPACE)
    words = T.running(T.stretch(T.running_bytes(lower), starts, ends))
    counts = np.diff(of_text)
    n_windows = np.where(counts >= width, counts - (width - 1), np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n_windows)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows - of_text[:-1], n_windows)
    keys = T.stretch(words, first, first + np.minimum(counts, width)[text]) >> U64(64 - BITS)
    pairs = np.unique((text.astype(U64) << U64(BITS)) | keys)
    return (pairs >> U64(BITS)).astype(np.int64), pairs & U64((1 << BITS) - 1)


def describe(text: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set and its name, 128 bits of two sums of mixed shingles, which do not depend on their order."""
    sizes = np.bincount(text, minlength=n)
    ends, names = np.cumsum(sizes), []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(T.mix(keys ^ U64(salt)), dtype=U64)])
        names.append(T.mix(total[ends] - total[ends - sizes] + sizes.astype(U64)))
    return sizes, np.stack(names, axis=1)


class Chunk:
    """Shingles of many documents, in their own order."""

    def __init__(self):
        self.ids, self.sizes, self.names, self.docs, self.keys = [], [], [], [], []
        self.size = self.n = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = T.flat(batch.column("text"))
        text, keys = shingles(data, offsets)
        sizes, names = describe(text, keys, batch.num_rows)
        self.ids.append(batch.column("id"))
        self.sizes.append(sizes)
        self.names.append(names)
        self.docs.append((text + self.n).astype(np.uint32))
        self.keys.append(keys)
        self.size += len(data)
        self.n += batch.num_rows

    def close(self) -> None:
        keys, docs = np.concatenate(self.keys), np.concatenate(self.docs)
        order = np.argsort(keys, kind="stable")
        self.docs = docs[order]
        keys = keys[order]
        self.new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        self.distinct = keys[self.new]
        self.counts = np.diff(np.append(np.flatnonzero(self.new), len(keys)))
        self.sizes, self.names = np.concatenate(self.sizes), np.concatenate(self.names)
        digest = hashlib.sha256(self.names.tobytes())
        digest.update(repr(pa.concat_arrays(self.ids).to_pylist()).encode())
        self.name = digest.digest()[:16]


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    chunk = Chunk()
    for whole in batches:
        for batch in T.slices(whole, "text"):
            for start in range(0, batch.num_rows, 50_000):  # a text's number must fit beside its shingle
                chunk.add(batch.slice(start, 50_000))
            if chunk.size >= size or chunk.n >= 200_000:
                chunk.close()
                full, chunk = chunk, Chunk()
                yield full
                del full
    if chunk.n:
        chunk.close()
        yield chunk


_PACKED = pa.schema([("route", pa.int64()), ("chunk", pa.binary()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_PACKED_DDL = "route long, chunk binary, part int, a binary, b binary, c binary"


def _packed(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED, strict=True)], schema=_PACKED)


def _send(batches: Iterator[pa.RecordBatch], fragments: int, size: int) -> Iterator[pa.RecordBatch]:
    """Requests to the fragments, and for each chunk what it needs when the answers are there."""
    limits = np.array([(f << BITS) // fragments for f in range(1, fragments)], U64)
    for chunk in chunks(batches, size):
        edges = np.concatenate([[0], np.searchsorted(chunk.distinct, limits), [len(chunk.distinct)]])
        for f in np.flatnonzero(np.diff(edges)).tolist():
            keys = chunk.distinct[edges[f] : edges[f + 1]]
            counts = chunk.counts[edges[f] : edges[f + 1]].astype(np.uint32)
            yield _packed(f, chunk.name, f, pack(np.diff(keys, prepend=U64(0))), pack(counts), None)
        with pa.BufferOutputStream() as sink:
            table = pa.table(
                {
                    "id": pa.concat_arrays(chunk.ids),
                    "size": chunk.sizes,
                    "name": pa.array([x.tobytes() for x in chunk.names], pa.binary()),
                }
            )
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            rows = sink.getvalue().to_pybytes()
        own = -1 - (int.from_bytes(chunk.name[:7]) >> 1)  # a route of its own, passed through
        yield _packed(own, chunk.name, -1, rows, pack(chunk.docs), pack(np.packbits(chunk.new)))
        del chunk, table, sink, rows  # before the next chunk is read
        T.release()


def _count(requests: pa.Table) -> pa.Table:
    """Frequencies of the shingles of one fragment, to each chunk for its own; and the shingles of frequency over one."""
    T.release()
    if requests["part"][0].as_py() < 0:
        return requests
    asked = [np.cumsum(unpack(x.as_py(), U64), dtype=U64) for x in requests["a"]]
    counts = [unpack(x.as_py(), np.uint32) for x in requests["b"]]
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.minimum(np.bincount(place, np.concatenate(counts)), (1 << 31) - 1).astype(np.uint32)
    ends, out = np.cumsum([len(x) for x in asked]), []
    for i, (chunk, part) in enumerate(zip(requests["chunk"].to_pylist(), requests["part"].to_pylist(), strict=True)):
        frequency = total[place[ends[i] - len(asked[i]) : ends[i]]]
        out.append(_packed(0, chunk, part, pack(frequency), pack(asked[i][frequency > 1]), None))
    return pa.Table.from_batches(out)


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n that any linked set has too, at least."""
    return (PERCENT * n + 99) // 100


_SET = "n long, name binary, shared long, keys binary, prefix array<long>"


def _collect(rows: pa.Table) -> pa.Table:
    """Sets of one chunk: size and class of each row; shared shingles and their prefix of those that may link."""
    T.release()
    parts = np.array(rows["part"].to_pylist())
    own = int(np.flatnonzero(parts < 0)[0])
    equal = int((parts < 0).sum())  # chunks of equal content, each with its own requests and answers
    head = pa.ipc.open_stream(rows["a"][own].as_py()).read_all()
    sizes = head["size"].to_numpy()
    docs = unpack(rows["b"][own].as_py(), np.uint32)
    new = np.unpackbits(unpack(rows["c"][own].as_py(), np.uint8), count=len(docs)).astype(bool)
    order = [i for i in np.unique(parts, return_index=True)[1].tolist() if parts[i] >= 0]
    frequency = np.concatenate([unpack(rows["a"][i].as_py(), np.uint32) for i in order] or [np.empty(0, np.uint32)])
    shared = np.concatenate([unpack(rows["b"][i].as_py(), U64) for i in order] or [np.empty(0, U64)])
    keys = np.zeros(len(frequency), U64)
    keys[frequency > 1] = shared
    key = np.cumsum(new) - 1
    known = frequency[key] > 1
    docs, key = docs[known], key[known]
    n_shared = np.bincount(docs, minlength=len(sizes))
    may = (n_shared >= needed(sizes)) & (sizes > 0)
    docs, key = docs[may[docs]], key[may[docs]]
    by_rank = np.lexsort((keys[key], frequency[key], docs))
    by_key = np.lexsort((keys[key], docs))
    ends, at = np.cumsum(np.bincount(docs, minlength=len(sizes))), 0
    packed, prefixes = [], []
    for d in range(len(sizes)):
        if not may[d]:
            packed.append(None)
            prefixes.append(None)
            continue
        part, at = slice(at, ends[d]), ends[d]
        packed.append(pack(np.diff(keys[key[by_key[part]]], prepend=U64(0))))
        length = sizes[d] - needed(sizes[d]) + 1 - (sizes[d] - n_shared[d])
        prefixes.append(keys[key[by_rank[part]]][:length].astype(np.int64).tolist())
    found = pa.table(
        {
            "id": head["id"],
            "n": head["size"].cast(pa.int64()),
            "name": head["name"],
            "shared": pa.array(n_shared, pa.int64()),
            "keys": pa.array(packed, pa.binary()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())),
        }
    )
    return pa.concat_tables([found] * equal)


def sets(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, size and class of its shingle set, and what the join needs if it may link."""
    fragments = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = source.schema["id"].dataType.simpleString()
    sent = source.mapInArrow(T.released(lambda batches: _send(batches, fragments, chunk_bytes)), _PACKED_DDL)
    counted = sent.groupBy("route").applyInArrow(_count, _PACKED_DDL)
    return counted.groupBy("chunk").applyInArrow(_collect, f"id {key}, {_SET}")


def _blocks(classes: DataFrame) -> DataFrame:
    """(token, node, n, place, reach) of the prefix shingles that several classes have.

    ``place`` is the shingle's place in the class's set by frequency and hash; shingles of no other document stand first. If it is the first that
    two classes share, they share at most n - place, so of n and m shingles together they can link only if 7 * (n - place) >= 3 * (n + m): m is
    ``reach`` at most.
    """
    first = F.col("n") - F.col("shared")
    rows = classes.select("node", "n", first.alias("first"), F.posexplode("prefix").alias("i", "token"))
    placed = rows.select("token", "node", "n", (F.col("first") + F.col("i")).alias("place"))
    return placed.withColumn("reach", F.floor((4 * F.col("n") - 7 * F.col("place")) / 3))


def _may_link():
    """Each of the two classes is within the other's reach, and of similar size."""
    sizes = 100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")
    return sizes & (F.col("n") <= F.col("hub_reach")) & (F.col("hub_n") <= F.col("reach"))


def _fragments(classes: DataFrame, fragments: int) -> DataFrame:
    """(node, n, fragment, keys): the sets cut by ranges of the shingles' order."""
    limits = np.array([(f << BITS) // fragments for f in range(1, fragments)], U64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, packed in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "keys")), strict=True):
                keys = np.cumsum(unpack(packed, U64), dtype=U64)
                for f, part in enumerate(np.split(keys, np.searchsorted(keys, limits))):
                    if len(part):
                        out.append({"node": node, "n": n, "fragment": f, "keys": pack(np.diff(part, prepend=U64(0)))})
            fields = [("node", pa.int64()), ("n", pa.int64()), ("fragment", pa.int32()), ("keys", pa.binary())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    return classes.select("node", "n", "keys").mapInArrow(T.released(cut), "node long, n long, fragment int, keys binary")


def _partial(rows: pa.Table) -> pa.Table:
    """Overlaps in one fragment of one hub with some of its partners."""
    nodes, hubs = rows["node"].to_pylist(), rows["hub"].to_pylist()
    at = [i for i, (node, hub) in enumerate(zip(nodes, hubs, strict=True)) if node == hub]
    others = [i for i, (node, hub) in enumerate(zip(nodes, hubs, strict=True)) if node != hub]
    overlaps = []
    if at and others:
        hub = np.cumsum(unpack(rows["keys"][at[0]].as_py(), U64), dtype=U64)
        sets_ = [np.cumsum(unpack(rows["keys"][i].as_py(), U64), dtype=U64) for i in others]
        keys = np.concatenate(sets_)
        place = np.minimum(np.searchsorted(hub, keys), len(hub) - 1)
        edges = np.concatenate([[0], np.cumsum([len(s) for s in sets_])])
        overlaps = T.sums_by_text(hub[place] == keys, edges).tolist()
    else:
        others = []
    fields = [("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())]
    columns = [[hubs[i] for i in others], [nodes[i] for i in others], overlaps]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def links(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pairs (hub, node, hub_n, node_n) that reach the similarity."""
    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("partners"))
    salts = counts.select("hub", F.ceil(F.col("partners") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(salts, "hub").select(
        "hub", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    )
    hubs = salts.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = salted.unionByName(hubs).join(pieces.select("node", "fragment", "keys"), "node")
    partial = members.groupBy("hub", "salt", "fragment").applyInArrow(_partial, "a long, b long, overlap long")
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    sizes = pairs.select(F.col("hub").alias("a"), F.col("node").alias("b"), (F.col("hub_n") + F.col("node_n")).alias("both"))
    reached = 100 * F.col("overlap") >= PERCENT * (F.col("both") - F.col("overlap"))
    return summed.join(sizes, ["a", "b"]).filter(reached).select("a", "b")


def _open_blocks(blocks: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their components, and what is known of each block with several components."""
    rows = blocks.withColumn("component", F.col("node"))
    if labels is not None:
        rows = blocks.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    central = F.struct((1000 * F.col("place") / F.col("n")).cast("int").alias("order"), "node", "n", "reach", "component")
    of_block = rows.groupBy("token").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.min("n").alias("least_n"),
        F.max("reach").alias("most_reach"),
        F.min(central).alias("hub"),
    )
    return rows, of_block.filter("lo <> hi and least_n <= most_reach")


def _hub_pairs(blocks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Each class with the hub of each of its blocks, unless both are in one component or can't link.

    The hub is the class with the fewest shingles of its own, the likeliest origin of the others.
    """
    rows, of_block = _open_blocks(blocks, labels)
    hubs = of_block.select(
        "token",
        F.col("hub.node").alias("hub"),
        F.col("hub.n").alias("hub_n"),
        F.col("hub.reach").alias("hub_reach"),
        F.col("hub.component").alias("hub_component"),
    )
    met = rows.join(hubs, "token").filter((F.col("component") != F.col("hub_component")) & _may_link())
    return met.select("hub", "node", "hub_n", F.col("n").alias("node_n")).distinct()


def _remaining_pairs(blocks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """All pairs of classes of one block and different components that may link.

    A class that no other of its block can reach, or that reaches none, leaves the block first.
    """
    rows, of_block = _open_blocks(blocks, labels)
    limits = of_block.select("token", "least_n", "most_reach")
    left = rows.join(limits, "token").filter("reach >= least_n and n <= most_reach").drop("least_n", "most_reach")
    names = {"node": "hub", "n": "hub_n", "reach": "hub_reach", "component": "hub_component"}
    right = left.select("token", *(F.col(c).alias(name) for c, name in names.items()))
    apart = (F.col("hub") < F.col("node")) & (F.col("component") != F.col("hub_component"))
    met = left.join(right, "token").filter(apart & _may_link())
    return met.select("hub", "node", "hub_n", F.col("n").alias("node_n")).distinct()


def _tiles(classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of components with their tiles, and (tile, pair, second): the tiles of each pair of tiles that may hold links.

    A tile is (component, band, part). It meets itself, the others of its band and those of the next.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    linked = classes.join(labels, "node").select("node", "n", "component", band.alias("band"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    bands = store(linked.groupBy("component", "band").agg(F.count(F.lit(1)).alias("classes"), parts.alias("parts")), "bands")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = linked.join(bands, ["component", "band"]).select("node", "n", F.xxhash64("component", "band", part).alias("tile"))

    low = bands.select("component", "band", "parts", "classes", F.explode(F.array("band", F.col("band") + 1)).alias("next"))
    high = bands.select("component", F.col("band").alias("next"), F.col("parts").alias("next_parts"))
    met = low.join(high, ["component", "next"]).filter("next > band or classes > 1")
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("next_parts") - 1))).filter("next > band or i <= j")
    first, second = F.xxhash64("component", "band", "i"), F.xxhash64("component", "next", "j")
    sides = met.select(first.alias("first"), second.alias("second"), F.xxhash64(first, second).alias("pair"))
    both = F.array(F.struct(F.col("first").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("second").alias("tile"), F.lit(1).alias("side")))
    alone = F.array(F.struct(F.col("first").alias("tile"), F.lit(2).alias("side")))
    members = sides.select("pair", F.explode(F.when(F.col("first") == F.col("second"), alone).otherwise(both)).alias("member"))
    return placed, members.select("pair", "member.tile", "member.side")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each value of ``keys``, which are next to each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = held != [] and tuple(c[0] for c in columns) != last
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and new[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common shingles of each set of ``a`` with each of ``b``."""
    keys_a, keys_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(keys_a, keys_b)
    out = np.zeros((len(a), len(b)), np.uint32)
    sides = []
    for keys, sets_ in ((keys_a, a), (keys_b, b)):
        row = np.repeat(np.arange(len(sets_)), [len(s) for s in sets_])
        column = np.searchsorted(common, keys)
        known = np.zeros(len(keys), bool)
        inside = column < len(common)
        known[inside] = common[column[inside]] == keys[inside]
        row, column = row[known], column[known]
        order = np.argsort(column, kind="stable")
        sides.append((len(sets_), row[order], column[order]))
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        dense = []
        for n, row, column in sides:
            lo, hi = np.searchsorted(column, [start, start + width])
            matrix = np.zeros((n, width), np.float32)
            matrix[row[lo:hi], column[lo:hi] - start] = 1
            dense.append(matrix)
        out += (dense[0] @ dense[1].T).astype(np.uint32)
    return out


_TILED = pa.schema([("pair", pa.int64()), ("same", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("found", pa.binary())])
_TILED_DDL = "pair long, same boolean, a binary, b binary, found binary"


def _tile_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles and fragment, a matrix of partial overlaps between their classes (node, n)."""
    for rows in _groups(batches, ("pair", "fragment")):
        side = rows["side"].to_numpy()
        node_n = np.stack([rows["node"].to_numpy(), rows["n"].to_numpy()], axis=1)
        sets_ = [np.cumsum(unpack(x.as_py(), U64), dtype=U64) for x in rows["keys"]]
        same = bool(side[0] == 2)
        at_a, at_b = (np.flatnonzero((side == s) | (side == 2)) for s in (0, 1))
        if not len(at_a) or not len(at_b):
            continue
        found = overlaps([sets_[i] for i in at_a], [sets_[i] for i in at_b])
        row = (rows["pair"][0].as_py(), same, pack(node_n[at_a].reshape(-1)), pack(node_n[at_b].reshape(-1)), pack(found.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TILED, strict=True)], schema=_TILED)


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the fragments' matrices, and which classes reach the similarity, as bits."""
    for rows in _groups(batches, ("pair",)):
        same = rows["same"][0].as_py()
        sides = [[unpack(x.as_py(), np.int64).reshape(-1, 2) for x in rows[c]] for c in ("a", "b")]
        (a, at_a), (b, at_b) = (_distinct(x) for x in sides)
        total = np.zeros((len(a), len(b)), np.int64)
        start_a = start_b = 0
        for i, blob in enumerate(rows["found"]):
            n_a, n_b = len(sides[0][i]), len(sides[1][i])
            part = unpack(blob.as_py(), np.uint32).reshape(n_a, n_b)
            total[np.ix_(at_a[start_a : start_a + n_a], at_b[start_b : start_b + n_b])] += part
            start_a, start_b = start_a + n_a, start_b + n_b
        linked = (total > 0) & (100 * total >= PERCENT * (a[:, 1][:, None] + b[:, 1][None, :] - total))
        if same:
            np.fill_diagonal(linked, False)
        if linked.any():
            row = (rows["pair"][0].as_py(), same, pack(a[:, 0].copy()), pack(b[:, 0].copy()), pack(np.packbits(linked)))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TILED, strict=True)], schema=_TILED)


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The classes (node, n) of several fragments by node, and the place of each."""
    rows = np.concatenate(parts)
    _, first, place = np.unique(rows[:, 0], return_index=True, return_inverse=True)
    return rows[first], place


def _packed_links(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """All links, stored: for each two tiles with any, their classes and a matrix of bits."""
    placed, members = _tiles(classes, labels)
    pieces = _fragments(classes, FRAGMENTS).select("node", "fragment", "keys")
    dealt = placed.join(members, "tile").join(pieces, "node").select("pair", "fragment", "side", "node", "n", "keys")
    dealt = dealt.repartition("pair", "fragment").sortWithinPartitions("pair", "fragment")
    partial = dealt.mapInArrow(T.released(_tile_overlaps), _TILED_DDL)
    summed = partial.repartition("pair").sortWithinPartitions("pair")
    return store(summed.mapInArrow(_tile_links, _TILED_DDL), "all_links")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    for same, a, b, found in zip(*(batch.column(c).to_pylist() for c in ("same", "a", "b", "found")), strict=True):
        a, b = unpack(a, np.int64), unpack(b, np.int64)
        bits = np.unpackbits(unpack(found, np.uint8), count=len(a) * len(b))
        yield same, a, b, bits.reshape(len(a), len(b)).astype(bool)


def _link_counts(packed: DataFrame) -> DataFrame:
    """(node, n_links): to how many other classes each class with links is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for same, a, b, linked in _matrices(batch):
                nodes.append(a)
                counts.append(linked.sum(axis=1))
                if not same:
                    nodes.append(b)
                    counts.append(linked.sum(axis=0))
            distinct, place = np.unique(np.concatenate(nodes), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], names=["node", "n_links"])

    counted = packed.select("same", "a", "b", "found").mapInArrow(count, "node long, n_links long")
    return counted.groupBy("node").agg(F.sum("n_links").alias("n_links")).filter("n_links > 0")


def _listed(packed: DataFrame) -> DataFrame:
    """(class_a, class_b), the lesser first, of every link."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b, linked in _matrices(batch):
                i, j = np.nonzero(np.triu(linked) if same else linked)
                lo, hi = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["class_a", "class_b"])

    return packed.select("same", "a", "b", "found").mapInArrow(unfold, "class_a long, class_b long")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their classes, the classes that may link, and the components of those that do; all stored."""
    spark = docs.sparkSession
    rows = store(sets(docs, id_col, text_col), "sets")
    node = F.xxhash64("name")
    rows = rows.withColumn("node", node)
    candidates = rows.filter("keys is not null").select("node", "n", "shared", "keys", "prefix").drop_duplicates(["node"])
    classes = store(candidates, "classes")
    blocks = _blocks(classes)
    several = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("token")
    blocks = store(blocks.join(several, "token"), "blocks")
    pieces = _fragments(classes, FRAGMENTS)
    labels = None
    for round_ in range(ROUNDS + 1):
        pairs = _hub_pairs(blocks, labels) if round_ < ROUNDS else _remaining_pairs(blocks, labels)
        pairs = store(pairs, "pairs")
        found = store(links(pairs, pieces), "links")
        labels = components(spark, found, labels)
    return rows, classes, labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", components_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``class`` (rows with equal sets share it), ``class_id``, ``n_links``, ``component`` and ``component_id``.

    ``class_id`` is the smallest id of the class; rows without shingles have their own. ``n_links`` is the exact number of other classes that the row's class is linked to; with ``components_only`` the links are not counted and the column is
    left out. ``component_id`` is the smallest id reachable by links, the row's own included; null ids count only where there is no other. Rows without
    words have no shingles and their own id. Repeated ids are rows of their own, of which each belongs to its set's class. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows, classes, labels = _classes(docs, id_col, text_col)
    rows = rows.drop("keys", "prefix")
    if not components_only:
        counts = store(_link_counts(_packed_links(classes, labels)), "link_counts")
        rows = rows.join(counts, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    classes_ids = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = classes_ids.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("node", "least", "component", "component_id")
    shown = [] if components_only else ["n_links"]
    joined = rows.select("id", "n", "node", *shown).join(of_node, "node", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("node").alias("class"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("class_id"),
        *shown,
        "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(class_a, class_b) of every two linked classes, once, ``class`` as ``join`` has it. A group of n near copies has up to n * (n - 1) / 2 of them."""
    _, classes, labels = _classes(docs, id_col, text_col)
    return _listed(_packed_links(classes, labels))


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with its texts' classes, as ``join`` has them, in a last column ``_class``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            numbered = pa.RecordBatch.from_arrays(whole.columns, names=[str(i) for i in range(whole.num_columns)])
            for batch in T.slices(numbered, str(place)):
                for start in range(0, batch.num_rows, 50_000):
                    part = batch.slice(start, 50_000)
                    _, names = describe(*shingles(*T.flat(part.column(place))), part.num_rows)
                    values = pa.array([x.tobytes() for x in names], pa.binary())
                    schema = whole.schema.append(pa.field("_class", pa.binary()))
                    yield pa.RecordBatch.from_arrays([*part.columns, values], schema=schema)

    named = docs.mapInArrow(T.released(run), StructType([*docs.schema.fields, StructField("_class", BinaryType())]))
    return named.withColumn("_class", F.xxhash64("_class"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, of the smallest id and then of the lowest class; columns stay, whatever their names.

    Rows without words are linked with nothing and all stay. Null ids are kept only where a component has no other. Of rows equal in id and
    shingle set one stays.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"_{i}" for i in range(len(names))))
    own_id, own_text = f"_{names.index(id_col)}", f"_{names.index(text_col)}"
    joined = store(join(numbered, own_id, own_text, components_only=True).withColumnRenamed(own_id, "_id"), "joined")
    linked = joined.filter("n_shingles > 0").groupBy("component", "_id", "class").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("_id").isNull().alias("missing"), "_id", "class", "copies")
    kept = linked.groupBy("component").agg(F.min(order).alias("first")).select("first._id", "first.class", "first.copies")
    wordless = joined.filter("n_shingles = 0").select("_id", "class", F.lit(1).cast("long").alias("copies")).distinct()
    kept = store(kept.unionByName(wordless), "kept")
    same = F.col(own_id).eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("class"))
    rows = _named(numbered, own_text).join(kept, same)
    once = rows.filter("copies = 1").select(*numbered.columns)
    if not kept.filter("copies > 1").isEmpty():
        once = once.unionByName(rows.filter("copies > 1").drop_duplicates(["_id", "_class"]).select(*numbered.columns))
    return once.toDF(*names)
