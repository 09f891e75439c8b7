"""A hierarchical Pitman-Yor language model: Chinese restaurants sampled by Gibbs, and scores of whole texts.

A context has a restaurant whose customers are the tokens that follow it. Every table sends one customer to the parent that all context restaurants share,
the restaurant of tokens without context, whose base is uniform over the known words and one for all unknown ones. A context is the word before, hashed
to one of ``restaurants`` many, so what is kept by context has a fixed size; nothing is left out: rare contexts share a restaurant.

The seating is kept as numbers of tables: given ``c`` customers of a word in a restaurant, the number of tables has the weight of a generalised Stirling number times
the chances of opening them. A Gibbs sweep draws all of these anew, given the rest. Blocks of words hold all customers of their words in every
restaurant, so a sweep of a block needs from elsewhere only the customers and tables of each restaurant. Those are summed in Spark after each round of sweeps, and are
one round old while blocks are swept beside each other. Probabilities are linear in the tables, so the tables of the sweeps that count are
averaged.

Words go to blocks by hash. A frequent word is spread over all blocks by its context; a small sample picks such words, which decides only where counts meet.
Then texts are scored where the blocks are: a chunk of texts sends each distinct pair of word and context once, and its tokens as
positions in these; a block answers with sums per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.bpe import CHANGED, pack, unpack
from riskmart.llm.components import groups_for, store
from riskmart.sources import remove

U64 = np.uint64
CHUNK_BYTES = 8_000_000
#: Hashes of the end of a text as a token, and of its start as a context.
END, START = U64(0xA5C9D3F20B6E1847), U64(0x5D1E8A7742C3960B)
#: Numbers of tables are drawn exactly up to so many customers, and grown from there in strides that double.
EXACT = 32


@dataclass(frozen=True)
class Settings:
    """``rounds`` of ``sweeps`` each; the sweeps of the last round count. ``group_bytes`` of input make one block."""

    restaurants: int = 1 << 20
    rounds: int = 2
    sweeps: int = 3
    strength: float = 1.0
    root_strength: float = 100.0
    seed: int = 11
    group_bytes: int = 12_000_000
    sample: float = 0.01

    @property
    def bits(self) -> int:
        return (self.restaurants - 1).bit_length()


def is_held_out(id_col: str) -> Column:
    """Texts never learned from: CRC-32 of the id as text leaves 2 modulo 7. Rows without id are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def tokens(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and restaurant of each token, ends of texts included, and the number of tokens of each text."""
    data, offsets = T.flat(column)
    data = T.LOWER[data]
    starts, ends, of_text = T.word_spans(data, offsets, T.NOT_SPACE)
    n = len(offsets) - 1
    hashes = np.empty(len(starts) + n, U64)
    last = of_text[1:] + np.arange(n)
    is_end = np.zeros(len(hashes), bool)
    is_end[last] = True
    hashes[~is_end] = T.stretch(T.running_bytes(data), starts, ends)
    hashes[last] = END
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[:1] = START
    before[last[:-1] + 1] = START
    place = (T.mix(before ^ U64(0x51ED270B)) >> U64(64 - bits)).astype(np.uint32)
    return hashes, place, np.diff(of_text) + 1


class Dealer:
    """The block of a pair: a range of the word's hash, or for frequent words a range of the pair's."""

    def __init__(self, blocks: int, frequent: np.ndarray):
        self.blocks, self.frequent = blocks, np.sort(frequent)

    def is_frequent(self, words: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return self.frequent[at] == words

    def block(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        spread = T.mix(words + places.astype(U64) * U64(0xD1B54A32D192ED03))
        h = np.where(self.is_frequent(words), spread, words)
        return ((h >> U64(32)) * U64(self.blocks) >> U64(32)).astype(np.int64)


def frequent_words(docs: DataFrame, text_col: str, blocks: int, settings: Settings) -> np.ndarray:
    """Hashes of the words that make up more than a quarter of a block's share in a sample: at most four times as many as blocks."""
    if blocks == 1:
        return np.empty(0, U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                hashes, counts = np.unique(tokens(batch["text"], settings.bits)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["word", "n"])

    sample = docs.select(F.col(text_col).alias("text")).sample(settings.sample, seed=settings.seed)
    counts = sample.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    found = counts.join(F.broadcast(total), F.col("n") * (4 * blocks) > F.col("total")).select("word").collect()
    return np.array([r.word for r in found], np.int64).view(U64)


COUNTS = pa.schema([("block", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])
COUNTS_DDL = "block int, words binary, sizes binary, places binary, counts binary"
BLOCK = pa.schema([*COUNTS, ("tables", pa.binary()), ("root", pa.binary())])
BLOCK_DDL = COUNTS_DDL + ", tables binary, root binary"


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _grouped(words: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Pairs in the order of their words: the words, how many pairs each has, and the pairs' restaurants."""
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    sizes = np.diff(np.append(first, len(words))).astype(np.uint32)
    return pack(words[first]), pack(sizes), pack(places)


def count_pairs(docs: DataFrame, text_col: str, dealer: Dealer, settings: Settings) -> DataFrame:
    """Blocks of words: for each pair of word and restaurant its customers, one table to begin with."""
    bits = settings.bits

    def sent(parts: list) -> Iterator[pa.RecordBatch]:
        hashes, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, number = np.unique(hashes, return_inverse=True)
        pairs, counts = np.unique(number.astype(U64) << U64(bits) | places, return_counts=True)
        word, place = words[pairs >> U64(bits)], (pairs & U64((1 << bits) - 1)).astype(np.uint32)
        block = dealer.block(word, place)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(dealer.blocks + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            yield _row(COUNTS, b, *_grouped(word[own], place[own]), pack(counts[own].astype(np.uint32)))
        T.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for whole in batches:
            for batch in T.slices(whole, "text"):
                hashes, places, _ = tokens(batch["text"], bits)
                parts.append((hashes, places))
                size += batch["text"].nbytes
                if size >= CHUNK_BYTES:
                    yield from sent(parts)
                    parts, size = [], 0
        if parts:
            yield from sent(parts)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        T.release()
        rows = [(unpack(r["words"], U64), unpack(r["sizes"], np.uint32), unpack(r["places"], np.uint32), unpack(r["counts"], np.uint32)) for r in group.to_pylist()]
        words = np.unique(np.concatenate([r[0] for r in rows]))
        pairs = np.concatenate([np.repeat(np.searchsorted(words, w).astype(U64) << U64(bits), n) | p for w, n, p, _ in rows])
        counts = np.concatenate([r[3] for r in rows]).astype(np.int64)
        del rows
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.add.reduceat(counts[order], first)
        pairs = pairs[first]
        word = words[pairs >> U64(bits)]
        packed = _grouped(word, (pairs & U64((1 << bits) - 1)).astype(np.uint32))
        ones = np.ones(len(pairs), np.uint32)
        T.release()
        return pa.Table.from_batches([_row(BLOCK, key[0].as_py(), *packed, pack(counts), pack(ones), pack(np.ones(len(words), np.uint32)))])

    source = docs.select(F.col(text_col).alias("text"))
    return source.mapInArrow(run, COUNTS_DDL).groupBy("block").applyInArrow(merge, BLOCK_DDL)


class Block:
    """One row of the blocks' table, unpacked."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.words, sizes = unpack(row["words"], U64), unpack(row["sizes"], np.uint32).astype(np.int64)
        self.word = np.repeat(np.arange(len(self.words)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.places = unpack(row["places"], np.uint32).astype(np.int64)
        self.counts = unpack(row["counts"], np.int64)
        self.tables = unpack(row["tables"], np.uint32).astype(np.int64)
        self.root = unpack(row["root"], np.uint32).astype(np.int64)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0, np.int64)


#: Kinds of sums: by restaurant, by frequent word, and of single numbers.
RESTAURANT, FREQUENT, SCALAR = range(3)
WORDS, PAIRS, ROOT_WORDS = range(3)  # numbers of all words and root tables; of pairs seen once and twice; of words with one and two tables


def sums(blocks: DataFrame, dealer: Dealer, settings: Settings) -> pa.Table:
    """``(kind, key, a, b)``: customers and tables of each restaurant; the same, and root tables as key ``-``, of frequent words; single numbers.

    At most ``restaurants`` rows, and some per frequent word, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, seated = (np.zeros(settings.restaurants, np.int64) for _ in range(2))
        scalars = np.zeros((3, 2), np.int64)
        kinds, keys, a, b = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                customers += np.bincount(block.places, block.counts, settings.restaurants).astype(np.int64)
                seated += np.bincount(block.places, block.tables, settings.restaurants).astype(np.int64)
                frequent = dealer.is_frequent(block.words)
                tables = block.by_word(block.tables)
                scalars[WORDS] += [np.count_nonzero(~frequent), block.root[~frequent].sum()]
                scalars[PAIRS] += [np.count_nonzero(block.counts == k) for k in (1, 2)]
                scalars[ROOT_WORDS] += [np.count_nonzero(tables[~frequent] == k) for k in (1, 2)]
                keys.append(block.words[frequent].view(np.int64))
                a.append(block.by_word(block.counts)[frequent])
                b.append(tables[frequent])
                kinds.append(np.full(len(a[-1]), FREQUENT))
            T.release()
        used = np.flatnonzero(customers)
        kinds += [np.full(len(used), RESTAURANT), np.full(3, SCALAR)]
        keys += [used, np.arange(3)]
        a += [customers[used], scalars[:, 0]]
        b += [seated[used], scalars[:, 1]]
        columns = [np.concatenate(x) for x in (kinds, keys, a, b)]
        for lo in range(0, len(columns[0]), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[lo : lo + 10_000].astype(d)) for c, d in zip(columns, (np.int32, np.int64, np.int64, np.int64), strict=True)], names=["kind", "key", "a", "b"]
            )

    found = blocks.mapInArrow(run, "kind int, key long, a long, b long")
    return found.groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()


class State:
    """What blocks need from each other: sizes of restaurants, frequent words, and constants of the model."""

    def __init__(self, found: pa.Table, settings: Settings, before: State | None = None, per_sample: int = 1):
        kind, key, a, b = (found[c].to_numpy() for c in ("kind", "key", "a", "b"))
        scalars = np.zeros((3, 2), np.int64)
        scalars[key[kind == SCALAR]] = np.stack([a, b], axis=1)[kind == SCALAR]
        self.customers, self.tables = np.zeros(settings.restaurants), np.zeros(settings.restaurants)
        at = key[kind == RESTAURANT]
        self.customers[at], self.tables[at] = a[kind == RESTAURANT], b[kind == RESTAURANT] / per_sample
        words = key[kind == FREQUENT].view(U64)
        order = np.argsort(words)
        self.frequent, self.frequent_count = words[order], a[kind == FREQUENT][order]
        self.frequent_tables = b[kind == FREQUENT][order] / per_sample
        self.n_tokens = int(self.customers.sum())
        self.n_words = int(scalars[WORDS, 0]) + len(self.frequent)
        self.base = 1 / (self.n_words + 1)
        self.strength, self.root_strength = settings.strength, settings.root_strength
        if before is None:  # discounts by counts of counts
            share = lambda once, twice: float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95))
            self.discount, self.root_discount = share(*scalars[PAIRS]), share(*scalars[ROOT_WORDS])
        else:
            self.discount, self.root_discount = before.discount, before.root_discount
        self.root_customers = float(self.tables.sum())
        # the root tables of frequent words: as many as are expected of so many customers
        self.frequent_root = np.ones(len(self.frequent))
        self.root_tables = scalars[WORDS, 1] / per_sample + len(self.frequent)
        for _ in range(3 if len(self.frequent) else 0):
            a_new = (self.root_strength + self.root_discount * self.root_tables) * self.base
            self.frequent_root = np.minimum(expected_tables(self.frequent_tables, a_new, self.root_discount), self.frequent_tables)
            self.root_tables = scalars[WORDS, 1] / per_sample + self.frequent_root.sum()

    def root_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of a word without context, by its customers and tables in the root restaurant."""
        open_ = (self.root_strength + self.root_discount * self.root_tables) * self.base
        return (np.maximum(customers - self.root_discount * tables, 0) + open_) / (self.root_strength + self.root_customers)

    def backing(self) -> np.ndarray:
        """The share of each restaurant that goes to its parent."""
        return (self.strength + self.discount * self.tables) / (self.strength + self.customers)

    def place_of_frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are frequent, and where among these."""
        if not len(self.frequent):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return self.frequent[at] == words, at


def stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers by customers and tables, up to ``EXACT``."""
    log = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log[1, 1] = 0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        log[c + 1, 1 : c + 1] = log[c, 1 : c + 1] + np.log(c - discount * t)
        log[c + 1, 2 : c + 2] = np.logaddexp(log[c + 1, 2 : c + 2], log[c, 1 : c + 1])
    return log


def expected_tables(customers: np.ndarray, opening: np.ndarray | float, discount: float) -> np.ndarray:
    """About how many tables so many customers open, seated one by one."""
    tables, seated = np.ones(len(customers)), np.ones(len(customers))
    while (seated < customers).any():
        then = np.minimum(seated * 2, customers)
        tables += opening * np.log((opening + then - discount * tables) / (opening + seated - discount * tables))
        seated = then
    return tables


def drawn_tables(rng: np.random.Generator, counts: np.ndarray, opening: np.ndarray, more: np.ndarray, discount: float, log: np.ndarray) -> np.ndarray:
    """A number of tables for each number of customers.

    The k-th table after the first opens with weight ``opening + k * more``. Up to ``EXACT`` customers the draw is exact; the rest are seated in strides.
    """
    tables = np.ones(len(counts), np.int64)
    some = np.flatnonzero(counts > 1)
    few = np.minimum(counts[some], EXACT)
    order = np.argsort(few, kind="stable")
    edges = np.searchsorted(few[order], np.arange(EXACT + 2))
    for c in range(2, EXACT + 1):
        own = some[order[edges[c] : edges[c + 1]]]
        for lo in range(0, len(own), 1 << 16):
            part = own[lo : lo + (1 << 16)]
            opens = np.log(opening[part, None] + more[part, None] * np.arange(c))
            weight = np.cumsum(opens, axis=1) + log[c, 1 : c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (weight[:, :-1] < rng.random(len(part))[:, None] * weight[:, -1:]).sum(axis=1)
    many = some[counts[some] > EXACT]
    seated = np.full(len(many), EXACT)
    while len(many):
        t = tables[many]
        then = np.minimum(seated * 2, counts[many])
        a = opening[many] + more[many] * t
        new = rng.poisson(a * np.log((a + then - discount * t) / (a + seated - discount * t)))
        tables[many] = np.minimum(t + new, then)
        left = then < counts[many]
        many, seated = many[left], then[left]
    return tables


def swept(block: Block, state: State, settings: Settings, round_: int, last: bool) -> None:
    """Draw the tables of a block anew, sweep by sweep. After the last round they are sums over its sweeps."""
    rng = np.random.default_rng([settings.seed, block.number, round_])
    log, root_log = stirling(state.discount), stirling(state.root_discount)
    frequent, at = state.place_of_frequent(block.words)
    kept, kept_root = np.zeros_like(block.tables), np.zeros_like(block.root)
    free = np.flatnonzero(block.counts > 1)
    word, place = block.word[free], block.places[free]
    for _ in range(settings.sweeps):
        customers = block.by_word(block.tables).astype(float)
        root = block.root.astype(float)
        if frequent.any():
            customers[frequent], root[frequent] = state.frequent_tables[at[frequent]], state.frequent_root[at[frequent]]
        chance = state.root_probability(customers, root)[word]
        others = np.maximum(state.tables[place] - block.tables[free], 0)
        opening = (state.strength + state.discount * others) * chance
        block.tables[free] = drawn_tables(rng, block.counts[free], opening, state.discount * chance, state.discount, log)
        customers = block.by_word(block.tables)
        others = np.maximum(state.root_tables - block.root, 0)
        opening = (state.root_strength + state.root_discount * others) * state.base
        more = np.full(len(opening), state.root_discount * state.base)
        block.root = drawn_tables(rng, customers, opening, more, state.root_discount, root_log)
        kept += block.tables
        kept_root += block.root
    if last:
        block.tables, block.root = kept, kept_root


@dataclass
class Model:
    """Blocks of words with customers and summed tables, and what they share."""

    blocks: DataFrame
    state: Broadcast
    dealer: Dealer
    settings: Settings

    @property
    def train_tokens(self) -> int:
        return self.state.value.n_tokens


def _path(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


def fit(docs: DataFrame, text_col: str = "text", settings: Settings | None = None) -> Model:
    """Learn from all texts of ``docs``. Null and empty texts are one end each; an empty table gives a model that knows no word.

    Other columns are not read. The result does not depend on the order of rows, nor on how they are partitioned, but for which words
    the sample calls frequent.
    """
    settings = settings or Settings()
    spark: SparkSession = docs.sparkSession
    n_blocks = groups_for(docs, settings.group_bytes)
    dealer = Dealer(n_blocks, frequent_words(docs, text_col, n_blocks, settings))
    blocks = store(count_pairs(docs, text_col, dealer, settings), "restaurants")
    state = State(sums(blocks, dealer, settings), settings)
    for round_ in range(settings.rounds):
        last = round_ == settings.rounds - 1
        shared = spark.sparkContext.broadcast(state)  # two numbers per restaurant and some per frequent word

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row)
                    swept(block, shared.value, settings, round_, last)
                    found = (pack(x.astype(np.uint32)) for x in (block.tables, block.root))
                    yield _row(BLOCK, *(row[c] for c in COUNTS.names), *found)
                    T.release()

        old, blocks = blocks, store(blocks.mapInArrow(run, BLOCK_DDL), "restaurants")
        if old.inputFiles():
            remove(spark, _path(old))  # read by nothing that follows
        state = State(sums(blocks, dealer, settings), settings, state, settings.sweeps if last else 1)
    return Model(blocks, spark.sparkContext.broadcast(state), dealer, settings)


REQUEST = pa.schema([("chunk", pa.binary()), *COUNTS][:5] + [("texts", pa.binary()), ("runs", pa.binary()), ("tokens", pa.binary())])
REQUEST_DDL = "chunk binary, block int, words binary, sizes binary, places binary, texts binary, runs binary, tokens binary"
ANSWER = pa.schema([("chunk", pa.binary()), ("block", pa.int32()), ("texts", pa.binary()), ("sums", pa.binary()), ("known", pa.binary())])
ANSWER_DDL = "chunk binary, block int, texts binary, sums binary, known binary"
ROWS = pa.schema([("chunk", pa.binary()), ("rows", pa.binary())])


class Texts:
    """Rows read one after the other until they make a chunk, named by a digest of ids and texts."""

    def __init__(self):
        self.size, self.batches, self.digest = 0, [], hashlib.blake2b(digest_size=16)

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = T.flat(batch["text"])
        self.size += len(data)
        self.digest.update(data.tobytes())
        self.digest.update(offsets.tobytes())
        self.digest.update(repr(batch["id"].to_pylist()).encode())
        self.batches.append(batch)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    chunk = Texts()
    for whole in batches:
        for batch in T.slices(whole, "text"):
            chunk.add(batch)
            if chunk.size >= CHUNK_BYTES:
                yield chunk
                chunk = Texts()
    if chunk.batches:
        yield chunk


def requests(chunk: Texts, dealer: Dealer, bits: int) -> Iterator[pa.RecordBatch]:
    """Each distinct pair of the chunk once, and its tokens as places among these, text by text."""
    hashes, places, sizes = (np.concatenate(x) for x in zip(*(tokens(b["text"], bits) for b in chunk.batches), strict=True))
    words, number = np.unique(hashes, return_inverse=True)
    pairs, pair = np.unique(number.astype(U64) << U64(bits) | places, return_inverse=True)
    word, place = words[pairs >> U64(bits)], (pairs & U64((1 << bits) - 1)).astype(np.uint32)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    block = dealer.block(word, place)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(dealer.blocks + 1))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of_token = rank[pair]
    by_block = np.argsort(block[pair].astype(np.uint16 if dealer.blocks < 1 << 16 else np.int64), kind="stable")
    token_edges = np.searchsorted(block[pair][by_block], np.arange(dealer.blocks + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own, at = order[edges[b] : edges[b + 1]], by_block[token_edges[b] : token_edges[b + 1]]
        in_text = text[at]
        first = np.flatnonzero(np.concatenate([[True], in_text[1:] != in_text[:-1]]))
        runs = np.diff(np.append(first, len(in_text)))
        small = of_token[at] - edges[b]
        values = [
            chunk.digest.digest(), b, *_grouped(word[own], place[own]),
            pack(np.diff(in_text[first], prepend=0).astype(np.uint32)), pack(runs.astype(np.uint32)), pack(small.astype(np.uint32)),
        ]
        yield _row(REQUEST, *values)


class Scorer:
    """Probabilities of the pairs of one block; a block without training rows knows the shared state only."""

    def __init__(self, blocks: pa.Table, state: State, settings: Settings):
        self.state, self.bits = state, settings.bits
        self.backing = state.backing()
        self.words, self.root, self.count = np.empty(0, U64), np.empty(0), np.empty(0, np.int64)
        self.pairs, self.own = np.empty(0, U64), np.empty(0)
        for row in blocks.to_pylist():  # one at most
            block = Block(row)
            tables, root = block.tables / settings.sweeps, block.root / settings.sweeps
            self.words, self.count = block.words, block.by_word(block.counts)
            self.root = state.root_probability(block.by_word(block.tables) / settings.sweeps, root)
            self.pairs = block.word.astype(U64) << U64(self.bits) | block.places.astype(U64)
            self.own = np.maximum(block.counts - state.discount * tables, 0) / (state.strength + state.customers[block.places])
        frequent, at = state.place_of_frequent(self.words)
        self.root = np.where(frequent, self._frequent_root()[at] if len(state.frequent) else 0, self.root)
        self.count = np.where(frequent, state.frequent_count[at] if len(state.frequent) else 0, self.count)

    def _frequent_root(self) -> np.ndarray:
        return self.state.root_probability(self.state.frequent_tables, self.state.frequent_root)

    def logs(self, words: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: log10 of its probability and of its word's base, and whether the word is known."""
        state = self.state
        root = np.full(len(words), state.root_probability(np.zeros(1), np.zeros(1))[0])
        count, number = np.zeros(len(words), np.int64), np.full(len(words), -1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            root[known], count[known], number[known] = self.root[at[known]], self.count[at[known]], at[known]
        frequent, at = state.place_of_frequent(words)
        if frequent.any():  # its pairs of this block may be held out all
            root[frequent], count[frequent] = self._frequent_root()[at[frequent]], state.frequent_count[at[frequent]]
        of_pair = np.repeat(np.arange(len(words)), sizes)
        chance = self.backing[places] * root[of_pair]
        if len(self.pairs):
            key = np.maximum(number, 0)[of_pair].astype(U64) << U64(self.bits) | places.astype(U64)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            chance += np.where((self.pairs[at] == key) & (number[of_pair] >= 0), self.own[at], 0)
        base = np.log10((count + 1) / (state.n_tokens + state.n_words + 1))
        return np.log10(chance), base[of_pair], (count > 0)[of_pair]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``base_score`` and ``score``, log10 of the text's probability.

    Null and empty texts have one token, the end. Rows are carried by position, so ids may repeat or be null; other columns are not read. The input is
    read twice and must be the same then.
    """
    settings, dealer, shared = model.settings, model.dealer, model.state
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = source.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield from requests(chunk, dealer, settings.bits)
            T.release()

    def answer(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        T.release()
        scorer, seen, out = Scorer(blocks, shared.value, settings), set(), []
        for i in range(asked.num_rows):
            row = asked.slice(i, 1).to_pylist()[0]
            if row["chunk"] in seen:
                continue
            seen.add(row["chunk"])
            pair = scorer.logs(unpack(row["words"], U64), unpack(row["sizes"], np.uint32), unpack(row["places"], np.uint32).astype(np.int64))
            runs, token = unpack(row["runs"], np.uint32).astype(np.int64), unpack(row["tokens"], np.uint32)
            first = np.cumsum(runs) - runs
            total, base, known = (np.add.reduceat(x[token].astype(float), first) for x in pair)
            out.append(_row(ANSWER, row["chunk"], row["block"], row["texts"], pack(np.concatenate([total, base])), pack(known.astype(np.uint32))))
        T.release()
        return pa.Table.from_batches(out, ANSWER)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            ids, sizes = [], []
            for batch in chunk.batches:
                data, offsets = T.flat(batch["text"])
                ids.append(batch["id"])
                sizes.append(np.diff(T.word_spans(data, offsets, T.NOT_SPACE)[2]) + 1)
            with pa.BufferOutputStream() as sink:
                table = pa.table({"id": pa.concat_arrays(ids), "n_tokens": np.concatenate(sizes)})
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table)
                yield _row(ROWS, chunk.digest.digest(), sink.getvalue().to_pybytes())
            T.release()

    def join(numbered: pa.Table, answers: pa.Table) -> pa.Table:
        T.release()
        if not numbered.num_rows or not answers.num_rows:
            raise ValueError(CHANGED)
        out = []
        for i in range(numbered.num_rows):
            rows = pa.ipc.open_stream(numbered["rows"][i].as_py()).read_all()
            total, base, known = np.zeros(rows.num_rows), np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for a in np.argsort(answers["block"].to_numpy()).tolist():  # always summed in the same order
                texts = np.cumsum(unpack(answers["texts"][a].as_py(), np.uint32), dtype=np.int64)
                found = unpack(answers["sums"][a].as_py(), np.float64).reshape(2, -1)
                total[texts] += found[0]
                base[texts] += found[1]
                known[texts] += unpack(answers["known"][a].as_py(), np.uint32)
            out.append(pa.table([rows["id"], rows["n_tokens"], pa.array(known), pa.array(base), pa.array(total)], names=["id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    asked = source.mapInArrow(ask, REQUEST_DDL)
    answers = asked.groupBy("block").cogroup(model.blocks.groupBy("block")).applyInArrow(answer, ANSWER_DDL)
    numbered = source.mapInArrow(number, "chunk binary, rows binary")
    joined = numbered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        join, f"id {key}, n_tokens long, n_known long, base_score double, score double"
    )
    return joined.withColumnRenamed("id", id_col)


def perplexity(scored: DataFrame) -> DataFrame:
    """``(n_tokens, perplexity, base_perplexity)`` over all rows of ``score``."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
