"""Collocations: phrases of two to four words that occur together far more often than their halves do apart.

Only the longest windows are counted. Each word of a piece begins one window, itself and the three words that follow it (lead columns), padded where the piece ends;
every shorter phrase is a prefix of windows, and its count the sum of theirs. Spark's ROLLUP over (lang, w1, w2, w3, w4) takes these sums.

A window whose four words are rarer together than ``least`` can't be a candidate, only its prefixes can. So before the ROLLUP the windows are
summed where the hash of all four words leads, and the rare ones lose their last word; the remaining three meet where their hash leads, and so on. Each count is
complete where it is judged, nothing is lost, and the ROLLUP is left with few rows: frequent phrases, and sums of what is rare.

A task sends its windows packed, once per distinct window, with the words that they use; a key, however frequent, costs a receiver one entry per
sending chunk. The receivers' number follows the size of the input. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.bpe import bucket_edges, gather, pack, unpack
from riskmart.llm.components import groups_for, store

U64 = np.uint64
#: Text of a chunk that is packed together, and of the windows that one receiving group should hold.
CHUNK_BYTES = 8_000_000
GROUP_BYTES = 12_000_000
LONGEST = 4
#: Where pieces end, the least count of a candidate, how many are returned, and the share of a phrase's count that a longer one must have to stand for it.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LEAST = 30
TOP = 2000
COVERED_PERCENT = 80
NO_LANGUAGE = "und"

IS_BREAK = T.byte_table(BREAKS)
IS_WORD = ~T.byte_table(b" \t" + BREAKS)

WORD_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]
MESSAGE = pa.schema(
    [("lang", pa.string()), ("shard", pa.int32())]
    + [(c, pa.binary()) for c in ("lengths", "words", "window", "open", "kept", "done")]
)
MESSAGE_DDL = "lang string, shard int, lengths binary, words binary, window binary, open binary, kept binary, done binary"
ROW = pa.schema([("lang", pa.string())] + [(c, pa.string()) for c in WORD_COLUMNS] + [("n", pa.int64())])
ROW_DDL = "lang string, " + ", ".join(f"{c} string" for c in WORD_COLUMNS) + ", n long"


class Entries:
    """Windows and prefixes of windows of one language, with the words that they name by number from 1; 0 is padding.

    ``open`` counts occurrences not yet given to a longer phrase, ``kept`` those that are; ``done`` marks phrases that are only passed on.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, window: np.ndarray, open_: np.ndarray, kept: np.ndarray, done: np.ndarray):
        self.words, self.lengths, self.window, self.open, self.kept, self.done = words, lengths, window, open_, kept, done

    def word_hashes(self) -> np.ndarray:
        ends = np.cumsum(self.lengths)
        hashes = T.stretch(T.running_bytes(self.words), ends - self.lengths, ends)
        return np.concatenate([np.zeros(1, U64), hashes])

    def take(self, rows: np.ndarray) -> Entries:
        return Entries(self.words, self.lengths, self.window[:, rows], self.open[rows], self.kept[rows], self.done[rows])

    def used_words(self) -> Entries:
        """The same with the words that occur, renumbered."""
        used, window = np.unique(self.window, return_inverse=True)
        window = window.reshape(self.window.shape)
        if not len(used) or used[0]:  # no padding among them
            used, window = np.concatenate([[0], used]), window + 1
        used = used[1:].astype(np.int64) - 1
        starts = np.cumsum(self.lengths) - self.lengths
        words = gather(self.words, starts[used], self.lengths[used])
        return Entries(words, self.lengths[used], window.astype(np.uint32), self.open, self.kept, self.done)


def prefix_hashes(words: np.ndarray, window: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(window.shape[1], U64)
    for column in window[:length]:
        h = T.mix(h * U64(0x9FB21C651E98DF25) + words[column] + U64(1))
    return h


def summed(entries: Entries, hashes: np.ndarray) -> tuple[Entries, np.ndarray]:
    """One entry per hash, in the hashes' order."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(order) else np.empty(0, np.int64)
    out = entries.take(order[first])
    if len(first):
        out.open, out.kept = (np.add.reduceat(x[order], first) for x in (entries.open, entries.kept))
    return out, hashes[first]


def messages(lang: str, entries: Entries, hashes: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Packed entries by the range that their hash lies in; ``hashes`` ascend."""
    edges = bucket_edges(hashes, shards)
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        part = entries.take(np.arange(edges[shard], edges[shard + 1]))
        w = part.window.astype(np.uint64)
        bits = U64(int(w.max()).bit_length())
        if int(bits) * 3 <= 64:  # an order in which the columns shrink well
            part = part.take(np.argsort((((w[0] << bits) | w[1]) << bits) | w[2]))
        part = part.used_words()
        packed = [pack(x) for x in (part.lengths.astype(np.uint32), part.window.astype(np.uint32).reshape(-1), part.open, part.kept, part.done)]
        words = zstandard.ZstdCompressor(level=3).compress(part.words.tobytes())
        values = [lang, shard, packed[0], words, *packed[1:]]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, MESSAGE, strict=True)], schema=MESSAGE)


def united(group: pa.Table) -> Entries:
    """The entries of all messages over one list of words."""
    texts, lengths, hashes, windows, sums = [], [], [], [], [[], [], []]
    for row in group.to_pylist():
        length = unpack(row["lengths"], np.uint32).astype(np.int64)
        words = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["words"]), np.uint8)
        window = unpack(row["window"], np.uint32).reshape(LONGEST, -1)
        own = Entries(words, length, window, None, None, None).word_hashes()
        distinct, first = np.unique(own[1:], return_index=True)
        texts.append(gather(words, (np.cumsum(length) - length)[first], length[first]))
        lengths.append(length[first])
        hashes.append(distinct)
        windows.append((own, window))
        for found, name, kind in zip(sums, ("open", "kept", "done"), (np.int64, np.int64, bool), strict=True):
            found.append(unpack(row[name], kind))
    every, length = np.concatenate(hashes), np.concatenate(lengths)
    distinct, first = np.unique(every, return_index=True)
    words = gather(np.concatenate(texts), (np.cumsum(length) - length)[first], length[first])
    renamed = []
    for own, window in windows:
        names = np.concatenate([[0], np.searchsorted(distinct, own[1:]) + 1]).astype(np.uint32)
        renamed.append(names[window])
    return Entries(words, length[first], np.concatenate(renamed, axis=1), *(np.concatenate(x) for x in sums))


def judged(entries: Entries, length: int, least: int) -> tuple[Entries, Entries]:
    """Frequent phrases of this length, and all entries as prefixes one word shorter.

    All entries of a phrase of this length are here, so its count is complete.
    """
    whole, _ = summed(entries, prefix_hashes(entries.word_hashes(), entries.window, length))
    count = whole.open + whole.kept
    frequent = (whole.window[length - 1] > 0) & (count >= least)
    phrases = whole.take(np.flatnonzero(frequent & (whole.open > 0)))
    phrases.done, phrases.kept = np.ones(len(phrases.open), bool), np.zeros(len(phrases.open), np.int64)
    whole.kept = np.where(frequent, count, whole.kept)
    whole.open = np.where(frequent, 0, whole.open)
    whole.window = whole.window.copy()
    whole.window[length - 1 :] = 0
    return phrases, whole


class Chunk:
    """Texts of one language: distinct words, and the place of each in its piece."""

    def __init__(self):
        self.size = 0
        self.hashes, self.lengths, self.bytes, self.tokens, self.follows = [], [], [], [], []

    def add(self, column: pa.Array) -> None:
        data, offsets = T.flat(column)
        data = T.LOWER[data]
        starts, ends, of_text = T.word_spans(data, offsets, IS_WORD)
        self.size += len(data)
        if not len(starts):
            return
        hashes = T.stretch(T.running_bytes(data), starts, ends)
        piece = np.cumsum(IS_BREAK[data])[starts] + T.owners(of_text)  # rises at each break and text
        follows = np.zeros(len(starts), bool)
        follows[:-1] = piece[1:] == piece[:-1]
        distinct, first = np.unique(hashes, return_index=True)
        self.hashes.append(distinct)
        self.lengths.append((ends - starts)[first])
        self.bytes.append(gather(data, starts[first], self.lengths[-1]))
        self.tokens.append(hashes)
        self.follows.append(follows)

    def windows(self) -> tuple[Entries, np.ndarray] | None:
        """Distinct windows with their counts, in the order of their hashes."""
        if not self.tokens:
            return None
        every, length = np.concatenate(self.hashes), np.concatenate(self.lengths)
        distinct, first = np.unique(every, return_index=True)
        words = gather(np.concatenate(self.bytes), (np.cumsum(length) - length)[first], length[first])
        tokens = (np.searchsorted(distinct, np.concatenate(self.tokens)) + 1).astype(np.uint32)
        follows = np.concatenate(self.follows)
        window = np.zeros((LONGEST, len(tokens)), np.uint32)
        window[0], inside = tokens, np.ones(len(tokens), bool)
        for k in range(1, LONGEST):  # lead columns: word k places on, while the piece lasts
            inside = inside[:-1] & follows[k - 1 : len(tokens) - 1]
            window[k, : len(inside)] = np.where(inside, tokens[k:], 0)
        n = len(tokens)
        entries = Entries(words, length[first], window, np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool))
        return summed(entries, prefix_hashes(np.concatenate([np.zeros(1, U64), distinct]), window, LONGEST))


def frequent_windows(
    docs: DataFrame,
    least: int = LEAST,
    text_col: str = "text",
    lang_col: str = "lang",
    groups: int | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(lang, w1, w2, w3, w4, n)``: windows whose phrases occur ``least`` times at least, and sums of all others.

    The sum over the windows with a prefix is that prefix's count, for every prefix of at least ``least`` occurrences; the sum over a language is
    the number of its words. Missing words are empty strings. A null language is ``und``; null and empty texts have no words.
    """
    source = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text")
    )
    shards = groups or groups_for(docs, GROUP_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, Chunk] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, chunk in chunks.items():
                if (found := chunk.windows()) is not None:
                    yield from messages(lang, *found, shards)
            chunks.clear()
            T.release()

        for whole in batches:
            for batch in T.slices(whole, "text"):
                names = batch["lang"].dictionary_encode()
                for code, lang in enumerate(names.dictionary.to_pylist()):
                    own = batch["text"].filter(pa.array(names.indices.to_numpy() == code))
                    chunks.setdefault(lang, Chunk()).add(own)
                if sum(c.size for c in chunks.values()) >= chunk_bytes:
                    yield from sent()
        yield from sent()

    def shorten(length: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            T.release()
            lang, entries = key[0].as_py(), united(group)
            rest = entries.take(np.flatnonzero(~entries.done))
            phrases, prefixes = judged(rest, length, least)
            parts = list(messages(lang, *summed(prefixes, prefix_hashes(prefixes.word_hashes(), prefixes.window, length - 1)), shards))
            for done in (phrases, entries.take(np.flatnonzero(entries.done))):
                if len(done.open):  # they go on, in the same share of the shards
                    place = np.full(len(done.open), (key[1].as_py() << 64) // shards + 1, U64)
                    parts += messages(lang, done, place, shards)
            T.release()
            return pa.Table.from_batches(parts, MESSAGE)

        return run

    def rows(key: tuple, group: pa.Table) -> pa.Table:
        T.release()
        entries = united(group)
        phrases, rare = judged(entries.take(np.flatnonzero(~entries.done)), 1, least)
        out = [_rows(key[0].as_py(), part) for part in (phrases, entries.take(np.flatnonzero(entries.done)))]
        if total := int(rare.open.sum()):
            out.append(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([key[0].as_py(), *[""] * LONGEST, total], ROW, strict=True)], schema=ROW))
        return pa.Table.from_batches(out, ROW)

    sent = source.mapInArrow(count, MESSAGE_DDL)
    for length in range(LONGEST, 1, -1):
        sent = sent.groupBy("lang", "shard").applyInArrow(shorten(length), MESSAGE_DDL)
    return sent.groupBy("lang", "shard").applyInArrow(rows, ROW_DDL)


def _rows(lang: str, entries: Entries) -> pa.RecordBatch:
    offsets = np.concatenate([[0, 0], np.cumsum(entries.lengths)]).astype(np.int64)  # number 0 is the empty string
    words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(entries.words))])
    columns = [words.take(pa.array(w.astype(np.int64))).cast(pa.string()) for w in entries.window]
    langs = pa.array([lang]).take(pa.array(np.zeros(len(entries.open), np.int64)))
    return pa.RecordBatch.from_arrays([langs, *columns, pa.array(entries.open)], schema=ROW)


def phrase_counts(windows: DataFrame) -> DataFrame:
    """``(lang, length, phrase, f)``: sums over ever shorter prefixes; length 0 is the number of words of the language."""
    totals = windows.rollup("lang", *WORD_COLUMNS).agg(F.grouping_id().alias("rolled"), F.sum("n").alias("f"))
    length = F.lit(LONGEST) - F.bit_count("rolled").cast("int")
    last = F.element_at(F.array(F.lit("."), *WORD_COLUMNS), length + 1)  # padding ends no phrase
    words = F.concat_ws(" ", *WORD_COLUMNS)
    return totals.filter((length >= 0) & (last != "")).select("lang", length.alias("length"), words.alias("phrase"), "f")


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    groups: int | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are the phrases of two to four words with ``a`` of at least ``least`` occurrences inside pieces. A cut into two parts with counts l and r
    scores floor(2000000 a / (l + r)); the lowest cut counts, the first of equal ones. A candidate inside a longer one of at least 80 % of its count
    is left out. Higher scores, then counts, then phrases in byte order come first.
    Other columns are not read. An empty table gives no rows.
    """
    windows = store(frequent_windows(docs, least, text_col, lang_col, groups, chunk_bytes), "windows")
    return best_phrases(store(phrase_counts(windows), "phrases"), least, top)


def best_phrases(counts: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The collocations among counted phrases, from ``(lang, length, phrase, f)``. Counts are 64-bit, their products exact decimals."""
    candidates = counts.filter((F.col("length") >= 2) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest")
    )
    known = counts.filter("length > 0")
    of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.filter("length > 2").select(
        "lang",
        "a",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("length") - 1),
                    lambda size: F.transform(F.sequence(F.lit(1), F.col("length") - size + 1), lambda start: part(start, size)),
                )
            )
        ).alias("phrase"),
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = _exact(F.col("longer")) * 100 >= _exact(F.col("a")) * COVERED_PERCENT
    standing = scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    best = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    few = standing.withColumn("place", F.row_number().over(dealt)).filter(F.col("place") <= top)  # no language meets in one task whole
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    n = counts.filter("length = 0").select("lang", F.col("f").alias("n"))
    return (
        ranked.filter(F.col("rank") <= top)
        .join(n, "lang")
        .select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    )
