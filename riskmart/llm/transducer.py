"""Byte-level BPE compiled to a deterministic transducer whose transitions carry emitted-token counts.

A state stands for all beginnings of a pre-token that go on alike. It holds the longest end of what was read that may
still be the beginning of a longer vocabulary token, and for each place in it the token that BPE has last there, with
its count relative to the state's. Reading a byte looks for the one vocabulary token that ends here and that BPE puts after the token
before it (two tokens may be neighbours if BPE gives just these two for their joined bytes); the transition's
weight is the change of the count. A byte that starts a pre-token is read from the initial state.

Transitions are compiled when first taken and kept in a table that numpy steps through for thousands of chunks of
text at once. A chunk that holds a start of a pre-token maps every state to the same one behind that start; so the chunks' maps are
composed by carrying the state over the few chunks that begin inside a pre-token.
"""

from __future__ import annotations

import json

import numpy as np

from riskmart.llm.pretokens import pretokens

#: A table of this many states is dropped and compiled anew, so that memory stays bounded on any text.
MAX_STATES = 240_000
_START = (b"", (None,), (0,))


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks by pair of byte strings, and the added tokens that split a text."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        alphabet = byte_alphabet()
        read = lambda token: bytes(alphabet[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(read(a), read(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        self.added = sorted((t["content"].encode() for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def encode(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(ranked)
            if best == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.beginnings = {t[:i] for t in vocabulary.tokens for i in range(len(t) + 1)}
        self._neighbours: dict[tuple, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states = [_START]
        self.ids = {_START: 0}
        self.column = np.full(256, -1, np.int64)
        self.width = 0
        self.next = np.full((1 << 12, 64), -1, np.int32)
        self.weight = np.zeros((1 << 12, 64), np.int8)

    def _may_follow(self, before: bytes | None, token: bytes) -> bool:
        key = (before, token)
        if (known := self._neighbours.get(key)) is None:
            if len(self._neighbours) > 300_000:
                self._neighbours.clear()
            whole = [token] if before is None else [before, token]
            known = self._neighbours[key] = self.vocabulary.encode(b"".join(whole)) == whole
        return known

    def read(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state behind a byte, and the change of the count."""
        seen, last, counts = state
        seen += bytes([byte])
        for size in range(len(seen), 0, -1):
            token = seen[-size:]
            if token in self.vocabulary.tokens and self._may_follow(last[-size], token):
                break
        else:
            raise AssertionError("every byte is a token")
        weight = counts[-size] + 1
        last, counts = (*last, token), tuple(c - weight for c in (*counts, weight))
        cut = next(i for i in range(len(seen) + 1) if seen[i:] in self.beginnings)
        return (seen[cut:], last[cut:], counts[cut:]), weight

    def _compile(self, state: int, byte: int) -> None:
        new, weight = self.read(self.states[state], byte)
        if (target := self.ids.get(new)) is None:
            target = self.ids[new] = len(self.states)
            self.states.append(new)
        if self.column[byte] < 0:
            self.column[byte], self.width = self.width, self.width + 1
        rows, columns = self.next.shape
        if len(self.states) > rows or self.width > columns:
            grown = (rows * 2 if len(self.states) > rows else rows, columns * 2 if self.width > columns else columns)
            for name, empty in (("next", -1), ("weight", 0)):
                old = getattr(self, name)
                new_table = np.full(grown, empty, old.dtype)
                new_table[:rows, :columns] = old
                setattr(self, name, new_table)
        self.next[state, self.column[byte]] = target
        self.weight[state, self.column[byte]] = weight

    def _step(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = self.column[read]
        target = self.next[states, columns]
        missing = np.flatnonzero((target < 0) | (columns < 0))
        if len(missing):
            for s, b in set(zip(states[missing].tolist(), read[missing].tolist(), strict=True)):
                self._compile(s, b)
            columns = self.column[read]
            target = self.next[states, columns]
        return target, self.weight[states, columns]

    def counts(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Tokens of each text."""
        n = len(data)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64)
        if len(self.states) > MAX_STATES:
            self._clear()
        starts, _ = pretokens(data, offsets)
        chunks = -(-n // chunk)
        text = np.zeros(chunks * chunk, np.uint8)
        text[:n] = data
        begins = np.zeros(chunks * chunk, bool)
        begins[starts] = True
        text, begins = text.reshape(chunks, chunk).T.copy(), begins.reshape(chunks, chunk).T.copy()
        weights = np.zeros((chunk, chunks), np.int8)
        # Each chunk by itself from its first start of a pre-token on: behind it, the state is the same whatever came before.
        known, state = np.zeros(chunks, bool), np.zeros(chunks, np.int32)
        for i in range(chunk):
            known |= begins[i]
            state[begins[i]] = 0
            if known.all():
                state, weights[i] = self._step(state, text[i])
            else:
                at = np.flatnonzero(known)
                state[at], weights[i, at] = self._step(state[at], text[i, at])
        self._compose(text, begins, weights, known, state)
        total = np.concatenate([[0], np.cumsum(weights.T.reshape(-1)[:n], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _compose(self, text, begins, weights, known, state) -> None:
        """Read the beginnings of chunks that lie inside a pre-token, from the state that the chunk before ends in.

        Chunks whose final state is known go first, all at once; each round makes known those behind them.
        """
        open_ = np.flatnonzero(~begins[0])
        open_ = open_[open_ > 0]
        while len(open_):
            ready = open_[known[open_ - 1]]
            now, s = ready, state[ready - 1].copy()
            for i in range(len(text)):
                go = ~begins[i, now]
                now, s = now[go], s[go]
                if not len(now):
                    break
                s, weights[i, now] = self._step(s, text[i, now])
            else:
                state[now], known[now] = s, True  # chunks without any start: their map is no constant
            open_ = np.setdiff1d(open_, ready, assume_unique=True)
