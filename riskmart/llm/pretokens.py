"""Pre-tokens of byte-level BPE: the stretches of text that merges never cross, found for many texts at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Whether a pre-token
starts at a character depends on its neighbours alone, so the starts are found without a scan from left to right:
a class change starts one; one space belongs to what follows it; the last of several white-space characters before text is
set apart from the others; and a contraction after a letter, digit, other white space or at the beginning is one by itself.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, DIGIT, BLANK, SPACE, EDGE = range(6)
# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = BLANK
    table[32] = SPACE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each pre-token, and n + 1 offsets into these by text. Pre-tokens lie without gaps."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[points]
    edges = np.searchsorted(places, offsets)
    first, last = edges[:-1][np.diff(edges) > 0], edges[1:][np.diff(edges) > 0] - 1
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first], after[last] = EDGE, EDGE
    white = (kind == BLANK) | (kind == SPACE)
    run = white & ((before == BLANK) | (before == SPACE))
    start = np.where(white, ~run | ((after != BLANK) & (after != SPACE) & (after != EDGE)), before != kind)
    start &= white | (before != SPACE)
    _contractions(points, kind, start, last)
    starts = places[start]
    return starts, np.searchsorted(starts, offsets)


def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, last: np.ndarray) -> None:
    at = np.flatnonzero((points == ord("'")) & start)
    if not len(at):
        return
    end = last[np.searchsorted(last, at)]  # last character of the text
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    one = np.where(at + 1 <= end, padded[at + 1], 0)
    two = np.where(at + 2 <= end, padded[at + 2], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    found = short | long
    start[at[found] + 1] = False
    behind = at[found] + np.where(short, 2, 3)[found]
    inside = behind <= end[found]
    behind = behind[inside]
    start[behind[kind[behind] == LETTER]] = True
