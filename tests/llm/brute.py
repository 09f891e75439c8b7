"""Plain one-machine versions of the operators, written from their contracts."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def contamination(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LOWER))
        n = min(width, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (key := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        named = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(words), len(hit), len(named), sha(",".join(named).encode()), bool(hit)))
    return out


def repeats(rows, length=200, keep="none"):
    """Per row: bytes, bytes removed, runs, digest of the rest."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for rank, i in enumerate(order):
        for p in range(len(texts[i]) - length + 1):
            seen[texts[i][p : p + length]].append((rank, p))
    out = []
    for rank, i in enumerate(order):
        data = texts[i]
        change = np.zeros(len(data) + 1, int)
        for p in range(len(data) - length + 1):
            places = seen[data[p : p + length]]
            if len(places) > 1 and (keep == "none" or min(places) != (rank, p)):
                change[p] += 1
                change[p + length] -= 1
        covered = np.cumsum(change[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) > 0).sum())
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out.append((rows[i][0], len(data), int(covered.sum()), runs, sha(kept)))
    return out


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]
