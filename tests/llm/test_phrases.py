import random
import re
from collections import Counter, defaultdict

import pytest
from llm import brute
from llm.conftest import by_row, in_order

from riskmart.llm import phrases as P


def plain(rows, least, top):
    """From the contract; rows are (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for size in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return best(f, n, least, top)


def best(f, n, least, top):
    out = []
    for lang, counts in f.items():
        candidates = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        covered = set()
        for w, a in candidates.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner = w[i : i + size]
                    if inner in candidates and 100 * a >= 80 * candidates[inner]:
                        covered.add(inner)
        rows = []
        for w, a in candidates.items():
            cuts = [(2000000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if w not in covered:
                rows.append((-score, -a, " ".join(w).encode(), " ".join(w), a, counts[w[:k]], counts[w[k:]], n[lang], score))
        out += [(lang, i, *r[3:]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(4)
    vocabulary = ["the", "of", "New", "york", "city", "a", "b", "été", "日本", "it's", "x\x00y", "\x85", "c-d"]
    made = []
    for _ in range(120):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\t", "\n", ";;", "\x0c", "  "]) for _ in range(rng.randrange(60))]
        made.append((" ".join(words), rng.choice(["en", "fr", None, ""])))
    made += [("New York City is new york city of new york", "en")] * 40  # a hot group of copies
    made += [(" ".join(rng.choice(vocabulary) for _ in range(40_000)), "en"), (None, "en"), ("", "xx"), (". , !", "yy"), ("one", None), ("und it und it", "und")]
    return made + [(t, "de") for t in texts if t is None or len(t) < 20_000]


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame([(*r, 5, "w", 1.0) for r in rows], "text string, lang string, n int, phrase string, shard double")
    return df.repartition(5).cache()


@pytest.mark.parametrize("least,top,groups,chunk", [(30, 2000, 1, 8_000_000), (3, 40, 4, 20_000)])
def test_phrases_are_those_of_brute_force(table, rows, least, top, groups, chunk):
    found = P.collocations(table, least, top, groups=groups, chunk_bytes=chunk)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert by_row(found) == in_order(plain(rows, least, top))


def test_windows_add_up(table, rows):
    counts = {(r.lang, r.phrase): r.f for r in P.phrase_counts(P.frequent_windows(table, 5, groups=3)).collect()}
    expected = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            expected.update(("und" if lang is None else lang, " ".join(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
            expected["und" if lang is None else lang, ""] += len(words)
    assert counts == {k: v for k, v in expected.items() if v >= 5 or (k[1] == "" and v)}


def test_arithmetic_beyond_64_bits(spark):
    big = 9 * 10**18
    f = {"en": Counter({("a",): big, ("b",): big - 1, ("a", "b"): big - 7, ("c",): 10, ("c", "a"): 5, ("a", "b", "c"): big - 9, ("b", "c"): 8 * 10**18})}
    n = Counter({"en": big})
    rows = [("en", 0, "", big)] + [("en", len(w), " ".join(w), a) for w, a in f["en"].items()]
    counts = spark.createDataFrame(rows, "lang string, length int, phrase string, f long")
    assert by_row(P.best_phrases(counts, 5, 10)) == in_order(best(f, n, 5, 10))


def test_empty_tables(table):
    assert P.collocations(table.limit(0)).count() == 0
    assert P.collocations(table.filter("text is null")).count() == 0
