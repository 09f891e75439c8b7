import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from riskmart.llm import language_model as L

SMALL = L.Settings(restaurants=1 << 12)
BLOCKS = L.Settings(restaurants=1 << 12, group_bytes=20_000, sample=1.0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER)) + [None]


def learned(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 != 2


@pytest.fixture(scope="module")
def fitted(docs):
    train = docs.filter(~L.is_held_out("doc_id"))
    return {s: L.fit(train, settings=s) for s in (SMALL, BLOCKS)}


def test_counts_and_base_scores_are_those_of_brute_force(docs, rows, fitted):
    counts = Counter(w for d, t in rows if learned(d) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t in rows:
        words = words_of(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        expected[d, len(words), sum(w in counts for w in words), round(base, 6)] += 1
    for model in fitted.values():
        assert (model.train_tokens, model.state.value.n_words) == (n, v)
        found = L.score(docs, model).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
        assert all(-1e9 < r.score < 0 for r in found)
    held = {r.doc_id: r.held for r in docs.select("doc_id", L.is_held_out("doc_id").alias("held")).collect()}
    assert all(h != learned(d) for d, h in held.items())


def totals(model, places):
    """Sums over all words and an unknown one, by context."""
    state, dealer, table = model.state.value, model.dealer, model.blocks.toArrow()
    numbers = np.array(table["block"].to_pylist())
    scorers = {b: L.Scorer(table.filter(numbers == b), state, model.settings) for b in range(dealer.blocks)}
    words = np.unique(np.concatenate([s.words for s in scorers.values()]))
    assert len(words) == state.n_words
    words = np.append(words, np.uint64(123456789))
    for place in places:
        blocks = dealer.block(words, np.full(len(words), place, np.uint32))
        own = {b: words[blocks == b] for b in np.unique(blocks).tolist()}
        yield sum((10 ** scorers[b].logs(w, np.ones(len(w), np.int64), np.full(len(w), place))[0]).sum() for b, w in own.items())


@pytest.mark.parametrize("settings", [SMALL, BLOCKS])
def test_probabilities_of_a_context_add_up_to_one(fitted, settings):
    customers = fitted[settings].state.value.customers
    for total in totals(fitted[settings], (0, 17, int(np.argmax(customers)), int(np.argmin(customers)))):
        assert abs(total - 1) < 1e-9


def test_frequent_words_are_spread_over_the_blocks(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(f"the w{rng.randrange(500)} of" for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    model = L.fit(df, settings=L.Settings(restaurants=1 << 12, group_bytes=30_000, sample=1.0))
    rows = [L.Block(r.asDict()) for r in model.blocks.collect()]
    words = Counter(w for b in rows for w in b.words.tolist())
    frequent = set(model.state.value.frequent.tolist())
    assert model.dealer.blocks > 3 and len(frequent) >= 2
    assert {w for w, n in words.items() if n > 1} <= frequent and max(words.values()) > 2
    assert all(abs(t - 1) < 1e-9 for t in totals(model, range(0, 4096, 500)))
    one = L.perplexity(L.score(df, L.fit(df, settings=SMALL))).first()
    spread = L.perplexity(L.score(df, model)).first()
    assert (one.n_tokens, one.base_perplexity) == (spread.n_tokens, spread.base_perplexity)
    assert abs(one.perplexity / spread.perplexity - 1) < 0.02


def test_a_context_tells_more_than_words_alone(spark):
    rng = random.Random(2)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}

    def text():
        word, out = f"w{rng.randrange(200)}", []
        for _ in range(rng.randrange(20, 60)):
            out.append(word)
            word = rng.choice(follow[word]) if rng.random() < 0.95 else f"new{rng.randrange(10**6)}"
            follow.setdefault(word, ["w1"])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string").repartition(4)
    model = L.fit(df.filter(~L.is_held_out("doc_id")), settings=SMALL)
    scored = L.score(df, model).filter(L.is_held_out("doc_id"))
    row = L.perplexity(scored).first()
    assert row.perplexity < 0.4 * row.base_perplexity
    again = L.score(df.repartition(7), L.fit(df.repartition(3).filter(~L.is_held_out("doc_id")), settings=SMALL))
    same = L.score(df, model).join(again.withColumnRenamed("score", "other"), "doc_id").filter(F.abs(F.col("score") - F.col("other")) > 1e-9)
    assert same.count() == 0


def test_draws_follow_the_seating_of_customers_one_by_one():
    discount, c, a, b = 0.6, 5, 0.8, 0.3
    weight = Counter()

    def seat(sizes, left, w):
        if not left:
            weight[len(sizes)] += w
            return
        seat([*sizes, 1], left - 1, w * (a + b * len(sizes)))
        for i, n in enumerate(sizes):
            seat([*sizes[:i], n + 1, *sizes[i + 1 :]], left - 1, w * (n - discount))

    seat([1], c - 1, 1.0)
    n = 40_000
    rng = np.random.default_rng(5)
    drawn = L.drawn_tables(rng, np.full(n, c), np.full(n, a), np.full(n, b), discount, L.stirling(discount))
    for t in range(1, c + 1):
        share = weight[t] / sum(weight.values())
        assert abs((drawn == t).mean() - share) < 4 * math.sqrt(share * (1 - share) / n) + 1e-3
    many = L.drawn_tables(rng, np.array([1, 2, 10**9]), np.ones(3), np.zeros(3), discount, L.stirling(discount))
    assert many[0] == 1 and 1 <= many[2] <= 10**9


def test_awkward_rows_and_empty_tables(spark, docs, no_docs, fitted):
    nothing = L.fit(no_docs, settings=SMALL)
    found = L.score(docs.limit(5), nothing).collect()
    assert {(r.n_known, r.base_score, round(r.score, 9)) for r in found} == {(0, 0.0, 0.0)}
    assert L.score(no_docs, fitted[SMALL]).count() == 0
    odd = spark.createDataFrame([("a", None), (None, ""), ("a", "x" * 300_000), ("a", None)], "doc_id string, text string")
    assert Counter(r.n_tokens for r in L.score(odd, fitted[BLOCKS]).collect()) == Counter({1: 3, 2: 1})
