import random
from collections import Counter

import pytest
from llm import brute
from llm.conftest import by_row, in_order, prose
from pyspark.sql import functions as F

from riskmart.llm import jaccard as J
from riskmart.llm.components import components


def shown(joined):
    return by_row(joined, "doc_id", "n_shingles", "component_id")


def test_components_are_those_of_brute_force(docs, rows):
    found = shown(J.join(docs))
    assert found == in_order(brute.jaccard_components(rows))
    assert len({r[2] for r in found}) < len({r[0] for r in found})


def test_a_table_twice(docs, rows):
    one = docs.coalesce(1)
    assert shown(J.join(one.union(one))) == in_order(brute.jaccard_components(rows * 2))


def near_copies(seed, n):
    """Chains and stars of texts around the threshold, with a passage that many share."""
    rng, passage, texts = random.Random(seed), prose(random.Random(1), 12), []
    for _ in range(n):
        words = prose(rng, rng.randrange(20, 70)).split()
        for _ in range(rng.randrange(1, 8)):
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words) + (f" {passage}" if rng.random() < 0.5 else ""))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_around_the_threshold(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "PARTNERS", 3)  # hubs are salted
    rows = near_copies(seed, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shown(J.join(df)) == in_order(brute.jaccard_components(rows))


def test_one_of_each_component_stays(docs, rows, no_docs):
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    components_ = {c for _, n, c in brute.jaccard_components(rows) if n}
    wordless = [d for d, t in rows if not brute.shingle_set(t)]
    assert in_order([(r.doc_id,) for r in kept.collect()]) == in_order([(c,) for c in [*components_, *wordless]])
    assert J.join(no_docs).count() == J.keep_one(no_docs).count() == 0


def test_long_chains_of_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    random.Random(4).shuffle(chain)
    links = spark.createDataFrame(chain, "a long, b long")
    found = {r.node: r.component for r in components(spark, links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    more = spark.createDataFrame([(5, 102), (200, 201)], "a long, b long")
    again = {r.node: r.component for r in components(spark, more, components(spark, links)).collect()}
    assert again == {**{i: 0 for i in found}, 200: 200, 201: 200}


def links_of(rows):
    """Linked pairs of different sets."""
    sets = list({s for _, t in rows if (s := brute.shingle_set(t))})
    pairs = ((a, b, len(a & b)) for i, a in enumerate(sets) for b in sets[:i] if a & b)
    return [(a, b) for a, b, both in pairs if 100 * both >= 75 * (len(a) + len(b) - both)]


def link_counts(rows):
    linked = Counter(s for pair in links_of(rows) for s in pair)
    return in_order([(d, linked[brute.shingle_set(t)]) for d, t in rows])


@pytest.mark.parametrize("tile", [2, 7, 1000])
def test_every_link_of_a_group_is_counted(spark, tile, monkeypatch):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "COLUMNS", 16)
    rng, base = random.Random(9), prose(random.Random(9), 120).split()
    group = [" ".join([*base[:i], "new" + str(i), *base[i + 1 :]][: rng.randrange(95, 121)]) for i in range(40)]
    rows = [*near_copies(5, 40), *enumerate([*group, *group[:3]], 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    joined = J.join(df)
    assert by_row(joined, "doc_id", "n_links") == link_counts(rows)
    assert shown(joined) == in_order(brute.jaccard_components(rows))
    pairs = [tuple(r) for r in J.linked_classes(df).collect()]
    assert len(pairs) == len(set(pairs)) == len(links_of(rows)) > 2 * len(group)
    listed = Counter(c for pair in pairs for c in pair)
    assert all(r.n_links == listed[r["class"]] for r in joined.collect())


def test_links_of_awkward_texts(docs, rows, no_docs):
    joined = J.join(docs)
    assert by_row(joined, "doc_id", "n_links") == link_counts(rows)
    sets = [(d, brute.shingle_set(t)) for d, t in rows]
    least = {s: min((d for d, other in sets if other == s and d is not None), default=None) for _, s in sets if s}
    assert by_row(joined, "doc_id", "class_id") == in_order([(d, least.get(s, d)) for d, s in sets])
    assert "n_links" not in J.join(docs, components_only=True).columns
    assert shown(J.join(docs, components_only=True)) == shown(J.join(docs))
    assert J.linked_classes(no_docs).count() == 0


def test_one_of_each_group_stays_whatever_the_columns_are_called(docs):
    names = ["class", "copies", "_class", "_id", "component", "node", "_0", "first"]
    clashing = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    kept = J.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert by_row(kept.select(*docs.columns)) == by_row(J.keep_one(docs))
