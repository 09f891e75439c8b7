import random
import re
from itertools import permutations

import numpy as np
import pytest
from llm.conftest import by_row, in_order

from riskmart.llm import filter_audit as A


def plain_audit(rows, labels):
    """From the contract, document by document and order by order; rows are (id, text, part)."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    docs = []
    for d, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if d is not None and least.get(text, d) < d else set()
        docs.append((part or "", fails, d in good, d in toxic))
    out, total = [], {}
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in own)
                alone = sum(x[0] == {f} for x in own)
                out.append([part, order, step, len(left), len(gone), failing - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)])
                total[part, f] = total.get((part, f), 0) + len(gone)
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in enumerate(texts)]
    long = " ".join(f"word{i}" for i in range(150))
    rows += [(900, long, "en"), (901, long, "fr"), (902, long + " $", "fr"), (903, long.upper(), "en"), (904, " ".join(["a"] * 120), "en")]
    rows += [rows[-4], rows[-4], (None, long, "en"), (None, None, "en"), (905, "\x0b\x0c\r" + long.replace(" ", "\x0b") + "\x85", "de")]
    df = spark.createDataFrame([(*r, 7, True, "x") for r in rows], "doc_id long, text string, lang string, mask int, part boolean, n string")
    return rows, df.repartition(5)


LABELS = [(d, d % 3 % 2, int(d % 5 == 0)) for d in range(0, 60, 2)] + [(900, 1, 0), (900, 0, 1), (901, 1, 1), (None, 1, 1), (902, None, 1), (77777, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_step_is_that_of_brute_force(documents, labels):
    rows, df = documents
    assert by_row(A.audit(df, labels)) == in_order(plain_audit(rows, LABELS))


def test_a_walk_gives_what_counting_each_subset_gives():
    counts = np.random.default_rng(3).integers(0, 50, (4, 32, 3))
    left = A.survivors(counts)
    masks = np.arange(32)
    for subset in range(32):
        assert (left[:, subset] == counts[:, masks & subset == 0].sum(axis=1)).all()
    for p in range(4):  # each order removes in all what all filters together remove
        assert A.shapley(left[p, :, 0]).sum() == 120 * (left[p, 0, 0] - left[p, 31, 0])


def test_a_hot_group_of_copies_and_repeated_rows(spark, labels):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text", "'en' as lang")
    found = A.failed_filters(df.union(df.limit(10))).groupBy("mask").agg({"n": "sum"})
    assert {r[0] & 16: r[1] for r in found.collect()}.keys() == {0, 16}
    assert sum(r[1] for r in found.collect() if r[0] & 16) == sum(r[1] for r in A.failed_filters(df.union(df.limit(10))).filter("mask >= 16").groupBy().agg({"n": "sum"}).selectExpr("0", "*").collect()) >= 999


def test_empty_tables(documents, labels, spark):
    _, df = documents
    assert A.audit(df.limit(0), labels).count() == 0
    bare = A.audit(df, labels.limit(0))
    assert bare.groupBy().sum("good_lost", "toxic_lost").first()[:] == (0, 0) and bare.count() % 600 == 0
