import pytest
from llm import brute
from llm.conftest import by_row, in_order

from riskmart.llm import decontaminate as D


@pytest.fixture(scope="module")
def items(texts):
    passage = texts[-20].split()
    return [(1, " ".join(passage[:10])), (2, "one two THREE"), (12, texts[45]), (None, "again and again again"), (7, None), (8, "")]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")


def test_counts_are_those_of_brute_force(docs, rows, benchmark, items):
    found = by_row(D.digest(D.scan(docs, benchmark)))
    assert found == in_order(brute.contamination(rows, items))
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_several_blocks_give_what_one_gives(docs, benchmark):
    scan = lambda **k: by_row(D.scan(docs, benchmark, **k))
    assert scan(max_windows=20) == scan()


def test_contaminated_documents_or_spans_go(docs, benchmark, rows):
    hit = {r[0] for r in by_row(D.digest(D.scan(docs, benchmark))) if r[-1]}
    kept = D.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - hit
    cut = D.decontaminate(docs, benchmark, mode="spans")
    assert cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[4] == "" and all(texts[d] == t for d, t in rows if d not in hit)


def test_empty_tables(docs, no_docs, benchmark):
    assert D.scan(no_docs, benchmark).count() == 0
    assert D.scan(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    with pytest.raises(ValueError, match="mode"):
        D.decontaminate(docs, benchmark, mode="words")
