import hashlib

import numpy as np
from llm.brute import sha
from llm.conftest import by_row, in_order

from riskmart.llm import fingerprint as P


def test_anchors_do_not_depend_on_what_stands_around(texts):
    inner = texts[-1][:3000].encode()
    alone = set(P.syncmers(np.frombuffer(inner, np.uint8)).tolist())
    data = b"something before it, " + inner + b" and behind"
    moved = {p - 21 for p in P.syncmers(np.frombuffer(data, np.uint8)).tolist()}
    assert alone == {p for p in moved if 0 <= p <= len(inner) - P.K}
    assert 0.15 < len(alone) / len(inner) < 0.3


def test_every_row_with_its_edited_text(docs, rows, no_docs):
    rows = [(d, t or "") for d, t in rows]
    found = P.compare_with_edits(docs).collect()
    distinct = {d: t for d, t in rows if d is not None}
    order = sorted(distinct)
    following = {d: distinct[order[i + 1]] for i, d in enumerate(order[:-1])}  # ids once only
    repeated = {d for d in order if sum(d == e for e, _ in rows) > 1}
    by_text = {}
    for r in found:
        if r.doc_id in following and r.doc_id not in repeated:
            text, nxt = distinct[r.doc_id], following[r.doc_id]
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[:half]
            assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited.encode()))
            assert [r.fingerprint, r.edited_fingerprint] == P.fingerprints([text.encode(), edited.encode()])
            by_text.setdefault(text, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert len(found) == len(rows) and P.compare_with_edits(no_docs).count() == 0
    first = next(t for d, t in rows if d is None)
    last = next(r for r in found if r.doc_id == order[-1])
    text = distinct[order[-1]]
    half = len(text) // 2
    assert last.edited_sha256 == hashlib.sha256((text[: len(text) - half] + first[:half]).encode()).hexdigest()
    marks = by_row(P.fingerprint(docs))
    assert marks == in_order(list(zip((d for d, _ in rows), P.fingerprints([t.encode() for _, t in rows]), strict=True)))


def test_likeness():
    base = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"term{i * 7}" for i in range(400))
    a, b, c, e = (P.parse(m) for m in P.fingerprints([base.encode(), other.encode(), (base[:1500] + other[:1200]).encode(), b""]))
    assert P.likeness(a, a) == 1 and P.likeness(e, e) == 1 and P.likeness(a, e) == 0
    assert P.likeness(a, b) < 0.1 < 0.3 < P.likeness(a, c) < 0.9
    assert P.likeness(a, c) == P.likeness(c, a) or abs(P.likeness(a, c) - P.likeness(c, a)) < 0.1


def test_long_texts_are_compared_by_all_anchors(spark):
    """A passage of two long texts counts by its length, and a small edit shows."""
    words = [f"word{i * 7919 % 100003}" for i in range(60_000)]
    base, passage = " ".join(words[:20_000]), " ".join(words[20_000:20_100])
    other, edit = " ".join(words[30_000:50_000]), base.replace(words[9], "changed")
    a, b = f"{base} {passage}", f"{passage} {other}"
    rows = [(0, a), (1, b), (2, edit), (3, base)]
    found = {r.doc_id: r for r in P.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def exact(x, y):
        sets = [{t[i : i + P.K] for i in P.syncmers(np.frombuffer(t, np.uint8)).tolist()} for t in (x.encode(), y.encode())]
        return 2 * len(sets[0] & sets[1]) / (len(sets[0]) + len(sets[1]))

    assert 0 < found[0].near_next < 0.02
    assert 0.99 < found[2].near_next < 1 and abs(found[2].near_next - exact(edit, base)) < 1e-4
    half = len(base) // 2
    edited = base[: len(base) - half] + a[:half]
    assert found[3].near_edited <= exact(base, edited) + 1e-12
    assert abs(found[2].near_edited - exact(edit, P.edited(edit, base))) < 0.02
    assert [found[i].fingerprint for i in range(4)] == P.fingerprints([t.encode() for _, t in rows])
