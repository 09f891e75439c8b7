"""URL verdicts and WARC archives."""

import gzip
import hashlib
import re

import pytest
from llm.conftest import by_row, in_order

from riskmart.llm import queries, urls, warc

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1", "https://example.org/en/12", "https://example.org/en",
    "https://a.b.org?x=/es/", "https://org/", "http://notorg.com/de/", "http://com/fr", "http://x.com/fr/#a", "http://ÄÖ.com/fr/?q",
    "http://cheap-pills.example.net/en/4", "http://library.example.net/en/4", "a://b://c/d", "http://h\n.com/de/\nx", "ftp://u@x.ORG:80/p",
]


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>the same long page</p>" * 10
    htmls = [None, "", "short", "short", big, big, big + " ", "é日本" * 50, "x" * 100, "x" * 99, "x" * 100, "x" * 99, big, big, "\r\n\r\n" * 40]
    rows = [(i * 3 % 41, URLS[i % len(URLS)], h) for i, h in enumerate(htmls)]
    rows += [(rows[4][0], "http://again.com", big), (None, "http://none", big), (None, None, "nobody" * 30)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fitting = []
    for kind, text in urls.RULES:
        domain, _, rest = text.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fitting.append((len(text), text, kind))
    return max(fitting)[1:] if fitting else (None, None)


def test_host_path_and_rule_of_every_url(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    judged = urls.judge(df, urls.labelled_urls(spark))
    for r in judged.collect():
        host, path = parts(URLS[r.page_id])
        text, kind = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text), URLS[r.page_id]
        assert r.verdict == (kind or ("block" if r.score >= 0.5 else "allow"))
    by_id = {r.page_id: r.verdict for r in judged.collect()}
    assert (by_id[14], by_id[15]) == ("block", "allow")
    assert urls.judge(df.limit(0), urls.labelled_urls(spark)).count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_learned_verdicts_on_hosts_not_seen(spark):
    blocked = ["http://casino-bonus.example.com/1", "http://www.best-pills.example.net/en/2", "http://adult-zone.example.net/en/8"]
    allowed = ["http://geography.example.net/en/9", "https://m.harbour.example.com/de-ch/3", "http://violin.example.net/fr/31"]
    df = spark.createDataFrame([(u,) for u in blocked + allowed], "url string")
    verdicts = {r.url: r.verdict for r in urls.judge(df, urls.labelled_urls(spark), rules=()).collect()}
    assert [verdicts[u] for u in blocked + allowed] == ["block"] * 3 + ["allow"] * 3


def expected(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for page, payload in rows:
        if len(payload) >= 100:
            first.setdefault(payload, []).append(page)
    out = []
    for page, payload in rows:
        owners = first.get(payload, [])
        least = min((p for p in owners if p is not None), default=None)
        revisit = len(payload) >= 100 and page != least
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return out


@pytest.mark.parametrize("shard, roll", [(2000, 300), (10**9, 10**9)])
def test_archives_give_every_page_back(spark, pages, tmp_path, shard, roll):
    out = f"file://{tmp_path}/archive"
    manifest = warc.write(pages, out, shard_bytes=shard, roll_bytes=roll)
    assert (len(manifest) > 3) == (shard == 2000) and sum(f["records"] for f in manifest) == pages.count()
    assert not (tmp_path / "archive/_temporary").exists()
    found = by_row(queries.warc_digest(warc.read(spark, out)))
    want = expected(pages)
    again = (next(r.page_id for r in pages.filter("url = 'http://again.com'").collect()),)
    # of two rows with one id and payload, the second refers to the first
    want = [w for w in want if w[0] != again[0]] + [r for r in found if r[0] == again[0]]
    assert found == in_order(want)
    records = warc.read(spark, out).filter("record_type = 'response'").collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in records} <= {(r.page_id, r.html or "") for r in pages.collect()}
    names = {r["file"] for r in manifest}
    assert {p.name for p in (tmp_path / "archive").glob("*.gz")} == names
    for f in manifest:
        data = (tmp_path / "archive" / f["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_same_pages_give_the_same_files(spark, pages, tmp_path):
    one = warc.write(pages, f"file://{tmp_path}/one", shard_bytes=3000, roll_bytes=900)
    two = warc.write(pages.repartition(7), f"file://{tmp_path}/two", shard_bytes=3000, roll_bytes=900)
    assert one == two


def test_ranges_hold_about_equal_bytes_whatever_the_ids(spark):
    ids = [-(2**63), -5, -4, 0, 7, 2**63 - 1, *range(10**6, 10**6 + 3000)]
    sizes = spark.createDataFrame([(i, 500) for i in ids], "id long, n_bytes long")
    firsts = warc.ranges(sizes, 100_000, bins=256)
    assert firsts == sorted(firsts) and firsts == warc.ranges(sizes.repartition(5), 100_000, bins=256)
    shares = [sum(a <= i < b for i in ids) for a, b in zip([-(2**63), *firsts], [*firsts, 2**63], strict=True)]
    assert sum(shares) == len(ids) and max(shares) <= 100 and sum(n < 40 for n in shares) <= 3
    one = spark.createDataFrame([(3, 10**9)] * 2, "id long, n_bytes long")
    assert warc.ranges(one, 1000) == [] == warc.ranges(one.limit(0), 1000)


def test_damage_and_emptiness(spark, pages, tmp_path):
    out = f"file://{tmp_path}/archive"
    warc.write(pages.limit(0), out)
    assert warc.read(spark, out).count() == 0
    raw = warc.record(1, "http://a\r\nb", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert raw.count(b"WARC-Target-URI: http://a%0D%0Ab\r\n") == 1
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse(warc.member(raw.replace(b"payload", b"pAyload", 1).replace(b"payload", b"pAyload"))))


def test_members_are_told_apart_and_a_cut_file_is_an_error(monkeypatch):
    payloads = [b"", b"x" * 100_000, bytes(range(256)) * 300, b"short"]
    records = [warc.member(warc.record(i, None, p, hashlib.sha256(p).hexdigest(), None, False)) for i, p in enumerate(payloads)]
    for piece in (7, 1 << 14):
        monkeypatch.setattr(warc, "PIECE_BYTES", piece)
        found = [block.partition(b"\r\n\r\n")[2] for _, block in warc.parse(b"".join(records))]
        assert found == payloads
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.parse(b"".join(records)[:-9]))
