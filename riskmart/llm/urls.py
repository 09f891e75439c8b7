"""URL verdicts by rules, and for the rest by a logistic regression on hashed character n-grams.

Host and path are taken from the url by patterns; their n-grams are hashed to buckets, and a url's features are the buckets it has. The
regression is fitted by Spark's own solver on a small labelled table. Its coefficients become one constant array, so that judging is a single
projection of built-in functions over the urls: no join, no shuffle, no Python.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 13
NGRAMS = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled table: hosts and paths of unwanted kinds, and ordinary ones.
BLOCKED_URLS = """
https://best-casino.example/play http://casino-royal.example/win/77 https://www.win-casino.example/slots
https://bigwin.example/jackpot http://lucky-win.example/spin https://cheap-meds.example/order http://pills-shop.example/buy
https://www.cheap-pills-online.example/viagra http://cheap-watches.example/rolex https://cheap-loans.example/apply
https://freebets.example/bonus http://free-bets-now.example/odds https://www.sport-bets.example/free http://free-money.example/claim
https://ads-server.example/banner http://track-ads.example/pixel https://click-track.example/r?id=1 http://ads.tracker.example/go
https://www.adult-cams.example/live http://adult-dating.example/meet https://hot-adult.example/x http://xxx-adult.example/tube
https://spam-host.example/mail http://link-farm.example/links https://spamlinks.example/page http://seo-farm.example/spam
https://content-farm.example/top10 http://www.farm-links.example/a https://x-videos.example/watch http://payday-loans.example/now
http://diet-pills.example/order https://pillstore.example/pills http://adult-chat.example/room https://adultvideo.example/new
http://betting-tips.example/win https://casino-slots.example/spin http://spammers.example/lists https://cheapest-pills.example/en/7
http://adult-shop.example/fr/12 https://free-spins.example/de/9 http://ad-tracker.example/es/3 https://lottery-win.example/en/5
https://replica-bags.example/sale http://crack-warez.example/keygen https://poker-win.example/table http://bet-track.example/ads
""".split()
ALLOWED_URLS = """
https://www.university.example/research/2021 http://library.example/catalogue/4411 https://news.example/world/article-88
https://blog.garden.example/posts/roses http://museum.example/en/rooms https://weather.example/fr/paris http://city.example/de/rathaus
https://m.recipes.example/soup/12 https://www.theatre.example/en/programme http://physics.example/papers/301.html
https://docs.language.example/reference/3 http://www.hospital.example/es/visitas https://thesaurus.example/en/word/thing
https://railway.example/timetable?page=2 http://blog.other.example/en/512 https://www.station.example/en/77.html
https://mountain.example/hiking/9 http://m.river.example/fr/210 https://history.example/de/1848 http://ethics.example/essays/4
https://www.nation.example/en/6021?ref=x http://orchestra.example/concerts https://science.example/en/3310#top
https://m.thinking.example/en/95 http://www.author.example/books/7 https://blog.lantern.example/es/431 https://parliament.example/acts/12
http://school.example/en/871/ https://www.heritage.example/sites/5 http://insects.example/beetles.html https://ocean.example/en/2745
http://violins.example/en/40 https://www.geology.example/en/8 http://m.bakery.example/fr/77 https://zoology.example/en/311
http://www.botany.example/de/12 https://blog.chess.example/en/64 http://lighthouse.example/es/15 https://m.vineyard.example/fr/903
http://furniture.example/en/21.html https://www.painting.example/en/1450 http://zone.example/en/6 https://best-essays.example/en/33
http://www.engineering.example/notes/14 https://archive.example/item/90210 http://festival.example/fr/1201?utm_source=feed
""".split()

# The rules of the checked query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none fits. Of rules of equal length the first by text wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last one wins
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(action)
    return rule, action


def buckets(host: Column, path: Column, n_buckets: int = BUCKETS, ngrams=NGRAMS) -> Column:
    """The distinct buckets of the character n-grams of host and path, each with marked ends."""

    def hashed(kind: str, text: Column, n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))

        def bucket(place: Column) -> Column:
            gram = F.substring(text, place, F.lit(n))
            return F.pmod(F.xxhash64(F.lit(f"{kind}{n}"), gram), F.lit(n_buckets)).cast("int")

        return F.transform(F.coalesce(places, F.array().cast("array<int>")), bucket)

    marked = {"host": F.concat(F.lit("^"), host, F.lit("$")), "path": F.concat(path, F.lit("$"))}
    return F.array_distinct(F.concat(*(hashed(kind, text, n) for kind, text in marked.items() for n in ngrams)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(u, 1.0) for u in BLOCKED_URLS] + [(u, 0.0) for u in ALLOWED_URLS]
    return spark.createDataFrame(rows, "url string, label double")


def fit(labelled: DataFrame, n_buckets: int = BUCKETS, ngrams=NGRAMS) -> tuple[list[float], float]:
    """Coefficients by bucket and intercept, for a table with ``url`` and ``label`` (1: block). Rows without label are left out."""
    url = F.col("url")
    present = buckets(host(url), path(url), n_buckets, ngrams)
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(n_buckets - 1)), lambda b: F.array_contains(F.col("present"), b).cast("double")
    )
    rows = labelled.filter(F.col("label").isNotNull()).select("label", present.alias("present")).coalesce(1)
    vectors = rows.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=0.01, standardization=False, maxIter=50).fit(vectors)
    return [round(float(c), 6) for c in model.coefficients], float(model.intercept)


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules=RULES,
    url_col: str = "url",
    threshold: float = 0.5,
    n_buckets: int = BUCKETS,
    ngrams=NGRAMS,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (columns of these names are replaced).

    A null url, or one without ``://``, has empty host and path; its score is that of two empty texts. Every row is judged by itself.
    """
    coefficients, intercept = fit(labelled, n_buckets, ngrams)
    weights = F.from_json(F.lit(json.dumps(coefficients)), "array<double>")  # folded to one constant
    parts = pages.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    logit = F.aggregate(
        buckets(F.col("host"), F.col("path"), n_buckets, ngrams),
        F.lit(intercept),
        lambda total, b: total + F.element_at(weights, b + 1),
    )
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "score": 1 / (1 + F.exp(-logit)), "_action": action})
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("_action", learned)).drop("_action")
