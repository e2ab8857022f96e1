"""URL filter: host rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions. The regression is trained from a small labelled table of URLs (a parameter; a
hand-written one is the default), its weights are one array literal of `DIMENSIONS` numbers, and a URL's score is the
sum over its n-grams. Nothing is shuffled: a judgement needs its row only.

Cases: a null url or one without `://` has an empty host and path, fits no rule and gets the regression's verdict on
no n-grams (its intercept); an empty table gives no rows; columns beside the url are kept only where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import lower_az

DIMENSIONS = 2048
SIZES = (3, 4, 5)

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Hand-labelled URLs, 1 to block.
LABELLED = tuple((url, 1) for url in (
    "http://cheap-pills.example.com/en/12", "http://www.cheap-pills.example.net/buy?x=1", "https://cheap-meds.example.com/order",
    "http://spam-farm.example.org/en/1", "https://spam-farm.example.net/links/9", "http://link-farm.example.com/en/7",
    "http://casino-bonus.example.com/win", "https://online-casino.example.net/slots/4", "http://free-casino.example.org/en/3",
    "http://adult-cams.example.com/live", "https://xxx-videos.example.net/en/5", "http://hot-singles.example.com/chat",
    "http://win-prizes.example.net/claim", "http://free-iphone.example.com/claim/now", "https://lottery-winner.example.net/en/2",
    "http://payday-loans.example.com/apply", "http://fast-cash.example.net/loan", "https://replica-watches.example.com/shop",
    "http://cracked-software.example.net/keygen", "http://torrent-warez.example.com/dl/8", "http://seo-backlinks.example.com/en/6",
    "http://viagra-online.example.net/buy", "https://poker-bets.example.com/en/99", "http://phish-login.example.net/verify/account",
)) + tuple((url, 0) for url in (
    "http://theatre.example.com/fr/825?page=2", "https://m.bookshop.example.net/en/26#top", "https://weather.example.org/en/36",
    "http://www.library.example.org/catalogue/12", "https://news.example.com/en/2021/07/story.html", "http://blog.garden.example.net/en/853/",
    "https://www.university.example.org/courses/math", "http://docs.example.net/manual/install.html", "https://recipes.example.com/en/soup",
    "http://m.weather.example.net/de/berlin", "https://history.example.org/es/771", "http://museum.example.com/fr/expo/5",
    "https://science.example.net/en/papers/314", "http://blog.travel.example.com/es/978?page=2&ref=x", "https://www.city.example.org/services",
    "http://music.example.net/en/albums/40", "https://northern.example.net/en/731#top", "http://together.example.com/en/861",
    "https://blog.translation.example.com/en/519/", "http://gathering.example.com/en/248/", "https://station.example.net/de/277.html",
    "http://health.example.org/en/nutrition", "https://forum.example.com/en/thread/1201", "http://www.sports.example.net/es/liga",
))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null url or one without `://`."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return lower_az(F.regexp_extract(whole, shape, 1)), F.regexp_extract(whole, shape, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one text) and its verdict; null where none fits."""
    rule = verdict = None
    for name, start, says in sorted(rules, key=lambda x: -len(x[0] + x[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def _buckets(host: Column, path: Column) -> Column:
    """Hashed n-grams of host and path as an array of places in the weights."""
    text = F.concat(F.lit("^"), host, F.lit("$"), lower_az(path))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))),
                         lambda i, n=n: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))
             for n in SIZES]
    return F.concat(*grams)


@dataclass(frozen=True)
class UrlModel:
    weights: list[float]
    intercept: float

    def score(self, host: Column, path: Column) -> Column:
        """Probability that the URL is to be blocked; n-grams weigh as counts over the root of their number."""
        buckets = _buckets(host, path)
        weights = F.lit(self.weights)
        total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
        margin = F.when((host == "") & (path == ""), F.lit(0.0)).otherwise(total / F.sqrt(F.size(buckets))) + self.intercept
        return 1 / (1 + F.exp(-margin))


def fit_urls(labelled: DataFrame, url: str = "url", label: str = "label") -> UrlModel:
    """Fit on a small labelled table. A table without both labels gives the logarithm of the smoothed odds alone."""
    host, path = host_path(F.col(url))
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), _buckets(host, path).alias("b"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return UrlModel([0.0] * DIMENSIONS, math.log((counts.get(1.0, 0) + 1) / (counts.get(0.0, 0) + 1)))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.size(F.filter(
        F.col("b"), lambda b: b == i)) / F.sqrt(F.size("b")))
    data = rows.select("label", array_to_vector(vector).alias("features"))
    model = LogisticRegression(regParam=0.01, maxIter=50, standardization=False).fit(data)
    return UrlModel([float(w) for w in model.coefficients], float(model.intercept))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def judge_urls(pages: DataFrame, model: UrlModel, url: str = "url", keep: Sequence[str] = ("page_id",),
               rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """`keep` columns, host, path, rule, block_score, verdict."""
    host, path = host_path(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("ruled"), model.score(F.col("host"), F.col("path")).alias("block_score"))
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(*keep, "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "block_score")
