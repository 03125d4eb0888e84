"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: what
follows the host up to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty.

A rule ``host/path`` fits its host and all subdomains, if the url's path starts with ``/path``; of the
rules that fit, the longest wins, and its verdict holds. Other urls are judged by the model: their host
and path are cut to character n-grams, which are hashed into BUCKETS features of equal weight.

Defined cases: empty host and path have no n-grams, and get the model's verdict by its bias alone;
repeated rows are judged each; very long urls count whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tandemql.llm import common

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
#: Rules are tried as one expression, so their number is bounded.
MAX_RULES = 1000

RULES: list[tuple[str, str]] = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# The small labelled table, written for this: label 1 is to be blocked (link farms, pills, gambling, adult, trackers).
LABELLED: list[tuple[str, int]] = [
    ("http://spam-farm.example.org/en/728", 1),
    ("https://www.spam-farm.example.com/de/12", 1),
    ("http://blog.spam-farm.example.net/es/4/", 1),
    ("http://spam-links.example.com/fr/900", 1),
    ("https://link-farm.example.org/en/33.html", 1),
    ("http://www.cheap-pills.example.com/en/450", 1),
    ("https://m.cheap-pills.example.org/fr/87", 1),
    ("http://cheap-pills.example.net/de/651.html", 1),
    ("https://buy-pills.example.org/en/1", 1),
    ("http://cheap-meds.example.com/es/77", 1),
    ("https://casino-win.example.com/en/9", 1),
    ("http://www.casino-win.example.org/es/310/", 1),
    ("https://blog.casino-win.example.net/fr/55", 1),
    ("http://online-casino.example.org/de/6", 1),
    ("https://win-slots.example.com/en/408", 1),
    ("https://adult-x.example.com/en/246", 1),
    ("http://m.adult-x.example.net/de/18", 1),
    ("https://www.adult-x.example.org/fr/799", 1),
    ("http://xxx-adult.example.com/en/20", 1),
    ("http://free-bets.example.net/en/5", 1),
    ("https://blog.free-bets.example.com/es/61", 1),
    ("https://www.free-bets.example.org/de/333.html", 1),
    ("http://sports-bets.example.com/en/14", 1),
    ("https://m.ads-track.example.com/en/2", 1),
    ("http://ads-track.example.org/fr/840", 1),
    ("https://www.ads-track.example.net/es/29/", 1),
    ("http://ad-tracker.example.com/en/98", 1),
    ("https://kitchen.example.com/en/825", 0),
    ("https://m.railways.example.net/en/25", 0),
    ("https://orchard.example.org/en/685", 0),
    ("http://theatre.example.com/en/676", 0),
    ("https://lantern.example.net/en/770", 0),
    ("https://blog.mountains.example.com/en/853/", 0),
    ("http://blog.harbour.example.net/en/960", 0),
    ("https://m.astronomy.example.com/de/474.html", 0),
    ("https://www.stations.example.org/es/671", 0),
    ("https://blog.furniture.example.com/en/369", 0),
    ("http://nation.example.com/en/328/", 0),
    ("https://www.thread.example.org/en/334", 0),
    ("http://blog.another.example.net/fr/65.html", 0),
    ("https://m.mother.example.com/de/7", 0),
    ("https://www.library.example.org/en/catalogue/12", 0),
    ("http://news.example.com/en/2024/05/article", 0),
    ("https://docs.example.net/de/guide/install", 0),
    ("https://school.example.org/fr/lessons/3", 0),
    ("http://www.city-museum.example.com/es/visit", 0),
    ("https://open-data.example.org/en/tables/9", 0),
    ("http://blog.garden.example.net/en/roses", 0),
    ("https://health.example.org/en/advice/88", 0),
    ("http://weather.example.com/de/today", 0),
    ("https://m.recipes.example.com/fr/soup/5.html", 0),
    ("https://re-search.example.org/en/paper/101", 0),
    ("https://www.on-line-courses.example.net/en/40", 0),
    ("http://forum.example.com/en/topic/5512", 0),
    ("https://wiki.example.org/es/pagina", 0),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = r"(?s)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, found, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, found, 2), F.lit(""))


def _features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of ``^host$`` and ``path|``."""
    seen = set()
    for part in (f"^{host}$".encode(), f"{path}|".encode()):
        for n in GRAMS:
            seen.update(zlib.crc32(part[i : i + n]) for i in range(len(part) - n + 1))
    return np.fromiter({x % BUCKETS for x in seen}, dtype=np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    """host_and_path() for one string on the driver."""
    rest = (url or "").partition("://")[2]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def train(labelled: list[tuple[str, int]] = LABELLED, *, epochs: int = 400, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights by full gradient steps in a fixed order; the last weight is the bias. The table is small by contract."""
    rows = [_features(*split_url(url)) for url, _ in labelled]
    y = np.array([label for _, label in labelled], dtype=float)
    weights = np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        step = np.zeros_like(weights)
        for x, label in zip(rows, y, strict=True):
            error = 1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(len(x)) + weights[-1]))) - label
            step[x] += error / np.sqrt(len(x))
            step[-1] += error
        weights -= rate * (step / len(y) + decay * weights)
    return weights


def score_one(weights: np.ndarray, host: str, path: str) -> float:
    x = _features(host, path)
    return float(1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + weights[-1]))))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]], give: int) -> Column:
    """Of the longest rule that fits: its text (give 0) or its verdict (give 1); else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the bound is {MAX_RULES}")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule[0].partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule[give])).otherwise(out)
    return out


def judge(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str]] | None = None,
    labelled: list[tuple[str, int]] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's, 0 to 1); no shuffle, and only ids and urls are read."""
    rules = RULES if rules is None else rules
    weights = train(LABELLED if labelled is None else labelled)

    @F.pandas_udf(DoubleType())
    def model(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([score_one(weights, h, p) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    host, path = host_and_path(F.col("url"))
    parts = common.pick(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    told = parts.withColumn("score", model("host", "path"))
    verdict = F.coalesce(rule_for(F.col("host"), F.col("path"), rules, 1), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules, 0).alias("rule"), verdict.alias("verdict"), "score")
