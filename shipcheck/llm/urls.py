"""URL filter: ordered allow/block rules first, else a logistic regression on hashed character
n-grams of host and path, trained in numpy on the small labelled table below."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The labelled table's words, unwanted (1) and wanted (0); hosts are made of one or two words of a label.
LABELLED_WORDS = {
    1: ["adult", "ads", "bets", "betting", "bonus", "cams", "casino", "cheap", "clickbait", "clickfarm", "crack", "escort", "gamble", "hookup", "jackpot", "keygen", "linkfarm", "loans", "lottery", "malware", "nude", "payday", "phish", "pills", "poker",
        "porn", "sexy", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx"],
    0: ["archive", "bakery", "books", "chess", "cinema", "city", "clinic", "docs", "forum", "garden", "guide", "health", "history", "hotel", "journal", "law", "library", "maps", "museum",
        "music", "news", "notes", "open", "physics", "poetry", "radio", "recipes", "review", "school", "science", "sport", "travel", "university", "weather", "wiki"],
}
SUBDOMAINS, TOPS = ["", "www.", "m.", "blog."], ["com", "net", "org", "info", "eu"]
PATHS = ["/", "/{}", "/en/{}", "/p/{}.html", "/tag/{}/", "/2020/05/{}", "/index.php"]
#: So many wanted hosts have names without meaning, made of these by a rule: an unknown name is no reason to block.
INVENTED, ONSETS, VOWELS = 400, "b c d f g h k l m n p r s t th v w z st br".split(), "a e i o u ei ou an er il".split()
#: Fixed values: (host, path) rules of the production filter.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DIMS, GRAMS = 1 << 14, (3, 4, 5)


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label): single words and pairs of words of a label, joined or hyphenated, and invented names, with subdomains, tops and paths in turn."""
    names = []
    for label, words in LABELLED_WORDS.items():
        names += [(w, label) for w in words]
        names += [(a + "-" * (i + j & 1) + c, label) for i, a in enumerate(words) for j, c in enumerate(words) if a != c and (i * 5 + j) % (3 - label) == 0]
    pick = lambda i, k: ONSETS[zlib.crc32(f"{i}:{k}".encode()) % len(ONSETS)] + VOWELS[zlib.crc32(f"{k}:{i}".encode()) % len(VOWELS)]
    names += [("".join(pick(i, k) for k in range(2 + i % 3)), 0) for i in range(INVENTED)]
    out = []
    for n, (name, label) in enumerate(names):
        out.append((f"{SUBDOMAINS[n % 4]}{name}.{TOPS[n % 5]}", PATHS[n % 7].format(1000 + 7 * n), label))
    return [*out, ("", "", 0)]


def features(host: str, path: str) -> np.ndarray:
    """Hashed ids of the distinct n-grams, every number as 0; host and path have names of their own."""
    found, path = set(), re.sub(r"\d+", "0", path)
    for space, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{space}{n}{s[i : i + n]}".encode()) % DIMS for i in range(len(s) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    """Weights and bias fitted on the whole labelled table."""
    return fitted(labelled_urls())


def fitted(rows: list[tuple[str, str, int]], steps: int = 900, rate: float = 12.0, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent on the mean loss, where each label has half the weight; (weights, bias)."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (host, path, _) in enumerate(rows):
        f = features(host, path)
        x[i, f] = 1 / np.sqrt(max(len(f), 1))
    y = np.array([r[2] for r in rows], np.float32)
    weight, bias = np.zeros(DIMS, np.float32), 0.0
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    for _ in range(steps):
        err = (1 / (1 + np.exp(-(x @ weight + bias))) - y) * share
        weight -= rate * (x.T @ err + ridge * weight)
        bias -= rate * float(err.sum())
    return weight, bias


def score(host: str, path: str, weight: np.ndarray, bias: float) -> float:
    f = features(host, path)
    return float(1 / (1 + np.exp(-(weight[f].sum() / np.sqrt(max(len(f), 1)) + bias))))


def host_path(url):
    """Columns host and path of a url column: null or without `://` gives two empty texts."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages.

    A rule `host/path` fits its host and all its subdomains where the url's path begins with the
    rule's path; the longest rule wins.  Where none fits, the regression decides (block from
    `threshold` on; elsewhere the score is null).  Null and odd urls have empty host and path and are scored like any other;
    repeated rows give repeated results.  Row-wise: no shuffle, the html is never read."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later, longer ones override
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    weight, bias = model()

    @F.pandas_udf("double")
    def scored(h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else score(a, b, weight, bias) for a, b in zip(h, p, strict=True)], dtype="float64")

    rows = rows.withColumn("rule", rule).withColumn("_says", verdict)
    rows = rows.withColumn("score", scored(F.when(F.col("_says").isNull(), F.col("host")), F.col("path")))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_says", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
