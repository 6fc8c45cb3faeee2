"""URL filters: rules for hosts and paths, and beyond them a logistic regression on hashed character n-grams.

The regression is fitted on a small labelled table of URLs (``SEEDS`` unless another is given): its n-grams are
hashed by the same SQL expressions that score the pages, the gradient runs over the few rows on the driver, and
the weights go into the plan as an array literal.  Pages meet DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words of the small labelled table (1 stands for block), written down before looking at any pages.
_BAD_WORDS = ("spam", "casino", "poker", "pills", "viagra", "porn", "xxx", "adult", "crack", "warez", "replica", "payday", "betting", "escort", "clickbait", "malware")
_BAD_TAILS = ("farm", "bonus", "cheap", "free", "online", "now")
_GOOD_WORDS = ("news", "weather", "library", "museum", "school", "garden", "kitchen", "travel", "history", "science", "music", "health", "sport", "forum", "bakery", "research")
_GOOD_TAILS = ("city", "daily", "guide", "house", "online", "world")
_PLACES = (("", "test"), ("www.", "invalid"), ("m.", "test"), ("blog.", "invalid"))
_PLAIN_PATHS = ("/", "/en/12", "/de/7712.html", "/a/103?page=2", "/2021/05/entry/")
_CONSONANTS, _VOWELS = "bdfghklmnprstvwz", "aeiou"


def _names(count: int) -> list[str]:
    """Names without a meaning, of three syllables each, by a rule: unknown hosts are allowed."""
    out = []
    for k in range(count):
        x = 7919 * k + 13
        out.append("".join(_CONSONANTS[x // 3**j % len(_CONSONANTS)] + _VOWELS[x // 7**j % len(_VOWELS)] for j in range(3)))
    return out


def seed_table() -> list[tuple[str, int]]:
    """The small labelled table: hosts of two words or of a name, with plain paths on both sides and words in some paths."""
    out = []
    for y, words, tails in ((1, _BAD_WORDS, _BAD_TAILS), (0, _GOOD_WORDS, _GOOD_TAILS)):
        for k, w in enumerate(words):
            for j in range(4):
                sub, top = _PLACES[(k + j) % 4]
                tail = tails[(k + j) % len(tails)]
                host = f"{w}-{tail}" if (j + k) % 3 else f"{tail}{w}"
                out += [(f"https://{sub}{host}.{top}{p}", y) for p in (_PLAIN_PATHS[(k + j) % 5], _PLAIN_PATHS[(k + j + 2) % 5])]
            out.append((f"https://{_names(32)[k + 16 * y]}.test/{w}/{tails[k % len(tails)]}", y))
    return out + [(f"https://{sub}{name}.{top}{_PLAIN_PATHS[k % 5]}", 0) for k, name in enumerate(_names(60)) for sub, top in (_PLACES[k % 4],)]


SEEDS = tuple(seed_table())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a labelled table that are fitted.
MAX_SEEDS = 5000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for a null."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, shape, 1), _UPPER, _LOWER), F.regexp_extract(url, shape, 2)


def _gram_buckets(host: Column, path: Column, buckets: int, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Buckets of the character n-grams of ``^host/path``; each side is marked, so that equal grams of host and path differ."""

    def bucket(mark: str, side: Column, n: int):
        return lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(side, i, F.lit(n))), F.lit(buckets)).cast("int")

    parts = []
    for mark, side in (("h", host), ("p", F.translate(path, _UPPER + "0123456789", _LOWER + "0" * 10))):
        side = F.concat(F.lit("^"), side, F.lit("$"))
        for n in sizes:
            places = F.sequence(F.lit(1), F.greatest(F.length(side) - n + 1, F.lit(1)))
            parts.append(F.transform(places, bucket(mark, side, n)))
    return F.concat(*parts)


def _fit(rows: list[tuple[list[int], int]], buckets: int, steps: int = 800, rate: float = 4.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """Full-batch gradient descent on the driver over the few labelled rows; returns weights and bias."""
    rows = [(g, y) for g, y in rows if g]
    if not rows:
        return [0.0] * buckets, 0.0
    x = np.zeros((len(rows), buckets))
    for k, (grams, _) in enumerate(rows):
        np.add.at(x[k], grams, 1 / np.sqrt(len(grams)))
    y = np.array([y for _, y in rows], float)
    weights, bias = np.zeros(buckets), 0.0
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y) / len(y)
        weights -= rate * (x.T @ d + decay / len(y) * weights)
        bias -= rate / 8 * d.sum()
    return weights.tolist(), float(bias)


def judge(pages: DataFrame, rules=RULES, seeds: DataFrame | None = None, buckets: int = 4096, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the regression's probability of block).

    ``seeds``: url string, label int (1: block), at most ``MAX_SEEDS`` rows.  The longest fitting rule wins;
    of rules of equal length the first.  A null or malformed URL has an empty host and path, meets no rule and is
    scored as such.  URLs of any length are taken whole.  Repeated rows are judged alike, with or without page_id; other
    columns are ignored, whatever their names; an empty table gives no rows.  Without seeds every URL scores 0.5.
    """
    spark = pages.sparkSession
    if seeds is None:
        seeds = spark.createDataFrame(list(SEEDS), T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.IntegerType())]))
    host, path = host_path(F.col("url"))
    fitted = seeds.where(F.col("label").isNotNull()).orderBy(F.xxhash64("url")).limit(MAX_SEEDS).select(_gram_buckets(host, path, buckets).alias("g"), "label").collect()
    weights, bias = _fit([(list(r["g"]), int(r["label"])) for r in fitted], buckets)

    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in reversed(ordered):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    table = F.array(*[F.lit(round(w, 9)) for w in weights])
    grams = F.col("_grams")
    total = F.aggregate(grams, F.lit(0.0).cast("double"), lambda acc, g: acc + F.get(F.col("_weights"), g))
    scored = (
        rows.withColumn("_grams", _gram_buckets(F.col("host"), F.col("path"), buckets))
        .withColumn("_weights", table)
        .withColumn("score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(grams))))))
    )
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
