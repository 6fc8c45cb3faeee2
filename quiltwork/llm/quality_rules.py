"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a ratio that is high in bad texts.  Its cutoff is taken from a fixed grid, for each stratum (language)
alone.  On the labelled rows, cutoff by cutoff from the loosest on, an exact binomial test asks whether the share of
good documents that it would reject is below ``risk / number of rules``; the grid is nested, so testing in this fixed
order needs no correction, and the level is shared out evenly over all rules and strata (Bonferroni).  With
probability ``1 - level`` or more every cutoff that passes keeps its promise.  Among those that pass, the one with
the best balance of bad documents caught and good ones lost is used; a rule that catches nothing is left out, and a
stratum with too few labels gets no cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch

_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: name -> (numerator, denominator, grid of cutoffs from the loosest on); fixed before any data is seen.
GRID = tuple(x / 100 for x in (90, 80, 70, 60, 50, 40, 35, 30, 25, 20, 16, 13, 10, 8, 6, 5, 4, 3, 2, 1))
RULES = {
    "symbols": ("n_symbols", "word_chars", GRID),
    "capitals": ("n_capitals", "word_chars", GRID),
    "shouts": ("n_shouts", "n_words", GRID),
    "lines": ("n_dup_lines", "n_lines", GRID),
    "repeats": ("n_repeat_words", "n_words", GRID),
}


def _count(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def _has_word(text: Column) -> Column:
    return F.length(F.translate(text, _BLANK, "")) > 0


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text_hash and counts of every whole text; null texts have no words, a null stratum is ''."""
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    text, words, grams = F.col("_text"), F.col("_words"), F.col("_grams")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_words", F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn(
        "_grams",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
        ),
    )
    # windows that are found again are rare in good texts, so the sort runs for the others only
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    pairs = F.col("_sorted")
    again = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["g"] == p["g"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["g"] == p["g"], F.lit(False)))
    df = df.withColumn("_places", F.array_sort(F.transform(again, lambda p: p["i"])))
    covered = F.aggregate(
        F.col("_places"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    lines = F.col("_lines")
    return (
        df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("_lines", F.filter(F.split(text, "\n"), _has_word))
        .select(
            "doc_id",
            "stratum",
            F.xxhash64(text).alias("text_hash"),
            "n_words",
            F.length(F.translate(text, _BLANK, "")).cast("long").alias("word_chars"),
            _count(text, _SYMBOLS).alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            _count(text, _UPPER).alias("n_capitals"),
            _count(text, "!").alias("n_shouts"),
        )
    )


def _ratio(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed exactly from the logarithms of its terms."""
    odds = math.log(p / (1 - p))
    start = n * math.log(1 - p)
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(
        steps,
        F.struct(start.cast("double").alias("t"), F.exp(start).cast("double").alias("s")),
        lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + odds)).alias("s")),
        lambda a: a["s"],
    )


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, cost: float = 20.0) -> DataFrame:
    """One row a stratum: ``stratum`` and ``cut_<rule>`` (null: no cutoff).

    ``labels``: doc_id, quality (1 good, 0 bad; others and nulls are left out; of several the lowest counts).
    ``cost``: how many bad documents a rule must catch for each good one that it loses.
    """
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = measured.join(marks, "doc_id")
    sums = [F.sum((F.col("quality") == 1).cast("long")).alias("n")]
    for rule, (_, _, grid) in RULES.items():
        for j, cut in enumerate(grid):
            over = _ratio(rule) > cut
            sums += [F.sum((over & (F.col("quality") == q)).cast("long")).alias(f"{rule}_{j}_{q}") for q in (0, 1)]
    counts = rows.groupBy("stratum").agg(*sums)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"{rule}_{j}_1").alias("lost"), F.col(f"{rule}_{j}_0").alias("caught")) for rule, (_, _, grid) in RULES.items() for j, cut in enumerate(grid)])
    share = risk / len(RULES)
    scratch = Scratch(measured.sparkSession, "cutoffs")
    counts = scratch.keep(counts)
    bound = level / (max(1, counts.count()) * len(RULES))
    tested = counts.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*")
    passed = tested.where((F.col("lost") <= F.col("n") * share) & (F.col("caught") > F.col("lost") * cost)).where(_tail(F.col("lost"), F.col("n"), share) <= bound)
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct((F.col("caught") - F.col("lost") * cost).alias("gain"), F.col("cut"))).alias("cut"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Counts of ``measure``, base_failed, rejected_by (the rules over their cutoffs) and kept, a row a document.

    base_failed: fewer than 10 words, or more than 20 % of them in 5-word windows found twice or more.
    kept: neither base_failed nor over a cutoff.  Without labels no rule has a cutoff.  A null text has no words, a null
    stratum is one of its own.  Texts of any length are measured whole; repeated rows are judged alike; a label counts
    for every row of its doc_id, none for rows without doc_id.  Columns of ``docs`` other than doc_id, text and the
    stratum are ignored, whatever their names.  An empty table gives no rows.
    """
    out = _judged(docs, labels, stratum, risk, level)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "stratum")


def _judged(docs: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.keep(measure(docs, stratum))
    cuts = scratch.keep(cutoffs(measured, labels, risk, level))
    over = [F.when(_ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]
    return (
        measured.join(cuts, "stratum", "left")
        .withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
        .withColumn("rejected_by", F.array_compact(F.array(*over)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns of any names, that the rules keep.

    Each row goes by its own text and stratum, also rows that share a doc_id or have none.
    """
    c = F.col
    bad = _judged(docs, labels, stratum).where(~c("kept")).select(c("doc_id").alias("_qw_id"), c("stratum").alias("_qw_stratum"), c("text_hash").alias("_qw_hash")).distinct()
    group = F.coalesce(docs[stratum].cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    same = docs["doc_id"].cast("long").eqNullSafe(c("_qw_id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == c("_qw_hash")) & (group == c("_qw_stratum"))
    return docs.join(bad, same, "left_anti")
