"""How filters act on each other: five filters replayed over all documents in all 120 orders.

Each document's failures are five bits.  The bits are crossed with the 120 orders, a broadcast table of fixed size;
for each order the first failing step is worked out, its five steps are exploded, and conditional sums by part, order
and step are combined on the map side, so that only a row a group and task is shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch

FILTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A text with more than one row in so many is looked up in a broadcast table of at most so many rows.
HOT_SHARE = 256
#: Documents that one task replays.
DOCS_A_TASK = 250_000


def _count(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, text_key (SHA-256 of the text) and mask (bits 1, 2, 4, 8 for A to D), a row a document."""
    group = F.coalesce(F.col(part).cast("string"), F.lit("")) if part in docs.columns else F.lit("")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    words, kinds, text = F.size("_w").cast("long"), F.size(F.array_distinct("_w")).cast("long"), F.col("_t")
    tests = (words < 100, kinds * 100 < words * 80, _count(text, _UPPER) * 100 > F.length(text).cast("long") * 10, _count(text, "#$%&*|") > 0)
    mask = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return df.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("text_key"), mask.alias("mask"))


def mark_copies(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with bit 16 set where a smaller doc_id has the same text.

    Texts that hold more than one row in ``HOT_SHARE`` are at most ``HOT_SHARE``, so they are broadcast; the others are
    joined by key, where no key is large.
    """
    c = F.col
    firsts = rows.groupBy("text_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where(c("_n") > 1)
    hot = F.broadcast(firsts.where(c("_n") * HOT_SHARE > total).drop("_n"))
    known = rows.join(hot, "text_key", "left")
    rest = known.where(c("_first").isNull()).drop("_first").join(firsts.where(c("_n") * HOT_SHARE <= total).drop("_n"), "text_key", "left")
    both = known.where(c("_first").isNotNull()).unionByName(rest)
    copy = F.coalesce(c("doc_id") > c("_first"), F.lit(False))
    return both.select("doc_id", "part", (c("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def _orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: filter_order and the bits of its steps."""
    rows = [F.struct(F.lit("".join(FILTERS[k] for k in p)).alias("filter_order"), F.array(*[F.lit(1 << k) for k in p]).alias("bits")) for p in permutations(range(len(FILTERS)))]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("o")).select("o.*")


def replay(flags: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, from ``part``, ``mask``, ``good`` and ``toxic`` of each document."""
    c, spark = F.col, flags.sparkSession
    crossed = flags.crossJoin(F.broadcast(_orders(spark)))
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(c("mask").bitwiseAND(F.get("bits", k)) != 0, k + 1).otherwise(first)
    steps = crossed.withColumn("first", first).select("*", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])).alias("step"))
    bit = F.get("bits", c("step") - 1)
    fails, here = c("mask").bitwiseAND(bit) != 0, c("first") == c("step")
    marks = {
        "kept": c("first") > c("step"),
        "removed": here,
        "redundant": fails & (c("first") < c("step")),
        "unique_fails": c("mask") == bit,
        "good_lost": here & c("good"),
        "toxic_lost": here & c("toxic"),
    }
    sums = steps.groupBy("part", "filter_order", "step").agg(*[F.sum(F.when(m, 1).otherwise(0)).cast("long").alias(n) for n, m in marks.items()])
    letter = F.substring("filter_order", c("step"), F.lit(1))
    totals = sums.groupBy("part", letter.alias("_letter")).agg(F.sum("removed").alias("shapley"))
    return sums.withColumn("_letter", letter).join(totals, ["part", "_letter"]).select("part", "filter_order", "step", *marks, "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: what the step keeps, removes and loses.

    A fails under 100 words, B where less than 80 % of the words are distinct, C where more than 10 % of the characters
    are A-Z, D where ``#$%&*|`` occur, E where a smaller doc_id has the same text, removed or not.  A null text is
    empty: it fails A, and E if a smaller doc_id is empty too.  Texts of any length are taken whole.  A null part is
    ''; every part has all 600 rows.  Rows that repeat a doc_id count each, and are no copies of each other; a row
    without doc_id is never a copy, nor makes one, and has no labels.  Of several labels of a doc_id one of 1 is
    enough.  Other columns are ignored, whatever their names; an empty table gives no rows.

    Labels are joined by doc_id; should one doc_id (or null) hold many rows, Spark's adaptive skew join splits it.
    """
    c, spark = F.col, docs.sparkSession
    scratch = Scratch(spark, "audit")
    rows = scratch.keep(failures(docs, part))
    total = rows.count()
    ids = c("doc_id").cast("long").alias("doc_id")
    marks = labels.groupBy(ids).agg(F.max(F.coalesce(c("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(c("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = mark_copies(rows, total).join(marks, "doc_id", "left")
    no = F.lit(False)
    flags = flags.select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // DOCS_A_TASK)
    return replay(flags.repartition(tasks))
