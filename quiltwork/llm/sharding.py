"""Balanced contiguous shards by global prefix sums.

Rows are dealt out by ranges of their id.  Each range partition's totals (bytes, rows) give, by a running sum
over the few partitions, the place at which it starts in the whole; inside a partition a running sum gives each
row's own place.  Shards are cut at equal targets of bytes.  Only ids, sizes and checksums are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch

#: Bytes that each document costs besides its text.
ROW_BYTES = 16


def by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null): contiguous in doc_id, then checksum.

    A null text has no bytes.  Null ids come first; rows that are equal in id, checksum and size are interchangeable
    and get adjacent slots.  A shard may be empty if one document is larger than a target.  An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    dealt = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    # One row a partition; the running sum over them is the only step in one task.
    parts = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = scratch.keep(
        parts.select(
            "part",
            F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("byte_start"),
            F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("row_start"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("row", F.row_number().over(numbered).cast("long"))
        .join(starts, "part")
        .withColumn("middle", (F.col("byte_start") + F.col("before")) * 2 + F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle").cast("decimal(38,0)") * shards / (F.col("total") * 2).cast("decimal(38,0)"))).cast("int"))
        .withColumn("place", F.col("row_start") + F.col("row") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    placed = scratch.keep(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write(docs: DataFrame, path: str, shards: int = 40) -> DataFrame:
    """Write whole rows as Parquet, a folder ``shard=<n>`` for each shard that has rows; returns the placement.

    Every row is written once, with all its columns, also rows with a null or repeated id: rows that are equal in id,
    checksum and size are numbered and meet their places by these numbers.  If ``docs`` has a column ``shard`` of its
    own, the folders are named ``shard_``, with as many underscores as it takes.  An empty table writes no rows.
    """
    placed = by_bytes(docs, shards)
    keys = ["_qw_id", "_qw_crc", "_qw_size"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumns({"_qw_id": F.col("doc_id").cast("long"), "_qw_crc": F.crc32(text.cast("binary")), "_qw_size": (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long")})
    rows = rows.withColumn("_qw_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    places = placed.select(F.col("doc_id").alias("p0"), F.col("text_crc32").alias("p1"), F.col("size").alias("p2"), F.col("shard").alias("_qw_shard"), F.row_number().over(Window.partitionBy("doc_id", "text_crc32", "size").orderBy("shard", "slot")).alias("p3"))
    same = None
    for k, c in enumerate([*keys, "_qw_n"]):
        one = F.col(c).eqNullSafe(F.col(f"p{k}"))
        same = one if same is None else same & one
    joined = rows.join(places, same).select(*docs.columns, F.col("_qw_shard").alias(name))
    # a shard's rows come together in a bounded number of files
    joined.repartition(name, F.pmod(F.xxhash64(*docs.columns[:1]), F.lit(8))).write.partitionBy(name).parquet(path)
    return placed
