"""Dictionaries from files: of each language the newest file counts, and a broken one costs that language only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str) -> DataFrame:
    """lang, key, text of the JSON files under ``path``, laid out as ``lang=<code>/<any name>``.

    Of several files of a language the one with the latest modification time is read (ties: the last by name), whole.
    A file that is no JSON object, or no JSON at all, yields no rows, and no older file stands in for it.  Values that
    are objects themselves are kept as JSON text; keys with a null are left out.
    """
    files = spark.read.option("wholetext", True).text(path).select("lang", "value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    newest = files.groupBy("lang").agg(F.max_by("value", F.struct("at", "file")).alias("value"))
    words = newest.select(F.col("lang").cast("string").alias("lang"), F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("words"))
    return words.select("lang", F.explode("words").alias("key", "text")).where(F.col("text").isNotNull())


def save(words: DataFrame, path: str) -> None:
    """One more file for each language of ``words`` (lang, key, text); the files that are there stay."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("key", "text"))), lambda e: F.struct(e["key"], e["text"]))
    files = words.groupBy("lang").agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
    files.repartition("lang").write.mode("append").partitionBy("lang").text(path)
