"""Tile cache pruning, request limits, debouncing and an LRU cache."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.operators.running import ordered_buckets, running_sum


def prune(tiles: DataFrame, now: Column, max_days: int, budget: int) -> DataFrame:
    """``tiles`` (id, is_base, mtime seconds, size, any others) with ``action``: 'expired', 'evicted' or 'kept'.

    Tiles older than ``max_days`` expire.  The others go in the order (is_base, mtime, id) until the rest fits the budget.
    """
    expired = F.col("mtime") < now - max_days * 86400
    live = ordered_buckets(tiles.where(~expired), ["is_base", "mtime", "id"])
    total = live.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))  # one row
    summed = running_sum(live, ["_bucket"], ["is_base", "mtime", "id"], "size", "_upto").join(F.broadcast(total), F.lit(True))
    judged = summed.withColumn("action", F.when(F.col("_total") - (F.col("_upto") - F.col("size")) > budget, "evicted").otherwise("kept"))
    return judged.select(*tiles.columns, "action").union(tiles.where(expired).withColumn("action", F.lit("expired")))


def fixed_window(requests: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests (ts seconds, id) with ``allowed``: at most ``limit`` a key and window."""
    w = Window.partitionBy(key, "slot").orderBy("ts", "id")
    return requests.withColumn("slot", F.floor(F.col("ts") / seconds)).withColumn("allowed", F.row_number().over(w) <= limit)


def debounce(events: DataFrame, key: str, gap: int) -> DataFrame:
    """The last event (ts seconds, id) of each burst: no later one of its key follows within ``gap`` seconds."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    return events.withColumn("next", F.lead("ts").over(w)).where(F.col("next").isNull() | (F.col("next") - F.col("ts") > gap)).drop("next")


class Lru:
    """Least recently used cache; a hit renews a key, overwriting it does not."""

    def __init__(self, size: int):
        self.size, self.rows = size, OrderedDict()

    def get(self, key):
        if key in self.rows:
            self.rows.move_to_end(key)
            return self.rows[key]
        return None

    def put(self, key, value=True) -> None:
        self.rows[key] = value
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)


def lru_hits(lookups: DataFrame, cache: str, key: str, size: int) -> DataFrame:
    """Hits and misses of each cache, whose lookups (ts, id) come in order; a cache is one sequential state."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lru, hits = Lru(size), 0
        for k in rows.sort_values(["ts", "id"])[key]:
            if lru.get(k) is not None:
                hits += 1
            else:
                lru.put(k)
        return pd.DataFrame({"cache": [rows[cache].iloc[0]], "hits": [hits], "misses": [len(rows) - hits]})

    return lookups.groupBy(cache).applyInPandas(run, f"cache {lookups.schema[cache].dataType.simpleString()}, hits long, misses long")
