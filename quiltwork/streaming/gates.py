"""Limits and sessions over streams of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def request_rates(requests: DataFrame, key: str, window: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests by key and fixed window, and how many are beyond ``limit``; ``requests`` has ``ts``, a timestamp."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window), key).agg(F.count(F.lit(1)).alias("asked"))
    return counted.select(key, F.col("window.start").alias("start"), "asked", F.greatest(F.lit(0), F.col("asked") - limit).cast("long").alias("rejected"))


def bursts(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key with pauses below ``gap``: the debounced form of a stream."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def slot_gate(requests: DataFrame, gate: str, interval: int) -> DataFrame:
    """gate, id, wait: each request (ts seconds, id) of a gate takes the first slot free at its time; state is one number a gate."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        waits = []
        for ts in rows["ts"]:
            slot = ts if free is None else max(ts, free)
            waits.append(slot - ts)
            free = slot + interval
        state.update((int(free),))
        yield pd.DataFrame({gate: [key[0]] * len(rows), "id": rows["id"].to_numpy(), "wait": waits})

    kind = requests.schema[gate].dataType.simpleString()
    return requests.groupBy(gate).applyInPandasWithState(run, f"{gate} {kind}, id long, wait long", "free long", "append", GroupStateTimeout.NoTimeout)


def lru_hits(lookups: DataFrame, cache: str, key: str, size: int) -> DataFrame:
    """cache, id, hit for each lookup (ts, id, key); the state of a cache is its keys in the order of use."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from quiltwork.operators.cache import Lru

        lru = Lru(size)
        for k in state.get[0] if state.exists else []:
            lru.put(k)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        hits = []
        for k in rows[key].astype(str):
            hits.append(lru.get(k) is not None)
            if not hits[-1]:
                lru.put(k)
        state.update((list(lru.rows),))
        yield pd.DataFrame({cache: [name[0]] * len(rows), "id": rows["id"].to_numpy(), "hit": hits})

    kind = lookups.schema[cache].dataType.simpleString()
    return lookups.groupBy(cache).applyInPandasWithState(run, f"{cache} {kind}, id long, hit boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)
