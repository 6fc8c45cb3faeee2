"""Best-fit decreasing packing of token sequences.

Only lengths decide a packing, and there are at most ``capacity`` different ones.  So the best-fit-decreasing
order is run once over the global histogram of lengths: a segment tree over the remaining capacities finds, for
a length, the tightest open bin in logarithmic time, and all bins that are equally full take their documents in
one step.  The result is a list of runs ("documents a to b of length l go to bins x, x+1, ... at offset o"),
whose number depends on the capacity alone.  Each document then finds its run by its rank among the documents
of its length; ranks come from prefix sums over partitions.  So the packing is the one that a single machine would
make, while no task ever holds more than its own partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm import bpe
from quiltwork.llm.common import Scratch, small_batches

CAPACITY = 2048


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which of them some open bin has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)

    def put(self, at: int, present: bool) -> None:
        at += self.width
        self.any[at] = present
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity that is ``least`` or more; -1 if there is none."""
        at = least + self.width
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, documents to a bin, offset) in order of length and rank; and the number of bins.

    Best-fit decreasing, exactly: longest first, each into the open bin with the least room that suffices.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> intervals (first bin, number of bins)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def add(room: int, first: int, n: int) -> None:
        open_bins.setdefault(room, []).append((first, n))
        tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                each = room // length
                n = -(-left // each)
                intervals = [(bins, n)]
                bins += n
            else:
                each = room // length  # a bin that took one is now the tightest, until it can take no more
                intervals = open_bins.pop(room)
                tree.put(room, False)
            while intervals:
                first, n = intervals.pop()
                if not left:
                    add(room, first, n)
                    continue
                full = min(n, left // each)
                if full:
                    runs.append((length, rank, first, each, capacity - room))
                    rank, left = rank + full * each, left - full * each
                    add(room - each * length, first, full)
                if full < n and left and left < each:
                    runs.append((length, rank, first + full, left, capacity - room))
                    add(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    intervals.append((first + full, n - full))
    return runs, bins


@lru_cache(2)
def _encoder(path: str):
    """The same vocabulary and merge ranks in the tiktoken library, which encodes single texts fastest."""
    import tiktoken

    codec = bpe.load(path)
    ranks = {token: codec.ranked[r] for token, r in codec.rank_of.items()}
    return codec, tiktoken.Encoding("own", pat_str=bpe._WORDS.pattern, mergeable_ranks=ranks, special_tokens={})


def _tokens(path: str, text: str) -> np.ndarray:
    codec, fast = _encoder(path)
    if codec.cut is not None and any(s in text for s in codec.special):
        return np.frombuffer(codec.encode(text), "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as token ids and an end id, cut only where longer than ``capacity``.

    A null text is empty (its document is the end id alone).  The first piece of a long document takes the remainder.
    """
    path = tokenizer or bpe.default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(_tokens(path, text or ""), np.uint32(end_id)).astype("<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for p in range(len(cut) - 1):
                    row.append(k)
                    piece.append(p)
                    start.append(cut[p])
                    length.append(cut[p + 1] - cut[p])
                    crc.append(zlib.crc32(ids[cut[p] : cut[p + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(items: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``items`` with sequence_id and offset.

    ``length`` is from 1 to ``capacity``; a row without one, or with another, raises an error.  Other columns may have
    any names but ``sequence_id`` and ``offset``, which are replaced.  Rows of equal length are interchangeable, so
    repeated rows are packed one by one; an empty table gives no rows.
    """
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = items.select(*columns)
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    kept = scratch.keep(items.withColumn("_qw_part", F.spark_partition_id()))
    bad = kept.where(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))
    if not bad.isEmpty():
        raise ValueError(f"length must be from 1 to {capacity}")
    counts = kept.groupBy("_qw_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_qw_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.keep(counts.withColumn("_qw_first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(histogram, capacity)
    # The plan's size is bounded by the capacity, not by the number of documents.
    table: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for r in runs:
        table.setdefault(r[0], []).append(r)
    shared = spark.sparkContext.broadcast({k: ([r[1] for r in v], v) for k, v in table.items()})
    own = Window.partitionBy("_qw_part", "length").orderBy(*[F.col(c) for c in ("doc_id", "piece") if c in items.columns])
    ranked = kept.withColumn("_qw_own", F.row_number().over(own)).join(starts.drop("n"), ["_qw_part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        for b in batches:
            ids, offsets = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("_qw_rank").to_pylist(), strict=True):
                firsts, own_runs = find[length]
                _, first, first_bin, each, offset = own_runs[bisect_right(firsts, rank) - 1]
                ids.append(first_bin + (rank - first) // each)
                offsets.append(offset + (rank - first) % each * length)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*columns, "sequence_id", "offset"])

    ranked = ranked.select(*columns, (F.col("_qw_first") + F.col("_qw_own") - 1).alias("_qw_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null or empty text is its end id alone; texts of any length are cut into as many pieces as it takes; repeated
    rows and rows without doc_id are packed as often as they occur; other columns are ignored; an empty table gives
    no rows.
    """
    return assign(pieces(docs, tokenizer, capacity, end_id), capacity)
