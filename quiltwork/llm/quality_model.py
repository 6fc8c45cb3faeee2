"""Quality classifier: a byte-level convolutional network in numpy.

A filter of width ``WIDTH`` gives each byte value a weight at each of its places, so the response at a place of the
text is a sum of ``WIDTH`` table rows.  The text, whole, is cut into blocks of ``BLOCK`` bytes, and a chunk is two
neighbouring blocks, so chunks overlap by half.  The responses' maxima over each chunk pass a rectifier and a linear
layer; the chunks' outputs are averaged into the logit of one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import byte_view, small_batches
from quiltwork.llm.language_id import remainder

WIDTH, FILTERS, BLOCK = 6, 16, 256
#: Bound of the training sample: documents of each label, each taken whole.
SAMPLE_DOCS = 1500
STEPS, BATCH, SEED = 260, 48, 7


class Network:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, shift: float):
        self.filters, self.bias, self.out, self.shift = filters, bias, out, shift

    def responses(self, data: np.ndarray) -> np.ndarray:
        """At each place the sum over the filter's places; beyond the end there is nothing to add."""
        r = np.repeat(self.bias[None, :], len(data), axis=0)
        for k in range(min(WIDTH, len(data))):
            r[: len(data) - k] += self.filters[k].take(data[k:], axis=0)
        return r

    def peaks(self, data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of each block: its text and its filters' largest responses; with ``places`` also the bytes seen there.

        The bytes are (blocks, filters, WIDTH) symbols; 256 stands for what is beyond a text's end.
        """
        n, gap = len(offsets) - 1, WIDTH - 1
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        if not len(owner):
            return owner, np.zeros((0, FILTERS), np.float32), np.zeros((0, FILTERS, WIDTH), np.uint16)
        # texts stand apart by the symbol 256, which weighs nothing, so no filter sees two texts
        place = offsets[:-1] + np.arange(n) * gap
        apart = np.full(len(data) + n * gap + 1, 256, np.uint16)
        for k in np.flatnonzero(blocks):
            apart[place[k] : place[k] + sizes[k]] = data[offsets[k] : offsets[k + 1]]
        first = np.cumsum(blocks) - blocks
        begin = place[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        end = np.minimum(begin + BLOCK, place[owner] + sizes[owner])
        step, top = 1 << 10, np.empty((len(begin), FILTERS), np.float32)
        seen = np.empty((len(begin), FILTERS, WIDTH), np.uint16) if places else None
        for a in range(0, len(begin), step):
            b = min(a + step, len(begin))
            lo, hi = int(begin[a]), int(end[b - 1])
            r = self.responses(apart[lo : hi + gap])
            if not places:
                edges = np.stack([begin[a:b] - lo, end[a:b] - lo], axis=1).reshape(-1)
                top[a:b] = np.maximum.reduceat(r, edges, axis=0)[::2]
                continue
            inside = begin[a:b, None] - lo + np.arange(BLOCK)
            rows = np.where((inside < end[a:b, None] - lo)[:, :, None], r[np.minimum(inside, len(r) - 1)], -np.inf)
            at = rows.argmax(axis=1)
            top[a:b] = np.take_along_axis(rows, at[:, None, :], 1)[:, 0]
            seen[a:b] = apart[(begin[a:b, None] + at)[:, :, None] + np.arange(WIDTH)]
        return owner, top, seen

    @staticmethod
    def chunks(owner: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A chunk is a block and the next one of the same text: its responses, and the block that each is from."""
        chunk, source = peaks.copy(), np.repeat(np.arange(len(peaks))[:, None], FILTERS, axis=1)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        chunk[joined] = np.maximum(peaks[joined], peaks[joined + 1])
        source[joined] += peaks[joined + 1] > peaks[joined]
        return chunk, source

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One logit a text; an empty text has that of silent filters."""
        owner, peaks, _ = self.peaks(data, offsets)
        value = np.maximum(self.chunks(owner, peaks)[0], 0) @ self.out
        n = len(offsets) - 1
        return self.shift + np.bincount(owner, value, n) / np.maximum(np.bincount(owner, minlength=n), 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -40, 40)))


def _first_filters(rng: np.random.Generator) -> np.ndarray:
    filters = rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32)
    filters[:, 256] = 0
    return filters


def train_network(texts: list[bytes], labels: np.ndarray, prior: float, steps: int = STEPS) -> Network:
    """Adam on balanced batches; the output's shift then takes up the share ``prior`` of label 1."""
    rng = np.random.default_rng(SEED)
    net = Network(_first_filters(rng), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    pools = [np.flatnonzero(labels == y) for y in (0, 1)]
    odds = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not len(pools[0]) or not len(pools[1]):
        net.out[:] = 0
        net.shift = odds
        return net
    params = {"filters": net.filters, "bias": net.bias, "out": net.out, "shift": np.zeros(1, np.float32)}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v2 = {k: np.zeros_like(v) for k, v in params.items()}
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, BATCH // 2) for p in pools])
        own = [texts[i] for i in pick]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        owner, peaks, seen = net.peaks(np.frombuffer(b"".join(own), np.uint8), offsets, places=True)
        chunk, source = net.chunks(owner, peaks)
        count = np.maximum(np.bincount(owner, minlength=len(pick)), 1)
        on = np.maximum(chunk, 0)
        z = np.bincount(owner, on @ net.out, len(pick)) / count + params["shift"][0]
        d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) / len(pick)).astype(np.float32)
        each = (d / count)[owner]
        back = each[:, None] * net.out * (chunk > 0)
        grad = {"shift": np.array([d.sum()], np.float32), "out": each @ on, "bias": back.sum(0)}
        # each response goes back to the bytes that its filter saw in the block that it is from
        bytes_seen = seen[source, np.arange(FILTERS)]
        index = (np.arange(WIDTH) * 257 + bytes_seen) * FILTERS + np.arange(FILTERS)[:, None]
        flat = np.bincount(index.reshape(-1), np.repeat(back.reshape(-1), WIDTH), WIDTH * 257 * FILTERS)
        grad["filters"] = flat.reshape(WIDTH, 257, FILTERS).astype(np.float32)
        grad["filters"][:, 256] = 0
        for k, p in params.items():
            g = grad[k] + (1e-4 * p if k in ("filters", "out") else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            p -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-6)
    net.shift = float(params["shift"][0]) + odds
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network of the labelled rows that are not held out; at most SAMPLE_DOCS documents of each label.

    Labels other than 0 and 1, nulls, and rows without doc_id are left out; of several labels of a document the lowest
    counts.  Sampled documents are taken whole, with rows that repeat their doc_id; null texts are empty.  Without
    labels of both kinds the network is silent and gives every text the same score.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(remainder(F.col("doc_id"), 4) != 2)
    share = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.union(part)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    # at most 2 * SAMPLE_DOCS ids
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int"), "raw").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["raw"])))
    total = sum(share.values())
    return train_network([bytes(r["raw"]) for r in rows], np.array([r["quality"] for r in rows], np.float32), share.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text; null and empty texts get the score of silent filters.

    Texts of any length are scored whole, repeated rows alike, other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(*byte_view(b.column(1))), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
