"""Language identification by prediction by partial matching.

For each language a tree of byte contexts (up to ``ORDER`` bytes) holds frozen counts.  A context that saw n bytes,
d of them different, predicts byte b with count c as c / (n + d) and escapes to the next shorter context with
d / (n + d); bytes that the longer context knows are excluded there, so each context's probabilities add up to one,
and below the empty context all 256 bytes are equally likely.  A text's code length under a language is exact to
rounding; the shortest wins.  The trees become two tables, context -> node and (node, byte) -> bits, so whole
batches of texts are scored by array lookups.  Where the alphabet is too large for a table of all contexts, the node of
the longest known context is looked up among the sorted contexts that the samples hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.common import byte_view, slices, small_batches

ORDER = 3
#: Bound of the training sample: documents a language, each taken whole.
SAMPLE_DOCS = 160
#: Contexts up to which a language's tree has a table of all of them.
DENSE = 1 << 22
UNKNOWN = "und"


#: One language's counts: for each context length the (context, next byte) pairs as one number, sorted, and how often.
Counts = list[tuple[np.ndarray, np.ndarray]]


def count_pairs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``length`` + 1 bytes inside the texts, as big-endian numbers, and how often each occurs."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    at = np.flatnonzero(place >= length)
    key = np.zeros(len(at), np.int64)
    for back in range(length, -1, -1):
        key = key << 8 | data[at - back]
    return np.unique(key, return_counts=True)


def _sample(train: DataFrame) -> dict[str, Counts]:
    """Counts by language, of at most SAMPLE_DOCS documents of each language."""
    small_batches(train.sparkSession)
    texts = train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = texts.where(F.col("doc_id").isNotNull()).select("doc_id", "lang")
    chosen = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, offsets = byte_view(b.column(1).filter(pa.array(langs == lang)))
                for length in range(ORDER + 1):
                    keys, n = count_pairs(data, offsets, length)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), pa.array(n)], ["lang", "length", "key", "n"])

    # the ids are at most SAMPLE_DOCS a language
    pairs = texts.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text").mapInArrow(run, "lang string, length int, key long, n long")
    # as many rows as the sample has different runs of bytes
    table = pairs.groupBy("lang", "length", "key").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("length", "ascending"), ("key", "ascending")])
    langs, lengths = table.column("lang").to_pylist(), table.column("length").to_numpy()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    empty = np.zeros(0, np.int64)
    out: dict[str, Counts] = {lang: [(empty, empty)] * (ORDER + 1) for lang in dict.fromkeys(langs)}
    bounds = [0, *(k for k in range(1, len(langs)) if langs[k] != langs[k - 1] or lengths[k] != lengths[k - 1]), len(langs)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            out[langs[a]][int(lengths[a])] = (keys[a:b], n[a:b])
    return out

#: Bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_BYTES = 16 << 20


class Model:
    """Context trees of all languages as lookup tables."""

    def __init__(self, counts: dict[str, Counts], order: int = ORDER):
        self.langs = sorted(counts)
        seen = np.zeros(256, bool)
        for own in counts.values():
            seen[own[0][0]] = True
        known = np.flatnonzero(seen)
        #: symbols: 0 is any byte that no sample has, and the time before a text
        self.width = len(known) + 1
        self.order = order
        self.dense = self.width**order <= DENSE
        self.symbol = np.zeros(256, np.int32)
        self.symbol[known] = np.arange(1, self.width)
        #: a language's nodes of all contexts, or for each length its sorted contexts and their nodes
        self.nodes: list = []
        self.bits: list[np.ndarray] = []
        for lang in self.langs:
            nodes, bits = self._tree(counts[lang])
            self.nodes.append(nodes)
            self.bits.append(bits.reshape(-1))

    @classmethod
    def of(cls, samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
        """A model of whole texts by language."""
        counts = {}
        for lang, texts in samples.items():
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            counts[lang] = [count_pairs(data, offsets, k) for k in range(order + 1)]
        return cls(counts, order)

    def contexts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each byte's symbol and the code of the ``order`` symbols before it, within its text."""
        symbols = self.symbol[data]
        code = np.zeros(len(data), np.int64 if self.width**self.order >= 1 << 31 else np.int32)
        heads = offsets[:-1][np.diff(offsets) > 0]
        for back in range(self.order, 0, -1):
            code *= self.width
            shifted = np.zeros(len(data), code.dtype)
            shifted[back:] = symbols[:-back]
            for k in range(back):
                at = heads + k
                shifted[at[at < len(data)]] = 0
            code += shifted
        return symbols, code

    def _tree(self, counts: Counts) -> tuple[np.ndarray | list, np.ndarray]:
        w = self.width
        table = np.zeros(w**self.order, np.int32) if self.dense else []
        probs: list[np.ndarray] = []
        parent_of: dict[int, int] = {}
        for k in range(self.order + 1):
            pairs, n = counts[k]
            # a context's code has its nearest byte in the lowest place
            code = np.zeros(len(pairs), np.int64)
            for back in range(k, 0, -1):
                code = code * w + self.symbol[pairs >> 8 * back & 255]
            order = np.argsort(code, kind="stable")
            code, after, n = code[order], self.symbol[pairs[order] & 255], n[order]
            keys, first = np.unique(code, return_index=True)
            bounds = np.append(first, len(code))
            if k == 0:  # the empty context; below it every byte costs 8 bits
                probs.append(self._node(np.bincount(after, n, w), np.full(w, 1 / 256), 256 - (w - 1)))
                continue
            nodes = {}
            for row, key in enumerate(keys.tolist()):
                own = slice(bounds[row], bounds[row + 1])
                nodes[key] = len(probs)
                probs.append(self._node(np.bincount(after[own], n[own], w), probs[parent_of.get(key % w ** (k - 1), 0)], 256 - (w - 1)))
            if self.dense:
                view = table.reshape(-1, w**k)
                for key, node in nodes.items():
                    view[:, key] = node
            else:
                table.append((keys, np.array([nodes[key] for key in keys.tolist()], np.int32)))
            parent_of = nodes
        return table, (-np.log2(np.array(probs))).astype(np.float32)

    @staticmethod
    def _node(counts: np.ndarray, below: np.ndarray, unseen: int) -> np.ndarray:
        """Probabilities of the symbols; that of symbol 0 is for one of the ``unseen`` bytes."""
        counts = np.where(np.arange(len(counts)) == 0, 0, counts)
        n, known = counts.sum(), counts > 0
        d = int(known.sum())
        if d == 0:
            return below
        room = max(1 - below[known].sum(), 1e-12)
        out = below * (d / (n + d) / room) if unseen or d < len(counts) - 1 else below * 0
        out = np.where(known, counts / (n + d), out)
        return np.maximum(out, 1e-12)

    def _node_of(self, nodes: np.ndarray | list, code: np.ndarray) -> np.ndarray:
        """The node of the longest context that the tree knows; 0 is the empty one."""
        if self.dense:
            return nodes[code]
        out = np.zeros(len(code), np.int32)
        for k, (keys, numbers) in enumerate(nodes, 1):
            if len(keys):
                short = code % self.width**k
                at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                out = np.where(keys[at] == short, numbers[at], out)
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language (texts x languages)."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return out
        symbols, code = self.contexts(data, offsets)
        for k, (nodes, bits) in enumerate(zip(self.nodes, self.bits, strict=True)):
            at = self._node_of(nodes, code)
            at *= self.width
            at += symbols
            out[full, k] = np.add.reduceat(bits[at], offsets[:-1][full], dtype=np.float64)
        return out


def fit(train: DataFrame) -> Model:
    """A model of the rows of ``train`` with neither doc_id, text nor lang null, whole texts.

    Of more than SAMPLE_DOCS rows of a language the first by a hash of doc_id are taken, with all rows that repeat
    their doc_id; an empty table gives a model without languages.
    """
    return Model(_sample(train))


def _classify(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share of the likelihood, and bits a byte under it."""
    data, offsets = byte_view(texts)
    parts = [model.code_lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    bits = np.concatenate(parts) if parts else np.zeros((0, len(model.langs)))
    # slice by slice, so that only a slice's texts are Python strings at a time
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for a, b in slices(offsets) for t in texts.slice(a, b - a).to_pylist()], bool)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = bits.argmin(axis=1)
    least = bits.min(axis=1)
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, share, 0.0), least / np.maximum(np.diff(offsets), 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every whole text.

    lang_pred is ``und`` and score 0 if the text is null, empty or has no letter, or no language was learned.
    Of equal code lengths the first language by name wins.  Equal texts and repeated rows are judged alike, texts of
    any length are coded whole, other columns are ignored, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, share, rate = _classify(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, model: Model, most_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in some learned language.

    Rejected: ``und``, and texts that even the best language codes with more than ``most_bits`` a byte, that is,
    worse than no model at all; null and empty texts are ``und``.  Repeated rows are kept or rejected alike, with or
    without doc_id; texts of any length are coded whole; columns of any name are carried along.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _, rate = _classify(shared.value, b.column(at))
            yield b.filter(pa.array((np.array(names, object) != UNKNOWN) & (rate <= most_bits)))

    return docs.mapInArrow(run, docs.schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
