"""Language-model scoring with a log-bilinear neural model.

Counts of all words of all training texts are gathered over the whole corpus.  The neural part is factored: it predicts
a class, then a word of the class.  Each of the most frequent words is a class; the next ones form classes of ``GROUP``
words of neighbouring frequency, in which each word has a vector of its own; all others fall into ``TAILS`` classes by
their last two bytes.  The words before a word are embedded, scaled by a weight for each place and summed; the product
with a vector, plus its bias, is the score of a class, or of a word within its class.  It is trained in numpy by
noise-contrastive estimation: a sample of bounded size gives the start, from which each partition goes once over all its
training texts, and the partitions' parameters are averaged by their tokens.  It is scored with batched matrix products
and exact softmaxes.  Inside a tail class a word has its discounted share of the corpus counts, and what is discounted
(the share of words that were met once) goes to words never met, which count as one in each tail class.

Only the words outside the model's table need their counts looked up.  Each task scores its texts as far as the model
goes and packs them into blocks of bounded bytes: a block names its other words once and keeps, for each text, their
places among these.  The names are joined with the counts, the counts come back to the block, and what is left is summed
up there.  Texts are never exchanged, and no task holds more than a block.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch, byte_view, mix64, slices, small_batches, word_hashes, word_spans
from quiltwork.llm.language_id import remainder

#: Single-word classes and one, words with a vector of their own as context and target, size of vectors, words before.
CLASSES, CONTEXTS, DIM, BEFORE = 128, 4096, 16, 4
#: Words of a class that has several of them, classes of all other words (a power of two).
GROUP, TAILS = 128, 32
#: Bounds of the sample that the parameters start from: training documents, words of a document (a stretch at a random place).
SAMPLE_DOCS, SAMPLE_WORDS = 3000, 120
EPOCHS, BATCH, NOISE, RATE, SEED = 6, 512, 64, 0.15, 11
#: Tokens and noise words of a step of the pass over all training texts, noise words inside a class.
PASS_BATCH, PASS_NOISE, GROUP_NOISE = 16384, 16, 8
#: Partitions whose parameters one task averages; their means are averaged again until one is left.
MEANS = 7
#: Bytes of text of a block, one text at least.
BLOCK_BYTES = 4_000_000
#: The end of a text is a token of its own, with this hash (fixed).
END = int(mix64(np.array([0xE0D], np.uint64))[0])
ALPHA = 0.1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and one end, and n+1 offsets; the lowest bits are the tail class, from a word's end."""
    starts, ends, first = word_spans(data, offsets)
    last = (data[ends - 1] | 0x20).astype(np.uint64) << np.uint64(8) | (data[np.maximum(ends - 2, starts)] | 0x20).astype(np.uint64)
    h = word_hashes(data, starts, ends) * np.uint64(TAILS) | mix64(last) % np.uint64(TAILS)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    out = np.empty(int(at[-1]), np.uint64)
    out[at[1:] - 1] = END
    is_word = np.ones(len(out), bool)
    is_word[at[1:] - 1] = False
    out[is_word] = h
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _add_rows(where: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their number."""
    where = np.ascontiguousarray(where, np.int64)
    return np.stack([np.bincount(where, v, rows) for v in np.array(values.T, np.float64, order="C")], axis=1).astype(np.float32)


class Model:
    """Sorted hashes and their numbers; the last context vector is that of none, the one before that of any other word.

    ``class_words``: each is a class; ``middle``: by frequency, ``GROUP`` of them a class; what is left of ``prior`` is
    the tail classes.  Both are among ``context_words``.  ``share``: frequencies of ``middle``.
    """

    PARAMETERS = ("embed", "place", "output", "bias", "inner", "inner_bias")

    def __init__(self, context_words: np.ndarray, class_words: np.ndarray, prior: np.ndarray, middle: np.ndarray | None = None, share: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        self.context_words, self.class_words = np.sort(context_words), np.sort(class_words)
        middle = np.zeros(0, np.uint64) if middle is None else middle
        groups = -(-len(middle) // GROUP)
        k, c = len(self.context_words) + 2, len(prior)
        self.embed = rng.normal(0, 0.1, (k, DIM)).astype(np.float32)
        self.place = np.full((BEFORE, DIM), 1 / BEFORE, np.float32) * np.arange(BEFORE, 0, -1, dtype=np.float32)[:, None] / 2
        self.output = rng.normal(0, 0.1, (c, DIM)).astype(np.float32)
        self.prior = np.maximum(prior, 1e-9) / np.maximum(prior, 1e-9).sum()
        self.bias = np.log(self.prior).astype(np.float32)
        self.first_group, self.first_tail = len(self.class_words), len(self.class_words) + groups
        self.inner = rng.normal(0, 0.1, (groups * GROUP, DIM)).astype(np.float32)
        # places without a word have no probability
        self.inner_bias = np.full(groups * GROUP, -1e9, np.float32)
        if len(middle):
            share = np.maximum(share, 1e-9)
            total = np.bincount(np.arange(len(middle)) // GROUP, share)
            self.inner_bias[: len(middle)] = np.log(share / np.repeat(total, GROUP)[: len(middle)])
        self.group_size = np.full(groups, GROUP, np.int64)
        if groups:
            self.group_size[-1] = len(middle) - GROUP * (groups - 1)
        # of each context word: its class (or -1) and its place among the words of all groups (or -1)
        self.own_class, self.own_slot = np.full(k - 1, -1, np.int32), np.full(k - 1, -1, np.int32)
        self.own_class[self._find(self.context_words, self.class_words)] = np.arange(len(self.class_words))
        at = self._find(self.context_words, middle)
        self.own_slot[at] = np.arange(len(middle))
        self.own_class[at] = self.first_group + np.arange(len(middle)) // GROUP
        self.sums = {n: np.full_like(getattr(self, n), 1e-6) for n in self.PARAMETERS}

    @staticmethod
    def _find(words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of the words; ``len(words)`` for others."""
        if not len(words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        return np.where(words[at] == h, at, len(words))

    def places(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's class, the numbers of the ``BEFORE`` tokens before it, nearest first, and its place in a group or -1."""
        own = self._find(self.context_words, h)
        none = len(self.context_words) + 1
        place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
        before = np.full((len(h), BEFORE), none, np.int32)
        for k in range(1, BEFORE + 1):
            before[k:, k - 1] = own[:-k]
            before[place < k, k - 1] = none
        target = self.own_class[own]
        tails = len(self.prior) - self.first_tail
        target = np.where(target < 0, self.first_tail + (h % np.uint64(max(1, tails))).astype(np.int32), target)
        return target, before, self.own_slot[own]

    def numbers(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class, and the numbers of the ``BEFORE`` tokens before it, nearest first."""
        return self.places(h, at)[:2]

    def _state(self, before: np.ndarray) -> np.ndarray:
        state = self.embed[before[:, 0]] * self.place[0]
        for k in range(1, BEFORE):
            state += self.embed[before[:, k]] * self.place[k]
        return state

    def train(self, target: np.ndarray, before: np.ndarray, slot: np.ndarray | None = None, epochs: int = EPOCHS, batch: int = BATCH, noise: int = NOISE, rng: np.random.Generator | None = None) -> None:
        """Noise-contrastive estimation, Adagrad; noise words come from the classes' prior and are shared by a batch."""
        rng = rng or np.random.default_rng(SEED)
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                self._learn(target[pick], before[pick], None if slot is None else slot[pick], noise, rng)

    def _learn(self, y: np.ndarray, ctx: np.ndarray, slot: np.ndarray | None, noises: int, rng: np.random.Generator) -> None:
        scale = np.float32(20 / len(y))
        log_noise = np.log(noises * self.prior).astype(np.float32)
        noise = rng.choice(len(self.prior), noises, p=self.prior)
        state = self._state(ctx)
        vectors, own = self.output[noise], self.output[y]
        dg = (_sigmoid(np.einsum("nd,nd->n", state, own) + self.bias[y] - log_noise[y]) - 1) * scale
        own *= dg[:, None]
        d_state, grads = own, {}
        g_out = _add_rows(y, dg[:, None] * state, len(self.output))
        g_bias = np.bincount(y, dg, len(self.bias)).astype(np.float32)
        for a in range(0, len(y), 2048):
            rows = slice(a, a + 2048)
            db = state[rows] @ vectors.T
            db += self.bias[noise] - log_noise[noise]
            db = _sigmoid(db)
            db *= scale
            d_state[rows] += db @ vectors
            np.add.at(g_out, noise, db.T @ state[rows])
            np.add.at(g_bias, noise, db.sum(0))
        grads["output"], grads["bias"] = g_out, g_bias
        inside = np.flatnonzero(slot >= 0) if slot is not None else ()
        if len(inside):
            grads["inner"], grads["inner_bias"] = self._learn_inside(state, d_state, inside, slot[inside], scale, rng)
        grads["place"] = np.stack([np.einsum("nd,nd->d", d_state, self.embed[ctx[:, k]]) for k in range(BEFORE)])
        grads["embed"] = sum(_add_rows(ctx[:, k], d_state, len(self.embed)) * self.place[k] for k in range(BEFORE))
        for name, grad in grads.items():
            self.sums[name] += grad * grad
            getattr(self, name)[...] -= RATE * grad / np.sqrt(self.sums[name] + 1e-4)

    def _learn_inside(self, state: np.ndarray, d_state: np.ndarray, rows: np.ndarray, slot: np.ndarray, scale: np.float32, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the words inside groups, added to ``d_state``; the noise is equally spread over a group's words."""
        order = np.argsort(slot // GROUP, kind="stable")
        rows, slot = rows[order], slot[order]
        bounds = np.searchsorted(slot // GROUP, np.arange(len(self.group_size) + 1))
        log_noise = np.log(GROUP_NOISE / self.group_size).astype(np.float32)
        mine, own = state[rows], self.inner[slot]
        dg = (_sigmoid(np.einsum("nd,nd->n", mine, own) + self.inner_bias[slot] - log_noise[slot // GROUP]) - 1) * scale
        own *= dg[:, None]
        g_inner = _add_rows(slot, dg[:, None] * mine, len(self.inner))
        g_bias = np.bincount(slot, dg, len(self.inner)).astype(np.float32)
        draws = rng.integers(0, 1 << 30, GROUP_NOISE)
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[g], bounds[g + 1])
            noise = g * GROUP + draws % self.group_size[g]
            vectors = self.inner[noise]
            db = _sigmoid(mine[part] @ vectors.T + (self.inner_bias[noise] - log_noise[g])) * scale
            own[part] += db @ vectors
            np.add.at(g_inner, noise, db.T @ mine[part])
            np.add.at(g_bias, noise, db.sum(0))
        d_state[rows] += own
        return g_inner, g_bias

    def log_probs(self, target: np.ndarray, before: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Natural logarithms of the classes' normalised probabilities."""
        out = np.empty(len(target))
        columns = np.ascontiguousarray(self.output.T)
        for a in range(0, len(target), rows):
            y = target[a : a + rows]
            s = self._state(before[a : a + rows]) @ columns
            s += self.bias
            out[a : a + rows] = _log_softmax(s, y)
        return out

    def log_inside(self, slot: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithms of the words' normalised probabilities inside their groups; 0 for tokens outside groups."""
        out = np.zeros(len(slot))
        rows = np.flatnonzero(slot >= 0)
        rows = rows[np.argsort(slot[rows] // GROUP, kind="stable")]
        bounds = np.searchsorted(slot[rows] // GROUP, np.arange(len(self.group_size) + 1))
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            mine = rows[bounds[g] : bounds[g + 1]]
            words = slice(g * GROUP, (g + 1) * GROUP)
            s = self._state(before[mine]) @ self.inner[words].T
            s += self.inner_bias[words]
            out[mine] = _log_softmax(s, slot[mine] - g * GROUP)
        return out

    def flat(self) -> np.ndarray:
        """All parameters."""
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.PARAMETERS])

    def put(self, flat: np.ndarray) -> None:
        """The reverse of ``flat``."""
        a = 0
        for n in self.PARAMETERS:
            x = getattr(self, n)
            x[...] = flat[a : a + x.size].reshape(x.shape)
            a += x.size


def _log_softmax(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row's entry ``y``; ``s`` is overwritten."""
    own = s[np.arange(len(y)), y].astype(np.float64)
    top = 0.0
    if s.max() > 60 or s[:, 0].min() < -60:  # else no sum can overflow or vanish
        top = s.max(axis=1)
        s -= top[:, None]
    np.exp(s, out=s)
    return own - top - np.log(s.sum(axis=1, dtype=np.float32))


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), n: every word of every training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            total = np.bincount(back, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(total)], ["word", "n"])

        for b in batches:
            data, ends = byte_view(b.column(0))
            for x, y in slices(ends, BLOCK_BYTES):
                words, n = np.unique(tokens(data[ends[x] : ends[y]], ends[x : y + 1] - ends[x])[0], return_counts=True)
                held.append((words, n))
                size += len(words)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.where("learn").select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _train(docs: DataFrame, counts: DataFrame, tail: np.ndarray, once: np.ndarray, scratch: Scratch) -> tuple[Model, np.ndarray, np.ndarray, np.ndarray]:
    """The model, its words' counts, and of each tail class the tokens and the words met once; given are those of all words by lowest bits."""
    top = counts.orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()  # of fixed size
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.float64)
    of = (words % np.uint64(TAILS)).astype(np.int64)
    tail, once = tail - np.bincount(of, n, TAILS), once - np.bincount(of, n == 1, TAILS)
    own, middle, share = words[: CLASSES - 1], words[CLASSES - 1 :], n[CLASSES - 1 :]
    order = np.argsort(own)
    groups = np.bincount(np.arange(len(middle)) // GROUP, share) if len(middle) else np.zeros(0)
    prior = np.concatenate([n[: CLASSES - 1][order], groups, np.maximum(1.0, tail)])
    model = Model(words, own, prior, middle, share)
    chosen = docs.where("learn").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = tokens(*byte_view(b.column(1)))
            out = []
            for k in range(len(at) - 1):
                size = int(at[k + 1] - at[k])
                start = int(at[k]) + (int(mix64(np.array([size], np.uint64))[0]) % (size - SAMPLE_WORDS + 1) if size > SAMPLE_WORDS else 0)
                out.append(h[start : min(start + SAMPLE_WORDS, at[k + 1])].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "words"])

    # at most SAMPLE_DOCS ids
    rows = docs.where("learn").select("id", "text").join(F.broadcast(chosen.distinct()), "id", "left_semi").mapInArrow(cut, "id long, words binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["words"])))
    parts = [np.frombuffer(bytes(r["words"]), np.uint64) for r in rows]
    if parts:
        h = np.concatenate(parts)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        model.train(*model.places(h, at))
    _pass(docs, model, scratch)
    return model, n[np.argsort(words)], tail, once


def _pass(docs: DataFrame, model: Model, scratch: Scratch) -> None:
    """Every token of every training text once: each partition goes on from ``model``, then all are averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen, rng = copy.deepcopy(shared.value), 0, np.random.default_rng(SEED)
        for batch in batches:
            whole, ends = byte_view(batch.column(0))
            for a, b in slices(ends):
                h, at = tokens(whole[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                m.train(*m.places(h, at), epochs=1, batch=PASS_BATCH, noise=PASS_NOISE, rng=rng)
                seen += len(h)
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([m.flat().tobytes()], pa.binary())], ["part", "seen", "flat"])

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        seen = table.column("seen").to_numpy()[order]
        flat = [np.frombuffer(table.column("flat")[k].as_py(), np.float32) for k in order.tolist()]
        total = sum(n * f.astype(np.float64) for n, f in zip(seen.tolist(), flat, strict=True))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "seen": pa.array([seen.sum()], pa.int64()), "flat": pa.array([(total / seen.sum()).astype(np.float32).tobytes()], pa.binary())})

    schema = "part long, seen long, flat binary"
    means = scratch.keep(docs.where("learn").select("text").mapInArrow(run, schema))
    rows = means.count()
    while rows > 1:  # a few neighbours become one
        means = scratch.keep(means.groupBy(F.floor(F.col("part") / MEANS).alias("near")).applyInArrow(mean, schema))
        rows = means.count()
    for r in means.collect():
        model.put(np.frombuffer(bytes(r["flat"]), np.float32))


_ROW = "doc_id array<bigint>, learn array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, score array<double>, at array<int>, tails array<binary>, other array<binary>"


def _blocks(docs: DataFrame, shared, known: np.ndarray, scale: float) -> DataFrame:
    """A row for each block: words (those outside the model's table), and of each text its sums so far and its other words.

    ``known``: counts of the table's words; ``tails`` are the words' tail classes, a byte each; ``other`` holds places
    in ``words``, a text's from ``at`` on.
    """
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, number = shared.value, TaskContext.get().partitionId() << 32, 0
        gain = np.append(np.log10((known + ALPHA) / scale), 0.0)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate([x[-1] for x in held]), return_inverse=True)
            ids = pa.concat_arrays([x[0] for x in held])
            columns = [ids, *(pa.array(np.concatenate([x[k] for x in held])) for k in range(1, 6))]
            at = np.concatenate([[0], np.cumsum(np.concatenate([x[6] for x in held]))])
            # places byte by byte, so that the high bytes, mostly zero, take no room in an exchange
            planes = np.ascontiguousarray(place.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            columns += [pa.array(at.astype(np.int32)), pa.array([(words & np.uint64(TAILS - 1)).astype(np.uint8).tobytes()], pa.binary()), pa.array([planes.tobytes()], pa.binary())]
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            return pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), whole(pa.array(words.view(np.int64))), *map(whole, columns)], ["block", "words", *names])

        for batch in batches:
            data, ends = byte_view(batch.column(1))
            for a, b in slices(ends):
                h, at = tokens(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                own = m._find(m.context_words, h)
                inside = own < len(m.context_words)
                target, before, slot = m.places(h, at)
                logs = (m.log_probs(target, before) + m.log_inside(slot, before)) / np.log(10)
                sums = lambda x: np.add.reduceat(x, at[:-1])
                learn = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                held.append((batch.column(0).slice(a, b - a), learn, np.diff(at).astype(np.int64), sums(inside.astype(np.int64)), sums(gain[own]), sums(logs), sums((~inside).astype(np.int64)), h[~inside]))
                size += int(ends[b] - ends[a])
                if size > BLOCK_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return docs.select("id", "text", "learn").mapInArrow(run, f"block long, words array<bigint>, {_ROW}")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: both scores are log10 of a whole text.

    Learned from the texts whose crc32(doc_id as text) mod 10 is not 0, and from those without doc_id.  A null text is
    empty: its end is its one token.  Without training texts N and V are 0, every token is unknown, and score is that
    of the tail classes.  Texts of any length are taken whole; repeated rows are learned and scored as often as they
    occur; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(remainder(F.col("doc_id"), 10) != 0, F.lit(True)).alias("learn"),
    )
    counts = scratch.keep(count_words(rows))
    by_tail = counts.groupBy(F.col("word").bitwiseAND(TAILS - 1).alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()  # TAILS rows
    n_all, v_all = sum(r["n"] for r in by_tail), sum(r["v"] for r in by_tail)
    tails, once = np.zeros(TAILS), np.zeros(TAILS)
    for r in by_tail:
        tails[r["tail"]], once[r["tail"]] = r["n"], r["once"]
    model, known, tails, once = _train(rows, counts, tails, once, scratch)
    # the tail classes: what their words were met, and what words met once leave to those never met
    tails = np.maximum(1.0, tails)
    unmet = np.minimum(0.9, np.maximum(once, 1) / tails)
    scale = n_all + ALPHA * (v_all + 1)
    blocks = scratch.keep(_blocks(rows, spark.sparkContext.broadcast(model), known, scale))  # a model of fixed size
    asked = blocks.select(F.col("block").alias("owner"), F.posexplode("words").alias("place", "word"))
    # a word that many blocks ask for makes a skewed join, which Spark splits
    answers = asked.join(counts, "word").select("owner", "place", "n")

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = pa.table({f: pa.array([], t) for f, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        row = {c: left.column(c).combine_chunks().flatten() for c in left.column_names if c != "block"}
        tail = np.frombuffer(row["tails"][0].as_py(), np.uint8).astype(np.int64)
        c = np.zeros(len(tail))
        if right.num_rows:
            c[right.column("place").to_numpy()] = right.column("n").to_numpy()
        inside = np.where(c > 0, np.log10(np.maximum(c, 1) / tails[tail]) + np.log10(1 - unmet[tail]), np.log10(unmet[tail]))
        at, planes = row["at"].to_numpy().astype(np.int64), np.frombuffer(row["other"][0].as_py(), np.uint8)
        other = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4")[:, 0]

        def add(name: str, values: np.ndarray) -> pa.Array:
            upto = np.concatenate([[0], np.cumsum(values[other], dtype=np.longdouble if values.dtype.kind == "f" else np.int64)])
            return pa.array((row[name].to_numpy() + (upto[at[1:]] - upto[at[:-1]])).astype(values.dtype))

        return pa.table(
            {
                "doc_id": row["doc_id"],
                "held_out": pa.array(~row["learn"].to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": row["n_tokens"],
                "n_known": add("n_known", (c > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(row["doc_id"]), n_all, np.int64)),
                "base_score": add("base", np.log10((c + ALPHA) / scale)),
                "score": add("score", inside),
            }
        )

    return blocks.drop("words").groupBy("block").cogroup(answers.groupBy("owner")).applyInArrow(run, schema)
