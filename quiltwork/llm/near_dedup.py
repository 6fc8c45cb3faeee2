"""MinHash near-duplicate grouping.

1. Sketch: each text becomes the set of its word shingles (64-bit hashes) and a SuperMinHash signature.
   Every element walks through the signature's places in its own random order; its value at the j-th step is j plus
   a random fraction, so places of one element are correlated and the signature's variance is lower than that of
   independent hashes; a set stops as soon as no later step can lower any place.
2. Equal sets are one class; only one row of a class goes on, so copies cost nothing.
3. Banding: classes that share a band are candidates.  A band's bucket is never expanded into pairs: each member is
   compared with the bucket's head, first with the one that it shares the most bands with, then with the others.
   A group of near copies so costs a few comparisons a row.
4. Verification on the full sets of both texts, 100 * intersection >= threshold * union.
5. Union-find: links are merged inside each partition by union-find, and what remains is contracted over all
   partitions, round by round, until no link joins two groups.
6. Members of a bucket that are still in different groups may be linked all the same.  What hangs together by such
   buckets is a heap, and in it only texts outside its largest group need to look for partners.  These are cut into
   blocks, and so are all texts of the heap; a block of the first kind meets each block of the second in a task that
   counts common shingles by an inverted index and returns only the links that join groups, never the pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch, byte_view, list_column, mix64, slices, small_batches, word_hashes, word_spans
from quiltwork.operators.graph import contract

BANDS, BAND_ROWS = 26, 5
#: Rounds in which members are compared with one more head of a bucket, before members are compared with each other.
HEAD_ROUNDS = 1
#: Most shingles and texts of a block, give or take the spread of a hash; up to SPREAD blocks are made of fewer texts.
BLOCK_SHINGLES, BLOCK_TEXTS, SMALL_BLOCK, SPREAD = 1_000_000, 2048, 128, 16
#: Rows without doc_id are known by a hash of their text, from here on; ids are below.
KEYLESS = 1 << 62


# ---------------------------------------------------------------- sketches


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their n+1 offsets.

    A text with words, but fewer than ``width``, has the whole sequence as its one shingle.
    """
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    prime = np.uint64(0xD6E8FEB86659FD93)
    rolled = h.copy()
    for k in range(1, width):
        rolled[: len(h) - k] = mix64(rolled[: len(h) - k] * prime + h[k:]) if len(h) > k else rolled[: len(h) - k]
    sets, at = [], np.zeros(len(offsets), np.int64)
    for d in range(len(offsets) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            one = np.unique(rolled[a : b - width + 1])
        elif b > a:
            acc = h[a : a + 1]
            for k in range(a + 1, b):
                acc = mix64(acc * prime + h[k : k + 1])
            one = mix64(acc + np.uint64(b - a))
        else:
            one = h[:0]
        sets.append(one)
        at[d + 1] = at[d] + len(one)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), at


def sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a text column, made slice by slice."""
    data, ends = byte_view(texts)
    parts = [shingle_sets(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], width) for a, b in slices(ends)]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, at in parts)])
    return np.concatenate([np.zeros(0, np.uint64), *(e for e, _ in parts)]), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def super_minhash(elements: np.ndarray, offsets: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash signatures (texts x places) of sets that follow each other in ``elements``."""
    n = len(offsets) - 1
    sig = np.full(n * places, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seed, order = elements, None
    before = None
    for j in range(places):
        if not len(seed):
            break
        draw = mix64(seed + np.uint64((j * 0xA0761D6478BD642F) & (2**64 - 1)))
        fraction = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = j + (mix64(draw) % np.uint64(places - j)).astype(np.int64)
        if j == 0:
            place, before = pick, pick
        elif j == 1:  # after one swap only the place that was drawn is out of order
            place = np.where(pick == before, 0, pick)
            drawn = (before, pick)
        else:
            if order is None:
                order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(seed), 1))
                rows = np.arange(len(seed))
                for step, at in enumerate(drawn):
                    held = order[rows, at].copy()
                    order[rows, at] = order[:, step]
                    order[:, step] = held
            rows = np.arange(len(seed))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
            order[:, j] = place
        np.minimum.at(sig, owner * places + place, fraction + j)
        open_sets = sig.reshape(n, places).max(axis=1) >= j + 1
        go = open_sets[owner]
        if not go.all():
            seed, owner = seed[go], owner[go]
            if order is not None:
                order = order[go]
            elif j == 0:
                before = before[go]
            else:
                drawn = (drawn[0][go], drawn[1][go])
    return sig.reshape(n, places)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit hash a band (texts x bands)."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    out = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), (len(signature), bands)).copy()
    for k in range(rows):
        out = mix64(out ^ bits[:, :, k])
    return out


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``key`` (doc_id, or a hash of the text where that is null) and text."""
    text = F.col("text").cast("string")
    return docs.select(_key(text).alias(key), text.alias("text"))


def _key(text: Column) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(KEYLESS) + F.xxhash64(text).bitwiseAND(KEYLESS - 1))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id (its key), n_shingles, f1 and f2 (a fingerprint of the set; an empty set has one of its own), bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            elements, at = sets_of(b.column(1), width)
            sizes = np.diff(at)
            bands = band_hashes(super_minhash(elements, at, BANDS * BAND_ROWS))
            prints = []
            for salt in (np.uint64(1), np.uint64(0x2545F4914F6CDD1D)):
                f = np.zeros(len(sizes), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    f[full] = np.add.reduceat(mix64(elements ^ salt), at[:-1][full])
                prints.append(mix64(f + sizes.astype(np.uint64)).view(np.int64))
            prints[0] = np.where(sizes > 0, prints[0], b.column(0).to_numpy())
            flat = list_column(np.ascontiguousarray(bands[sizes > 0]).reshape(-1).view(np.int64), BANDS) if (sizes > 0).any() else None
            index = np.cumsum(sizes > 0) - 1
            column = pa.nulls(len(sizes), pa.list_(pa.int64())) if flat is None else flat.take(pa.array(np.where(sizes > 0, index, 0), mask=sizes == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), column], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return _keyed(docs, "doc_id").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


# ---------------------------------------------------------------- verification


def _verify(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose texts' full sets have 100 * intersection >= threshold * union."""
    texts = _keyed(docs, "id")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts_a = batch.column(2)
            new = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
            sets_a, at_a = sets_of(texts_a.take(pa.array(new, pa.int64())), width)
            sets_b, at_b = sets_of(batch.column(3), width)
            keep, turn = [], -1
            for k in range(len(ids)):
                if turn + 1 < len(new) and new[turn + 1] == k:
                    turn += 1
                    held = (ids[k], sets_a[at_a[turn] : at_a[turn + 1]])
                mine, other = held[1], sets_b[at_b[k] : at_b[k + 1]]
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(common > 0 and 100 * common >= threshold * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- the rest


def _blocks(texts: Column, shingles: Column) -> Column:
    """Blocks of so many texts: small ones while SPREAD of them do, then such that a block fits into memory."""
    few = F.least(F.ceil(texts / SMALL_BLOCK), F.lit(SPREAD).cast("long"))
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(texts / BLOCK_TEXTS), few).cast("int")


def _compare_blocks(open_rows: DataFrame, docs: DataFrame, width: int, threshold: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between texts of different groups that share a bucket; ``open_rows``: band, cid, n, root.

    All texts that hang together by buckets are a heap.  Of these, texts outside the largest group ask, and all answer.
    """
    low = scratch.keep(open_rows.groupBy("band").agg(F.min("cid").alias("a")))
    heap = contract(open_rows.join(low, "band").where("cid <> a").select("a", F.col("cid").alias("b")).distinct(), scratch)
    texts = open_rows.select("cid", "n", "root").distinct().join(heap.select(F.col("node").alias("cid"), F.col("root").alias("heap")), "cid", "left")
    texts = scratch.keep(texts.select("cid", "n", "root", F.coalesce("heap", "cid").alias("heap")))
    one = F.lit(1)
    by_root = texts.groupBy("heap", "root").agg(F.count(one).alias("texts"), F.sum("n").alias("shingles"))
    sizes = by_root.groupBy("heap").agg(F.max_by(F.struct("root", "texts", "shingles"), F.struct("texts", -F.col("root"))).alias("main"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"))
    sizes = scratch.keep(sizes.select("heap", F.col("main.root").alias("main"), _blocks(F.col("texts"), F.col("shingles")).alias("answers"), _blocks(F.col("texts") - F.col("main.texts"), F.col("shingles") - F.col("main.shingles")).alias("asks")))
    dealt = texts.join(sizes, "heap")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answers = dealt.where("asks > 0").select("cid", "root", "heap", every("asks").alias("i"), F.pmod(F.xxhash64("cid"), F.col("answers")).cast("int").alias("j"), F.lit(False).alias("asking"))
    asks = dealt.where(F.col("root") != F.col("main")).select("cid", "root", "heap", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("asks")).cast("int").alias("i"), every("answers").alias("j"), F.lit(True).alias("asking"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, roots = table.column("cid").to_numpy(), table.column("root").to_numpy()
        asking = table.column("asking").to_numpy().astype(bool)
        parts = [sets_of(c, width) for c in table.column("text").chunks if len(c)]
        n = np.concatenate([np.diff(p[1]) for p in parts])
        elements, at = np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(ids)), n)
        order = np.flatnonzero(~asking[owner])
        order = order[np.argsort(elements[order], kind="stable")]
        held, ranked = owner[order], elements[order]
        named, back = np.unique(roots, return_inverse=True)
        up = list(range(len(named)))

        def top(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        out: tuple[list, list] = ([], [])
        for y in np.flatnonzero(asking).tolist():
            mine = elements[at[y] : at[y + 1]]
            first = np.searchsorted(ranked, mine, "left")
            count = np.searchsorted(ranked, mine, "right") - first
            ends = np.cumsum(count)
            common = np.bincount(held[np.repeat(first - ends + count, count) + np.arange(ends[-1])], minlength=len(ids))
            linked = (common > 0) & (100 * common >= threshold * (n[y] + n - common)) & (back != back[y])
            for m in np.flatnonzero(linked).tolist():
                a, b = top(back[y]), top(back[m])
                if a != b:
                    up[b] = a
                    out[0].append(min(ids[y], ids[m]))
                    out[1].append(max(ids[y], ids[m]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    # only the heaps' texts are dealt out: the others are left where they are read
    rows = scratch.keep(answers.union(asks))
    held = scratch.keep(_keyed(docs, "cid").join(texts.select("cid"), "cid", "left_semi"))
    return rows.join(held, "cid").groupBy("heap", "i", "j").applyInArrow(run, "a long, b long")


# ---------------------------------------------------------------- grouping


def _roots(docs: DataFrame, width: int, threshold: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sketches, and the root of each class of equal sets: f1, f2, root."""
    sketches = scratch.keep(sketch(docs, width))
    classes = sketches.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("cid"))
    classes = scratch.keep(classes)
    heads = sketches.where("n_shingles > 0").select("doc_id", "n_shingles", "bands").join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi")
    member = scratch.keep(heads.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band")))
    shared = member.groupBy("band").agg(F.min(F.struct("cid", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    mixed = scratch.keep(member.join(shared, "band").select("band", "cid", "n", "size", F.col("head.cid").alias("head"), F.col("head.n").alias("head_n")))
    scratch.drop(member)

    def alike(n: str, m: str):  # sets whose sizes alone rule a link out
        return F.least(n, m) * 100 >= F.greatest(n, m) * threshold

    star = mixed.where(F.col("cid") != F.col("head")).where(alike("n", "head_n")).groupBy(F.col("head").alias("a"), F.col("cid").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    star = scratch.keep(star)
    links = tried = None
    roots = None

    def add(found: DataFrame) -> None:
        nonlocal links, roots
        found = scratch.keep(found)
        links = found if links is None else links.union(found)
        roots = scratch.keep(contract(links, scratch))

    def settle(pairs: DataFrame) -> None:
        nonlocal tried
        tried = pairs if tried is None else tried.union(pairs)
        add(_verify(pairs, docs, width, threshold))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs that are not in one group yet."""
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def open_rows(rows: DataFrame) -> DataFrame:
        """Members of buckets that still hold different groups."""
        rooted = rows.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("band", "cid", "n", F.coalesce("root", "cid").alias("root"))
        # kept, so that Spark knows its size: a small one is broadcast, with a large one hot buckets are split
        still = scratch.keep(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band"))
        return scratch.keep(rooted.join(still, "band", "left_semi"))

    best = scratch.keep(star.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a")).select("a", "b"))
    if not best.isEmpty():
        settle(best)
        others = scratch.keep(apart(star).join(best, ["a", "b"], "left_anti").select("a", "b"))
        if not others.isEmpty():
            settle(others)
        # a bucket of two is settled: its one pair has been tried
        rest = open_rows(mixed.where("size > 2").select("band", "cid", "n"))
        for turn in range(HEAD_ROUNDS):
            pivot = scratch.keep(rest.groupBy("band").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "n", "root")).alias("p")))
            pairs = rest.join(pivot, "band").where(F.col("root") != F.col("p.root")).where(alike("n", "p.n"))
            pairs = scratch.keep(pairs.select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                break
            settle(pairs)
            rest = open_rows(rest.select("band", "cid", "n"))
        if not rest.isEmpty():
            add(_compare_blocks(rest, docs, width, threshold, scratch))
    named = classes
    if roots is not None:
        named = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("f1", "f2", F.coalesce("root", "cid").alias("root"))
    else:
        named = classes.select("f1", "f2", F.col("cid").alias("root"))
    return sketches, scratch.keep(named)


def _components(docs: DataFrame, width: int, threshold: int, scratch: Scratch) -> DataFrame:
    """key, n_shingles, component (a key): a row for each row of ``docs``."""
    sketches, named = _roots(docs, width, threshold, scratch)
    out = sketches.select(F.col("doc_id").alias("key"), "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    return out.select("key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("key")).alias("component"))


def group(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id = component_id).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a text without words, or null, has an
    empty set and is linked with nothing.  A text of fewer than ``width`` words has one shingle; very long texts are
    taken whole.  Equal sets are always linked.  ``doc_id`` is the key, below 2**62; repeated rows give repeated rows,
    of which all are marked alike.  A row without doc_id takes part by its text, names a component only for others
    like it (component_id is then null) and is not marked as kept.  Other columns are ignored; an empty table gives no
    rows.
    """
    rows = _components(docs, width, threshold, Scratch(docs.sparkSession, "near-dedup"))
    doc_id, component = (F.when(F.col(c) < KEYLESS, F.col(c)) for c in ("key", "component"))
    return rows.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(doc_id == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the one with the least doc_id.

    Of rows that repeat both doc_id and text one stays.  A group without any doc_id keeps the rows of one text, once.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    rows = scratch.keep(_components(docs, width, threshold, scratch).select("key", "component"))
    gone = rows.where("key <> component").select(F.col("key").alias("_qw_key"))
    keyed = docs.withColumn("_qw_key", _key(F.col("text").cast("string")))
    out = keyed.join(gone, "_qw_key", "left_anti")
    twice = scratch.keep(rows.where("key = component").groupBy(F.col("key").alias("_qw_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_qw_key"))
    if not twice.isEmpty():
        once = out.join(twice, "_qw_key", "left_semi").dropDuplicates(["_qw_key", "text"])
        out = out.join(twice, "_qw_key", "left_anti").unionByName(once)
    return out.select(*docs.columns)
