"""Approximate nearest neighbours by the largest inner product.

Equal vectors are one point.  Points are dealt out to shards by a hash; in each shard a hierarchical navigable
small-world graph is built, kept as flat arrays (for each layer its points and a points x links table of
neighbours), and written as one row.  Inner products become distances by one more coordinate that makes all stored
vectors equally long.  Queries, packed into blocks of one row each, search every shard; results are merged, and the
members of a point are given out by their ids.  Many queries, or many new points, walk a graph side by side in numpy.
Shards grow with the root of the number of points, up to a bound, so that a query meets few of them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch, mix64

LINKS, GROUND_LINKS, BUILD_WIDTH, LAYER_RATIO = 24, 48, 64, 16
#: Points that a walk steps on at a time, points of the largest norm at which a search may start.
STEPS, PIVOTS = 3, 256
#: At least so many shards for parallel work; most points of a shard, and most components of its points; queries of a
#: block.  Recall falls with the points of a shard at a given width, so shards don't grow with the table.
SHARDS, SHARD_POINTS, SHARD_COMPONENTS, QUERY_BLOCK = 16, 10_000, 16_000_000, 16_384


def search_width(points: int) -> int:
    """Width of the last walk in a graph of so many points."""
    return max(160, min(400, points // 20))


class Graph:
    """points: (n, dim) float32; layers: from the ground up, (members, links) with -1 for no link."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []

    # ------------------------------------------------ search

    def _walk(self, queries: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search side by side: for each query the ``width`` best points found and their scores, best first.

        ``links`` has a row for each member of the layer, ``place`` gives a point's row (None: its own number).
        """
        q = len(queries)
        n = len(self.points)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        found = np.full((q, width), n, np.int64)
        score = np.full((q, width), -np.inf, np.float32)
        done = np.ones((q, width), bool)
        new = np.where(entries < 0, n, entries)
        active = np.arange(q)
        while len(active):
            mine = rows[: len(active)]
            new = np.sort(new, axis=1)
            fresh = new < n
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[active[:, None], new]
            seen[active[:, None], new] = True
            at = np.where(fresh, new, 0)
            s = np.einsum("qkd,qd->qk", self.points[at], queries[active], optimize=False)
            s = np.where(fresh, s, -np.inf).astype(np.float32)
            both_s = np.concatenate([score[active], s], axis=1)
            order = np.argpartition(-both_s, width - 1, axis=1)[:, :width] if both_s.shape[1] > width else np.argsort(-both_s, axis=1)[:, :width]
            found[active] = np.concatenate([found[active], np.where(fresh, new, n)], axis=1)[mine, order]
            score[active] = both_s[mine, order]
            done[active] = np.concatenate([done[active], ~fresh], axis=1)[mine, order]
            waiting = np.where(done[active], -np.inf, score[active])
            best = np.argpartition(-waiting, STEPS - 1, axis=1)[:, :STEPS] if width > STEPS else np.argsort(-waiting, axis=1)
            ok = np.isfinite(np.take_along_axis(waiting, best, 1))
            go = ok.any(axis=1)
            active, best, ok = active[go], best[go], ok[go]
            if not len(active):
                break
            done[active[:, None], best] = True
            here = np.where(ok, found[active[:, None], best], 0)
            new = links[here if place is None else place[here]]
            new = np.where((new < 0) | ~ok[:, :, None], n, new).reshape(len(active), -1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)

    def search(self, queries: np.ndarray, width: int, ground: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Down through the layers with a narrow walk, then a wide one in layer ``ground``."""
        q = len(queries)
        top = self.layers[-1][0]
        entries = np.broadcast_to(top[:1], (q, 1))
        if len(top) <= 256:  # the top layer is small: start at its best points
            entries = self._best(queries, top)
        for level in range(len(self.layers) - 1, ground - 1, -1):
            members, links = self.layers[level]
            place = None if level == 0 else self._places(level)
            if level == 0:
                # the last coordinate is what a vector lacks in length
                pivots = np.argsort(self.points[:, -1], kind="stable")[:PIVOTS]
                entries = np.concatenate([entries, self._best(queries, pivots)], axis=1)
            found, score = self._walk(queries, links, entries, width if level == ground else 8, place)
            entries = np.where(np.isfinite(score), found, -1)
        return found, score

    def _best(self, queries: np.ndarray, points: np.ndarray, k: int = 4) -> np.ndarray:
        """The best few of ``points`` for each query."""
        k = min(k, len(points))
        return points[np.argpartition(-(queries @ self.points[points].T), k - 1, axis=1)[:, :k]]

    def _places(self, level: int) -> np.ndarray:
        place = np.zeros(len(self.points) + 1, np.int64)
        place[self.layers[level][0]] = np.arange(len(self.layers[level][0]))
        return place

    # ------------------------------------------------ build

    @classmethod
    def build(cls, points: np.ndarray) -> Graph:
        """Points are inserted in blocks that grow with the graph; a block's points also see each other."""
        self = cls(points)
        n = len(points)
        height = (np.log(((mix64(np.arange(n, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / -np.log(LAYER_RATIO)).astype(int)
        levels = 1
        while (height >= levels).sum() > 1 and levels < 8:
            levels += 1
        for level in range(levels - 1, -1, -1):
            members = np.flatnonzero(height >= level)
            self.layers.insert(0, (members, np.full((len(members), LINKS if level else GROUND_LINKS), -1, np.int64)))
            self._fill(members, level)
        return self

    def _fill(self, members: np.ndarray, level: int) -> None:
        """Link the layer's members; entries come from the layers above, which are complete."""
        links = self.layers[0][1]
        place = np.zeros(len(self.points) + 1, np.int64)
        place[members] = np.arange(len(members))
        done = 0
        while done < len(members):
            block = members[done : done + max(1, min(256, max(done, 32)))]
            x = self.points[block]
            inner = x @ x.T
            np.fill_diagonal(inner, -np.inf)
            k = min(links.shape[1], len(block) - 1)
            near = np.argsort(-inner, axis=1)[:, :k]
            cand, score = block[near], np.take_along_axis(inner, near, 1)
            if done:
                entries = np.broadcast_to(members[:1], (len(block), 1))
                above = self.layers[1:]
                for step in range(len(above) - 1, -1, -1):
                    upper, upper_links = above[step]
                    up_place = np.zeros(len(self.points) + 1, np.int64)
                    up_place[upper] = np.arange(len(upper))
                    if step == len(above) - 1:
                        entries = np.broadcast_to(upper[:1], (len(block), 1))
                    f, s = self._walk(x, upper_links, entries, 8, up_place)
                    entries = np.where(np.isfinite(s), f, -1)
                    # points that are not linked here yet are no way in
                known = place[np.maximum(entries, 0)] < done
                known &= np.isin(entries, members)
                entries = np.concatenate([np.where(known, entries, -1), np.broadcast_to(members[:1], (len(block), 1))], axis=1)
                f, s = self._walk(x, links, entries, BUILD_WIDTH, place)
                cand, score = np.concatenate([cand, f], axis=1), np.concatenate([score, s], axis=1)
            own = np.arange(done, done + len(block))
            links[own] = self._spread(block, cand, score, links.shape[1])
            self._link_back(own, members, links, place)
            done += len(block)

    def _spread(self, block: np.ndarray, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """``most`` links: of the candidates those that are nearer to the point than to any neighbour taken before; then the nearest of the rest."""
        n = len(self.points)
        score = np.where((cand < n) & (cand >= 0) & (cand != block[:, None]), score, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, : max(BUILD_WIDTH, most + 16)]
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        valid = np.isfinite(score)
        vectors = self.points[np.where(valid, cand, 0)]
        between = np.einsum("qad,qbd->qab", vectors, vectors, optimize=False) if vectors.shape[1] <= 48 else vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros_like(valid)
        count = np.zeros(len(block), int)
        for k in range(cand.shape[1]):
            rival = (between[:, k, :] > score[:, k, None]) & taken
            ok = valid[:, k] & ~rival.any(axis=1) & (count < most)
            taken[:, k] = ok
            count += ok
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cand, order, 1), -1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _link_back(self, own: np.ndarray, members: np.ndarray, links: np.ndarray, place: np.ndarray) -> None:
        """Neighbours get a link back; a full list is chosen anew from its links and the new one."""
        source = np.repeat(members[own], links.shape[1])
        target = links[own].reshape(-1)
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
        bounds = np.append(heads, len(target))
        crowded, extra, most = [], [], links.shape[1]
        for k in range(len(heads)):
            t, new = target[heads[k]], source[bounds[k] : bounds[k + 1]]
            row = links[place[t]]
            new = new[~np.isin(new, row)]
            free = np.flatnonzero(row < 0)
            if len(new) <= len(free):
                row[free[: len(new)]] = new
            else:
                crowded.append(t)
                extra.append(new if len(new) <= most else new[np.argsort(-(self.points[new] @ self.points[t]))[:most]])
        if crowded:
            crowded = np.array(crowded)
            width = max(map(len, extra))
            more = np.full((len(crowded), width), -1, np.int64)
            for k, e in enumerate(extra):
                more[k, : len(e)] = e
            cand = np.concatenate([links[place[crowded]], more], axis=1)
            score = np.einsum("qkd,qd->qk", self.points[np.maximum(cand, 0)], self.points[crowded], optimize=False)
            links[place[crowded]] = self._spread(crowded, cand, np.where(cand >= 0, score, -np.inf), most)

    # ------------------------------------------------ flat form

    def dump(self) -> bytes:
        out = io.BytesIO()
        flat = {"points": self.points}
        for k, (members, links) in enumerate(self.layers):
            flat[f"members{k}"], flat[f"links{k}"] = members.astype(np.int32), links.astype(np.int32)
        np.savez(out, **flat)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Graph:
        flat = np.load(io.BytesIO(blob))
        self = cls(flat["points"])
        k = 0
        while f"members{k}" in flat:
            self.layers.append((flat[f"members{k}"].astype(np.int64), flat[f"links{k}"].astype(np.int64)))
            k += 1
        return self


# ---------------------------------------------------------------- Spark


def _finite(value: Column) -> Column:
    """A vector that takes part: not null, empty or zero, and without null or non-finite components."""
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & (F.size(value) > 0) & ~bad & F.exists(value, lambda x: x != 0)


def _points(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, vec, dim, point (the vector's hash): of each distinct vector the least k+1 of its vec_ids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & _finite(F.col("vec")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).withColumn("point", F.xxhash64("vec"))
    rank = Window.partitionBy("point", "vec").orderBy("vec_id")
    return rows.distinct().withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= k + 1).select("vec_id", "vec", F.size("vec").alias("dim"), "point")


def search(vectors: DataFrame, k: int = 20, every: int = 20, width: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest of each row whose vec_id is divisible by ``every``.

    Nearness is the inner product in double precision; equal scores go by vec_id.  Rows with a null id or vector, an
    empty or zero vector, or a null or non-finite component take no part; vectors of different lengths have no inner
    product and are searched apart.  Candidates are rows: repeated (vec_id, vector) rows count once, and a vec_id with
    several vectors is found by each of them, so that it may fill several ranks, and asks with each of them, of whose
    answers the best ``k`` count; it never finds itself.  Long vectors make small shards.  Other columns are ignored.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    members = scratch.keep(_points(vectors, k))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n = F.count_distinct("point")
    size = F.greatest(F.lit(1), F.least(F.lit(SHARD_POINTS), F.floor(SHARD_COMPONENTS / F.col("dim")).cast("int")))
    dims = scratch.keep(members.groupBy("dim").agg(F.greatest(F.lit(SHARDS), F.ceil(n / size)).cast("int").alias("shards"), F.max(norm).alias("longest")))
    points = members.groupBy("dim", "point", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = points.join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("point"), F.col("shards")).cast("int"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.argsort(mix64(table.column("point").to_numpy().view(np.uint64)), kind="stable")
        x = x[order]
        more = np.sqrt(np.maximum(table.column("longest")[0].as_py() - (x * x).sum(axis=1), 0))
        graph = Graph.build(np.concatenate([x, more[:, None]], axis=1).astype(np.float32))
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        vec = io.BytesIO()
        np.save(vec, x)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([graph.dump()], pa.binary()), "vectors": pa.array([vec.getvalue()], pa.binary()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64())))})

    index = scratch.keep(points.select("dim", "shard", "point", "vec", "ids", "longest").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary, vectors binary, ids array<array<bigint>>"))

    wanted = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))
    wanted = wanted.where((F.col("query_id") % every == 0) & _finite(F.col("vec"))).distinct().withColumn("dim", F.size("vec"))
    # the stated queries meet all shards of their length; a block of them travels as one row
    sizes = wanted.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    dealt = wanted.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    asks = scratch.keep(dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vec")).alias("asks")))
    pairs = scratch.keep(index.select("dim", "shard").join(asks.select("dim", "block"), "dim"))
    left = pairs.join(asks, ["dim", "block"]).groupBy("dim", "block", "shard")
    right = pairs.select(F.col("dim").alias("d"), F.col("block").alias("b"), F.col("shard").alias("s")).join(index.select(F.col("dim").alias("d"), F.col("shard").alias("s"), "graph", "vectors", "ids"), ["d", "s"]).groupBy("d", "b", "s")

    schema = "query_id long, vec_id long, score double"

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        graph = Graph.load(right.column("graph")[0].as_py())
        stored = np.load(io.BytesIO(right.column("vectors")[0].as_py()))
        ids = right.column("ids")[0].as_py()
        asked = left.column("asks").combine_chunks().flatten()
        names = asked.field(0).to_numpy()
        q = asked.field(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, stored.shape[1])
        out: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), 128):
            block = q[a : a + 128]
            found, got = graph.search(np.concatenate([block, np.zeros((len(block), 1))], axis=1).astype(np.float32), width or search_width(len(stored)))
            for j, name in enumerate(names[a : a + 128].tolist()):
                near = found[j][np.isfinite(got[j])]
                exact = np.cumsum(stored[near] * block[j], axis=1)[:, -1]  # added from the first component on, on any machine
                best = [(-s, i) for s, p in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[p] if i != name]
                for s, i in sorted(best)[:k]:
                    out[0].append(name)
                    out[1].append(i)
                    out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    parts = left.cogroup(right).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
