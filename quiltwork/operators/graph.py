"""Street graphs: planar noding, graph building, components, routing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.functions import metric
from quiltwork.operators.spatial_join import box_cells
from quiltwork.sources.scratch import Scratch


def node_segments(segments: DataFrame, size: float, digits: int = 5) -> DataFrame:
    """ax, ay, bx, by: unique undirected edges between neighbouring crossings, coordinates rounded to ``digits``."""
    s = segments.select("ax", "ay", "bx", "by").distinct().withColumn("id", F.xxhash64("ax", "ay", "bx", "by"))
    box = s.select("*", F.least("ax", "bx").alias("minx"), F.least("ay", "by").alias("miny"), F.greatest("ax", "bx").alias("maxx"), F.greatest("ay", "by").alias("maxy"))
    cells = box_cells(box, size).drop("minx", "miny", "maxx", "maxy")
    other = cells.select("cx", "cy", *[F.col(c).alias(f"o{c}") for c in ("id", "ax", "ay", "bx", "by")])
    c = F.col
    dx, dy, ex, ey = c("bx") - c("ax"), c("by") - c("ay"), c("obx") - c("oax"), c("oby") - c("oay")
    det = dx * ey - dy * ex
    t = ((c("oax") - c("ax")) * ey - (c("oay") - c("ay")) * ex) / F.nullif(det, F.lit(0.0))
    u = ((c("oax") - c("ax")) * dy - (c("oay") - c("ay")) * dx) / F.nullif(det, F.lit(0.0))
    met = cells.join(other, ["cx", "cy"]).where("id <> oid").withColumn("t", t).withColumn("u", u).where(c("t").between(-1e-9, 1 + 1e-9) & c("u").between(-1e-9, 1 + 1e-9))
    cuts = met.select("id", "ax", "ay", "bx", "by", "t")
    ends = s.select("id", "ax", "ay", "bx", "by", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    r = lambda v: F.floor(v * 10**digits + 0.5).cast("long")
    points = cuts.union(ends).select("id", r(c("ax") + (c("bx") - c("ax")) * c("t")).alias("x"), r(c("ay") + (c("by") - c("ay")) * c("t")).alias("y"), "t").groupBy("id", "x", "y").agg(F.min("t").alias("t"))
    w = Window.partitionBy("id").orderBy("t", "x", "y")
    hops = points.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx IS NOT NULL")
    lo, hi = F.least(F.struct("x", "y"), F.struct(c("nx").alias("x"), c("ny").alias("y"))), F.greatest(F.struct("x", "y"), F.struct(c("nx").alias("x"), c("ny").alias("y")))
    f = float(10**digits)
    return hops.select(lo.alias("a"), hi.alias("b")).distinct().select((c("a.x") / f).alias("ax"), (c("a.y") / f).alias("ay"), (c("b.x") / f).alias("bx"), (c("b.y") / f).alias("by"))


def build(edges: DataFrame, digits: int = 5, keep_parallel: bool = False) -> DataFrame:
    """src, dst, w: undirected weighted edges between rounded node keys; loops go, of parallel edges the shortest stays."""
    key = lambda x, y: F.concat_ws(",", F.floor(x * 10**digits + 0.5).cast("string"), F.floor(y * 10**digits + 0.5).cast("string"))
    c = F.col
    rows = edges.select(key(c("ax"), c("ay")).alias("p"), key(c("bx"), c("by")).alias("q"), metric.dist(c("ax"), c("ay"), c("bx"), c("by")).alias("w")).where("p <> q")
    rows = rows.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), "w")
    return rows if keep_parallel else rows.groupBy("src", "dst").agg(F.min("w").alias("w"))


def merge_inside(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition as links of its members to their least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (p := up.setdefault(top, top)) != top:
                top = p
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        rows = [(root(x), x) for x in list(up)]
        rows = [(r, x) for r, x in rows if r != x]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def contract(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: for every node of the links (a, b) the least node that it is connected with."""
    rest = scratch.keep(merge_inside(links).distinct())
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("next")).union(rest.select(F.col("b"), F.col("a")))
        up = both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("up"))
        up = scratch.keep(up)
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = scratch.keep(up.join(top, "up").select("node", F.col("top").alias("up")))
        steps.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("up").alias("ra")), step.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        left = rest.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, rest = rest, scratch.keep(merge_inside(left).distinct())
        scratch.drop(old)
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (least connected node) of the edges (src, dst), whose names are whole numbers."""
    links = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    return contract(links, Scratch(edges.sparkSession, "components"))


def shortest(adjacent: dict, start, goal, budget: int, guess=None) -> tuple[float, list] | None:
    """A* with a ceiling on pops, stale entries included; None beyond it or without a way."""
    best, came, heap, pops = {start: 0.0}, {}, [(guess(start) if guess else 0.0, start)], 0
    while heap and pops < budget:
        _, node = heapq.heappop(heap)
        pops += 1
        if node == goal:
            path = [node]
            while node in came:
                node = came[node]
                path.append(node)
            return best[goal], path[::-1]
        for near, w in adjacent.get(node, ()):
            d = best[node] + w
            if d < best.get(near, math.inf):
                best[near], came[near] = d, node
                heapq.heappush(heap, (d + (guess(near) if guess else 0.0), near))
    return None


def routes(edges: DataFrame, pairs: DataFrame, project: str, budget: int) -> DataFrame:
    """project, src, dst, meters, hops, path (nodes) for each pair; null where there is no way within the budget.

    A project is an area of bounded size; its graph and pairs meet in one task.
    """

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict = {}
        for a, b, w in zip(graph["src"], graph["dst"], graph["w"], strict=True):
            adjacent.setdefault(a, []).append((b, w))
            adjacent.setdefault(b, []).append((a, w))
        out = [shortest(adjacent, a, b, budget) for a, b in zip(asked["src"], asked["dst"], strict=True)]
        return asked[[project, "src", "dst"]].assign(meters=[r[0] if r else None for r in out], hops=[len(r[1]) - 1 if r else None for r in out], path=pd.Series([r[1] if r else None for r in out], asked.index, dtype=object)).astype({"hops": "Int64"})

    return edges.groupBy(project).cogroup(pairs.groupBy(project)).applyInPandas(run, f"{project} long, src string, dst string, meters double, hops long, path array<string>")
