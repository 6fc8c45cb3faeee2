"""Ways in windows against Dijkstra on the whole weighted graph."""

import heapq
import math
import random

from quiltwork.operators import ways


def dijkstra(edges, start, bearing, weight):
    """Least costs from one node over the whole graph."""
    near = {}
    for a, b, w, ax, ay, bx, by in edges:
        near.setdefault(a, []).append((b, w, (ax, ay), (bx, by)))
        near.setdefault(b, []).append((a, w, (bx, by), (ax, ay)))
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > cost[at]:
            continue
        for to, w, p, q in near.get(at, ()):
            new = d + w * (1 if bearing is None else 1 + weight * ways.turn(p, q, bearing) / 90)
            if new < cost.get(to, math.inf):
                cost[to] = new
                heapq.heappush(heap, (new, to))
    return cost


def town(seed, n=14, keep=0.72):
    """A crooked grid with streets missing, so that many ways lead far around."""
    rnd = random.Random(seed)
    at = {(i, j): (19.9 + i * 0.0008 + rnd.uniform(-2e-4, 2e-4), 50.0 + j * 0.0006 + rnd.uniform(-2e-4, 2e-4)) for i in range(n) for j in range(n)}
    edges = []
    for i, j in at:
        for to in ((i + 1, j), (i, j + 1)):
            if to in at and rnd.random() < keep:
                a, b = at[i, j], at[to]
                edges.append((f"{i},{j}", f"{to[0]},{to[1]}", ways.meters(a, b), *a, *b))
    return at, edges


def test_routes_equal_dijkstra_on_the_weighted_board(spark):
    for seed in (1, 2):
        at, edges = town(seed)
        rnd = random.Random(seed + 10)
        asked = []
        for k in range(60):
            a, b = rnd.sample(sorted(at), 2)
            asked.append((k, f"{a[0]},{a[1]}", f"{b[0]},{b[1]}", *at[a], *at[b], None if k % 5 == 0 else rnd.uniform(-180, 180)))
        e = spark.createDataFrame(edges, "src string, dst string, w double, ax double, ay double, bx double, by double")
        q = spark.createDataFrame(asked, "key long, src string, dst string, sx double, sy double, tx double, ty double, bearing double")
        got = {r.key: r for r in ways.routes(e, q, budget=10**6).collect()}
        assert set(got) == set(range(60))
        length = {frozenset(x[:2]): x[2] for x in edges}
        for k, src, dst, *_, bearing in asked:
            want = dijkstra(edges, src, bearing, 0.3).get(dst)
            r = got[k]
            assert (r.cost is None) == (want is None)
            if want is not None:
                assert abs(r.cost - want) < 1e-6 and r.path[0] == src and r.path[-1] == dst and r.hops == len(r.path) - 1
                assert abs(r.meters - sum(length[frozenset(s)] for s in zip(r.path, r.path[1:]))) < 1e-6


def test_a_way_far_around_is_sought_in_wider_windows(spark):
    """Two ends a few metres apart on either side of a long wall."""
    line = [(19.9 + k * 0.0005, 50.0) for k in range(30)]
    other = [(19.9 + k * 0.0005, 50.0001) for k in range(30)]
    edges = [(f"{t}{k}", f"{t}{k + 1}", ways.meters(s[k], s[k + 1]), *s[k], *s[k + 1]) for t, s in (("a", line), ("b", other)) for k in range(29)]
    edges.append(("a29", "b29", ways.meters(line[29], other[29]), *line[29], *other[29]))
    e = spark.createDataFrame(edges, "src string, dst string, w double, ax double, ay double, bx double, by double")
    q = spark.createDataFrame([(1, "a0", "b0", *line[0], *other[0], None), (2, "a0", "nowhere", *line[0], *other[0], 90.0), (3, "a0", "a0", *line[0], *line[0], None)], "key long, src string, dst string, sx double, sy double, tx double, ty double, bearing double")
    got = {r.key: r for r in ways.routes(e, q).collect()}
    assert got[1].hops == 59 and got[2].cost is None and got[3].hops == 0
    assert {r.key: r.cost for r in ways.routes(e, q, budget=5).collect()}[1] is None
    assert ways.routes(e.limit(0), q).where("cost IS NULL").count() == 3 and ways.routes(e, q.limit(0)).count() == 0
