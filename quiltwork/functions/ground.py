"""Box footprints settled in order on discs, inside one block of a board: ground by atoms, answers by a footprint's rim.

Lines through all edges of footprints, cells and upright or level borders cut the block into atoms; an atom belongs to one
slot, to none, or is mixed (a slanted border crosses it, or slots overlap) and is then as the block's polygons have it.

Where every slot is one part without holes, what a footprint does follows from its own ground and the thinnest rim around
it: two stretches of a slot on the rim that hang together through the footprint can't hang together around it too, as
they would enclose ground of others.  So a slot is parted by giving the footprint up just where one of its connected
pieces in footprint and rim has several stretches of the rim.  A footprint reads its rim and changes its inside; of two
that don't touch, neither sees the other, and only those wait that touch an earlier waiting one or leave the block.
"""

from __future__ import annotations

import numpy as np

from quiltwork.functions import board
from quiltwork.functions import overlay as ov
from quiltwork.functions.judge import Rule, judge
from quiltwork.functions.overlay import Polygon

Cell = tuple[int, int]
NOBODY, MIXED = 254, 255
#: A block of more atoms, or more slots, is not held by atoms.
MOST_ATOMS, MOST_SLOTS = 250_000_000, 250
#: Atoms in the side of a square whose holder is known at a glance.
TILE = 32


class TooFine(Exception):
    """The block has too many atoms or slots."""


def _lines(fixed: np.ndarray, more: np.ndarray, close: float) -> np.ndarray:
    """All places in order, those within ``close`` of each other once; a fixed one stays as it is."""
    places = np.concatenate([fixed, more])
    kind = np.concatenate([np.zeros(len(fixed), bool), np.ones(len(more), bool)])
    order = np.lexsort((kind, places))
    places, kind = places[order], kind[order]
    group = np.concatenate([[0], np.cumsum(np.diff(places) > close)]) if len(places) else np.zeros(0, int)
    best = np.lexsort((kind, group))
    first = np.concatenate([[True], np.diff(group[best]) > 0]) if len(places) else np.zeros(0, bool)
    return places[best[first]]


def _is_square(shape: Polygon, x0: float, y0: float, x1: float, y1: float) -> bool:
    return len(shape) == 1 and len(shape[0]) == 5 and {*shape[0]} == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}


class Ground:
    def __init__(self, cells: dict[Cell, dict[int, Polygon]], boxes: np.ndarray, span: tuple[int, int, int, int] | None, side: float, rule: Rule):
        """``boxes``: minx, miny, maxx, maxy by row; ``span``: first and last column, first and last row, None: all there are."""
        self.side, self.rule, self.close, self.cells = side, rule, side * 1e-7, cells
        if span is None:
            xs, ys = [c[0] for c in cells], [c[1] for c in cells]
            low, high = (np.floor(boxes[:, k].min() / side) if len(boxes) else 0 for k in (0, 1)), (np.floor(boxes[:, k].max() / side) if len(boxes) else 0 for k in (2, 3))
            (lx, ly), (hx, hy) = low, high
            span = (int(min([lx, *xs])) - 1, int(max([hx, *xs])) + 1, int(min([ly, *ys])) - 1, int(max([hy, *ys])) + 1)
        self.span = span
        self.keys = sorted({k for slots in cells.values() for k in slots})
        if len(self.keys) > MOST_SLOTS:
            raise TooFine
        number = {k: n for n, k in enumerate(self.keys)}
        whole, partial, upright, level = {}, {}, [], []
        for (x, y), slots in cells.items():
            held = {k: s for k, s in slots.items() if s}
            if len(held) == 1 and _is_square(next(iter(held.values())), x * side, y * side, (x + 1) * side, (y + 1) * side):
                whole[x, y] = number[next(iter(held))]
            elif held:
                partial[x, y] = held
                for shape in held.values():
                    for ring in shape:
                        for a, b in zip(ring, ring[1:], strict=False):
                            if a[0] == b[0]:
                                upright.append(a[0])
                            elif a[1] == b[1]:
                                level.append(a[1])
        x0, x1, y0, y1 = span
        inside = lambda v, lo, hi: (v := np.asarray(v, float))[(v > lo * side) & (v < (hi + 1) * side)]
        self.xs = _lines(np.arange(x0, x1 + 2) * side, inside([*boxes[:, 0], *boxes[:, 2], *upright], x0, x1), self.close)
        self.ys = _lines(np.arange(y0, y1 + 2) * side, inside([*boxes[:, 1], *boxes[:, 3], *level], y0, y1), self.close)
        self.dx, self.dy = np.diff(self.xs), np.diff(self.ys)
        if len(self.dx) * len(self.dy) > MOST_ATOMS:
            raise TooFine
        self.cx = np.searchsorted(self.xs, np.arange(x0, x1 + 2) * side - self.close)
        self.cy = np.searchsorted(self.ys, np.arange(y0, y1 + 2) * side - self.close)
        self.label = np.full((len(self.dy), len(self.dx)), NOBODY, np.uint8)
        for (x, y), k in whole.items():
            self.label[self._of(x, y)] = k
        for (x, y), held in partial.items():
            self._draw(x, y, {number[k]: s for k, s in held.items()})
        self.dirty: dict[Cell, int] = {}  # the first footprint that has changed the cell
        self.broken = False

    def _of(self, x: int, y: int) -> tuple[slice, slice]:
        i, j = x - self.span[0], y - self.span[2]
        return slice(self.cy[j], self.cy[j + 1]), slice(self.cx[i], self.cx[i + 1])

    def _draw(self, x: int, y: int, held: dict[int, Polygon]) -> None:
        rows, cols = self._of(x, y)
        xs, ys = self.xs[cols.start : cols.stop + 1], self.ys[rows.start : rows.stop + 1]
        xc, yc = (xs[1:] + xs[:-1]) / 2, (ys[1:] + ys[:-1]) / 2
        out, mixed = self.label[rows, cols], np.zeros((len(yc), len(xc)), bool)
        for k, shape in held.items():
            turns = np.zeros((len(yc), len(xc) + 1), bool)
            for ax, ay, bx, by, _ in ov._edges(shape, 0):
                r0, r1 = np.searchsorted(yc, (ay, by))
                if ax == bx:
                    turns[r0:r1, np.searchsorted(xc, ax)] ^= True
                    continue
                at = lambda v: ax + (bx - ax) * (v - ay) / (by - ay)  # noqa: B023, E731
                here = np.arange(r0, r1)
                turns[here, np.searchsorted(xc, at(yc[r0:r1]))] ^= True
                for r in range(max(0, np.searchsorted(ys, ay, "right") - 1), min(len(yc), np.searchsorted(ys, by))):
                    p, q = sorted((at(max(ay, ys[r])), at(min(by, ys[r + 1]))))
                    mixed[r, max(0, np.searchsorted(xs, p, "right") - 1) : np.searchsorted(xs, q)] = True
            mine = np.logical_xor.accumulate(turns[:, :-1], axis=1)
            mixed |= mine & (out != NOBODY)
            out[mine] = k
        out[mixed] = MIXED

    def _tiles(self) -> np.ndarray:
        """Who holds each square of ``TILE`` atoms; MIXED: more than one holder, or unknown."""
        starts = [np.arange(0, n, TILE) for n in self.label.shape]
        low, high = (f.reduceat(f.reduceat(self.label, starts[0], axis=0), starts[1], axis=1) for f in (np.minimum, np.maximum))
        return np.where(low == high, low, MIXED).astype(np.uint8)

    def run(self, order: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Which footprints are settled, taken in ``order``; the ground is as they leave it."""
        g, (x0, x1, y0, y1) = self.side, self.span
        done = np.zeros(len(boxes), bool)
        slack = 2 * self.close
        fits = (boxes[:, 0] > x0 * g + slack) & (boxes[:, 2] < (x1 + 1) * g - slack) & (boxes[:, 1] > y0 * g + slack) & (boxes[:, 3] < (y1 + 1) * g - slack)
        at = lambda lines, v: np.searchsorted(lines, v - self.close)
        left, right, low, high = at(self.xs, boxes[:, 0]), at(self.xs, boxes[:, 2]), at(self.ys, boxes[:, 1]), at(self.ys, boxes[:, 3])
        label, tiles = self.label, self._tiles()
        waits, near_waits = np.zeros(label.shape, bool), np.zeros(tiles.shape, bool)
        for n, ok, a, b, c, d in zip(order.tolist(), *(v[order].tolist() for v in (fits, low, high, left, right)), strict=True):
            rows, cols = slice(max(0, a - 1) // TILE, b // TILE + 1), slice(max(0, c - 1) // TILE, d // TILE + 1)
            if not ok or (near_waits[rows, cols].any() and waits[a - 1 : b + 1, c - 1 : d + 1].any()):
                waits[a:b, c:d] = True
                near_waits[rows, cols] = True
                continue
            done[n] = True
            near = tiles[rows, cols]
            first = near[0, 0]
            if first != MIXED and (near == first).all():
                continue
            seen = label[a - 1 : b + 1, c - 1 : d + 1]
            first = seen[0, 0]
            if first == seen[-1, -1] and first == seen[0, -1] and first != MIXED and (seen == first).all():
                continue
            taker = self._judge(seen, a, b, c, d)
            if taker is not None:
                label[a:b, c:d] = taker
                near[near != taker] = MIXED
                tiles[-(-a // TILE) : b // TILE, -(-c // TILE) : d // TILE] = taker
                cells = np.searchsorted(self.cx, (c, d - 1), "right") - 1, np.searchsorted(self.cy, (a, b - 1), "right") - 1
                for x in range(x0 + int(cells[0][0]), x0 + int(cells[0][1]) + 1):
                    for y in range(y0 + int(cells[1][0]), y0 + int(cells[1][1]) + 1):
                        self.dirty.setdefault((x, y), n)
        return done

    def _judge(self, seen: np.ndarray, a: int, b: int, c: int, d: int) -> int | None:
        """Who takes the footprint of rows a to b and columns c to d, seen with its rim; None: nothing changes."""
        rows = np.empty(len(seen), bool)
        rows[0] = True
        np.any(seen[1:] != seen[:-1], axis=1, out=rows[1:])
        rows[1] = rows[-1] = True
        rows = np.flatnonzero(rows)
        few = seen[rows]
        cols = np.empty(seen.shape[1], bool)
        cols[0] = True
        np.any(few[:, 1:] != few[:, :-1], axis=0, out=cols[1:])
        cols[1] = cols[-1] = True
        cols = np.flatnonzero(cols)
        small = few[:, cols].tolist()
        if any(MIXED in row for row in small):
            return self._judge_polygons(a, b, c, d)
        ys, xs = self.ys[a - 1 : b + 2], self.xs[c - 1 : d + 2]
        high = np.diff(ys[np.append(rows, len(seen))]).tolist()
        wide = np.diff(xs[np.append(cols, seen.shape[1])]).tolist()
        ny, nx = len(small), len(small[0])
        share: dict[int, float] = {}
        for y in range(1, ny - 1):
            row, h = small[y], high[y]
            for x in range(1, nx - 1):
                share[row[x]] = share.get(row[x], 0.0) + h * wide[x]
        share.pop(NOBODY, None)
        if len(share) < 2:
            return None
        sizes = self.rule.sizes
        even = lambda s: round(s / sizes.unit, 6)
        floor = even(sizes.floor((xs[-2] - xs[1]) * (ys[-2] - ys[1])))
        held = [k for _, k in sorted((-even(s), k) for k, s in share.items())]
        owners = [k for k in held if even(share[k]) >= floor]
        if len(owners) < 2:
            return None
        rim = [*small[0], *(row[-1] for row in small[1:]), *small[-1][-2::-1], *(row[0] for row in small[-2:0:-1])]
        runs = {k: sum(p == k != q for p, q in zip(rim, [rim[-1], *rim[:-1]], strict=True)) or int(rim[0] == k) for k in held}
        # a slot with one stretch of the rim is one part, so all of it hangs on that
        parted: dict[int, bool] = {k: not runs[k] for k in held if runs[k] < 2}
        for owner in owners:
            for k in held:
                if k != owner and k not in parted:
                    parted[k] = any(n != 1 for n in _stretches(small, k))
                if k != owner and parted[k]:
                    break
            else:
                self.broken |= runs[owner] > 1 and _joined(small, owner) > 1
                return owner
        return None

    def _judge_polygons(self, a: int, b: int, c: int, d: int) -> int | None:
        """The same where slanted borders or overlaps lie in footprint or rim: by the polygons of that window."""
        rows, cols = slice(a - 1, b + 1), slice(c - 1, d + 1)
        slots = self._polygons(rows, cols)
        x0, y0, x1, y1 = self.xs[c], self.ys[a], self.xs[d], self.ys[b]
        roof = [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
        frame = (self.xs[c - 1], self.ys[a - 1], self.xs[d + 1], self.ys[b + 1])
        got = judge(slots, roof, self.rule, frame, dict.fromkeys(slots, float("inf")))
        if got is None:
            self.broken = True
            return None
        return None if got.taker is None else self.keys.index(got.taker)

    def _polygons(self, rows: slice, cols: slice) -> dict[int, Polygon]:
        """What each slot holds in these atoms: boxes one beside another, and parts of the first polygons where it is mixed."""
        seen = self.label[rows, cols]
        out: dict[int, Polygon] = {}
        y = np.append(np.flatnonzero(np.concatenate([[True], np.any(seen[1:] != seen[:-1], axis=1)])), len(seen))
        for r0, r1 in zip(y.tolist(), y[1:].tolist(), strict=False):
            row = seen[r0]
            x = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row))
            for c0, c1 in zip(x.tolist(), x[1:].tolist(), strict=False):
                x0, x1, y0, y1 = (float(v) for v in (self.xs[cols.start + c0], self.xs[cols.start + c1], self.ys[rows.start + r0], self.ys[rows.start + r1]))
                k = int(row[c0])
                if k < NOBODY:
                    out.setdefault(self.keys[k], []).append([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
                elif k == MIXED:
                    g, near = self.side, self.close
                    for i in range(int((x0 + near) // g), int((x1 - near) // g) + 1):
                        for j in range(int((y0 + near) // g), int((y1 - near) // g) + 1):
                            for slot, shape in self.cells.get((i, j), {}).items():
                                out.setdefault(slot, []).extend(ov.clip(shape, (x0, y0, x1, y1)))
        return out

    def changed(self) -> dict[Cell, dict[int, Polygon]]:
        """Cells whose ground may have changed, with all their slots."""
        out = {}
        for x, y in self.dirty:
            rows, cols = self._of(x, y)
            got = self._polygons(rows, cols)
            out[x, y] = {k: board.as_polygon(ov.union_all([s])) for k, s in got.items() if s}
        return out


def _stretches(small: list[list[int]], k: int) -> list[int]:
    """For each connected piece of ``k`` that has ground inside the rim: on how many stretches of the rim it lies."""
    ny, nx = len(small), len(small[0])
    rim = [(0, x) for x in range(nx)] + [(y, nx - 1) for y in range(1, ny)] + [(ny - 1, x) for x in range(nx - 2, -1, -1)] + [(y, 0) for y in range(ny - 2, 0, -1)]
    stretch: dict[tuple[int, int], int] = {}
    runs, before = 0, False
    for p in rim:
        if small[p[0]][p[1]] == k:
            runs += not before
            stretch[p] = runs
            before = True
        else:
            before = False
    if runs > 1 and before and rim[0] in stretch:  # the last one goes on in the first
        stretch = {p: 1 if n == runs else n for p, n in stretch.items()}
    return [len({stretch[p] for p in piece if p in stretch}) for piece in _pieces(small, k) if any(0 < y < ny - 1 and 0 < x < nx - 1 for y, x in piece)]


def _joined(small: list[list[int]], k: int) -> int:
    """How many connected pieces of ``k`` in footprint and rim the footprint joins."""
    ny, nx = len(small), len(small[0])
    inside = lambda y, x: 0 < y < ny - 1 and 0 < x < nx - 1
    beside = lambda y, x: (0 < y < ny - 1) != (0 < x < nx - 1)
    return sum(any(inside(*p) or beside(*p) for p in piece) for piece in _pieces(small, k))


def _pieces(small: list[list[int]], k: int) -> list[list[tuple[int, int]]]:
    rest = {(y, x) for y, row in enumerate(small) for x, v in enumerate(row) if v == k}
    out = []
    while rest:
        group = [rest.pop()]
        for y, x in group:
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in rest:
                    rest.remove(p)
                    group.append(p)
        out.append(group)
    return out
