"""Footprints settled in order inside one block of a board, as far as the order allows without looking beyond it.

The board's ground is kept by small square cells.  A footprint is judged in a window of cells that grows until the
answer is certain.  One that comes before others and has to wait (its window leaves the block, or it needs ground that
an earlier one may still change) keeps its zone, the only ground that it may change: later footprints whose windows meet
the zone wait too; all others go on.  What later ones have changed already is undone, for its eyes only, in the window
of one that waited, so every footprint sees the board as it would be in sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from quiltwork.functions import board, morph, settle
from quiltwork.functions import overlay as ov
from quiltwork.functions.judge import Answer, Rule, judge
from quiltwork.functions.overlay import Polygon

Cell = tuple[int, int]
Box = tuple[float, float, float, float]
Order = tuple[float, int]


@dataclass
class Roof:
    order: Order  # size, id
    shape: Polygon | Callable[[], Polygon]  # read when it is needed
    box: Box


@dataclass
class Move:
    """What a footprint has done: who took it, the window it read, and by cell and slot what was lost and gained."""

    order: Order
    taker: int | None
    read: Box
    changes: list[tuple[Cell, int, Polygon, Polygon]]
    far: bool = False  # it changed ground outside its zone
    broken: bool = False  # ... which a later one had read before, or a slot is no disc any more


@dataclass
class Block:
    cells: dict[Cell, dict[int, Polygon]]
    span: tuple[int, int, int, int] | None  # first and last column, first and last row; None: the whole board
    side: float
    zone: float
    rule: Rule
    others: dict[int, float]
    moves: list[Move] = field(default_factory=list)

    def __post_init__(self):
        self.later: dict[Cell, list[tuple[Order, int, Polygon, Polygon]]] = {}
        for m in self.moves:
            self._note(m)
        if self.span is None:
            xs, ys = [c[0] for c in self.cells], [c[1] for c in self.cells]
            self.all = (min(xs, default=0), max(xs, default=0), min(ys, default=0), max(ys, default=0))

    def _note(self, move: Move) -> None:
        for cell, k, lost, gained in move.changes:
            self.later.setdefault(cell, []).append((move.order, k, lost, gained))

    def _cells(self, box: Box, pad: float) -> tuple[int, int, int, int]:
        return int((box[0] - pad) // self.side), int((box[2] + pad) // self.side), int((box[1] - pad) // self.side), int((box[3] + pad) // self.side)

    def _seen(self, at: tuple[int, int, int, int], order: Order) -> tuple[dict[int, Polygon], set[Cell]]:
        """Slots in the cells as they were when it was this footprint's turn, and the cells in which that isn't now."""
        slots: dict[int, Polygon] = {}
        undone = set()
        for x in range(at[0], at[1] + 1):
            for y in range(at[2], at[3] + 1):
                own = self.cells.get((x, y))
                if own is None:
                    continue
                ahead = [c for c in self.later.get((x, y), ()) if c[0] > order]
                if ahead:
                    own = dict(own)
                    undone.add((x, y))
                    for _, k, lost, gained in sorted(ahead, key=lambda c: c[0], reverse=True):
                        lost, gained = (p() if callable(p) else p for p in (lost, gained))  # moves of other rounds are read when needed
                        own[k] = board.as_polygon(ov.overlay([own.get(k, []), lost, gained], lambda s: s[1] or (s[0] and not s[2])))
                for k, shape in own.items():
                    if shape:
                        slots.setdefault(k, []).extend(shape)
        return slots, undone

    def run(self, roofs: list[Roof]) -> list[Move]:
        """The footprints that could be settled; the cells are as these leave them."""
        waits: dict[Cell, list[Box]] = {}
        done = []
        for roof in sorted(roofs, key=lambda r: r.order):
            move = self._try(roof, waits)
            if move is None:
                x0, y0, x1, y1 = roof.box
                zone = (x0 - self.zone, y0 - self.zone, x1 + self.zone, y1 + self.zone)
                at = self._cells(zone, 0.0)
                for x in range(at[0], at[1] + 1):
                    for y in range(at[2], at[3] + 1):
                        waits.setdefault((x, y), []).append(zone)
            else:
                move.broken |= self._broken(move)
                self.moves.append(move)
                self._note(move)
                done.append(move)
        return done

    def _broken(self, move: Move) -> bool:
        """Whether it changed ground outside its zone that a later footprint had read before."""
        if not move.far:
            return False
        g, later = self.side, [m.read for m in self.moves if m.order > move.order]
        return any(r[0] < (x + 1) * g and x * g < r[2] and r[1] < (y + 1) * g and y * g < r[3] for (x, y), *_ in move.changes for r in later)

    def _try(self, roof: Roof, waits: dict[Cell, list[Box]]) -> Move | None:
        reach, g = self.zone, self.side
        while True:
            at = self._cells(roof.box, reach)
            frame: Box | None = (at[0] * g, at[2] * g, (at[1] + 1) * g, (at[3] + 1) * g)
            if self.span is None:
                a = self.all
                if at[0] <= a[0] and at[1] >= a[1] and at[2] <= a[2] and at[3] >= a[3]:
                    at, frame = a, None
            elif at[0] < self.span[0] or at[1] > self.span[1] or at[2] < self.span[2] or at[3] > self.span[3]:
                return None
            x0, y0, x1, y1 = read = frame or (at[0] * g, at[2] * g, (at[1] + 1) * g, (at[3] + 1) * g)
            for x in range(at[0], at[1] + 1):
                for y in range(at[2], at[3] + 1):
                    if any(w[0] < x1 and x0 < w[2] and w[1] < y1 and y0 < w[3] for w in waits.get((x, y), ())):
                        return None
            slots, undone = self._seen(at, roof.order)
            if self.rule.claims and len(slots) < 2:
                return Move(roof.order, None, read, [])
            if callable(roof.shape):
                roof.shape = roof.shape()
            got = judge(slots, roof.shape, self.rule, frame, self.others)
            if got is not None:
                move = self._change(roof, got, read, undone)
                if self.rule.discs and frame is None and got.taker is not None:
                    bit = 1 << got.keys.index(got.taker)
                    move.broken = bool(morph.holes(ov.union_all([board.as_polygon([t for t, m in zip(got.traps, got.after, strict=True) if m & bit])])))
                return move
            if frame is None:
                return self._whole(roof, slots, read)
            reach = 2 * reach + g

    def _change(self, roof: Roof, got: Answer, read: Box, undone: set[Cell]) -> Move:
        g = self.side
        by_cell: dict[Cell, list[int]] = {}
        touched: dict[Cell, int] = {}
        for i, t in enumerate(got.traps):
            cell = int((t[2] + t[3] + t[4] + t[5]) / 4 // g), int((t[0] + t[1]) / 2 // g)
            by_cell.setdefault(cell, []).append(i)
            if got.before[i] != got.after[i]:
                touched[cell] = touched.get(cell, 0) | (got.before[i] ^ got.after[i])
        x0, y0, x1, y1 = roof.box
        move = Move(roof.order, got.taker, read, [])
        for cell, bits in touched.items():
            own = self.cells.setdefault(cell, {})
            for b, k in enumerate(got.keys):
                if not bits >> b & 1:
                    continue
                inside = by_cell[cell]
                had, has = got.before, got.after
                lost = [got.traps[i] for i in inside if had[i] >> b & 1 and not has[i] >> b & 1]
                gained = [got.traps[i] for i in inside if has[i] >> b & 1 and not had[i] >> b & 1]
                for t in lost + gained:
                    move.far |= min(t[2], t[3]) < x0 - self.zone or max(t[4], t[5]) > x1 + self.zone or t[0] < y0 - self.zone or t[1] > y1 + self.zone
                lost, gained = board.as_polygon(lost) if lost else [], board.as_polygon(gained) if gained else []
                if cell in undone:
                    own[k] = board.as_polygon(ov.overlay([own.get(k, []), lost, gained], lambda s: s[2] or (s[0] and not s[1])))
                else:
                    now = [got.traps[i] for i in inside if has[i] >> b & 1]
                    own[k] = board.as_polygon(now) if now else []
                move.changes.append((cell, k, lost, gained))
        return move

    def _whole(self, roof: Roof, slots: dict[int, Polygon], read: Box) -> Move:
        """On whole territories, where only rounded corners or closed seams can help."""
        slots = {k: board.as_polygon(ov.union_all([s])) for k, s in slots.items()}
        changed, taker, _ = settle.settle(slots, roof.shape, self.rule.sizes)
        move = Move(roof.order, taker, read, [], far=True)
        g = self.side
        for k, shape in changed.items():
            for cell in list(self.cells):
                square = (cell[0] * g, cell[1] * g, (cell[0] + 1) * g, (cell[1] + 1) * g)
                old, new = ov.clip(slots[k], square), ov.clip(shape, square)
                lost, gained = ov.difference(old, new) if old else [], ov.difference(new, old) if new else []
                if lost or gained:
                    lost, gained = board.as_polygon(lost) if lost else [], board.as_polygon(gained) if gained else []
                    own = self.cells[cell]
                    own[k] = board.as_polygon(ov.overlay([own.get(k, []), lost, gained], lambda s: s[2] or (s[0] and not s[1])))
                    move.changes.append((cell, k, lost, gained))
        return move


def cut(shape: Polygon, cell: Cell, side: float) -> Polygon:
    """A shape's part in a cell; corners on the cell's border lie on it exactly, so that neighbours' parts meet."""
    box = (cell[0] * side, cell[1] * side, (cell[0] + 1) * side, (cell[1] + 1) * side)
    near = lambda v, a, b: a if abs(v - a) < side * 1e-9 else b if abs(v - b) < side * 1e-9 else v
    out = [[(near(x, box[0], box[2]), near(y, box[1], box[3])) for x, y in ring] for ring in ov.clip(shape, box)]
    return out if out and board.area(out) > 0 else []
