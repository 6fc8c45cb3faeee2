from quiltwork.functions import board as bd


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def total(shapes):
    return round(sum(map(bd.area, shapes)), 6)


def test_cut_and_merge():
    parts = bd.cut(box(0, 0, 10, 10), (3.0, -5.0), (3.0, 20.0), 5)
    assert sorted(round(bd.area(p)) for p in parts) == [30, 70]
    assert bd.cut(box(0, 0, 10, 10), (20.0, 0.0), (20.0, 5.0), 5) is None
    slanted = bd.cut(box(0, 0, 10, 10), (0.0, 0.0), (10.0, 10.0), 5)
    assert [round(bd.area(p)) for p in slanted] == [50, 50]
    assert round(bd.area(bd.merge(parts))) == 100 and bd.merge(parts[:1]) is None


def test_absorb_goes_to_the_longest_border():
    board = [box(0, 0, 2, 10), box(4, 0, 8, 4)]
    got = bd.absorb(board, box(2, 0, 4, 10), 0.1)
    assert [round(bd.area(t)) for t in got] == [40, 16]
    assert bd.absorb(board, box(50, 50, 51, 51), 0.1) is None
    assert len(bd.adopt(board, [box(2, 0, 4, 10)])) == 3


def test_detach_moves_a_whole_footprint():
    board = [box(0, 0, 5, 10), box(5, 0, 10, 10)]
    house = box(4, 4, 5.5, 6)
    assert [(k, c) for k, _, c in bd.shares(board, house, 0.01, 0.02)] == [(0, True), (1, True)]
    got = bd.detach(board, house, 0.01, 0.02)
    assert total(got) == 100 and round(bd.shared(got[0], house), 6) == 3 and bd.shared(got[1], house) < 1e-9
    assert bd.detach(board, box(1, 1, 2, 2), 0.01, 0.02) is None  # no crossing
    assert bd.detach(board, box(4.99, 1, 6, 2), 0.1, 0.02) is None  # a claim needs a real slice


def test_detach_refuses_to_break_a_donor():
    board = [box(0, 0, 10, 4), box(0, 4, 10, 6)]
    wall = box(4, 3, 5, 6)  # taking it would split the upper strip, giving it away leaves the lower one whole
    got = bd.detach(board, wall, 0.01, 0.02)
    assert got is not None and total(got) == 60 and all(len(bd.pieces(t)) == 1 for t in got)


def test_boundary_replacement_and_drawing():
    board = [(box(0, 0, 5, 5), True), (box(5, 0, 10, 5), True), (box(9.9, 5, 10, 10), False)]
    kept, dropped, unmarked = bd.replace_outer(board, box(0, 0, 8, 10), 1, 0.5)
    assert [m for _, m in kept] == [True, False] and (dropped, unmarked) == (1, 1)
    assert bd.replace_outer(board, box(50, 50, 60, 60), 1, 0.5)[0][0][1] is False
    auto = [(box(0, 0, 10, 10), True)]
    drawn = bd.add_inner(auto, box(2, 2, 20, 20), box(0, 0, 10, 10), 0.5, 1)
    assert [round(bd.area(p)) for p, _ in drawn] == [36, 64]
    assert bd.add_inner(drawn, box(3, 3, 4, 4), box(0, 0, 10, 10), 0.5, 1) is None
    outer = [*box(0, 0, 2, 2), *box(5, 5, 9, 9)]
    assert [round(bd.area(p)) for p in bd.keep_inhabited(outer, [box(0, 0, 1, 1)], 0.5)] == [4]
    assert [round(bd.area(p)) for p in bd.keep_inhabited(outer, [], 0.5)] == [16]


def test_connect_hands_orphans_over():
    board = [[*box(0, 0, 4, 4), *box(8, 0, 9, 4)], box(4, 0, 8, 4)]
    got = bd.connect(board, 0.1, 0.5, 0.05, 5)
    assert total(got) == 36 and all(len(bd.pieces(t)) == 1 for t in got) and len(got) == 2
    crumbs = bd.connect([[*box(0, 0, 10, 10), *box(50, 50, 50.1, 50.1)]], 0.1, 0.5, 0.05, 5)
    assert total(crumbs) == 100
