"""Footprints on several territories: transactions on one board, and the same in windows and rounds."""

import pytest

from quiltwork.functions import board, settle
from quiltwork.functions import overlay as ov
from quiltwork.functions.morph import box
from quiltwork.operators import footprints

SIZES = settle.Sizes(unit=1.0, grid=0.01, seam=0.5)
U = 100.0


def unit(*edges):
    return box(*[e * U for e in edges])


def size(p):
    return board.area(p)


def done(slots, *roofs):
    return settle.run(dict(enumerate(slots)), [(k, r) for k, r in enumerate(roofs)], SIZES)


def test_the_roof_goes_to_the_larger_side_and_no_ground_is_lost():
    west, east, house = unit(0, 0, 1, 1), unit(1, 0, 2, 1), unit(0.99, 0.4, 1.03, 0.44)
    after, takers = done([west, east], house)
    assert takers == {0: 1}
    assert abs(board.shared(after[1], house) - size(house)) < 1e-6 and board.shared(after[0], house) < 1e-6
    assert abs(size(after[0]) + size(after[1]) - 2 * U * U) < 1e-6
    assert [len(board.pieces(after[k])) for k in (0, 1)] == [1, 1]


def test_three_territories_on_one_roof_all_give_it_up():
    house = unit(0.98, 0.4, 1.06, 0.46)
    after, takers = done([unit(0, 0, 1, 1), unit(1, 0.42, 2, 1), unit(1, 0, 2, 0.42)], house)
    held = [board.shared(p, house) for p in after.values()]
    assert sum(h > 0.01 * size(house) for h in held) == 1 and max(held) > 0.999 * size(house) and takers[0] == held.index(max(held))


def test_a_roof_that_would_swallow_a_territory_is_given_to_it():
    main, scrap, house = unit(0, 0, 1, 1), unit(1, 0.45, 1.1, 0.55), unit(0.9, 0.4, 1.2, 0.7)
    after, takers = done([main, scrap], house)
    assert takers == {0: 1} and size(after[1]) > size(scrap) and size(after[0]) < size(main)
    assert all(len(board.pieces(p)) == 1 for p in after.values())


def test_a_refusal_leaves_the_board_as_it_was():
    slots = [unit(0, 0, 1, 1), unit(1, 0.45, 1.06, 0.5), unit(1, 0.55, 1.06, 0.6)]
    after, takers = done(slots, unit(0.9, 0.4, 1.2, 0.7))
    assert takers == {0: None} and all(after[k] is s for k, s in enumerate(slots))


def test_an_overlapping_neighbour_gives_the_roof_up_and_the_owner_stays():
    owner, house, over = unit(0, 0, 1, 1), unit(0.8, 0.4, 0.9, 0.5), unit(0.88, 0.3, 1.6, 0.7)
    after, takers = done([owner, over], house)
    assert takers == {0: 0} and after[0] is owner and board.shared(after[1], house) < 1e-9


def lobed(west):
    p = [(1, 0), (2, 0), (2, 1), (1, 1), (1, 0.7), (west, 0.7), (west, 0.6), (1, 0.6), (1, 0)]
    return [[(x * U, y * U) for x, y in p]]


@pytest.mark.parametrize("reach, crumb", [(0.947, True), (0.5, False)])
def test_a_speck_is_swept_up_and_a_place_is_not_cut_off_if_there_is_another_way(reach, crumb):
    donor = lobed(reach)
    west = board.as_polygon(ov.difference(unit(0, 0, 1, 1), donor))
    house = unit(0.95, 0.25, 1.005, 0.85)
    after, takers = done([west, donor], house)
    whole = size(west) + size(donor)
    assert abs(sum(size(p) for p in after.values()) - whole) < 1
    assert takers[0] is not None and all(len(board.pieces(p)) == 1 for p in after.values())
    if crumb:  # the largest holder takes it, and the fleck beyond goes with it
        assert takers == {0: 0} and board.shared(after[0], unit(0.947, 0.6, 0.95, 0.7)) > 0.29


def test_a_piece_is_stranded_only_where_nothing_else_works():
    """Either side would be cut in two by the roof: the piece that only the new owner reaches goes with it."""
    west = [[(x * U, y * U) for x, y in [(0, 0), (1, 0), (1, 0.45), (1.5, 0.45), (1.5, 0.5), (1, 0.5), (1, 1), (0, 1), (0, 0)]]]
    east = board.as_polygon(ov.difference(board.as_polygon(ov.union_all([unit(1, 0, 2, 1), unit(0.5, 0.6, 1, 0.65)])), unit(1, 0.45, 1.5, 0.5)))
    west = board.as_polygon(ov.difference(west, unit(0.5, 0.6, 1, 0.65)))
    house = unit(0.7, 0.4, 1.3, 0.7)
    after, takers = done([west, east], house)
    assert takers[0] is not None and all(len(board.pieces(p)) == 1 for p in after.values())
    assert abs(sum(map(size, after.values())) - size(west) - size(east)) < 1 and board.shared(after[takers[0]], house) > 0.999 * size(house)


def test_a_window_accepts_only_what_the_whole_accepts():
    donor = lobed(0.5)
    west = board.as_polygon(ov.difference(unit(0, 0, 1, 1), donor))
    house = unit(0.95, 0.25, 1.005, 0.85)
    frame = (0.9 * U, 0.2 * U, 1.05 * U, 0.9 * U)
    parts = {k: ov.clip(p, frame) for k, p in enumerate((west, donor))}
    assert settle.run(parts, [(0, house)], SIZES, frame) is None


def test_on_spark_as_in_sequence(spark):
    """Boards of three kinds: settled in windows, put off to whole territories, and roofs that overlap one another."""
    donor = lobed(0.5)
    west = board.as_polygon(ov.difference(unit(0, 0, 1, 1), donor))
    shift = lambda p, k: [[(x + 1000.0 * k, y) for x, y in r] for r in p]
    slots = [shift(unit(0, 0, 1, 1), 0), shift(unit(1, 0, 2, 1), 0), shift(west, 1), shift(donor, 1), shift(unit(0, 0, 1, 1), 2), shift(unit(1, 0, 2, 1), 2)]
    roofs = [shift(unit(0.99, 0.4, 1.03, 0.44), 0), shift(unit(0.95, 0.8, 1.02, 0.9), 0), shift(unit(0.95, 0.25, 1.005, 0.85), 1), shift(unit(0.97, 0.4, 1.02, 0.44), 2), shift(unit(0.97, 0.43, 1.05, 0.5), 2), shift(unit(0.2, 0.2, 0.3, 0.3), 2)]
    cell = footprints._cell
    f = spark.createDataFrame([(k, cell(r)) for k, r in enumerate(roofs)], f"id long, rings {footprints.RINGS}")
    s = spark.createDataFrame([(k, cell(p)) for k, p in enumerate(slots)], f"ord long, rings {footprints.RINGS}")
    crossings, after = footprints.detach(f, s, 50.0, 2.0, SIZES)
    got = {r.id: r.taker for r in crossings.collect()}
    ring = {r.ord: footprints._rings(r.rings) for r in after.collect()}
    crossed = sorted((k for k in range(len(roofs)) if k != 5), key=lambda k: (size(roofs[k]), k))
    want, takers = settle.run(dict(enumerate(slots)), [(k, roofs[k]) for k in crossed], SIZES)
    assert got == takers
    assert all(abs(size(ring[k]) - size(want[k])) < 1e-6 and size(want[k]) - board.shared(ring[k], want[k]) < 1e-6 for k in want)


def test_empty_tables(spark):
    f = spark.createDataFrame([], f"id long, rings {footprints.RINGS}")
    s = spark.createDataFrame([(1, footprints._cell(unit(0, 0, 1, 1)))], f"ord long, rings {footprints.RINGS}")
    crossings, after = footprints.detach(f, s, 50.0, 2.0, SIZES)
    assert crossings.count() == 0 and after.count() == 1


def test_issues_settle_no_more_of_the_order_than_they_need(spark, monkeypatch):
    """The first crossing of the order moves, so the board's other crossings don't matter to what can be fixed."""
    slots = spark.createDataFrame([(k, footprints._cell(unit(k, 0, k + 1, 1))) for k in range(2)], f"ord long, rings {footprints.RINGS}")
    roofs = spark.createDataFrame([(k, footprints._cell(unit(0.95 - 0.001 * k, 0.1 * k, 1.03, 0.1 * k + 0.04))) for k in range(8)], f"id long, rings {footprints.RINGS}")
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 0.0, 0.0), (3, 100.0, 20.0), (4, 20.0, 100.0)], "id long, x double, y double")
    asked = []
    settle_all = footprints.settle_all
    monkeypatch.setattr(footprints, "settle_all", lambda roofs, *rest: (asked.append(roofs.count()), settle_all(roofs, *rest))[1])
    monkeypatch.setattr(footprints, "FIRST_MOVES", 3)
    got = {r.ord: tuple(r)[1:] for r in footprints.issues(slots, roofs, points, 50.0, 2.0, SIZES).collect()}
    assert got == {0: (1, False, False, 8, True), 1: (1, False, False, 8, True)}
    assert len(asked) == 1 and 0 < asked[0] < 8


def test_the_area_of_a_box_is_that_of_its_overlay():
    assert footprints._upright(unit(0.1, 0.2, 0.7, 0.9)) == size(unit(0.1, 0.2, 0.7, 0.9)) and footprints._upright([]) == 0
    assert footprints._upright(lobed(0.5)) is None and footprints._upright([[(0, 0), (2, 1), (0, 1), (2, 0), (0, 0)]]) is None
