"""Opening, healing, holes, outlines; stored state."""

import random
from types import SimpleNamespace

import pytest

from quiltwork.functions import board, morph
from quiltwork.functions import overlay as ov
from quiltwork.sources.scratch import shared_folder


def test_a_barbell_opens_into_two_lobes():
    bell = ov.union_all([morph.box(0, 0, 4, 4), morph.box(4, 1.9, 8, 2.1), morph.box(8, 0, 11, 4)])
    assert len(ov.parts(bell)) == 1
    lobes = morph.opened(bell, 0.5)
    assert [round(ov.area(g), 9) for g in lobes] == [16, 12]


def test_a_seam_is_no_gap_and_a_slab_is():
    outer = morph.box(0, 0, 10, 10)
    assert morph.gaps(outer, [morph.box(0, 0, 4.95, 10), morph.box(5.05, 0, 10, 10)], 0.5, 0.1) == []
    found = morph.gaps(outer, [morph.box(0, 0, 4, 10), morph.box(6, 0, 10, 10)], 0.5, 0.1)
    assert [round(ov.area(g), 9) for g in found] == [20]


def test_slanted_shapes_keep_their_area_when_opened():
    diamond = [[(0, 0), (3, 3), (0, 6), (-3, 3), (0, 0)]]
    lobe = morph.opened(ov.union_all([diamond]), 0.5)[0]
    assert 18 - 4 * 0.51 < ov.area(lobe) <= 18 + 1e-9
    assert abs(ov.area(morph.shrink(morph.grow(ov.union_all([diamond]), 0.5), 0.5)) - 18) < 1e-6


def test_healing_closes_hairlines_only():
    near = [morph.box(0, 0, 1, 1), morph.box(1.001, 0, 2, 1)]
    assert len(ov.parts(morph.healed(near, 0.001))) == 1
    assert len(ov.parts(morph.healed([morph.box(0, 0, 1, 1), morph.box(1.5, 0, 2, 1)], 0.001))) == 2


def test_outlines_are_the_shape():
    rng = random.Random(4)
    for _ in range(60):
        shapes = [[[(x + rng.uniform(0, 2), y + rng.uniform(0, 2)) for x, y in ((0, 0), (3, 0), (3, 3), (0, 3))] for _ in range(1)] for _ in range(4)]
        shapes = [[[*r[0], r[0][0]]] for r in shapes]
        got = ov.overlay([*shapes], lambda s: sum(s) % 2 == 1)
        rings = ov.outline(got)
        assert abs(ov.area(ov.union_all([rings])) - ov.area(got)) < 1e-9
        signed = sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r, r[1:], strict=False)) / 2
        assert abs(signed - ov.area(got)) < 1e-9
    frame = ov.difference(morph.box(0, 0, 4, 4), morph.box(1, 1, 2, 2))
    assert sorted(map(len, ov.outline(frame))) == [5, 5]
    assert board.area(board.as_polygon(frame)) == 15


def test_scratch_refuses_a_machines_own_folder_on_a_cluster():
    def session(master, folder=None, given=None):
        none = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))

    assert shared_folder(session("spark://host:7077", "s3://here/")) == "s3://here"
    assert shared_folder(session("spark://host:7077", None, "hdfs://there")) == "hdfs://there"
    assert shared_folder(session("local[2]")).startswith("file:")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_faces_tile_what_lines_enclose():
    from quiltwork.functions import kernels, planar

    rng = random.Random(9)
    for _ in range(20):
        frame = [((0, 0), (4, 0)), ((4, 0), (4, 4)), ((4, 4), (0, 4)), ((0, 4), (0, 0))]
        lines = [((0, rng.uniform(0, 4)), (4, rng.uniform(0, 4))) for _ in range(4)] + [((rng.uniform(0, 4), 0), (rng.uniform(0, 4), 4)) for _ in range(3)]
        dead = [((0, 0), (-1, -1)), ((4, 4), (4.1, 4.2))]
        faces = planar.faces(planar.node(frame + lines + dead))
        assert abs(sum(kernels.ring_area(f) for f in faces) - 16) < 1e-6
        edges = planar.node(frame + lines)
        points = {p for e in edges for p in e}
        assert len(faces) == len(edges) - len(points) + 1  # Euler
    assert planar.faces(planar.node([((0, 0), (1, 0)), ((1, 0), (2, 2))])) == []


def test_a_plan_adopts_splits_frees_and_merges():
    from quiltwork.functions import heal

    slots = [(0, morph.box(0, 0, 2, 2) + morph.box(6, 0, 7, 1)), (1, morph.box(2, 0, 4, 2)), (2, morph.box(0, 2, 4, 4))]
    points = [(0.5, 0.5), (3, 1)]
    roof = morph.box(1.8, 0.5, 2.1, 0.7)
    after, hosts, report = heal.plan(slots, points, [roof], [morph.box(4, 0, 5, 2)], 0.001, 0.02, 0.01)
    assert report == {"adopted": 1, "split": 1, "detached": 1, "merged": 2}
    assert hosts == {3: 1, 2: 0} or hosts == {3: 1, 2: 1}
    shapes = dict(after)
    assert set(shapes) == {0, 1, 4}  # the piece far away touches nobody
    assert abs(sum(board.area(s) for s in shapes.values()) - (4 + 4 + 8 + 1 + 2)) < 1e-9
    assert board.shared(shapes[0], roof) > 0.0599 and board.shared(shapes[1], roof) < 1e-9
    assert heal.merge_empty(slots, [], 0.01)[1] == {}
