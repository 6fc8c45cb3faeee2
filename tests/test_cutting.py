"""Ends of cutting lines without a boundary or a direction."""

import pytest

from quiltwork.operators import cutting

EDGES = [(1.0, -1.0, 1.0, 1.0), (2.0, -1.0, 2.0, 1.0)]


def test_push_out(spark):
    ends = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.0), (2, 0.0, 0.0, -0.5, 0.0), (3, 0.5, 0.0, 0.5, 0.0), (4, 0.0, 0.0, 1.0, 0.0)], "id long, fx double, fy double, tx double, ty double")
    over = 1.5 / 110540

    def found(edges):
        frame = spark.createDataFrame(edges, "ax double, ay double, bx double, by double")
        return {r.id: (r.x, r.y) for r in cutting.push_out(ends, frame, "id", 1.5, 0.5).collect()}

    got = found(EDGES)
    assert got[1] == pytest.approx((1 + over, 0))
    assert got[2] == pytest.approx((-0.5 - over, 0))  # no boundary on its way
    assert got[3] == (0.5, 0.0)  # no direction
    assert got[4] == pytest.approx((2 + over, 0))  # the edge that it lies on does not count
    assert found([])[1] == pytest.approx((0.5 + over, 0))
