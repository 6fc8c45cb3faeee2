"""Named queries."""

from __future__ import annotations


def _load():
    from quiltwork.plans import areas, facts, geometry, labels, more, moves, registry, routes, shapes, spatial, stored, text  # noqa: F401

    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
