"""Registry of named queries and, where SQL can say it, of an independent SQL form of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The synthetic layers in plain SQL, for the oracles.
LAYERS = {
    "b": """b AS (SELECT c_custkey AS id, 19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 AS x, 50e0 + ((c_custkey * 104729) % 20021) / 1e6 AS y,
      CASE WHEN c_custkey % 11 = 3 THEN NULL WHEN c_custkey % 11 = 5 THEN 'nan' WHEN c_custkey % 11 = 7 THEN '  ' ELSE n_name END AS city,
      CASE WHEN c_custkey % 11 = 3 THEN NULL WHEN c_custkey % 11 = 5 THEN 'nan' WHEN c_custkey % 11 = 7 THEN '  ' ELSE c_mktsegment END AS place,
      CASE WHEN c_custkey % 11 = 9 THEN NULL ELSE r_name END AS suburb
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "t": """t0 AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS name, 19.9e0 + (n_nationkey % 5) * 4e-3 AS minx, 50e0 + (n_nationkey // 5) * 4e-3 AS miny FROM nation),
      t AS (SELECT *, minx + 4.01e-3 AS maxx, miny + 4.01e-3 AS maxy FROM t0)""",
    "s": """s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 19.9e0 ELSE 19.9e0 + ((s_suppkey * 37) % 200) * 1e-4 END AS ax,
      CASE WHEN s_suppkey % 2 = 0 THEN 50e0 + ((s_suppkey * 37) % 200) * 1e-4 ELSE 50e0 END AS ay,
      CASE WHEN s_suppkey % 2 = 0 THEN 19.92e0 ELSE 19.9e0 + ((s_suppkey * 37) % 200) * 1e-4 END AS bx,
      CASE WHEN s_suppkey % 2 = 0 THEN 50e0 + ((s_suppkey * 37) % 200) * 1e-4 ELSE 50.02e0 END AS "by" FROM supplier)""",
    "f": """f AS (SELECT id, x - (4 + id % 7) * 1e-5 AS minx, y - (4 + id % 7) * 1e-5 AS miny, x + (4 + id % 7) * 1e-5 AS maxx, y + (4 + id % 7) * 1e-5 AS maxy FROM b)""",
}


def layers(*names: str) -> str:
    return "WITH " + ",\n".join(LAYERS[n] for n in names)


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return register
