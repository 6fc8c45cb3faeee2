"""Polygon kernels over tables: a row at a time, or a project (at most 200 territories) at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cores: a file of one row group, or a small exchange, would be one task."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def each(df: DataFrame, run: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``run`` gives for each row, wherever they lie: the work by row is long, so the rows are dealt out."""
    names = _columns(schema)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([out for r in rows.itertuples(index=False) for out in run(r)], columns=names)

    return dealt(df).mapInPandas(go, schema)


def project(df: DataFrame, key: str, order: str, run: Callable[[int, list], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``run`` gives for a project's key and its rows in order; one task a project."""
    names = _columns(schema)

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(run(int(rows[key].iloc[0]), list(rows.sort_values(order).itertuples(index=False))), columns=names)

    return df.groupBy(key).applyInPandas(go, schema)
