"""Writes that tell their counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "error", by: tuple[str, ...] = ()) -> dict[str, int]:
    """Write df as Parquet, in folders by the columns `by`, and give the aggregates of what was written: one job, one scan.

    A task that runs again counts once, as a stage's result does; a write that fails gives no counts.
    """
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    rows = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    rows.write.mode(mode).partitionBy(*by).parquet(path)
    return seen.get
