"""Small arithmetic on shares and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blend(first: Column, second: Column, part: Column) -> Column:
    """(1 - part) first + part second."""
    return (1 - part) * first + part * second


def half_open_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index of the bin [edge, next edge) that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((value >= edges[k]) & (value < edges[k + 1]), F.lit(k)).otherwise(out)
    return out


def years(weeks: Column) -> Column:
    return weeks / 52
