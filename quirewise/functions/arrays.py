"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: list, array: Column, pos: str, value: str) -> DataFrame:
    """``posexplode`` for an array that is dear to compute.

    For a plain explode Spark infers the filter ``size(array) > 0`` and pushes
    it down, which computes the array a second time.  The outer form infers
    nothing; the rows it adds for empty arrays are dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


def explode_map_once(df: DataFrame, keep: list, entries: Column, key: str, value: str) -> DataFrame:
    """The same for a map."""
    rows = df.select(*keep, F.explode_outer(entries).alias(key, value))
    return rows.filter(F.col(key).isNotNull())
