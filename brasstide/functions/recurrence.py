"""Exponential smoothing: what is asked for, and the row numbers it goes by.

The recurrence level = a*x + (1-a)*level is carried from row to row by `functions.sliding.Scan`, in the
pass over the sorted rows that makes all other figures of the last rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 64


@dataclass(frozen=True)
class Smooth:
    """`out`: `src` smoothed with factor `alpha`, shown from the n-th value on."""

    out: str
    src: str
    alpha: float
    n: int


def ema_spec(out: str, src: str, n: int) -> Smooth:
    return Smooth(out, src, 2.0 / (n + 1), n)


def wilder_spec(out: str, src: str, n: int) -> Smooth:
    return Smooth(out, src, 1.0 / n, n)


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Row number `_i` within the key and its block `_b`.

    Windows ordered by (_b, _i) see the order of `order`: one sort serves every indicator.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return (df.withColumn("_i", F.row_number().over(w) - 1)
            .withColumn("_b", F.floor(F.col("_i") / BLOCK)))
