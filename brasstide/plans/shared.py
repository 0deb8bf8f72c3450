"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns (and write a negative zero as zero)."""
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()})
