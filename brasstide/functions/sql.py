"""Functions callable from SQL: `register(spark)` makes them available to a session."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    from brasstide.operators import answers
    spark.udf.register("normal_cdf", _normal_cdf)
    spark.udf.register("answer_figures", answers.figures_of)
    spark.udf.register("json_numbers", answers.json_numbers)
    spark.udtf.register("strike_ladder", StrikeLadder)


@F.pandas_udf("double")
def _normal_cdf(x: pd.Series) -> pd.Series:
    """The column expression of `pricing` for callers in SQL."""
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), na_action="ignore")


@udtf(returnType="strike double, moneyness double")
class StrikeLadder:
    """Strikes at a round step around a spot price: strike_ladder(spot, step, each_side)."""

    def eval(self, spot: float, step: float, each_side: int):
        middle = round(spot / step) * step
        for k in range(-each_side, each_side + 1):
            strike = middle + k * step
            if strike > 0:
                yield strike, strike / spot
