"""What kind of market a ticker is in: trend strength, direction, and volatility rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brasstide.functions import series, sliding
from brasstide.operators.features import Features

# Conventional thresholds and window lengths.
TREND_AT, RANGE_BELOW, VOLATILE_AT = 25.0, 20.0, 0.80
SLOPE_OF, SLOPE_DAYS = 50, 20
VOL_DAYS, VOL_PAST = 20, 252
MEASURES = ["adx", "plus_di", "minus_di", "slope", "volatility", "volatility_rank"]


def request(f: Features) -> list[str]:
    """Ask for the measurements; returns their column names."""
    adx, plus, minus = f.adx(14)
    line = f.sma(f.close, SLOPE_OF)
    ret = f.column("log_return", F.log(F.col(f.close) / F.lag(f.close).over(f.w)))
    f.column("adx", F.col(adx), adx)
    f.column("plus_di", F.col(plus), plus)
    f.column("minus_di", F.col(minus), minus)
    f.slide("slope", sliding.growth(SLOPE_DAYS), SLOPE_DAYS, line)
    vol = f.slide("volatility", sliding.deviation(VOL_DAYS, sample=True, times=series.TRADING_DAYS ** 0.5), VOL_DAYS - 1, ret)
    f.slide("volatility_rank", sliding.percentile_rank(VOL_PAST), VOL_PAST, vol)
    return list(MEASURES)


def measure(bars: DataFrame, keys=("ticker",)) -> DataFrame:
    f = Features(keys)
    request(f)
    return f.apply(bars)


def classify(rule: str = "slope") -> Column:
    """The label from the measurement columns. `agree` also asks the DI lines."""
    if rule not in ("slope", "agree"):
        raise ValueError(rule)
    adx, slope = F.col("adx"), F.col("slope")
    missing = adx.isNull() | slope.isNull() | F.col("volatility_rank").isNull()
    up, down = slope > 0, slope <= 0
    if rule == "agree":
        up = up & (F.col("plus_di") > F.col("minus_di"))
        down = (slope < 0) & (F.col("minus_di") > F.col("plus_di"))
    strong = adx >= TREND_AT
    return (F.when(missing, "unknown").when(F.col("volatility_rank") >= VOLATILE_AT, "volatile")
            .when(strong & up, "trending_up").when(strong & down, "trending_down")
            .when(adx < RANGE_BELOW, "ranging").otherwise("transition"))
