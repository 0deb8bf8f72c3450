"""Returns, risk and summaries of price series, per ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.functions.markets import benchmark_bars, with_market
from brasstide.functions.series import TRADING_DAYS

ROOT = TRADING_DAYS ** 0.5


def returns(prices: DataFrame, price: str = "adj_close", keys=("ticker",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("day")
    step = F.col(price) / F.lag(price).over(w)
    return prices.withColumns({"simple_return": step - 1.0, "log_return": F.log(step)})


def max_drawdown(prices: DataFrame, price: str = "adj_close", keys=("ticker",)) -> DataFrame:
    """Deepest fall from a running peak; the first such trough and the first peak before it."""
    w = Window.partitionBy(*keys).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = prices.select(*keys, "day", F.col(price).alias("_p"))
    df = df.withColumn("_peak", F.max("_p").over(upto))
    # The peak's first day: where the running maximum last rose.
    rose = F.col("_p") > F.coalesce(F.lag("_peak").over(w), F.lit(float("-inf")))
    df = df.withColumn("_peak_day", F.last(F.when(rose, F.col("day")), ignorenulls=True).over(upto))
    fall = F.col("_p") / F.col("_peak") - 1.0
    return df.groupBy(*keys).agg(
        F.min(F.struct(fall.alias("d"), "day", "_peak_day")).alias("_m")).select(
        *keys, F.col("_m.d").alias("max_drawdown"), F.col("_m._peak_day").alias("peak_day"),
        F.col("_m.day").alias("trough_day"))


def with_benchmark(prices: DataFrame, benchmark: DataFrame, price: str = "adj_close") -> DataFrame:
    """Days both have, then returns on those days only. `benchmark` has benchmark, day, price: the few
    indices' days, which are sent to every task, so the prices are shuffled once, by ticker."""
    b = F.broadcast(benchmark.select("benchmark", "day", F.col(price).alias("_b")))
    both = prices.select("ticker", "benchmark", "day", F.col(price).alias("_a")).join(
        b, ["benchmark", "day"])
    w = Window.partitionBy("ticker").orderBy("day")
    return both.withColumns({"ra": F.col("_a") / F.lag("_a").over(w) - 1.0,
                             "rb": F.col("_b") / F.lag("_b").over(w) - 1.0})


def beta_and_correlation(pairs: DataFrame) -> DataFrame:
    """Null below three common days or when the benchmark does not vary."""
    n, var = F.count("rb"), F.var_samp("rb")
    return pairs.groupBy("ticker").agg(
        F.when((n >= 2) & (var > 0), F.covar_samp("ra", "rb") / var).alias("beta"),
        F.when(n >= 2, F.try_divide(F.covar_samp("ra", "rb"), F.stddev_samp("ra") * F.stddev_samp("rb")))
        .alias("correlation"),
        n.alias("overlapping_return_days"))


def summary(bars: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Everything above for each ticker with at least two bars, against its market's index."""
    marked = with_market(bars)
    r = returns(marked)
    last, first = F.max_by("adj_close", "day"), F.min_by("adj_close", "day")
    n = F.count(F.lit(1))
    flat = r.groupBy("ticker", "exchange", "benchmark").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), n.alias("trading_days"),
        (last / first - 1.0).alias("total_return"),
        F.when(first > 0, F.pow(last / first, TRADING_DAYS / (n - 1)) - 1.0).alias("annualised_return"),
        (F.stddev_samp("simple_return") * ROOT).alias("annualised_volatility"),
        F.max("simple_return").alias("best_day"), F.min("simple_return").alias("worst_day"))
    flat = flat.filter("trading_days >= 2").withColumn("sharpe_ratio", F.when(
        F.col("annualised_volatility") > 0,
        (F.col("annualised_return") - risk_free) / F.col("annualised_volatility")))
    index = benchmark_bars(bars).withColumnRenamed("ticker", "benchmark")
    pairs = with_benchmark(marked.filter(F.col("ticker") != F.col("benchmark")), index)
    return (flat.join(max_drawdown(bars), "ticker")
            .join(beta_and_correlation(pairs), "ticker", "left"))


def price_range(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """First, last, high and low close with dates, and change, per request (ticker, start, end)."""
    df = requests.join(bars, "ticker").filter(F.col("day").between(F.col("start"), F.col("end")))
    c = F.col("close")
    out = df.groupBy("ticker", "start", "end").agg(
        F.count(F.lit(1)).alias("trading_days"),
        F.min("day").alias("first_day"), F.min_by("close", "day").alias("first_close"),
        F.max("day").alias("last_day"), F.max_by("close", "day").alias("last_close"),
        F.max("close").alias("high"), F.min_by("day", F.struct(-c, "day")).alias("high_day"),
        F.min("close").alias("low"), F.min_by("day", F.struct(c, "day")).alias("low_day"))
    change = F.col("last_close") - F.col("first_close")
    return out.withColumns({
        "change": F.round(change, 4),
        "change_pct": F.round(F.when(F.col("first_close") != 0, change / F.col("first_close") * 100), 4),
        "series_truncated": F.col("trading_days") > 250})


def recent_points(bars: DataFrame, points: int = 250) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    return bars.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= points).drop("_k")


def cards(bars: DataFrame, points: int = 60) -> DataFrame:
    """The dashboard card of every ticker: price, change on the day before, recent closes."""
    w = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    recent = (bars.select("ticker", "day", "close").withColumn("_k", F.row_number().over(w))
              .filter(F.col("_k") <= points))
    df = recent.groupBy("ticker").agg(
        F.max("day").alias("as_of"), F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("_last"),
        F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("_prev"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "close"))),
                                 lambda x: F.format_string("%.2f", x["close"])), " ").alias("sparkline"))
    df = df.withColumns({"price": F.round("_last", 2),
                         "change_pct": F.round((F.col("_last") / F.col("_prev") - 1.0) * 100, 2)})
    return with_market(df).select("ticker", "exchange", "currency_symbol", "as_of", "price",
                                  "change_pct", "sparkline")


def strip(card_rows: DataFrame) -> DataFrame:
    """Indices first, then stocks; cards without a price are left out."""
    kind = F.when(F.col("ticker").startswith("^") | (F.col("ticker") == "SPY"), "index").otherwise("stock")
    return card_rows.filter(F.col("price").isNotNull()).select(
        "ticker", "exchange", kind.alias("kind"), "currency_symbol", "price", "change_pct", "as_of"
    ).orderBy("kind", "ticker")


def historical_volatility(bars: DataFrame, window: int = 30) -> DataFrame:
    """Spot and annualised volatility of the last `window` log returns of the traded close."""
    w = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    recent = bars.select("ticker", "day", "close").withColumn("_k", F.row_number().over(w)).filter(
        F.col("_k") <= window + 1)
    r = recent.withColumn("_r", F.log(F.col("close") / F.lead("close").over(w)))
    return r.groupBy("ticker").agg(
        F.max("day").alias("as_of"), F.max_by("close", "day").alias("spot"),
        F.stddev_samp("_r").alias("_sd"), F.count("_r").alias("_n")).filter(
        F.col("_n") == window).select("ticker", "as_of", "spot", (F.col("_sd") * ROOT).alias("sigma"))
