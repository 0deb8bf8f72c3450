"""The signal's out-of-sample record: against holding, the index, and its own re-timings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brasstide.functions.series import TRADING_DAYS, spread
from brasstide.operators import backtest, signals
from brasstide.operators.signals import FIRST_BAR, NOTIONAL

# Evaluation settings.
RANDOM_RUNS = 200
EDGE_AT = 0.95
HORIZON = 20
MIN_BARS = 60
CARRY = ["ticker", "day", "bar", "open", "close", "buy_rate", "sell_rate", "per_sale"]


def window(signal_rows: DataFrame, years: int = 5) -> DataFrame:
    """Signal rows of the evaluated window; tickers with too few are left out.
    Rows of a pass that made the columns of WINDOW know whether they are in it."""
    if "trading_days" in signal_rows.columns:
        return signal_rows.filter(F.col("trading_days").isNotNull())
    whole = Window.partitionBy("ticker")
    wanted = F.date_sub(F.max("day").over(whole), round(365.25 * years))
    df = signal_rows.withColumns({
        "_wanted": wanted,
        "ahead": F.lead("close", HORIZON).over(Window.partitionBy("ticker").orderBy("day"))
        / F.col("close") - 1.0})
    df = df.filter((F.col("bar") >= FIRST_BAR) & (F.col("day") >= F.col("_wanted")))
    n = F.count(F.lit(1)).over(whole)
    return df.withColumn("trading_days", n).filter(F.col("trading_days") >= MIN_BARS).drop("_wanted")


def _ahead(v, bars: pa.Table) -> pa.Array:
    """`ahead` of `window` on one ticker's signal rows (signals._Votes)."""
    close = pc.cast(bars["close"], pa.float64()).to_numpy()[v.rows]
    out = np.full(len(close), np.nan)
    with np.errstate(all="ignore"):
        out[:max(0, len(close) - HORIZON)] = close[HORIZON:] / close[:max(0, len(close) - HORIZON)] - 1.0
    return pa.array(out, from_pandas=True)


def _trading_days(v, bars: pa.Table, years: int = 5) -> pa.Array:
    """`trading_days` of `window`; null outside of it."""
    day = bars["day"].combine_chunks().take(pa.array(v.rows))
    known = pc.is_valid(day).to_numpy(zero_copy_only=False)
    at = pc.cast(day, pa.int32()).fill_null(0).to_numpy()
    inside = known & (at >= at[known].max() - round(365.25 * years)) if known.any() else known
    n = int(inside.sum())
    return pa.array(np.full(len(inside), n), mask=~inside if n >= MIN_BARS else np.ones(len(inside), dtype=bool))


#: Columns of days for `signals.rule_runs`: they tell `window` which rows it wants.
WINDOW = {"ahead": (T.DoubleType(), _ahead), "trading_days": (T.LongType(), _trading_days)}


def _runs(rows: DataFrame, targets: dict[str, Column], carry=CARRY) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("run"), e.cast("double").alias("target"))
                      for n, e in targets.items()])
    return rows.select(*carry, F.explode(pairs).alias("_p")).select(*carry, "_p.run", "_p.target")


def curves(rows: DataFrame) -> DataFrame:
    """Equity of the signal and of holding, on the same terms."""
    runs = _runs(rows, {"signal": F.col("position"), "buy_and_hold": F.lit(1.0)})
    return backtest.simulate(runs, ["ticker", "run"], cash=NOTIONAL)


def risk(curve_rows: DataFrame) -> DataFrame:
    return backtest.risk_metrics(curve_rows.withColumn("equity", F.round("equity", 4)),
                                 ["ticker", "run"])


def index_starts(rows: DataFrame) -> DataFrame:
    """(ticker, benchmark, day0): each ticker's index and the first day of its window."""
    from brasstide.functions.markets import with_market
    return with_market(rows.groupBy("ticker").agg(F.min("day").alias("day0"))).select("ticker", "benchmark", "day0")


def index_curve(starts: DataFrame, bars: DataFrame) -> DataFrame:
    """The benchmark index held, free of cost, from a first day on: a curve for every (benchmark, day0) of `starts`.
    Tickers that share both share the curve, so there are no more than an index has days."""
    from brasstide.functions.markets import benchmark_bars
    from brasstide.operators.rules import adjusted_prices
    index = adjusted_prices(benchmark_bars(bars)).select(F.col("ticker").alias("benchmark"), "day", "open", "close")
    runs = starts.select("benchmark", "day0").distinct().join(index, "benchmark").filter(F.col("day") >= F.col("day0"))
    runs = runs.withColumns({"target": F.lit(1.0), "buy_rate": F.lit(0.0),
                             "sell_rate": F.lit(0.0), "per_sale": F.lit(0.0)})
    out = backtest.simulate(runs, ["benchmark", "day0"], cash=NOTIONAL, slippage_bps=0.0)
    return out.withColumn("run", F.lit("index"))


def shifts(m: int, runs: int = RANDOM_RUNS) -> np.ndarray:
    """Up to `runs` of the possible shifts of m rows, by a fixed shuffle (a multiplicative generator's step)."""
    k = np.arange(1, m, dtype=np.int64)
    return k[np.argsort((k * 48271) % 2147483647, kind="stable")][:runs]


def _retimed(rows: DataFrame, runs: int, figures: Callable[[dict], dict], schema: str) -> DataFrame:
    """`figures` of the signal itself (run 0), of holding (run -1), and of the signal's positions shifted
    circularly by `runs` distinct offsets (run k): one row per ticker and run.

    A ticker's window (a few years of days at most) is read once, its runs are columns beside each
    other; only a run's figures leave the task.
    """
    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        n, position = len(pdf), pdf["position"].to_numpy(float)
        offsets = shifts(n, runs)
        at = (np.arange(n)[:, None] - offsets[None, :]) % n
        levels, code = np.unique(np.concatenate([[0.0, 1.0], np.nan_to_num(position)]), return_inverse=True)
        own = code[2:]
        codes = np.column_stack([own, np.full(n, code[1]), own[at]])
        columns = [pdf[c].to_numpy(float) for c in ("buy_rate", "sell_rate", "per_sale")]
        with np.errstate(all="ignore"):
            sim = backtest.simulate_levels(pdf["open"].to_numpy(float), pdf["close"].to_numpy(float), levels, codes, *columns, cash=NOTIONAL)
            found = figures(sim)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "trading_days": pdf["trading_days"].iloc[0],
                             "shift": np.concatenate([[0, -1], offsets]), **found})

    types = f"ticker string, trading_days bigint, shift int, {schema}"
    return (spread(rows, "ticker").select(*CARRY, "position", "trading_days")
            .groupBy("ticker", "trading_days").applyInPandas(per_ticker, types))


def _steps(equity: np.ndarray) -> np.ndarray:
    return equity[1:] / equity[:-1] - 1.0


def _drawdown(equity: np.ndarray) -> np.ndarray:
    return (equity / np.maximum.accumulate(equity, axis=0) - 1.0).min(axis=0)


def _inside(held: np.ndarray) -> np.ndarray:
    return (np.abs(held[1:]) > 0).mean(axis=0)


def run_figures(rows: DataFrame, runs: int = RANDOM_RUNS) -> DataFrame:
    """Both Sharpe ratios, CAGR, drawdown and time in market of every run, in one pass."""
    def figures(sim: dict) -> dict:
        equity = sim["equity"]
        r = _steps(equity)
        grown = np.where(equity[-1] > 0, (equity[-1] / equity[0]) ** (TRADING_DAYS / len(r)) - 1.0, np.nan)
        volatility = r.std(axis=0, ddof=1) * TRADING_DAYS ** 0.5
        return {"sharpe_ratio": np.where(volatility > 0, grown / volatility, np.nan), "cagr": grown,
                "total_return": equity[-1] / equity[0] - 1.0, "annualised_volatility": volatility,
                "max_drawdown": _drawdown(equity), "exposure": _inside(sim["held"]), "costs_paid": np.nansum(sim["fee"], axis=0)}

    names = ["sharpe_ratio", "cagr", "total_return", "annualised_volatility", "max_drawdown", "exposure", "costs_paid"]
    stats = _retimed(rows, runs, figures, ", ".join(f"{n} double" for n in names)).withColumns(backtest.defined(*names))
    return stats.withColumns({n: F.round(n, 6) for n in ("sharpe_ratio", "cagr")})


def random_summary(figures: DataFrame) -> DataFrame:
    """Where the signal's Sharpe stands among its re-timings."""
    own = F.max(F.when(F.col("shift") == 0, F.col("sharpe_ratio"))).over(Window.partitionBy("ticker"))
    df = figures.withColumn("own", own).filter(F.col("shift") > 0)

    def pct(col, q):
        return F.percentile(col, q)

    below = F.when(F.col("sharpe_ratio").isNotNull() & F.col("own").isNotNull(),
                   (F.col("sharpe_ratio") < F.col("own")).cast("double"))
    return df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("runs"),
        *[pct("cagr", q).alias(f"cagr_{n}") for q, n in ((0.05, "p5"), (0.5, "median"), (0.95, "p95"))],
        *[pct("sharpe_ratio", q).alias(f"sharpe_{n}")
          for q, n in ((0.05, "p5"), (0.5, "median"), (0.95, "p95"))],
        F.round(F.avg(below), 4).alias("signal_sharpe_percentile"))


def verdict_inputs(rows: DataFrame, runs: int = RANDOM_RUNS) -> DataFrame:
    """Per ticker: risk of the signal and of holding, and the re-timing percentile, with every
    run simulated once."""
    def figures(sim: dict) -> dict:
        exact, value = sim["equity"], np.round(sim["equity"], 4)
        r, root = _steps(value), TRADING_DAYS ** 0.5
        grown = (exact[-1] / exact[0]) ** (TRADING_DAYS / len(r)) - 1.0
        volatility, sd = _steps(exact).std(axis=0, ddof=1) * root, r.std(axis=0, ddof=1)
        return {"ratio": np.where(volatility > 0, grown / volatility, np.nan), "cagr": grown,
                "sharpe": np.where(sd > 0, r.mean(axis=0) / sd * root, np.nan), "max_drawdown": _drawdown(value),
                "time_in_market": _inside(sim["held"])}

    names = ["ratio", "cagr", "sharpe", "max_drawdown", "time_in_market"]
    each = _retimed(rows, runs, figures, ", ".join(f"{n} double" for n in names)).withColumns(backtest.defined(*names))
    each = each.withColumns({n: F.round(n, 6 if n == "ratio" else 4) for n in names})
    own = F.max(F.when(F.col("shift") == 0, F.col("ratio"))).over(Window.partitionBy("ticker"))
    each = each.withColumn("_own", own)

    def of(shift, name):
        return F.max(F.when(F.col("shift") == shift, F.col(name)))

    below = F.when((F.col("shift") > 0) & F.col("ratio").isNotNull() & F.col("_own").isNotNull(),
                   (F.col("ratio") < F.col("_own")).cast("double"))
    return each.groupBy("ticker", "trading_days").agg(
        *[of(shift, m).alias(f"{short}_{m}") for shift, short in ((0, "s"), (-1, "b"))
          for m in ("cagr", "sharpe", "max_drawdown", "time_in_market")],
        F.sum((F.col("shift") > 0).cast("bigint")).alias("runs"),
        F.round(F.avg(below), 4).alias("signal_sharpe_percentile"))


def hit_rate(rows: DataFrame) -> DataFrame:
    """How often the price rose (fell) over the horizon after BUY (SELL), and base rates."""
    known = F.col("ahead").isNotNull()
    up, down = (F.col("ahead") > 0).cast("double"), (F.col("ahead") < 0).cast("double")

    def share(x, said=None):
        on = known if said is None else known & (F.col("decision") == said)
        return F.round(F.avg(F.when(on, x)), 4)

    def days(said):
        return F.sum((known & (F.col("decision") == said)).cast("bigint"))

    return rows.groupBy("ticker").agg(
        share(up, "BUY").alias("after_buy_up"), days("BUY").alias("buy_days"),
        share(up).alias("base_rate_up"), share(down, "SELL").alias("after_sell_down"),
        days("SELL").alias("sell_days"), share(down).alias("base_rate_down"))


def decision_counts(rows: DataFrame) -> DataFrame:
    regimes = ("trending_up", "trending_down", "ranging", "transition", "volatile", "unknown")

    def n(cond):
        return F.sum(cond.cast("bigint"))

    return rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("trading_days"), n(F.col("limited")).alias("limited_days"),
        *[n(F.col("decision") == d).alias(d.lower()) for d in ("BUY", "SELL", "HOLD")],
        *[n(F.col("regime") == x).alias(x) for x in regimes])


def _percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def verdict(df: DataFrame) -> DataFrame:
    """edge / no_edge, with the sentence that says why, from `verdict_inputs`."""
    years = F.round(F.col("trading_days") / 252, 2)
    more = F.coalesce(F.col("s_cagr") > F.col("b_cagr"), F.lit(False))
    safer = F.coalesce(F.col("s_sharpe") > F.col("b_sharpe"), F.lit(False))
    timed = F.coalesce(F.col("signal_sharpe_percentile") >= EDGE_AT, F.lit(False))
    edge = more & safer & timed
    share = F.regexp_replace(F.format_string("%.1f", F.col("signal_sharpe_percentile") * 100), r"\.0$", "")
    figures = F.concat(
        F.lit("the signal returned "), _percent(F.col("s_cagr")), F.lit(" a year against "),
        _percent(F.col("b_cagr")), F.lit(" for buy-and-hold, with a Sharpe ratio of "),
        F.format_string("%.2f against %.2f", "s_sharpe", "b_sharpe"), F.lit(", and beat "), share,
        F.format_string("%% of %d random re-timings", "runs"))
    why = (F.when(edge, "")
           .when(more & ~timed, " Randomly timed trades often did as well.")
           .when(more & ~safer, " It took more risk for each unit of return.").otherwise(""))
    short = F.when(years < 3, F.concat(F.lit(" Only "), years.cast("string"), F.lit(" years were tested.")))
    return df.select(
        "ticker", F.when(edge, "edge").otherwise("no_edge").alias("verdict"), years.alias("years"),
        F.col("s_cagr").alias("signal_cagr"), F.col("b_cagr").alias("buy_and_hold_cagr"),
        F.col("s_sharpe").alias("signal_sharpe"), F.col("b_sharpe").alias("buy_and_hold_sharpe"),
        F.col("s_max_drawdown").alias("signal_max_drawdown"),
        F.col("b_max_drawdown").alias("buy_and_hold_max_drawdown"),
        F.col("s_time_in_market").alias("time_in_market"),
        F.col("signal_sharpe_percentile").alias("random_percentile"),
        F.concat(F.lit("The backtest shows "), F.when(edge, "an edge").otherwise("no edge"),
                 F.lit(" for "), F.col("ticker"), F.lit(": "), figures, F.lit("."), why,
                 F.coalesce(short, F.lit(""))).alias("statement"))


def schedule_figures(refit_days, years: int = 5) -> tuple[Callable[[pd.DataFrame], pd.DataFrame], str]:
    """What `refit_spread` wants of one ticker's bars and runs: a row per schedule of its signal's Sharpe and CAGR
    and those of holding, and the schema of these rows. For `signals.rule_runs`, where no bar leaves the task."""
    schedules, figures = list(refit_days), ["sharpe", "cagr", "_hs", "_hc"]

    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        position = signals.positions_of_schedules(pdf, schedules)
        day = pd.to_datetime(pdf["day"])
        at = ((pdf["bar"] >= FIRST_BAR) & (day >= day.max() - pd.Timedelta(days=round(365.25 * years)))).to_numpy()
        if at.sum() < MIN_BARS:
            return pd.DataFrame({"ticker": pd.Series(dtype=str), "schedule": pd.Series(dtype="int32"), **{n: pd.Series(dtype=float) for n in figures}})
        targets = np.column_stack([position[at], np.ones(at.sum())])
        columns = [pdf[c].to_numpy(float)[at] for c in ("open", "close", "buy_rate", "sell_rate", "per_sale")]
        with np.errstate(all="ignore"):
            sim = backtest.simulate_key(columns[0], columns[1], targets, *columns[2:], cash=NOTIONAL)
            found = backtest.risk_figures(np.round(sim["equity"], 4), sim["held"])
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "schedule": np.array(schedules, dtype=np.int32), "sharpe": found["sharpe"][:-1],
                             "cagr": found["cagr"][:-1], "_hs": found["sharpe"][-1], "_hc": found["cagr"][-1]})

    return per_ticker, "ticker string, schedule int, " + ", ".join(f"{n} double" for n in figures)


def refit_spread(runs: DataFrame, refit_days, years: int = 5) -> DataFrame:
    """How much the choice of refit day matters: spread of Sharpe and CAGR over schedules.

    A ticker's bars are bounded and read once for all schedules: the schedules' positions and holding are
    simulated beside each other, and one row per schedule leaves the task. Runs of a pass that ended with
    `schedule_figures` are those rows already.
    """
    figures = ["sharpe", "cagr", "_hs", "_hc"]
    if "schedule" in runs.columns:
        df = runs
    else:
        rows = runs.select(*CARRY, "month_day", "allows_short", "regime", *[F.col(f"runs.{c}").alias(c) for c in (
            "rule", "target", "sharpe_long", "sharpe_short")])
        df = spread(rows, "ticker").groupBy("ticker").applyInPandas(*schedule_figures(refit_days, years))
    df = df.withColumns(backtest.defined(*figures)).withColumns({n: F.round(n, 4) for n in figures})
    x, c = F.col("sharpe"), F.col("cagr")
    return df.groupBy("ticker").agg(
        F.min(x).alias("sharpe_min"), F.percentile(x, 0.5).alias("sharpe_median"), F.max(x).alias("sharpe_max"),
        F.min(c).alias("cagr_min"), F.percentile(c, 0.5).alias("cagr_median"), F.max(c).alias("cagr_max"),
        F.sum(((x > F.col("_hs")) & (c > F.col("_hc"))).cast("bigint")).alias("runs_beating_hold"),
        F.count(F.lit(1)).alias("runs"))
