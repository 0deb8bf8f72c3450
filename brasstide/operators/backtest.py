"""Next-open execution over any number of runs at once.

A run is one key (ticker, rule, ...). The target decided at a bar's close is traded at the
next bar's open: overnight the old position earns, then costs, then the new one earns to
the close. Each bar maps equity V to g*V + h (h only where a market charges a fixed sum per
sale), so a run's equity is a product window and a sum window; no run is walked row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brasstide.functions.markets import DeliveryRates
from brasstide.functions.series import TRADING_DAYS

SLIPPAGE_BPS = 5.0
START_CASH = 10_000.0


def _legs(df: DataFrame, w) -> DataFrame:
    """What is held before and after each open, and the notional shares traded there."""
    df = df.withColumns({
        "_i": F.row_number().over(w) - 1,
        "held": F.coalesce(F.lag("target").over(w), F.lit(0.0)),
        "_was": F.coalesce(F.lag("target", 2).over(w), F.lit(0.0)),
        "_prev_close": F.lag("close").over(w),
    })
    bought = F.greatest(F.lit(0.0), F.col("held") - F.col("_was"))
    sold = F.greatest(F.lit(0.0), F.col("_was") - F.col("held"))
    selling = (F.least(sold, F.greatest(F.col("_was"), F.lit(0.0)))
               + F.least(bought, F.greatest(-F.col("_was"), F.lit(0.0))))
    return df.withColumns({"_moved": bought + sold, "_sell": selling,
                           "_buy": bought + sold - selling})


@dataclass(frozen=True)
class Beside:
    """Runs that share their bars: `rows` has a target column for each of `labels`, and what `simulate` needs of a
    bar. They are traded in the pass that takes their figures, so neither a bar nor an equity is repeated for a run."""

    rows: DataFrame
    labels: list[str]
    cash: float = START_CASH
    slippage_bps: float = SLIPPAGE_BPS


def simulate(runs: DataFrame | Beside, keys: list[str], order: str = "day", cash: float = START_CASH,
             slippage_bps: float | Column = SLIPPAGE_BPS) -> DataFrame | Beside:
    """Equity, position and costs per bar.

    `runs` needs keys, `order`, open, close, target, buy_rate, sell_rate, per_sale.
    """
    if isinstance(runs, Beside):
        return replace(runs, cash=cash, slippage_bps=slippage_bps)
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    slip = slippage_bps if isinstance(slippage_bps, Column) else F.lit(slippage_bps / 1e4)
    df = _legs(runs.withColumn("slip", slip), w)
    df = df.withColumns({
        "_night": F.when(F.col("_i") == 0, 1.0).otherwise(
            1.0 + F.col("_was") * (F.col("open") / F.col("_prev_close") - 1.0)),
        "_day": F.when(F.col("_i") == 0, 1.0).otherwise(
            1.0 + F.col("held") * (F.col("close") / F.col("open") - 1.0)),
        "_share": (F.col("_sell") * F.col("sell_rate") + F.col("_buy") * F.col("buy_rate")
                   + F.col("_moved") * F.col("slip")),
        "_fixed": F.when(F.col("_sell") > 0, F.col("per_sale")).otherwise(0.0),
    })
    df = df.withColumn("_growth", F.product(
        F.col("_night") * (1.0 - F.col("_share")) * F.col("_day")).over(upto))
    charge = F.when(F.col("_fixed") > 0, -F.col("_fixed") * F.col("_day") / F.col("_growth"))
    df = df.withColumn("equity", F.col("_growth") * (
        F.lit(float(cash)) + F.sum(F.coalesce(charge, F.lit(0.0))).over(upto)))
    df = df.withColumn("_before", F.coalesce(F.lag("equity").over(w), F.lit(float(cash)))
                       * F.col("_night"))
    return df.withColumn("fee", F.col("_before") * F.col("_share") + F.col("_fixed"))


def _later(x: np.ndarray, n: int, first) -> np.ndarray:
    """`x` moved down by n rows, the first rows filled."""
    return np.concatenate([np.full((min(n, len(x)), *x.shape[1:]), first, dtype=float), x[:max(0, len(x) - n)]])


def simulate_key(open_: np.ndarray, close: np.ndarray, targets: np.ndarray, buy_rate: np.ndarray, sell_rate: np.ndarray,
                 per_sale: np.ndarray, cash: float = START_CASH, slippage_bps: float = SLIPPAGE_BPS) -> dict[str, np.ndarray]:
    """`simulate` for many runs over the ordered bars of one key: `targets` has a row per bar, a column per run.

    The runs share their bars, so these are read once for all of them. NaN stands for null.
    """
    held, was = (np.nan_to_num(_later(targets, n, 0.0)) for n in (1, 2))
    bought, sold = np.maximum(0.0, held - was), np.maximum(0.0, was - held)
    selling = np.minimum(sold, np.maximum(was, 0.0)) + np.minimum(bought, np.maximum(-was, 0.0))
    moved = bought + sold
    night = 1.0 + was * (open_ / _later(close, 1, np.nan) - 1.0)[:, None]
    day = 1.0 + held * (close / open_ - 1.0)[:, None]
    night[:1] = day[:1] = 1.0
    share = selling * sell_rate[:, None] + (moved - selling) * buy_rate[:, None] + moved * (slippage_bps / 1e4)
    fixed = np.where(selling > 0, per_sale[:, None], 0.0)
    factor = night * (1.0 - share) * day
    growth = np.cumprod(np.where(np.isnan(factor), 1.0, factor), axis=0)
    charge = np.where(fixed > 0, -fixed * day / growth, 0.0)
    equity = growth * (cash + np.cumsum(np.where(np.isnan(charge), 0.0, charge), axis=0))
    before = _later(equity, 1, cash) * night
    return {"held": held, "equity": equity, "fee": before * share + fixed, "was": was, "moved": moved, "selling": selling,
            "fixed": fixed, "before": before}


def simulate_levels(open_: np.ndarray, close: np.ndarray, levels: np.ndarray, code: np.ndarray, buy_rate: np.ndarray, sell_rate: np.ndarray,
                    per_sale: np.ndarray, cash: float = START_CASH, slippage_bps: float = SLIPPAGE_BPS) -> dict[str, np.ndarray]:
    """Equity, position and fees of `simulate_key` for many runs whose targets, `levels[code]`, are few levels, as in
    and out: what a bar does to a run hangs on what it holds and held before, so it is worked out once per bar and
    pair of levels. `levels` are in order, 0 among them."""
    k = len(levels)
    if k > 4:
        return simulate_key(open_, close, levels[code], buy_rate, sell_rate, per_sale, cash, slippage_bps)
    zero, code = np.searchsorted(levels, 0.0), code.astype(np.int32)
    now, before = (np.concatenate([np.full((min(n, len(code)), code.shape[1]), zero, dtype=np.int32), code[:max(0, len(code) - n)]]) for n in (1, 2))
    was, held = (x.ravel()[None, :] for x in np.meshgrid(levels, levels, indexing="ij"))
    bought, sold = np.maximum(0.0, held - was), np.maximum(0.0, was - held)
    selling = np.minimum(sold, np.maximum(was, 0.0)) + np.minimum(bought, np.maximum(-was, 0.0))
    moved = bought + sold
    night = 1.0 + was * (open_ / _later(close, 1, np.nan) - 1.0)[:, None]
    day = 1.0 + held * (close / open_ - 1.0)[:, None]
    night[:1] = day[:1] = 1.0
    share = selling * sell_rate[:, None] + (moved - selling) * buy_rate[:, None] + moved * (slippage_bps / 1e4)
    fixed = np.where(selling > 0, per_sale[:, None], 0.0)
    factor = night * (1.0 - share) * day
    at = before * np.int32(k) + now + np.arange(len(code), dtype=np.int32)[:, None] * np.int32(k * k)
    growth = np.cumprod(np.where(np.isnan(factor), 1.0, factor).ravel().take(at), axis=0)
    equity = growth * cash
    if (fixed > 0).any():
        charge = np.where(fixed > 0, -fixed * day, 0.0).ravel().take(at) / growth
        equity = growth * (cash + np.cumsum(np.where(np.isnan(charge), 0.0, charge), axis=0))
    return {"held": levels[now], "equity": equity, "fee": _later(equity, 1, cash) * (night * share).ravel().take(at) + fixed.ravel().take(at)}


def risk_figures(equity: np.ndarray, held: np.ndarray) -> dict[str, np.ndarray]:
    """`risk_metrics` of equity curves beside each other, a column per run. NaN stands for null."""
    r, root, none = equity[1:] / equity[:-1] - 1.0, TRADING_DAYS ** 0.5, np.full(equity.shape[1], np.nan)
    if not len(r):
        return {"cagr": none, "max_drawdown": (equity / equity).min(axis=0) - 1.0, "sharpe": none, "sortino": none, "time_in_market": none}
    mean, sd = r.mean(axis=0), r.std(axis=0, ddof=1) if len(r) > 1 else none
    down = np.sqrt((np.minimum(r, 0.0) ** 2).sum(axis=0) / len(equity))      # the first bar counts as no loss
    return {"cagr": np.where(equity[-1] > 0, (equity[-1] / equity[0]) ** (TRADING_DAYS / len(r)) - 1.0, np.nan),
            "max_drawdown": (equity / np.maximum.accumulate(equity, axis=0) - 1.0).min(axis=0),
            "sharpe": np.where(sd > 0, mean / sd * root, np.nan),
            "sortino": np.where(down > 0, mean * TRADING_DAYS / (down * root), np.nan),
            "time_in_market": (np.abs(held[1:]) > 0).mean(axis=0)}


def defined(*names: str) -> dict[str, Column]:
    """What is not a number in a task is null in a table."""
    return {n: F.when(~F.isnan(n), F.col(n)) for n in names}


def capped(runs: DataFrame, keys: list[str], rates: DeliveryRates, order: str = "day",
           cash: float = START_CASH, slippage_bps: float = SLIPPAGE_BPS) -> DataFrame:
    """`simulate` where brokerage is the lesser of a rate and a cap per leg.

    That is not an affine step, so each run is folded in one Arrow batch (at most one row
    per trading day); runs are spread over the cluster.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    df = _legs(runs.withColumn("slip", F.lit(slippage_bps / 1e4)), w)
    added = ["equity", "fee"]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in added])
    taxed = 1 + rates.service_tax

    def charge(amount, buying):
        if amount == 0:
            return 0.0
        broker = amount * rates.brokerage
        if rates.brokerage_cap is not None:
            broker = min(broker, rates.brokerage_cap)
        levies = taxed * (broker + amount * (rates.exchange + rates.regulator))
        side = amount * rates.stamp_on_buys if buying else rates.depository_per_sale
        return levies + amount * rates.transaction_tax + side

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        value, equity, fees = float(cash), [], []
        for r in pdf.itertuples(index=False, name=None):
            b = dict(zip(pdf.columns, r))
            if b["_i"] == 0:
                equity.append(value)
                fees.append(0.0)
                continue
            value *= 1 + b["_was"] * (b["open"] / b["_prev_close"] - 1)
            fee = (charge(value * b["_sell"], False) + charge(value * b["_buy"], True)
                   + value * b["_moved"] * b["slip"])
            value = (value - fee) * (1 + b["held"] * (b["close"] / b["open"] - 1))
            equity.append(value)
            fees.append(fee)
        return pdf.assign(equity=equity, fee=fees)

    return df.groupBy(*keys).applyInPandas(fold, schema)


def _fills(simulated: DataFrame) -> DataFrame:
    """Per bar: whether a trade opens or closes there, at what fill, and the fees of each."""
    side, before = F.signum("held"), F.signum("_was")
    turned = side != before
    opens, closes = turned & (side != 0), turned & (before != 0)
    sale = F.col("_before") * F.col("_sell") * F.col("sell_rate") + F.col("_fixed")
    purchase = F.col("_before") * F.col("_buy") * F.col("buy_rate")
    stake = (F.col("_before") - F.col("fee")) * F.abs("held")
    own = F.when(side > 0, stake * F.col("buy_rate")).otherwise(
        stake * F.col("sell_rate") + F.when(stake != 0, F.col("per_sale")).otherwise(0.0))
    # A flip closes and opens on one bar: the new trade pays its own charges, not the bar's.
    fees_in = F.when(opens & closes, own).when(side > 0, purchase).otherwise(sale)
    return simulated.withColumns({
        "_opens": opens, "_closes": closes, "_stake": stake, "_fees_in": fees_in,
        "_fees_out": F.when(before > 0, sale).otherwise(purchase),
        "_fill_in": F.col("open") * (1 + side * F.col("slip")),
        "_fill_out": F.col("open") * (1 - before * F.col("slip"))})


def _net(sign: Column, entry, exit_price: Column, fees_out: Column) -> Column:
    return (sign * (exit_price / entry["price"] - 1)
            - (entry["fees"] + fees_out) / (entry["stake"] + entry["fees"]))


def trades(simulated: DataFrame, keys: list[str], order: str = "day") -> DataFrame:
    """One row per trade; the last may still be open. Found where a trade ends: the entry is
    the last opening before (or, for a trade still open, at or before) that bar."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = _fills(simulated)
    entry = F.when(F.col("_opens"), F.struct(
        F.col(order).alias("day"), F.col("_i").alias("i"), F.col("_fill_in").alias("price"),
        F.col("_fees_in").alias("fees"), F.col("_stake").alias("stake"),
        F.signum("held").alias("sign")))
    df = df.withColumns({
        "_prior": F.last(entry, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_current": F.last(entry, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_final": F.lead(F.lit(1)).over(w).isNull()})

    def ended(e, price, fees, status):
        return F.struct(
            F.when(e["sign"] > 0, "long").otherwise("short").alias("side"),
            e["day"].alias("entry_day"), e["price"].alias("entry_price"),
            F.col(order).alias("exit_day"), price.alias("exit_price"),
            (F.col("_i") - e["i"]).alias("bars_held"),
            _net(e["sign"], e, price, fees).alias("net_return"), F.lit(status).alias("status"))

    closed = F.when(F.col("_closes"), ended(F.col("_prior"), F.col("_fill_out"),
                                            F.col("_fees_out"), "closed"))
    left = F.when(F.col("_final") & (F.col("held") != 0),
                  ended(F.col("_current"), F.col("close"), F.lit(0.0), "open"))
    found = F.filter(F.array(closed, left), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("_t")).select(*keys, "_t.*")


def _with_returns(simulated: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return simulated.withColumns({
        "_r": F.col("equity") / F.lag("equity").over(w) - 1.0,
        "_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def _compound(last: Column, first: Column, steps: Column) -> Column:
    return F.when((steps > 0) & (last > 0), F.pow(last / first, TRADING_DAYS / steps) - 1.0)


def _equity_aggs(order: str) -> list[Column]:
    return [F.count("_r").alias("_n"), F.min_by("equity", order).alias("_v0"),
            F.max_by("equity", order).alias("final_equity"),
            (F.stddev_samp("_r") * TRADING_DAYS ** 0.5).alias("annualised_volatility"),
            F.min(F.col("equity") / F.col("_peak") - 1.0).alias("max_drawdown"),
            F.avg(F.when(F.col("_i") > 0, (F.abs("held") > 0).cast("double"))).alias("exposure"),
            F.sum("_moved").alias("turnover"), F.sum("fee").alias("costs_paid")]


def _equity_figures(d: DataFrame) -> DataFrame:
    cagr = _compound(F.col("final_equity"), F.col("_v0"), F.col("_n"))
    d = d.withColumns({"total_return": F.col("final_equity") / F.col("_v0") - 1.0, "cagr": cagr})
    return d.withColumn("sharpe_ratio", F.when(
        F.col("annualised_volatility") > 0, F.col("cagr") / F.col("annualised_volatility"))
    ).drop("_n", "_v0")


def run_stats(simulated: DataFrame, keys: list[str], order: str = "day") -> DataFrame:
    """The equity half of a backtest's figures. Sharpe here is CAGR over volatility."""
    return _equity_figures(_with_returns(simulated, keys, order).groupBy(*keys).agg(
        *_equity_aggs(order)))


def _trade_figures(sim: dict[str, np.ndarray], open_: np.ndarray, buy_rate: np.ndarray, sell_rate: np.ndarray, per_sale: np.ndarray,
                   slip: float) -> dict[str, np.ndarray]:
    """The trade figures of `backtest_stats` for runs beside each other (`simulate_key`)."""
    open_, buy_rate, sell_rate, per_sale = (x[:, None] for x in (open_, buy_rate, sell_rate, per_sale))
    side, before = np.sign(sim["held"]), np.sign(sim["was"])
    opens, closes = (side != before) & (side != 0), (side != before) & (before != 0)
    sale = sim["before"] * sim["selling"] * sell_rate + sim["fixed"]
    purchase = sim["before"] * (sim["moved"] - sim["selling"]) * buy_rate
    stake = (sim["before"] - sim["fee"]) * np.abs(sim["held"])
    own = np.where(side > 0, stake * buy_rate, stake * sell_rate + np.where(stake != 0, per_sale, 0.0))
    fees_in = np.where(opens & closes, own, np.where(side > 0, purchase, sale))
    fees_out = np.where(before > 0, sale, purchase)
    # The entry is the last opening before the bar that closes.
    last = np.maximum.accumulate(np.where(opens, np.arange(len(opens))[:, None], -1), axis=0)
    at = np.maximum(np.concatenate([np.full((1, last.shape[1]), -1), last[:-1]]), 0)
    price, fees, put = (np.take_along_axis(x, at, axis=0) for x in (open_ * (1 + side * slip), fees_in, stake))
    net = np.where(closes, before * (open_ * (1 - before * slip) / price - 1) - (fees + fees_out) / (put + fees), np.nan)
    closed = (~np.isnan(net)).sum(axis=0)
    return {"trades": opens.sum(axis=0), "closed_trades": closes.sum(axis=0), "win_rate": (net > 0).sum(axis=0) / closed,
            "average_trade_return": np.nansum(net, axis=0) / closed}


def _stats_beside(runs: Beside, keys: list[str], order: str) -> DataFrame:
    """`backtest_stats` of runs beside each other; `keys` are those of a bar and the name of a run."""
    *by, name = keys
    labels, cash, bps = list(runs.labels), runs.cash, runs.slippage_bps
    figures = ["_v0", "final_equity", "annualised_volatility", "max_drawdown", "exposure", "turnover", "costs_paid",
               "win_rate", "average_trade_return"]
    rows = runs.rows.select(*by, order, "open", "close", "buy_rate", "sell_rate", "per_sale", *labels)
    schema = T.StructType([*[rows.schema[k] for k in by], T.StructField(name, T.StringType()), T.StructField("_n", T.LongType()),
                           *[T.StructField(n, T.DoubleType()) for n in figures],
                           *[T.StructField(n, T.LongType()) for n in ("trades", "closed_trades")]])

    def per_key(bars: pa.Table) -> pa.Table:
        bars = bars.take(pc.sort_indices(bars, sort_keys=[(order, "ascending")], null_placement="at_start"))

        def doubles(column: str) -> np.ndarray:
            return pc.cast(bars[column], pa.float64()).to_numpy()

        open_, close, *rates = (doubles(c) for c in ("open", "close", "buy_rate", "sell_rate", "per_sale"))
        with np.errstate(all="ignore"):
            sim = simulate_key(open_, close, np.column_stack([doubles(k) for k in labels]), *rates, cash=cash, slippage_bps=bps)
            equity, n, k = sim["equity"], len(bars) - 1, len(labels)
            none = np.full(k, np.nan)
            r = equity[1:] / equity[:-1] - 1.0
            known = np.nonzero(pc.is_valid(bars[order]).to_numpy())[0]
            first, last = (equity[known[0]], equity[known[-1]]) if len(known) else (none, none)
            found = {"_n": np.full(k, n), "_v0": first, "final_equity": last,
                     "annualised_volatility": r.std(axis=0, ddof=1) * TRADING_DAYS ** 0.5 if n > 1 else none,
                     "max_drawdown": (equity / np.maximum.accumulate(equity, axis=0) - 1.0).min(axis=0),
                     "exposure": (np.abs(sim["held"][1:]) > 0).mean(axis=0) if n else none,
                     "turnover": sim["moved"].sum(axis=0), "costs_paid": np.nansum(sim["fee"], axis=0),
                     **_trade_figures(sim, open_, *rates, bps / 1e4)}
        whole = [bars[c].combine_chunks().take(pa.array(np.zeros(k, dtype=int))) for c in by]
        return pa.table([*whole, pa.array(labels), *[pa.array(found[f.name], from_pandas=True) for f in schema.fields[len(by) + 1:]]],
                        names=schema.names)

    made = rows.groupBy(*by).applyInArrow(per_key, schema)
    last = ["trades", "closed_trades", "win_rate", "average_trade_return"]
    return _equity_figures(made.select(*keys, "_n", *[n for n in figures if n not in last], *last))


def backtest_stats(simulated: DataFrame | Beside, keys: list[str], order: str = "day") -> DataFrame:
    """Equity and trade figures together, in one pass over the simulated bars."""
    if isinstance(simulated, Beside):
        return _stats_beside(simulated, keys, order)
    w = Window.partitionBy(*keys).orderBy(order)
    df = _fills(_with_returns(simulated, keys, order))
    entry = F.when(F.col("_opens"), F.struct(
        F.col("_fill_in").alias("price"), F.col("_fees_in").alias("fees"), F.col("_stake").alias("stake")))
    df = df.withColumn("_prior", F.last(entry, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_net", F.when(F.col("_closes"), _net(
        F.signum("_was"), F.col("_prior"), F.col("_fill_out"), F.col("_fees_out"))))
    return _equity_figures(df.groupBy(*keys).agg(
        *_equity_aggs(order), F.sum(F.col("_opens").cast("bigint")).alias("trades"),
        F.sum(F.col("_closes").cast("bigint")).alias("closed_trades"),
        F.avg((F.col("_net") > 0).cast("double")).alias("win_rate"),
        F.avg("_net").alias("average_trade_return")))


def risk_metrics(equity: DataFrame, keys: list[str], order: str = "day",
                 held: str | None = "held") -> DataFrame:
    """CAGR, drawdown, daily Sharpe, Sortino, Calmar and time in market of equity curves."""
    d = _with_returns(equity, keys, order).withColumn(
        "_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    inside = (F.lit(1.0) if held is None else
              F.avg(F.when(F.col("_k") > 1, (F.abs(held) > 0).cast("double"))))
    d = d.groupBy(*keys).agg(
        F.count("_r").alias("_n"), F.min_by("equity", order).alias("_v0"),
        F.max_by("equity", order).alias("_v1"), F.avg("_r").alias("_mean"),
        F.stddev_samp("_r").alias("_sd"),
        F.sqrt(F.avg(F.pow(F.least(F.col("_r"), F.lit(0.0)), 2))).alias("_down"),
        F.min(F.col("equity") / F.col("_peak") - 1.0).alias("max_drawdown"),
        inside.alias("time_in_market"))
    root = TRADING_DAYS ** 0.5
    d = d.withColumn("cagr", _compound(F.col("_v1"), F.col("_v0"), F.col("_n")))
    return d.select(
        *keys, "cagr", "max_drawdown",
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root).alias("sharpe"),
        F.when(F.col("_down") > 0, F.col("_mean") * TRADING_DAYS / (F.col("_down") * root)
               ).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "time_in_market")


def exposure_matched(benchmark: DataFrame, exposure: Column, keys: list[str],
                     order: str = "day") -> DataFrame:
    """Buy-and-hold scaled to a fixed exposure, the rest idle; same starting value."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.col("equity") / F.lag("equity").over(w) - 1.0, F.lit(0.0))
    return (benchmark.withColumns({"_step": step, "_e": exposure})
            .withColumn("equity", F.first("equity").over(upto)
                        * F.product(1.0 + F.col("_e") * F.col("_step")).over(upto))
            .drop("_step", "_e"))


def turnover_per_year(positions: DataFrame, keys: list[str], order: str = "day",
                      position: str = "held") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.col(position) != F.lag(position).over(w)
    return (positions.withColumn("_c", changed.cast("int")).groupBy(*keys)
            .agg((F.coalesce(F.sum("_c"), F.lit(0)) / (F.count(F.lit(1)) / TRADING_DAYS))
                 .alias("turnover_per_year")))
