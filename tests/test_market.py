"""Indicators, rules and backtests against plain loops over a seeded price walk."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brasstide.functions import markets
from brasstide.operators import backtest, features, rules


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(11)
    out = []
    for ticker in ("AAA", "BBB.NS"):
        step = rng.normal(0.0004, 0.018, 400)
        step[150:160] = 0.0
        step[300:315] = 0.01
        close = 100 * np.exp(np.cumsum(step))
        open_ = close * (1 + rng.normal(0, 0.004, 400))
        out.append(pd.DataFrame({
            "ticker": ticker, "day": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)],
            "open": open_, "high": np.maximum(open_, close) * 1.004, "low": np.minimum(open_, close) * 0.996,
            "close": close, "adj_close": close * 0.97, "volume": rng.integers(1, 9, 400) * 1_000_000,
            "provider": "test"}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, walk):
    return spark.createDataFrame(walk).repartition("ticker").cache()


def ewm(x, alpha, n):
    y = x.ewm(alpha=alpha, adjust=False).mean()
    y[x.notna().cumsum() < n] = np.nan
    return y


def same(got, want):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got[~np.isnan(got)], want[~np.isnan(want)], rtol=1e-9, atol=1e-9)


def test_indicators_match_pandas(bars, walk):
    got = features.indicators(bars, ["sma20", "ema26", "rsi14", "macd", "bollinger", "atr14", "obv", "adx"]
                              ).toPandas().sort_values(["ticker", "day"])
    for ticker, w in walk.groupby("ticker"):
        g, c = got[got.ticker == ticker], w.close.reset_index(drop=True)
        same(g.sma20, c.rolling(20).mean())
        same(g.ema26, ewm(c, 2 / 27, 26))
        move = c.diff()
        up, down = ewm(move.clip(lower=0), 1 / 14, 14), ewm((-move).clip(lower=0), 1 / 14, 14)
        same(g.rsi14, 100 - 100 / (1 + up / down))
        line = ewm(c, 2 / 13, 12) - ewm(c, 2 / 27, 26)
        same(g.macd, line)
        same(g.macd_signal, ewm(line, 0.2, 9))
        same(g.bb_upper, c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0))
        h, lo = w.high.reset_index(drop=True), w.low.reset_index(drop=True)
        tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
        same(g.atr14, ewm(tr, 1 / 14, 14))
        same(g.obv, (np.sign(move.fillna(0)) * w.volume.reset_index(drop=True)).cumsum())
        u, d = h.diff().fillna(0), -lo.diff().fillna(0)
        pdi = 100 * ewm(u.where((u > d) & (u > 0), 0.0), 1 / 14, 14) / ewm(tr, 1 / 14, 14)
        mdi = 100 * ewm(d.where((d > u) & (d > 0), 0.0), 1 / 14, 14) / ewm(tr, 1 / 14, 14)
        dx = (100 * (pdi - mdi).abs() / (pdi + mdi)).where(pdi.notna())
        same(g.adx, ewm(dx, 1 / 14, 14))


@pytest.fixture(scope="module")
def positions(bars):
    return rules.wide_targets(rules.adjusted_prices(bars), rules.default_rules()).cache()


def test_hold_state_toggles_like_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"k": np.repeat([1, 2], 300), "i": np.tile(np.arange(300), 2),
                         "e": rng.random(600) < 0.2, "x": rng.random(600) < 0.2})
    from brasstide.functions import series
    w = series.rows(["k"], "i")
    a, b = series.held_state("e", "x", "s", w)
    got = spark.createDataFrame(rows).withColumns(a).withColumns(b).toPandas().sort_values(["k", "i"])
    for _, g in got.groupby("k"):
        holding, want = False, []
        for e, x in zip(g.e, g.x):
            holding = (not holding and e) or (holding and not x)
            want.append(float(holding))
        assert list(g.s) == want


def test_no_rule_reads_the_future(bars, positions):
    whole = positions.toPandas().set_index(["ticker", "day"]).sort_index()
    for cut in (150, 260, 330):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=cut)
        part = rules.wide_targets(rules.adjusted_prices(bars.filter(F.col("day") < F.lit(day))), rules.default_rules())
        part = part.toPandas().set_index(["ticker", "day"]).sort_index()
        for key in rules.CATALOGUE:
            assert (part[key] == whole.loc[part.index, key]).all(), (key, cut)


def loop(p, target, cash, buy, sell, per_sale, slip):
    """Next-open execution, one bar at a time."""
    equity, held = [cash], 0.0
    for t in range(1, len(p)):
        o, c, before = p.open[t], p.close[t], p.close[t - 1]
        v = equity[-1] * (1 + held * (o / before - 1))
        want = target[t - 1]
        added, cut = max(0.0, want - held), max(0.0, held - want)
        sold = v * (min(cut, max(held, 0)) + min(added, max(-held, 0)))
        bought = v * (added + cut) - sold
        v -= bought * buy + sold * sell + (per_sale if sold else 0) + v * (added + cut) * slip
        held = want
        equity.append(v * (1 + held * (c / o - 1)))
    return equity


@pytest.mark.parametrize("key", ["sma_cross_long_short", "rsi2_pullback", "atr_trailing_stop", "bollinger_breakout"])
def test_equity_matches_a_loop(positions, key):
    wide = markets.with_market_costs(markets.with_market(positions.withColumn("target", F.col(key))))
    wide = wide.withColumn("target", F.when(F.col("allows_short"), F.col("target")).otherwise(F.greatest("target", F.lit(0.0))))
    got = backtest.simulate(wide, ["ticker"]).toPandas().sort_values(["ticker", "day"])
    for ticker, g in got.groupby("ticker"):
        g = g.reset_index(drop=True)
        costs = markets.delivery_costs() if ticker.endswith(".NS") else markets.flat_costs()
        want = loop(g, list(g.target), 10_000.0, costs.buy_rate, costs.sell_rate, costs.per_sale, 0.0005)
        assert np.allclose(g.equity, want, rtol=1e-10)


def test_capped_brokerage_without_a_cap_is_the_affine_form(positions):
    rates = markets.DeliveryRates(brokerage=0.001, brokerage_cap=None)
    runs = markets.with_costs(positions.select("ticker", "day", "open", "close", F.col("rsi_reversion").alias("target")),
                              markets.delivery_costs(rates))
    a = backtest.simulate(runs, ["ticker"]).select("ticker", "day", "equity").toPandas().sort_values(["ticker", "day"])
    b = backtest.capped(runs, ["ticker"], rates).select("ticker", "day", "equity").toPandas().sort_values(["ticker", "day"])
    assert np.allclose(a.equity, b.equity, rtol=1e-10)


def test_trailing_stop_by_hand():
    close = np.array([9.0, 11, 12, 11.5, 8, 11, 12])
    trend = np.array([np.nan, 10, 10, 10, 10, 10, 10])
    assert list(rules.trailing_stop(close, trend, np.ones(7), 3.0)) == [0, 1, 1, 1, 0, 1, 1]


def test_delivery_charges_on_one_lakh():
    c = markets.delivery_costs()
    assert c.buy_rate * 100_000 == pytest.approx(100 + 3.07 + 0.1 + 15 + 0.18 * 3.17)
    assert c.sell_rate * 100_000 + c.per_sale == pytest.approx(100 + 3.07 + 0.1 + 0.18 * 3.17 + 15.34)


def test_put_call_parity(spark):
    from brasstide.functions.pricing import option_figures
    rows = [(s, k, t, 0.065, v, kind) for s in (80.0, 100.0, 130.0) for k in (90.0, 100.0) for t in (0.1, 1.0)
            for v in (0.1, 0.4) for kind in ("call", "put")]
    got = option_figures(spark.createDataFrame(rows, "spot double, strike double, years double, rate double, sigma double, kind string")).toPandas()
    p = got.pivot_table(index=["spot", "strike", "years", "sigma"], columns="kind", values="value").reset_index()
    assert np.allclose(p.call - p.put, p.spot - p.strike * np.exp(-0.065 * p.years), atol=1e-9)
    textbook = option_figures(spark.createDataFrame([(42.0, 40.0, 0.5, 0.1, 0.2, "call")],
                              "spot double, strike double, years double, rate double, sigma double, kind string")).first()
    assert textbook["value"] == pytest.approx(4.7594, abs=1e-4)


def test_clusters_and_drift_are_bounded(spark):
    from brasstide.operators import ensembles
    d = dt.date(2020, 1, 1)
    fits = spark.createDataFrame([("T", d, k, s, None) for k, s in (("a", 2.0), ("b", 1.5), ("c", 1.0), ("e", 0.5))],
                                 "ticker string, fitted_on date, rule string, train_sharpe double, skipped string")
    pairs = spark.createDataFrame([("T", d, "a", "b", 0.9), ("T", d, "a", "c", 0.1), ("T", d, "b", "c", 0.95),
                                   ("T", d, "c", "e", 0.85), ("T", d, "a", "e", None)],
                                  "ticker string, fitted_on date, rule_a string, rule_b string, corr double")
    got = {r["rule"]: r["leader"] for r in ensembles.clusters(fits, pairs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "e": "c"}
