"""Passes over a ticker's bars that go on to what a query wants, against the steps taken one by one."""

import datetime as dt
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brasstide.functions import sliding
from brasstide.operators import assessment, backtest, ensembles, features, regime, rules, signals
from brasstide.plans import catalog
from brasstide.sources import derived

FIRST = dt.date(2019, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(got, want):
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.fixture(scope="module")
def wide(spark):
    """Targets of tickers with limited and with full history, too few bars for a signal, and no shorts."""
    rng = np.random.default_rng(12)
    rows = []
    for ticker, n in (("A", 320), ("B.NS", 320), ("L", 820), ("S", 40)):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.015, n)))
        rows += [(ticker, FIRST + dt.timedelta(i), float(c * 1.002), float(c * 1.01), float(c * 0.99), float(c), float(c), 1000 + i, "test")
                 for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "ticker string, day date, open double, high double, low double, close double, "
                                 "adj_close double, volume bigint, provider string")
    return signals.rule_targets(bars).withColumn("regime", regime.classify("slope")).localCheckpoint()


@pytest.fixture(scope="module")
def runs(wide):
    return signals.rule_runs(wide).localCheckpoint()


@pytest.fixture(scope="module")
def votes(runs):
    return signals.vote_runs(runs).localCheckpoint()


@pytest.fixture(scope="module")
def days(wide):
    made = {**signals.TARGETS, **ensembles.POSITIONS, **signals.LATEST, **assessment.WINDOW}
    return signals.signals(signals.vote_runs(signals.rule_runs(wide, refit_day=0, signal=made))).localCheckpoint()


def test_smoothing_goes_on_from_batch_to_batch():
    """a scan is one pass; nulls come first in a key, whose rows may span batches."""
    rng = np.random.default_rng(1)
    sizes = [1, 5, 300, 40, 2]
    number = np.concatenate([np.arange(n) for n in sizes]).astype(float)
    x = rng.normal(size=len(number))
    x[(number < 3) & (np.repeat(np.arange(5), sizes) == 2)] = np.nan
    for alpha, n in ((2 / 13, 12), (1 / 22, 3), (0.5, 2), (1.0, 1)):
        scan, out = sliding._Smoothing(sliding.Scan(alpha, n, ("x",))), []
        for at in range(0, len(x), 37):
            v = x[at:at + 37]
            level, known = scan(number[at:at + 37], (np.nan_to_num(v), ~np.isnan(v)))
            out.append(np.where(known, level, np.nan))
        key = pd.Series(np.repeat(np.arange(5), sizes))
        want = pd.Series(x).groupby(key).transform(lambda s: s.ewm(alpha=alpha, adjust=False).mean().where(s.notna().cumsum() >= n))
        assert np.allclose(np.concatenate(out), want, rtol=1e-12, equal_nan=True)


def test_smoothing_forgets_no_row_that_counts():
    """in a series that falls by many orders of magnitude old rows decide the level."""
    x = np.concatenate([np.full(50, 1e30), np.full(2000, 1e-30)])
    level = sliding._Smoothing(sliding.Scan(2 / 13, 12, ("x",)))(np.arange(len(x)).astype(float), (x, np.ones(len(x), dtype=bool)))[0]
    assert np.allclose(level, pd.Series(x).ewm(alpha=2 / 13, adjust=False).mean(), rtol=1e-9)


def test_smoothing_takes_no_window_of_blocks(spark, wide):
    """an indicator that reads smoothed ones is made in the same pass."""
    f = features.Features()
    f.adx(14), f.macd(12, 26, 9), f.rsi(14)
    text = plan(f.apply(wide.select("ticker", "day", "open", "high", "low", "close", F.lit(1.0).alias("volume"))))
    assert "collect_list" not in text and text.count("ArrowEvalPython") == 1 and text.count("Exchange hashpartitioning") == 1


def test_month_days_take_no_sort_of_their_own(wide):
    want = wide.select("ticker", "day", "bar").toPandas()
    month = pd.to_datetime(want.day).dt.to_period("M")
    want["n"] = want.sort_values("bar").groupby(["ticker", month]).cumcount()
    got = wide.select("ticker", "day", "bar", F.col("month_day").alias("n")).toPandas()
    pd.testing.assert_frame_equal(*(x.sort_values(["ticker", "bar"]).reset_index(drop=True) for x in (got, want)), check_dtype=False)


def returns(spark, n=90):
    rng = np.random.default_rng(3)
    rows = []
    for ticker in ("A", "B", None):
        x = rng.normal(0, 0.01, (n, 3))
        x[:, 2] = 0.9 * x[:, 0] + 0.1 * x[:, 1]
        rows += [(ticker, i, *map(float, x[i]), None if ticker == "B" or i % 7 == 0 else float(x[i, 1]), 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, bar int, a double, b double, c double, d double, flat double")


def test_correlations_shuffle_moments_not_rows(spark):
    """a batch leaves a row per key; nulls count for the pairs they are in only."""
    names = ["a", "b", "c", "d", "flat"]
    wide = returns(spark).repartition(5).localCheckpoint()
    found = ensembles.correlations(wide, ["ticker"], names)
    text = plan(found)
    assert "covar" not in text and text.index("MapInArrow") > text.index("Exchange hashpartitioning") > text.index("FlatMapGroupsInArrow")
    got = {(r.ticker, r.rule_a, r.rule_b): r["corr"] for r in found.collect()}
    assert len(got) == 3 * 10
    for ticker, g in wide.toPandas().groupby("ticker", dropna=False):
        want = g[names].astype(float).corr(min_periods=2)
        for a, b in combinations(names, 2):
            value = got[None if pd.isna(ticker) else ticker, a, b]
            if "flat" in (a, b) or ticker == "B" and "d" in (a, b):
                assert value is None
            else:
                both = g[[a, b]].dropna()
                sd = g[a].std() * g[b].std()
                assert abs(value - both[a].cov(both[b]) / sd) < 1e-10
                assert "d" in (a, b) or abs(value - want.loc[a, b]) < 1e-10


def test_refits_slice_their_windows(spark):
    """a bar is not repeated for the windows it is in, and a window's figures are those of its rows."""
    wide = returns(spark)
    refits = spark.createDataFrame([(t, FIRST + dt.timedelta(i), i, 20, k) for t in ("A", "B", None, "absent") for i in (10, 40, 89) for k in "xy"],
                                   "ticker string, fitted_on date, fit_bar int, train_days int, rule string")
    found = ensembles.refit_correlations(wide, refits, ["a", "b", "c"])
    assert "Join" not in plan(found) and "FlatMapCoGroupsInArrow" in plan(found)
    got = {(r.ticker, r.fitted_on, r.rule_a, r.rule_b): r["corr"] for r in found.collect()}
    assert len(got) == 2 * 3 * 3
    g = wide.where("ticker = 'A'").toPandas().set_index("bar")
    for i in (10, 40, 89):
        want = g.loc[max(0, i - 19):i, ["a", "b", "c"]].corr()
        assert abs(got["A", FIRST + dt.timedelta(i), "a", "c"] - want.loc["a", "c"]) < 1e-10


def test_clustered_votes_meet_their_leaders_once_a_day(spark, runs, votes):
    """no row per vote is joined; positions are those of the votes one by one."""
    fits = signals.fits(runs)
    leaders = ensembles.clusters(fits, ensembles.refit_correlations(ensembles.wide_returns(runs), fits)).localCheckpoint()
    assert leaders.where("leader <> rule").count() > 0
    got = ensembles.variant_positions(votes, leader_rows=leaders)
    assert "Generate" not in plan(got)
    same(got, ensembles.variant_positions(signals.vote_rows(votes), leader_rows=leaders))
    same(ensembles.variant_positions(votes, exclude=("macd_cross",)), ensembles.variant_positions(signals.vote_rows(votes), exclude=("macd_cross",)))


def test_signals_of_the_trading_pass_are_those_of_its_votes(days, votes, wide):
    """The pass goes on to the signals; no vote leaves it and nothing is shuffled for them."""
    assert "Window" not in plan(signals.signals(signals.vote_runs(signals.rule_runs(wide, refit_day=0, signal={}))))
    digits = {"score": 10, "_den": 10}
    got, want = (x.withColumns({n: F.round(n, d) for n, d in digits.items()}) for x in (
        days.drop("targets", "ensembles", "votes", *assessment.WINDOW), signals.signals(votes)))
    assert got.schema.simpleString() == want.schema.simpleString()
    same(got, want)


def test_ensembles_of_the_trading_pass_are_those_of_its_votes(days, votes):
    """F4, F5, F18"""
    same(ensembles.ensemble_positions(days), ensembles.ensemble_positions(votes))


def test_the_window_is_known_to_the_trading_pass(days, votes):
    """The evaluated rows are read from the signals; they are not shuffled or stored again."""
    got = assessment.window(days)
    assert "Window" not in plan(got)
    columns = ["ticker", "day", "trading_days", "ahead"]
    same(got.select(columns), assessment.window(signals.signals(votes)).select(columns))
    short = assessment.window(days.drop(*assessment.WINDOW).where("bar >= 0"), years=5)
    assert got.count() == short.count()


def test_shares_read_the_last_day_only(days, votes):
    """of the votes only the last day's are stored."""
    kept = days.where("votes IS NOT NULL")
    assert kept.count() == 3
    same(signals.latest_votes(signals.vote_rows(kept.select("ticker", "day", "bar", "votes"))), signals.latest_votes(signals.vote_rows(votes)))


def test_fits_read_refit_rows_only(wide, runs):
    """F8: the runs of other days don't leave the task, nor is their drift made."""
    due = signals.rule_runs(wide, fields=("sharpe_long", "sharpe_short", "cusum"), due=0)
    assert due.schema["runs"].dataType.elementType.names == ["rule", "sharpe_long", "sharpe_short", "cusum"]
    assert 0 < due.count() == runs.where(signals._due(0)).count() < runs.count() / 10
    same(signals.fits(due), signals.fits(runs))


def test_schedules_end_in_the_trading_pass(wide, runs):
    """a row per schedule leaves it; no bar is shuffled again."""
    made = signals.rule_runs(wide, fields=("target", "sharpe_long", "sharpe_short"), ended=assessment.schedule_figures([0, 3]))
    assert made.columns == ["ticker", "schedule", "sharpe", "cagr", "_hs", "_hc"] and made.count() == 6
    same(assessment.refit_spread(made, [0, 3]), assessment.refit_spread(runs, [0, 3]))


def test_metrics_join_nothing(spark, sf):
    """the window's days hold what rules and ensembles held. F6, F8, F24: runs are not stored."""
    queries = catalog.queries()
    assert "Join" not in plan(queries["best_rule_in_hindsight"](spark, sf))
    queries["rule_correlation"](spark, sf).count()
    queries["strategy_drift"](spark, sf).count()
    queries["refit_day_spread"](spark, sf).count()
    queries["signal_vote_shares"](spark, sf).count()
    names = {name for app, folder, name in derived._WRITTEN if folder == sf}
    assert not names & {"voting_runs", "votes", "assessed", "ensemble_positions"}


def test_all_rules_are_traded_in_the_pass_that_takes_their_figures(wide):
    """a bar is not repeated for its rules; figures are those of each run alone. A bar without a day comes first."""
    labels = ["sma_cross_long_short", "rsi_reversion", "obv_trend"]
    days = wide.withColumn("day", F.when(F.col("bar") > 0, F.col("day")))
    run = ["ticker", "rule"]
    got = backtest.backtest_stats(backtest.simulate(backtest.Beside(days, labels), run), run)
    assert "Generate" not in plan(got) and "Window" not in plan(got)
    long = rules.long_targets(days, labels, ["ticker", "day", "open", "close", "buy_rate", "sell_rate", "per_sale"])
    want = backtest.backtest_stats(backtest.simulate(long, run), run)
    assert got.schema.simpleString() == want.schema.simpleString() and got.where("closed_trades > 0").count() > 3
    a, b = (x.toPandas().sort_values(run).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_tickers_share_the_curve_of_their_index(spark):
    """one curve for each index and first day, not one for each ticker."""
    bars = spark.createDataFrame([("SPY", FIRST + dt.timedelta(i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 100.5 + i) for i in range(30)],
                                 "ticker string, day date, open double, high double, low double, close double, adj_close double")
    rows = spark.createDataFrame([(f"T{k}", FIRST + dt.timedelta(i)) for k in range(20) for i in range(5 + k % 2, 30)], "ticker string, day date")
    starts = assessment.index_starts(rows)
    curve = assessment.index_curve(starts, bars)
    assert starts.count() == 20 and curve.count() == 25 + 24
    first = curve.groupBy("day0").agg(F.min("day").alias("day"), F.min_by("equity", "day").alias("equity")).collect()
    assert all(r.day0 == r.day and r.equity == 100_000.0 for r in first)


@pytest.mark.parametrize("values", [(0.0, 1.0), (0.0, 1.0, -1.0), (0.0, 0.25, 0.5, 0.75, 1.0)])
def test_few_levels_are_traded_like_any(values):
    """what a bar does to a run is worked out once for each pair of levels."""
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))
    prices, rates = (close * 1.001, close), (np.full(60, 0.001), np.full(60, 0.002), np.full(60, 15.0))
    levels = np.sort(values)
    code = rng.integers(0, len(levels), (60, 7))
    got = backtest.simulate_levels(*prices, levels, code, *rates, cash=1e5)
    want = backtest.simulate_key(*prices, levels[code], *rates, cash=1e5)
    for name, x in got.items():
        assert np.allclose(x, want[name], rtol=1e-12, atol=1e-9)


def test_recall_searches_once_for_all_depths(spark, sf):
    """both searches are stored; a depth's limit does not go down into a search of its own."""
    found = catalog.queries()["approximate_recall"](spark, sf)
    assert {"exact_neighbours", "found_neighbours"} <= {name for app, folder, name in derived._WRITTEN if folder == sf}
    assert plan(found).count("MapInPandas") <= 1
