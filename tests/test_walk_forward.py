import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from brasstide.operators import assessment, backtest, ensembles, regime, signals


def window_rows(spark, n=80):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    first = dt.date(2020, 1, 1)
    rows = [("A", first + dt.timedelta(i), i, float(close[i] * 1.001), float(close[i]), 0.001, 0.002, 15.0, float(i // 7 % 2), n)
            for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, day date, bar int, open double, close double, buy_rate double, "
                                 "sell_rate double, per_sale double, position double, trading_days bigint")


def test_runs_beside_each_other_equal_the_windows_of_one_run(spark):
    rows = window_rows(spark)
    pdf = rows.toPandas()
    sim = backtest.simulate(rows.withColumn("target", F.col("position")), ["ticker"]).orderBy("day").toPandas()
    got = backtest.simulate_key(*(pdf[c].to_numpy() for c in ("open", "close")), np.stack([pdf["position"], np.ones(80)], 1),
                                *(pdf[c].to_numpy() for c in ("buy_rate", "sell_rate", "per_sale")))
    for name in ("equity", "held", "fee"):
        assert np.allclose(got[name][:, 0], sim[name], rtol=1e-12)


def test_retimed_runs_stay_in_their_task(spark):
    """A row per run leaves a task, not a row per run and day."""
    figures = assessment.run_figures(window_rows(spark), 20)
    assert figures.count() == 22
    assert "Generate" not in figures._jdf.queryExecution().executedPlan().toString()
    assert [r.shift for r in figures.where("shift > 0").orderBy("shift").limit(2).collect()] == sorted(assessment.shifts(80, 20))[:2]
    own = figures.where("shift = 0").first()
    rows = window_rows(spark)
    want = backtest.run_stats(backtest.simulate(rows.withColumn("target", F.col("position")), ["ticker"], cash=1e5), ["ticker"]).first()
    assert abs(own.cagr - want.cagr) < 1e-6 and abs(own.max_drawdown - want.max_drawdown) < 1e-9


def test_trailing_figures_take_no_window_of_rows(spark):
    rng = np.random.default_rng(6)
    ret = rng.normal(0, 0.01, 700)
    first = dt.date(2019, 1, 1)
    rows = [(t, k, first + dt.timedelta(i), i, float(ret[i]) if k == "x" else 0.0) for t in ("A", None) for k in ("x", "flat") for i in range(700)]
    out = signals.with_trailing(spark.createDataFrame(rows, "ticker string, rule string, day date, bar int, ret double"))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    last = {(r.ticker, r.rule): r for r in out.where("bar = 699").collect()}
    assert len(last) == 4 and last["A", "flat"].cusum is None and last["A", "flat"].sharpe_long == 0.0
    want = ret[-504:].mean() / ret[-504:].std(ddof=1) * 252 ** 0.5
    assert abs(last["A", "x"].sharpe_long - want) < 1e-9 and last[None, "x"].sharpe_long == last["A", "x"].sharpe_long
    fives = np.array([ret[699 - 5 * b - 4:700 - 5 * b].sum() for b in range(100)])[::-1]
    z, now, worst = (fives[88:] - fives[:88].mean()) / fives[:88].std(ddof=1), 0.0, 0.0
    for x in z:
        now = max(0.0, now - x - 0.5)
        worst = max(worst, now)
    assert abs(last["A", "x"].cusum - worst) < 1e-9


def walk(spark, tickers=("A", "B.NS"), n=320):
    rng = np.random.default_rng(8)
    rows, first = [], dt.date(2019, 1, 1)
    for ticker in tickers:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.015, n)))
        rows += [(ticker, first + dt.timedelta(i), float(c * 1.002), float(c * 1.01), float(c * 0.99), float(c), float(c), 1000 + i, "test")
                 for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "ticker string, day date, open double, high double, low double, close double, "
                                 "adj_close double, volume bigint, provider string")


def test_a_bar_leaves_the_walk_once_with_its_runs_beside_each_other(spark):
    """rows per bar, not per bar and rule; each run is what `simulate` gives for its rule alone."""
    bars = walk(spark)
    wide = signals.rule_targets(bars).withColumn("regime", regime.classify("slope")).localCheckpoint()
    runs = signals.rule_runs(wide).localCheckpoint()
    assert runs.count() == 640
    long = signals.run_rows(runs)
    assert long.where("ticker = 'B.NS' AND rule = 'sma_cross_long_short'").count() == 0
    sim = backtest.simulate(wide.select("ticker", "day", "open", "close", "buy_rate", "sell_rate", "per_sale",
                                        F.col("rsi_reversion").alias("target")), ["ticker"], cash=1e5)
    both = sim.select("ticker", "day", F.round("equity", 4).alias("want")).join(long.where("rule = 'rsi_reversion'"), ["ticker", "day"])
    assert both.count() == 640 and both.where("abs(equity - want) > 1e-3").count() == 0

    votes = signals.vote_runs(runs)
    plan = signals.signals(votes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    day = signals.vote_rows(votes).where("ticker = 'A' AND bar = 300").toPandas()
    weight = (day.weight * day.multiplier).fillna(0.0)
    want = (weight * day.vote).sum() / weight.sum() if weight.sum() > 0 else 0.0
    got = signals.signals(votes).where("ticker = 'A' AND bar = 300").first()
    assert abs(got.score - want) < 1e-9 and got.eligible == day.train_sharpe.notna().sum() and got.left_out == day.skipped.notna().sum()


def test_schedules_of_refits_stay_in_their_task(spark):
    """one row per ticker and schedule is shuffled; a schedule's positions are those of its own signals."""
    wide = signals.rule_targets(walk(spark, ("A",))).withColumn("regime", regime.classify("slope"))
    runs = signals.rule_runs(wide).localCheckpoint()
    spread = assessment.refit_spread(runs, [0, 3])
    assert "Generate" not in spread._jdf.queryExecution().executedPlan().toString()
    sharpes = []
    for k in (0, 3):
        rows = assessment.window(signals.signals(signals.vote_runs(runs, k)))
        sharpes.append(round(assessment.risk(assessment.curves(rows)).where("run = 'signal'").first().sharpe, 4))
    got = spread.first()
    assert (got.runs, got.sharpe_min, got.sharpe_max) == (2, min(sharpes), max(sharpes))


def test_full_metrics_are_those_of_each_run_alone(spark):
    """a ticker's runs share one pass, net and gross, without a window."""
    rows = window_rows(spark)
    days = rows.withColumn("runs", F.array(*[F.struct(F.lit(n).alias("rule"), e.alias("target")) for n, e in (
        ("own", F.col("position")), ("held", F.lit(1.0)))]))
    out = ensembles.full_metrics(days, "rule")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    sim = backtest.simulate(rows.withColumn("target", F.col("position")), ["ticker"], cash=1e5).withColumn("equity", F.round("equity", 4))
    want = backtest.risk_metrics(sim, ["ticker"]).join(backtest.turnover_per_year(sim, ["ticker"]), "ticker").first()
    got = out.where("rule = 'own'").first()
    assert out.count() == 2
    for a, b in (("cagr", "cagr"), ("max_drawdown", "max_drawdown"), ("sharpe", "sharpe"), ("sortino", "sortino"), ("exposure", "time_in_market")):
        assert got[a] == round(want[b], 4)
    assert got.turnover_per_year == round(want.turnover_per_year, 2) and got.cost_drag > 0


def test_wide_returns_shuffle_nothing(spark):
    """the returns of a day's rules are read from its own row."""
    runs = spark.createDataFrame([("A", dt.date(2020, 1, 1), 0, [("x", 0.5), ("y", -0.25)])],
                                 "ticker string, day date, bar int, runs array<struct<rule string, ret double>>")
    wide = ensembles.wide_returns(runs, ["x", "y", "z"])
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    assert tuple(wide.first())[3:] == (0.5, -0.25, None)


def test_votes_take_fits_of_refit_days_only_to_their_ticker(spark):
    """Trailing figures of the other days are not shuffled: below the exchange they are gone."""
    runs = signals.rule_runs(signals.rule_targets(walk(spark, ("A",))).withColumn("regime", regime.classify("slope")))
    path = runs.limit(5).localCheckpoint()
    plan = signals.vote_runs(path)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert "sharpe_long" in window and "arrays_zip" in window
    got = signals.vote_runs(path).schema["votes"].dataType.elementType.names
    assert got[:2] == ["rule", "target"] and "train_sharpe" in got and "equity" not in got


def test_votes_of_the_trading_pass_are_those_of_the_stored_runs(spark):
    """With a refit day the pass that trades the rules votes too; neither runs nor fits are shuffled again."""
    bars = walk(spark).unionByName(walk(spark, ("S",), 40)).unionByName(walk(spark, ("L",), 800))
    wide = signals.rule_targets(bars).withColumn("regime", regime.classify("slope")).localCheckpoint()
    for day in (0, 3):
        want, got = signals.vote_runs(signals.rule_runs(wide), day), signals.vote_runs(signals.rule_runs(wide, refit_day=day), day)
        assert got.schema["votes"].dataType.simpleString() == want.schema["votes"].dataType.simpleString() and got.columns == want.columns
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 1020 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_drift_of_runs_beside_each_other_is_that_of_each_alone():
    """The statistic of all rules is one pass, a column per run."""
    total = np.cumsum(np.random.default_rng(9).normal(0, 0.01, (700, 3)), axis=0)
    total[:, 2] = 0.0
    got = signals._cusum(total, np.arange(700))
    assert got.shape == (700, 3) and np.isnan(got[:, 2]).all() and (got[650:, :2] > 0).all()
    for k in range(3):
        assert np.allclose(got[:, k], signals._cusum(total[:, k], np.arange(700)), rtol=1e-9, equal_nan=True)
