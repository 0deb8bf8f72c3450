"""Figures of the last rows against pandas, over keys that span batches."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest

from brasstide.operators import features, regime, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def walk():
    rng, out = np.random.default_rng(5), []
    for ticker, n in (("A", 700), ("B.NS", 7), ("C", 330), ("D", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        close[100:140] = 90.1
        out.append(pd.DataFrame({"ticker": ticker, "day": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)],
                                 "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1000}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture
def bars(spark, walk):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    yield spark.createDataFrame(walk).repartition(3, "ticker")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_last_rows_of_a_key_reach_over_batches(bars, walk):
    f = features.Features()
    names = [f.sma("close", 50), f.bollinger(20)[1], f.highest("high", 20), f.lowest("low", 10)]
    regime.request(f)
    made = f.apply(bars)
    assert not re.search(r"RowFrame, -\d\d", plan(made)), "a sliding frame takes as many steps a row as it is long"
    got = made.orderBy("ticker", "day").toPandas()
    for ticker, w in walk.groupby("ticker"):
        g, c = got[got.ticker == ticker].reset_index(), w.close.reset_index(drop=True)
        vol = np.log(c / c.shift(1)).rolling(20).std() * 252 ** 0.5
        # An exact zero of a flat window is one here too.
        vol[(c.rolling(21).max() == c.rolling(21).min())] = 0.0
        want = [c.rolling(50).mean(), c.rolling(20).std(ddof=0), (w.high.shift(1).rolling(20).max()).reset_index(drop=True),
                (w.low.shift(1).rolling(10).min()).reset_index(drop=True)]
        for name, x in zip([*names, "volatility", "slope"], [*want, vol, want[0] / want[0].shift(20) - 1]):
            assert np.allclose(g[name].astype(float), x, rtol=1e-9, atol=1e-7, equal_nan=True), (ticker, name)
        own = g["volatility"].astype(float)
        for i in range(len(g)):
            past = own[max(0, i - 252):i].dropna()
            rank = (past <= own[i]).mean() if len(past) >= 126 and not np.isnan(own[i]) else None
            assert (pd.isna(g.volatility_rank[i]) if rank is None else g.volatility_rank[i] == pytest.approx(rank))
        flat = (c.rolling(20).max() == c.rolling(20).min()).to_numpy()
        assert (g["sd_20"].to_numpy(float)[flat] == 0.0).all()


def test_rows_without_a_day_come_last_in_the_walk(spark):
    close = [100.0 + i for i in range(80)]
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), c, c + 1, c - 1, c) for i, c in enumerate(close)]
    df = spark.createDataFrame([*rows, ("A", None, 90.0, 91.0, 89.0, 90.0)], "ticker string, day date, open double, high double, low double, close double")
    got = rules.wide_targets(df, rules.default_rules(["atr_trailing_stop"])).orderBy("day").toPandas()["atr_trailing_stop"]
    assert got[0] == 1.0 and got[1] == 0.0 and got[80] == 1.0
