"""Chart indicators and regime measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import features, regime
from brasstide.plans.market_sql import C, REGIME, REGIME_AGREE
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import r
from brasstide.sources.derived import bars


def _digits(name: str) -> int:
    """Averages of 200 prices of 4 decimals end in a 5 at the 7th: rounding there has no ties."""
    return 7 if name == "sma200" else 6


def _series(names, cols, start=None):
    def run(spark, sf):
        out = features.indicators(bars(spark, sf), names, start)
        return rounded(out.select("ticker", "day", *cols), {c: _digits(c) for c in cols})
    return run


def _sql(exprs: dict, where: str = "") -> str:
    cols = ", ".join(r(e, _digits(n), n) for n, e in exprs.items())
    return C.compose(f"SELECT ticker, day, {cols} FROM traded_all {where}")


_SETS = {
    "sma": (["sma20", "sma50", "sma200"], {"sma20": "sma20", "sma50": "sma50", "sma200": "sma200"}),
    "ema": (["ema12", "ema26"], {"ema12": "ema12", "ema26": "ema26"}),
    "rsi": (["rsi14", "rsi2"], {"rsi14": "rsi14", "rsi2": "rsi2"}),
    "macd": (["macd"], {"macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal"}),
    "bollinger": (["bollinger"], {"bb_middle": "sma20", "bb_upper": "sma20 + 2 * sd20",
                                  "bb_lower": "sma20 - 2 * sd20"}),
    "atr": (["atr14"], {"atr14": "tr14"}),
    "adx": (["adx"], {"adx": "adx", "plus_di": "pdi", "minus_di": "mdi"}),
    "keltner": (["keltner"], {"kc_middle": "ema20", "kc_upper": "ema20 + 2 * tr20",
                              "kc_lower": "ema20 - 2 * tr20"}),
    "volume_sma_obv": (["volume", "obv"], {"volume_sma20": "vsma20", "obv": "obv"}),
}
QUERIES = {k: _series(names, list(cols)) for k, (names, cols) in _SETS.items()}
SQL = {k: _sql(cols) for k, (_, cols) in _SETS.items()}

# True range and the Wilder-smoothed inputs on their own.
def _true_range(spark, sf):
    f = features.Features()
    name = f.true_range()
    gain = f.rsi(14) and "wilder_gain_14"
    out = f.apply(bars(spark, sf)).select("ticker", "day", F.col(name).alias("true_range"),
                                          F.col(gain).alias("wilder_gain"))
    return rounded(out, {"true_range": 6, "wilder_gain": 6})


QUERIES["true_range_wilder"] = _true_range
SQL["true_range_wilder"] = C.compose(
    f"SELECT ticker, day, {r('tr', 6, 'true_range')}, {r('g14', 6, 'wilder_gain')} FROM traded_all")

# The chart request: several named indicators, computed over the warm-up, shown from a day.
_CHART = ["sma50", "ema12", "bollinger", "rsi14", "macd", "atr14", "obv"]
_CHART_COLS = {"sma50": "sma50", "ema12": "ema12", "bb_upper": "sma20 + 2 * sd20", "rsi14": "rsi14",
               "macd_hist": "macd - macd_signal", "atr14": "tr14", "obv": "obv"}
QUERIES["chart_indicators"] = _series(features.parse_names(_CHART), list(_CHART_COLS), "1996-06-01")
SQL["chart_indicators"] = _sql(_CHART_COLS, "WHERE day >= DATE '1996-06-01'")


def _latest(spark, sf):
    series = features.indicators(bars(spark, sf), ["sma200", "rsi14", "macd"])
    out = features.latest_values(series, ["sma200", "rsi14", "macd_signal"])
    return rounded(out, {c: _digits(c) for c in ("last_close", "sma200", "rsi14", "macd_signal")})


QUERIES["latest_indicator_values"] = _latest
SQL["latest_indicator_values"] = C.compose(f"""
  SELECT ticker, max(day) AS as_of, {r('max_by(c, day)', 6, 'last_close')},
    {r('max_by(sma200, day) FILTER (sma200 IS NOT NULL)', 7, 'sma200')},
    {r('max_by(rsi14, day) FILTER (rsi14 IS NOT NULL)', 6, 'rsi14')},
    {r('max_by(macd_signal, day) FILTER (macd_signal IS NOT NULL)', 6, 'macd_signal')}
  FROM traded_all GROUP BY ticker""")


def _regime(spark, sf):
    m = regime.measure(bars(spark, sf))
    out = m.withColumns({"regime": regime.classify("slope"), "regime_agree": regime.classify("agree")})
    out = out.select("ticker", "day", *regime.MEASURES, "regime", "regime_agree")
    return rounded(out, {c: 5 for c in regime.MEASURES})


QUERIES["regime"] = _regime
SQL["regime"] = C.compose(f"""
  SELECT ticker, day, {r('adx', 5, 'adx')}, {r('pdi', 5, 'plus_di')}, {r('mdi', 5, 'minus_di')},
    {r('slope', 5, 'slope')}, {r('rv', 5, 'volatility')}, {r('rank252', 5, 'volatility_rank')},
    {REGIME} AS regime, {REGIME_AGREE} AS regime_agree FROM traded_all""")


def _rolling(spark, sf):
    f = features.Features()
    hi, lo = f.highest("high", 20), f.lowest("low", 10)
    out = f.apply(bars(spark, sf)).select("ticker", "day", F.col(hi).alias("highest_20"),
                                          F.col(lo).alias("lowest_10"))
    return rounded(out, {"highest_20": 6, "lowest_10": 6})


QUERIES["rolling_extremes"] = _rolling
SQL["rolling_extremes"] = C.compose(
    f"SELECT ticker, day, {r('hi20', 6, 'highest_20')}, {r('lo10', 6, 'lowest_10')} FROM traded_w1")
