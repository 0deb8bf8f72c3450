"""Checker SQL for the market chain, written independently of the Spark plans:
smoothing is a weighted sum over all earlier rows, not a scan."""

from __future__ import annotations

from brasstide.plans.sqltext import Ctes
from brasstide.sources.derived import BARS

C = Ctes()
C.raw("bars", BARS)

EXCHANGE = ("CASE WHEN ticker = '^NSEI' OR ticker LIKE '%.NS' THEN 'NSE' "
            "WHEN ticker = '^BSESN' OR ticker LIKE '%.BO' THEN 'BSE' ELSE 'US' END")


def _base(name: str, cols: str) -> None:
    C.add(f"{name}_px", f"""
      SELECT ticker, day, row_number() OVER (PARTITION BY ticker ORDER BY day) - 1 AS i,
             count(*) OVER (PARTITION BY ticker) AS n, {cols}, CAST(volume AS DOUBLE) AS v
      FROM bars""")
    w = "(PARTITION BY ticker ORDER BY i)"

    def f(a, b):
        return f"(PARTITION BY ticker ORDER BY i ROWS BETWEEN {a} PRECEDING AND {b})"

    def sma(x, k):
        return f"CASE WHEN i >= {k - 1} THEN avg({x}) OVER {f(k - 1, 'CURRENT ROW')} END AS sma{k}"

    C.add(f"{name}_w1", f"""
      SELECT *, lag(c) OVER {w} AS pc, lag(h) OVER {w} AS ph, lag(l) OVER {w} AS pl,
             {sma('c', 5)}, {sma('c', 20)}, {sma('c', 50)}, {sma('c', 200)},
             CASE WHEN i >= 19 THEN stddev_pop(c) OVER {f(19, 'CURRENT ROW')} END AS sd20,
             CASE WHEN i >= 19 THEN avg(v) OVER {f(19, 'CURRENT ROW')} END AS vsma20,
             CASE WHEN i >= 20 THEN max(h) OVER {f(20, '1 PRECEDING')} END AS hi20,
             CASE WHEN i >= 10 THEN min(l) OVER {f(10, '1 PRECEDING')} END AS lo10,
             lag(c, 21) OVER {w} AS c21, lag(c, 252) OVER {w} AS c252
      FROM {name}_px""")
    C.add(f"{name}_w2", f"""
      SELECT *, CASE WHEN i > 0 THEN greatest(c - pc, 0) END AS gain,
             CASE WHEN i > 0 THEN greatest(pc - c, 0) END AS loss,
             CASE WHEN i = 0 THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr,
             CASE WHEN i > 0 AND h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS pdm,
             CASE WHEN i > 0 AND pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS mdm,
             CASE WHEN i > 0 THEN ln(c / pc) END AS lr,
             sum(CASE WHEN i = 0 THEN 0 ELSE sign(c - pc) * v END) OVER (PARTITION BY ticker
                 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv
      FROM {name}_w1""")

    def smooth(x, alpha, first, k, out):
        body = (f"sum(CASE WHEN b.i = {first} THEN 1.0 ELSE {alpha} END "
                f"* power(1 - {alpha}, a.i - b.i) * b.{x}) FILTER (b.i >= {first})")
        return f"CASE WHEN a.i >= {first + k - 1} THEN {body} END AS {out}"

    pair = f"{name}_w2 a JOIN {name}_w2 b ON a.ticker = b.ticker AND b.i <= a.i"
    e = lambda k: f"(2.0 / {k + 1})"           # noqa: E731
    wi = lambda k: f"(1.0 / {k})"              # noqa: E731
    C.add(f"{name}_s1", f"""
      SELECT a.ticker, a.i, {smooth('c', e(12), 0, 12, 'ema12')}, {smooth('c', e(26), 0, 26, 'ema26')},
             {smooth('c', e(20), 0, 20, 'ema20')}, {smooth('gain', wi(14), 1, 14, 'g14')},
             {smooth('loss', wi(14), 1, 14, 'l14')}, {smooth('gain', wi(2), 1, 2, 'g2')},
             {smooth('loss', wi(2), 1, 2, 'l2')}, {smooth('tr', wi(14), 0, 14, 'tr14')},
             {smooth('tr', wi(20), 0, 20, 'tr20')}, {smooth('tr', wi(22), 0, 22, 'tr22')},
             {smooth('pdm', wi(14), 0, 14, 'p14')}, {smooth('mdm', wi(14), 0, 14, 'm14')}
      FROM {pair} GROUP BY a.ticker, a.i""")
    C.add(f"{name}_j1", f"""
      SELECT w.*, s.* EXCLUDE (ticker, i), ema12 - ema26 AS macd,
             CASE WHEN l14 = 0 THEN CASE WHEN g14 > 0 THEN 100.0 END
                  ELSE 100 - 100 / (1 + g14 / l14) END AS rsi14,
             CASE WHEN l2 = 0 THEN CASE WHEN g2 > 0 THEN 100.0 END
                  ELSE 100 - 100 / (1 + g2 / l2) END AS rsi2,
             CASE WHEN n >= 28 THEN 100 * p14 / tr14 END AS pdi,
             CASE WHEN n >= 28 THEN 100 * m14 / tr14 END AS mdi,
             CASE WHEN i >= 49 THEN avg(obv) OVER {f(49, 'CURRENT ROW')} END AS obv50,
             CASE WHEN i >= 20 THEN stddev_samp(lr) OVER {f(19, 'CURRENT ROW')} * sqrt(252) END AS rv,
             sma50 / lag(sma50, 20) OVER {w} - 1 AS slope
      FROM {name}_w2 w JOIN {name}_s1 s USING (ticker, i)""".replace("SELECT w.*, s.* EXCLUDE (ticker, i)",
                                                                    "SELECT w.*, s.* EXCLUDE (ticker, i)"))
    C.add(f"{name}_j2", f"""
      SELECT *, CASE WHEN pdi IS NULL THEN NULL WHEN pdi + mdi > 0
                     THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx
      FROM {name}_j1""")
    C.add(f"{name}_s2", f"""
      SELECT a.ticker, a.i, {smooth('macd', e(9), 25, 9, 'macd_signal')},
             CASE WHEN a.n >= 28 THEN {smooth('dx', wi(14), 13, 14, 'adx').removesuffix(' AS adx')} END AS adx
      FROM {name}_j2 a JOIN {name}_j2 b ON a.ticker = b.ticker AND b.i <= a.i
      GROUP BY a.ticker, a.i, a.n""")
    C.add(f"{name}_past", f"""
      SELECT a.ticker, a.i, count(b.rv) AS m, count(*) FILTER (b.rv <= a.rv) AS below
      FROM {name}_j2 a JOIN {name}_j2 b ON a.ticker = b.ticker AND b.i < a.i AND b.i >= a.i - 252
      GROUP BY a.ticker, a.i""")
    C.add(f"{name}_all", f"""
      SELECT j.*, s.macd_signal, s.adx,
             CASE WHEN j.rv IS NOT NULL AND p.m >= 126 THEN p.below / p.m END AS rank252
      FROM {name}_j2 j JOIN {name}_s2 s USING (ticker, i) LEFT JOIN {name}_past p USING (ticker, i)""")


_base("traded", "open AS o, high AS h, low AS l, close AS c")
_base("adj", "open * (adj_close / close) AS o, high * (adj_close / close) AS h, "
      "low * (adj_close / close) AS l, close * (adj_close / close) AS c")

REGIME = """CASE WHEN adx IS NULL OR slope IS NULL OR rank252 IS NULL THEN 'unknown'
  WHEN rank252 >= 0.8 THEN 'volatile'
  WHEN adx >= 25 THEN CASE WHEN slope > 0 THEN 'trending_up' ELSE 'trending_down' END
  WHEN adx < 20 THEN 'ranging' ELSE 'transition' END"""
REGIME_AGREE = """CASE WHEN adx IS NULL OR slope IS NULL OR rank252 IS NULL THEN 'unknown'
  WHEN rank252 >= 0.8 THEN 'volatile'
  WHEN adx >= 25 AND slope > 0 AND pdi > mdi THEN 'trending_up'
  WHEN adx >= 25 AND slope < 0 AND mdi > pdi THEN 'trending_down'
  WHEN adx < 20 THEN 'ranging' ELSE 'transition' END"""

HOLDS = {
    "rsi_reversion": ("rsi14 < 30", "rsi14 > 70"),
    "bollinger_reversion": ("c < sma20 - 2 * sd20", "c > sma20"),
    "bollinger_breakout": ("c > sma20 + 2 * sd20", "c < sma20"),
    "donchian_breakout": ("c > hi20", "c < lo10"),
    "zscore_reversion": ("(c - sma20) / nullif(sd20, 0) < -2", "(c - sma20) / nullif(sd20, 0) > 0"),
    "rsi2_pullback": ("rsi2 < 10 AND c > sma200", "c > sma5"),
    "keltner_breakout": ("c > ema20 + 2 * tr20", "c < ema20"),
}
LEVELS = {
    "buy_and_hold": "true",
    "sma_cross": "sma50 > sma200",
    "ema_cross": "ema12 > ema26",
    "price_above_sma": "c > sma200",
    "macd_cross": "macd > macd_signal",
    "momentum": "c21 / c252 - 1 > 0",
    "adx_trend": "adx > 25 AND pdi > mdi",
    "trend_alignment": "c > sma20 AND sma20 > sma50 AND sma50 > sma200",
    "obv_trend": "obv > obv50 AND c > sma50",
}
RULE_NAMES = [*LEVELS, *HOLDS, "atr_trailing_stop", "sma_cross_long_short"]

C.add("hold_events", "SELECT ticker, i, " + ", ".join(
    f"CAST(coalesce({a}, false) AS INT) AS e_{k}, CAST(coalesce({b}, false) AS INT) AS x_{k}"
    for k, (a, b) in HOLDS.items()) + " FROM adj_all")
_UP = "(PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
C.add("hold_flips", "SELECT *, " + ", ".join(
    f"sum(e_{k} * x_{k}) OVER {_UP} AS f_{k}" for k in HOLDS) + " FROM hold_events")
C.add("hold_states", "SELECT ticker, i, " + ", ".join(
    f"(coalesce(last_value(CASE WHEN e_{k} <> x_{k} THEN (e_{k} + f_{k}) % 2 END IGNORE NULLS) "
    f"OVER {_UP}, 0) + f_{k}) % 2 AS {k}" for k in HOLDS) + " FROM hold_flips")
C.add("stop_inputs", "SELECT ticker, i, c, coalesce(sma50 IS NOT NULL AND tr22 IS NOT NULL "
      "AND c > sma50, false) AS may, tr22 AS a FROM adj_all")
# The trailing stop, one entry at a time: each round finds where the stop of the current entry
# is hit, then the next bar that may enter.
C.add("stop_states", """
  SELECT ticker, i, CASE WHEN state.best > 0 THEN 1 ELSE 0 END AS atr_trailing_stop FROM stop_walk state""")
C.raw("stop_walk", """stop_walk AS (/*recursive*/
  SELECT ticker, i, CASE WHEN may THEN c ELSE 0 END AS best FROM stop_inputs WHERE i = 0
  UNION ALL
  SELECT s.ticker, s.i,
         CASE WHEN w.best = 0 THEN CASE WHEN s.may THEN s.c ELSE 0 END
              WHEN s.c < greatest(w.best, s.c) - 3.0 * s.a THEN 0
              ELSE greatest(w.best, s.c) END
  FROM stop_walk w JOIN stop_inputs s ON s.ticker = w.ticker AND s.i = w.i + 1)""")
C.bodies["stop_states"] = C.bodies.pop("stop_states")
C.add("targets", "SELECT a.*, " + REGIME + " AS regime, " + REGIME_AGREE + " AS regime_agree, " + ", ".join(
    f"CASE WHEN {e} THEN 1.0 ELSE 0.0 END AS {k}" for k, e in LEVELS.items()) + ", "
    + ", ".join(f"CAST(h.{k} AS DOUBLE) AS {k}" for k in HOLDS)
    + """, CAST(t.atr_trailing_stop AS DOUBLE) AS atr_trailing_stop,
      CASE WHEN sma50 IS NULL OR sma200 IS NULL THEN 0.0 WHEN sma50 > sma200 THEN 1.0 ELSE -1.0 END
        AS sma_cross_long_short
      FROM adj_all a JOIN hold_states h USING (ticker, i) JOIN stop_states t USING (ticker, i)""")
C.add("cheap_targets", "SELECT *, CASE WHEN sma50 > sma200 THEN 1.0 ELSE 0.0 END AS sma_cross FROM adj_w1")


def simulate(name: str, source: str, keys: str, cash: float, slip: float = 0.0005,
             costs: str = "market") -> None:
    """Add CTE `name`: the equity of `source` (keys, day, o, c, target) from its first row on.

    costs: 'market' (by ticker), 'flat:<rate>' or 'columns' (buy_rate, sell_rate, per_sale)."""
    w = f"(PARTITION BY {keys} ORDER BY day)"
    up = f"(PARTITION BY {keys} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    indian = f"({EXCHANGE}) <> 'US'"
    levies = "(0.001 + 1.18 * (0.0000307 + 0.000001))"
    if costs == "market":
        rates = (f"CASE WHEN {indian} THEN {levies} + 0.00015 ELSE 0.0005 END AS br, "
                 f"CASE WHEN {indian} THEN {levies} ELSE 0.0005 END AS sr, "
                 f"CASE WHEN {indian} THEN 15.34 ELSE 0.0 END AS ps")
    elif costs.startswith("flat:"):
        rates = f"{costs[5:]} AS br, {costs[5:]} AS sr, 0.0 AS ps"
    else:
        rates = "buy_rate AS br, sell_rate AS sr, per_sale AS ps"
    C.add(f"{name}_a", f"""
      SELECT *, row_number() OVER {w} - 1 AS k, coalesce(lag(target) OVER {w}, 0.0) AS held,
             coalesce(lag(target, 2) OVER {w}, 0.0) AS was, lag(c) OVER {w} AS prevc, {rates}
      FROM {source}""")
    C.add(f"{name}_b", f"""
      SELECT *, abs(held - was) AS moved,
             CASE WHEN held < was THEN least(was - held, greatest(was, 0.0)) ELSE 0.0 END
             + CASE WHEN held > was THEN least(held - was, greatest(-was, 0.0)) ELSE 0.0 END AS sells
      FROM {name}_a""")
    C.add(f"{name}_c", f"""
      SELECT *, moved - sells AS buys, CASE WHEN k = 0 THEN 1.0 ELSE 1 + was * (o / prevc - 1) END AS night,
             CASE WHEN k = 0 THEN 1.0 ELSE 1 + held * (c / o - 1) END AS daytime,
             sells * sr + (moved - sells) * br + moved * {slip} AS share,
             CASE WHEN sells > 0 THEN ps ELSE 0.0 END AS fixed
      FROM {name}_b""")
    C.add(f"{name}_d", f"""
      SELECT *, product(night * (1 - share) * daytime) OVER {up} AS growth FROM {name}_c""")
    C.add(f"{name}_e", f"""
      SELECT *, growth * ({cash} - sum(CASE WHEN fixed > 0 THEN fixed * daytime / growth ELSE 0.0 END)
                          OVER {up}) AS equity FROM {name}_d""")
    C.add(name, f"""
      SELECT *, coalesce(lag(equity) OVER {w}, {cash}) * night AS before,
             coalesce(lag(equity) OVER {w}, {cash}) * night * share + fixed AS fee,
             equity / lag(equity) OVER {w} - 1 AS ret,
             equity / max(equity) OVER {up} - 1 AS dd
      FROM {name}_e""")


STATS = """count(ret) AS days_n, max_by(equity, day) AS v1, min_by(equity, day) AS v0,
  max_by(equity, day) / min_by(equity, day) - 1 AS total_return,
  power(max_by(equity, day) / min_by(equity, day), 252.0 / count(ret)) - 1 AS cagr,
  stddev_samp(ret) * sqrt(252) AS vol, avg(ret) AS mean_r, stddev_samp(ret) AS sd_r,
  sqrt(avg(power(least(ret, 0), 2))) AS down, min(dd) AS max_drawdown,
  avg(CASE WHEN k > 0 THEN CAST(abs(held) > 0 AS INT) END) AS exposure,
  sum(moved) AS turnover, sum(fee) AS costs_paid"""
RISK = """round(cagr, 4) + 0.0 AS cagr, round(max_drawdown, 4) + 0.0 AS max_drawdown,
  round(CASE WHEN sd_r > 0 THEN mean_r / sd_r * sqrt(252) END, 4) + 0.0 AS sharpe,
  round(CASE WHEN down > 0 THEN mean_r * 252 / (down * sqrt(252)) END, 4) + 0.0 AS sortino,
  round(CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END, 4) + 0.0 AS calmar,
  round(exposure, 4) + 0.0 AS time_in_market"""
