"""Trading rules over every ticker at once: bars in, a target position per bar out.

A rule asks `Features` for its inputs and answers with one of
  level(expr)         the target itself
  hold(entry, exit)   an enter/exit position (see functions.series.held_state)
                      (a trailing stop's is walked row by row over each ticker's sorted bars)
A target uses rows up to its own bar only; it is put on at the next bar's open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.functions import series
from brasstide.operators.features import Features


def adjusted_prices(bars: DataFrame) -> DataFrame:
    """Open, high, low and close scaled to the dividend-adjusted close."""
    factor = F.col("adj_close") / F.col("close")
    return bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")})


@dataclass
class Level:
    target: Column
    walked: bool = False


@dataclass
class Hold:
    entry: Column
    exit: Column


def _over(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a > b, F.lit(False))


def _under(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a < b, F.lit(False))


def _on(condition: Column) -> Level:
    return Level(condition.cast("double"))


def _crossing(f: Features, p: dict, average: str) -> Level:
    pick = getattr(f, average)
    return _on(_over(pick("close", int(p["fast"])), pick("close", int(p["slow"]))))


def _bands(f: Features, p: dict) -> tuple[Column, Column, Column]:
    mid, sd = f.bollinger(int(p["period"]))
    reach = p["width"] * F.col(sd)
    return F.col(mid), F.col(mid) + reach, F.col(mid) - reach


def _reversion(f, p):
    mid, _, low = _bands(f, p)
    return Hold(_under("close", low), _over("close", mid))


def _breakout(f, p):
    mid, high, _ = _bands(f, p)
    return Hold(_over("close", high), _under("close", mid))


def _macd(f, p):
    return _on(_over(*f.macd(int(p["fast"]), int(p["slow"]), int(p["signal"]))))


def _rsi(f, p):
    r = f.rsi(int(p["period"]))
    return Hold(_under(r, F.lit(p["buy_below"])), _over(r, F.lit(p["sell_above"])))


def _channel(f, p):
    return Hold(_over("close", f.highest("high", int(p["entry"]))),
                _under("close", f.lowest("low", int(p["exit"]))))


def _momentum(f, p):
    recent, old = f.lag("close", int(p["skip"])), f.lag("close", int(p["lookback"]))
    return _on(_over(F.col(recent) / F.col(old) - 1.0, F.lit(0.0)))


def _zscore(f, p):
    mid, sd = f.bollinger(int(p["period"]))
    z = (F.col("close") - F.col(mid)) / F.nullif(F.col(sd), F.lit(0.0))
    return Hold(_under(z, F.lit(p["entry"])), _over(z, F.lit(p["exit"])))


def _trailing(f, p):
    trend, atr = f.sma("close", int(p["trend"])), f.atr(int(p["atr_period"]))
    name = f"stop_{p['multiple']}_{trend}_{atr}".replace(".", "_")
    return Level(F.col(f.walk(name, lambda: _stops(p["multiple"]), "close", trend, atr)), walked=True)


def _long_short(f, p):
    a, b = F.col(f.sma("close", int(p["fast"]))), F.col(f.sma("close", int(p["slow"])))
    return Level(F.when(a.isNull() | b.isNull(), 0.0).when(a > b, 1.0).otherwise(-1.0))


def _pullback(f, p):
    dip = _under(f.rsi(int(p["period"])), F.lit(p["buy_below"]))
    return Hold(dip & _over("close", f.sma("close", int(p["trend"]))),
                _over("close", f.sma("close", int(p["exit_sma"]))))


def _keltner(f, p):
    mid, atr = f.ema("close", int(p["period"])), f.atr(int(p["period"]))
    return Hold(_over("close", F.col(mid) + p["multiple"] * F.col(atr)), _under("close", mid))


def _adx(f, p):
    strength, up, down = f.adx(int(p["period"]))
    return _on(_over(strength, F.lit(p["threshold"])) & _over(up, down))


def _alignment(f, p):
    s, m, lg = (f.sma("close", int(p[k])) for k in ("short", "medium", "long"))
    return _on(_over("close", s) & _over(s, m) & _over(m, lg))


def _obv(f, p):
    volume_line = f.obv()
    return _on(_over(volume_line, f.sma(volume_line, int(p["period"])))
               & _over("close", f.sma("close", int(p["period"]))))


@dataclass(frozen=True)
class Rule:
    key: str
    build: Callable[[Features, dict], Level | Hold] = field(repr=False)
    defaults: dict
    style: str | None
    warmup: int
    shorts: bool = False


# Each rule's default parameters, style and warm-up bars.
CATALOGUE = {r.key: r for r in (
    Rule("buy_and_hold", lambda f, p: Level(F.lit(1.0)), {}, None, 0),
    Rule("sma_cross", lambda f, p: _crossing(f, p, "sma"), {"fast": 50, "slow": 200}, "trend", 200),
    Rule("ema_cross", lambda f, p: _crossing(f, p, "ema"), {"fast": 12, "slow": 26}, "trend", 26),
    Rule("price_above_sma", lambda f, p: _on(_over("close", f.sma("close", int(p["period"])))),
         {"period": 200}, "trend", 200),
    Rule("macd_cross", _macd, {"fast": 12, "slow": 26, "signal": 9}, "trend", 34),
    Rule("rsi_reversion", _rsi, {"period": 14, "buy_below": 30, "sell_above": 70}, "reversion", 15),
    Rule("bollinger_reversion", _reversion, {"period": 20, "width": 2.0}, "reversion", 20),
    Rule("bollinger_breakout", _breakout, {"period": 20, "width": 2.0}, "trend", 20),
    Rule("donchian_breakout", _channel, {"entry": 20, "exit": 10}, "trend", 20),
    Rule("momentum", _momentum, {"lookback": 252, "skip": 21}, "trend", 252),
    Rule("zscore_reversion", _zscore, {"period": 20, "entry": -2.0, "exit": 0.0}, "reversion", 20),
    Rule("atr_trailing_stop", _trailing, {"trend": 50, "atr_period": 22, "multiple": 3.0}, "trend", 50),
    Rule("sma_cross_long_short", _long_short, {"fast": 50, "slow": 200}, "trend", 200, True),
    Rule("rsi2_pullback", _pullback,
         {"period": 2, "buy_below": 10, "trend": 200, "exit_sma": 5}, "trend", 200),
    Rule("keltner_breakout", _keltner, {"period": 20, "multiple": 2.0}, "trend", 20),
    Rule("adx_trend", _adx, {"period": 14, "threshold": 25}, "trend", 27),
    Rule("trend_alignment", _alignment, {"short": 20, "medium": 50, "long": 200}, "trend", 200),
    Rule("obv_trend", _obv, {"period": 50}, "trend", 50),
)}

# A rule that restates another one does not vote; it can still be backtested.
RESTATED = {"zscore_reversion": "bollinger_reversion"}


def parameters(key: str, overrides: dict | None = None) -> dict:
    """Defaults with the known overrides; unknown names are ignored."""
    rule = CATALOGUE[key]
    return {**rule.defaults,
            **{k: float(v) for k, v in (overrides or {}).items() if k in rule.defaults}}


def trailing_stop(close, trend, atr, multiple: float) -> np.ndarray:
    """1 while in: enter above the trend line, leave `multiple` ATRs below the best close."""
    return _stops(multiple)(np.arange(len(close)), close, trend, atr)


def _stops(multiple: float) -> Callable[..., np.ndarray]:
    """`trailing_stop` over batches of many keys' rows; row 0 of a key starts anew."""
    best = None

    def batch(number, close, trend, atr) -> np.ndarray:
        nonlocal best
        out = np.zeros(len(close))
        may_enter = close > trend                     # False where the trend line is undefined
        may_enter &= ~np.isnan(atr)
        leave = multiple * atr
        for t, (n, c, enter, fall) in enumerate(zip(number.tolist(), close.tolist(), may_enter.tolist(), leave.tolist())):
            if n == 0:
                best = None
            if best is None:
                best = c if enter else None
            else:
                best = max(best, c)
                best = None if c < best - fall else best
            out[t] = best is not None
        return out

    return batch


def wide_targets(prices: DataFrame, rules: dict[str, tuple[str, dict]], keys=("ticker",),
                 order: str = "day", carry: Callable[[Features], list[str]] | None = None
                 ) -> DataFrame:
    """Prices plus one target column per entry of `rules` (label -> (rule, overrides)).

    `carry` may request further features to keep (the regime's measurements).
    """
    f = Features(keys, order)
    built = {label: CATALOGUE[k].build(f, parameters(k, o)) for label, (k, o) in rules.items()}
    kept = carry(f) if carry else []
    base = prices.columns
    df = f.apply(series.spread(prices, *keys))

    holds = {label: b for label, b in built.items() if isinstance(b, Hold)}
    levels = {label: b.target for label, b in built.items() if isinstance(b, Level)}
    signals = {}
    for label, b in holds.items():
        signals |= {f"_e_{label}": b.entry, f"_x_{label}": b.exit}
    # From here on only what the targets need: the states' windows sort these rows once more.
    df = df.select(*dict.fromkeys([*base, *kept, "_b", "_i"]),
                   *[e.alias(n) for n, e in {**signals, **levels}.items()])
    # The walk takes rows without a day first, where its inputs are undefined; they hold what their key ends with.
    whole = series.rows(keys, ["_b", "_i"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({label: F.when(F.col(order).isNull(), F.last(label).over(whole)).otherwise(F.col(label))
                         for label, b in built.items() if isinstance(b, Level) and b.walked})
    flips, states = {}, {}
    for label in holds:
        a, b = series.held_state(f"_e_{label}", f"_x_{label}", label, f.w)
        flips |= a
        states |= b
    if holds:
        df = df.withColumns(flips).withColumns(states)
    clip = {}
    for label, (k, _) in rules.items():
        x = F.coalesce(F.col(label), F.lit(0.0))
        clip[label] = x if CATALOGUE[k].shorts else F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return df.withColumns(clip).select(*base, *kept, *rules)


def long_targets(wide: DataFrame, labels: list[str], carry: list[str]) -> DataFrame:
    """One row per (carried columns, rule): the run key of everything downstream."""
    pairs = F.array(*[F.struct(F.lit(x).alias("rule"), F.col(x).alias("target")) for x in labels])
    return wide.select(*carry, F.explode(pairs).alias("_p")).select(*carry, "_p.rule", "_p.target")


def default_rules(keys=None) -> dict[str, tuple[str, dict]]:
    return {k: (k, {}) for k in (keys or CATALOGUE)}
