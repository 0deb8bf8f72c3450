"""Rule positions and next-open backtests."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from brasstide.functions import markets
from brasstide.operators import backtest, rules
from brasstide.plans.market_sql import C, EXCHANGE, RULE_NAMES, STATS, simulate
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import r
from brasstide.sources.derived import bars, table

QUERIES, SQL = {}, {}
RUN = ["ticker", "rule"]


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


def _wide(spark, sf, names=None):
    return rules.wide_targets(rules.adjusted_prices(bars(spark, sf)), rules.default_rules(names))


def _positions(names):
    def run(spark, sf):
        return _wide(spark, sf, names).select("ticker", "day", *names)
    return run


def _positions_sql(names):
    return "SELECT ticker, day, " + ", ".join(names) + " FROM targets"


# One query per family; together they are every rule of the catalogue.
_FAMILIES = {
    "rules_moving_averages": ["buy_and_hold", "sma_cross", "ema_cross", "price_above_sma",
                              "sma_cross_long_short", "trend_alignment"],
    "rules_oscillators": ["macd_cross", "rsi_reversion", "rsi2_pullback", "adx_trend"],
    "rules_bands": ["bollinger_reversion", "bollinger_breakout", "zscore_reversion",
                    "donchian_breakout", "keltner_breakout"],
    "rules_momentum_volume": ["momentum", "obv_trend"],
    "rule_trailing_stop": ["atr_trailing_stop"],
}
assert sorted(sum(_FAMILIES.values(), [])) == sorted(rules.CATALOGUE)
for _name, _keys in _FAMILIES.items():
    QUERIES[_name] = _positions(_keys)
    SQL[_name] = C.compose(_positions_sql(_keys))


@query("rule_parameter_grid", """
  WITH g AS (SELECT ticker, day, i, avg(c) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a10,
    avg(c) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a20,
    avg(c) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS a50 FROM adj_px)
  SELECT ticker, day, CASE WHEN i >= 49 AND a10 > a50 THEN 1.0 ELSE 0.0 END AS fast_10,
         CASE WHEN i >= 49 AND a20 > a50 THEN 1.0 ELSE 0.0 END AS fast_20 FROM g""")
def _grid(spark, sf):
    grid = {f"fast_{n}": ("sma_cross", {"fast": n, "slow": 50, "ignored": 1}) for n in (10, 20)}
    out = rules.wide_targets(rules.adjusted_prices(bars(spark, sf)), grid)
    return out.select("ticker", "day", *grid)


# -- costs ------------------------------------------------------------------------------------

@query("costs_flat", f"""
  SELECT o_orderkey, {r('abs(o_totalprice) * 5 / 10000', 8, 'fee')} FROM orders""")
def _flat(spark, sf):
    rate = markets.flat_costs(5.0).buy_rate
    return table(spark, sf, "orders").select("o_orderkey", (F.round(F.abs("o_totalprice") * rate, 8)
                                                            + 0.0).alias("fee"))


@query("costs_delivery", f"""
  WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
                    o_totalprice AS a FROM orders)
  SELECT o_orderkey, side, {r('a * 0.001', 12, 'stt')}, {r('a * 0.0000307', 12, 'exchange_fee')},
    {r('a * 0.000001', 12, 'sebi')}, {r("CASE WHEN side = 'buy' THEN a * 0.00015 ELSE 0 END", 12, 'stamp_duty')},
    {r('(least(a * 0.001, 20) + a * 0.0000317) * 0.18', 12, 'gst')}, {r('least(a * 0.001, 20)', 12, 'brokerage')},
    CASE WHEN side = 'sell' THEN 15.34 ELSE 0.0 END AS dp_charge FROM s""")
def _delivery(spark, sf):
    side = F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy")
    rates = markets.DeliveryRates(brokerage=0.001, brokerage_cap=20.0)
    items = markets.delivery_items(side, F.col("o_totalprice"), rates)
    out = table(spark, sf, "orders").select("o_orderkey", side.alias("side"),
                                            *[e.alias(n) for n, e in items.items()])
    return rounded(out, {n: 12 for n in items if n != "dp_charge"})


# -- backtests --------------------------------------------------------------------------------

_FIGURES = {"total_return": 6, "cagr": 6, "annualised_volatility": 6, "sharpe_ratio": 5,
            "max_drawdown": 6, "exposure": 6, "turnover": 6, "costs_paid": 3, "final_equity": 3,
            "win_rate": 6, "average_trade_return": 6}


def _trade_sql(sim: str, keys: str) -> None:
    """Trades of a simulated CTE by pairing each entry with the next change of side."""
    w = f"(PARTITION BY {keys} ORDER BY day)"
    C.add(f"{sim}_x", f"""
      SELECT *, before * sells * sr + fixed AS sale, before * buys * br AS purchase,
        before - fee AS after, max(k) OVER (PARTITION BY {keys}) AS lastk,
        max(day) OVER (PARTITION BY {keys}) AS lastday,
        last_value(c) OVER (PARTITION BY {keys} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING
                            AND UNBOUNDED FOLLOWING) AS lastc FROM {sim}""")
    C.add(f"{sim}_y", f"""
      SELECT *, lead(k) OVER {w} AS xk, lead(day) OVER {w} AS xday, lead(o) OVER {w} AS xo,
        lead(sale) OVER {w} AS xsale, lead(purchase) OVER {w} AS xpurchase
      FROM {sim}_x WHERE sign(held) <> sign(was)""")
    C.add(f"{sim}_trades", f"""
      WITH z AS (SELECT *, sign(held) AS sg, after * abs(held) AS stake,
          CASE WHEN was <> 0 THEN CASE WHEN held > 0 THEN after * abs(held) * br
                                       ELSE after * abs(held) * sr + ps END
               WHEN held > 0 THEN purchase ELSE sale END AS fin,
          o * (1 + sign(held) * 0.0005) AS pin,
          CASE WHEN xk IS NULL THEN lastc ELSE xo * (1 - sign(held) * 0.0005) END AS pout,
          CASE WHEN xk IS NULL THEN 0 WHEN held > 0 THEN xsale ELSE xpurchase END AS fout
        FROM {sim}_y WHERE held <> 0)
      SELECT {keys}, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, day AS entry_day,
        pin AS entry_price, coalesce(xday, lastday) AS exit_day, pout AS exit_price,
        coalesce(xk, lastk) - k AS bars_held, sg * (pout / pin - 1) - (fin + fout) / (stake + fin) AS net_return,
        CASE WHEN xk IS NULL THEN 'open' ELSE 'closed' END AS status FROM z""")


def _stats_sql(sim: str, keys: str, columns: str = "") -> str:
    return f"""
      WITH s AS (SELECT {keys}, {STATS} FROM {sim} GROUP BY {keys}),
      t AS (SELECT {keys}, count(*) AS trades, count(*) FILTER (status = 'closed') AS closed_trades,
              avg(CASE WHEN status = 'closed' THEN CAST(net_return > 0 AS INT) END) AS wr,
              avg(CASE WHEN status = 'closed' THEN net_return END) AS ar FROM {sim}_trades GROUP BY {keys})
      SELECT {keys}, {columns} {r('total_return', 6, 'total_return')}, {r('cagr', 6, 'cagr')},
        {r('vol', 6, 'annualised_volatility')}, {r('CASE WHEN vol > 0 THEN cagr / vol END', 5, 'sharpe_ratio')},
        {r('max_drawdown', 6, 'max_drawdown')}, coalesce(trades, 0) AS trades,
        coalesce(closed_trades, 0) AS closed_trades, {r('wr', 6, 'win_rate')},
        {r('ar', 6, 'average_trade_return')}, {r('exposure', 6, 'exposure')}, {r('turnover', 6, 'turnover')},
        {r('costs_paid', 3, 'costs_paid')}, {r('v1', 3, 'final_equity')}
      FROM s LEFT JOIN t USING ({keys})"""


C.add("cross_runs", "SELECT ticker, day, o, c, sma_cross AS target FROM cheap_targets")
simulate("cross_sim", "cross_runs", "ticker", 10000.0)
_trade_sql("cross_sim", "ticker")


def _cross(spark, sf):
    wide = _wide(spark, sf, ["sma_cross"]).withColumnRenamed("sma_cross", "target")
    priced = markets.with_market_costs(markets.with_market(wide))
    return backtest.simulate(priced, ["ticker"])


@query("backtest_sma_cross", _stats_sql("cross_sim", "ticker"))
def _cross_stats(spark, sf):
    return rounded(backtest.backtest_stats(_cross(spark, sf), ["ticker"]), _FIGURES)


@query("backtest_equity_curve", f"""
  SELECT ticker, day, held, {r('equity', 3, 'equity')}, {r('fee', 4, 'fee')} FROM cross_sim""")
def _curve(spark, sf):
    out = _cross(spark, sf).select("ticker", "day", "held", "equity", "fee")
    return rounded(out, {"equity": 3, "fee": 4})


C.add("all_runs", "SELECT ticker, day, o, c, unnest([" + ", ".join(f"'{x}'" for x in RULE_NAMES)
      + "]) AS rule, unnest([" + ", ".join(RULE_NAMES) + "]) AS target0 FROM targets")
C.add("market_runs", f"SELECT * EXCLUDE (target0), CASE WHEN {EXCHANGE} <> 'US' THEN greatest(target0, 0.0) "
      "ELSE target0 END AS target FROM all_runs")
simulate("all_sim", "market_runs", "ticker, rule", 10000.0)
_trade_sql("all_sim", "ticker, rule")


def _all_wide(spark, sf):
    return markets.with_market_costs(markets.with_market(_wide(spark, sf)))


def _allowed(target):
    """A market without overnight shorts turns a short into flat."""
    return F.when(F.col("allows_short"), F.col(target)).otherwise(F.greatest(target, F.lit(0.0)))


def _all_runs(spark, sf):
    carry = ["ticker", "day", "open", "close", "allows_short", "buy_rate", "sell_rate", "per_sale"]
    runs = rules.long_targets(_all_wide(spark, sf), list(rules.CATALOGUE), carry)
    return runs.withColumn("target", _allowed("target"))


@query("backtest_all_rules", _stats_sql("all_sim", "ticker, rule"))
def _all_stats(spark, sf):
    runs = backtest.Beside(_all_wide(spark, sf).withColumns({k: _allowed(k) for k in rules.CATALOGUE}), list(rules.CATALOGUE))
    return rounded(backtest.backtest_stats(backtest.simulate(runs, RUN), RUN), _FIGURES)


@query("trade_list", f"""
  SELECT ticker, rule, side, entry_day, {r('entry_price', 5, 'entry_price')}, exit_day,
    {r('exit_price', 5, 'exit_price')}, bars_held, {r('net_return', 6, 'net_return')}, status
  FROM all_sim_trades""")
def _trade_list(spark, sf):
    out = backtest.trades(backtest.simulate(_all_runs(spark, sf), RUN), RUN)
    return rounded(out, {"entry_price": 5, "exit_price": 5, "net_return": 6})


C.add("late_runs", "SELECT * FROM cross_runs WHERE day >= DATE '1996-06-01'")
C.add("late_ok", "SELECT r.* FROM late_runs r JOIN (SELECT ticker FROM late_runs GROUP BY ticker "
      "HAVING count(*) >= 3) USING (ticker)")
simulate("late_sim", "late_ok", "ticker", 10000.0)
_trade_sql("late_sim", "ticker")


@query("backtest_from_day", _stats_sql("late_sim", "ticker"))
def _from_day(spark, sf):
    # Warm-up rows feed the rule, not the equity.
    wide = _wide(spark, sf, ["sma_cross"]).withColumnRenamed("sma_cross", "target")
    late = markets.with_market_costs(markets.with_market(wide)).filter("day >= DATE '1996-06-01'")
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    late = late.withColumn("_n", n).filter("_n >= 3")
    return rounded(backtest.backtest_stats(backtest.simulate(late, ["ticker"]), ["ticker"]), _FIGURES)


@query("backtest_capped_brokerage")
def _capped(spark, sf):
    wide = _wide(spark, sf, ["sma_cross"]).withColumnRenamed("sma_cross", "target")
    rates = markets.DeliveryRates(brokerage=0.001, brokerage_cap=20.0)
    runs = markets.with_costs(wide.select("ticker", "day", "open", "close", "target"),
                              markets.delivery_costs(rates))
    sim = backtest.capped(runs, ["ticker"], rates, cash=100_000.0)
    return rounded(sim.select("ticker", "day", "held", "equity", "fee"), {"equity": 3, "fee": 4})


@query("risk_metrics", f"""
  WITH s AS (SELECT ticker, rule, {STATS} FROM all_sim GROUP BY ticker, rule)
  SELECT ticker, rule, {r('cagr', 6, 'cagr')}, {r('max_drawdown', 6, 'max_drawdown')},
    {r('CASE WHEN sd_r > 1e-12 THEN mean_r / sd_r * sqrt(252) END', 5, 'sharpe')},
    {r('CASE WHEN down > 0 THEN mean_r * 252 / (down * sqrt(252)) END', 5, 'sortino')},
    {r('CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END', 5, 'calmar')},
    {r('exposure', 6, 'time_in_market')} FROM s""")
def _risk(spark, sf):
    sim = backtest.simulate(_all_runs(spark, sf), RUN)
    return rounded(backtest.risk_metrics(sim, RUN), {"cagr": 6, "max_drawdown": 6, "sharpe": 5,
                                                     "sortino": 5, "calmar": 5, "time_in_market": 6})


@query("exposure_matched", f"""
  WITH h AS (SELECT ticker, day, ret, equity FROM all_sim WHERE rule = 'buy_and_hold'),
  e AS (SELECT ticker, avg(CASE WHEN k > 0 THEN CAST(abs(held) > 0 AS INT) END) AS e FROM cross_sim GROUP BY ticker)
  SELECT ticker, day, {r('10000 * product(1 + e * coalesce(ret, 0)) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 3, 'equity')}
  FROM h JOIN e USING (ticker)""")
def _matched(spark, sf):
    wide = markets.with_market_costs(markets.with_market(_wide(spark, sf, ["buy_and_hold", "sma_cross"])))
    carry = ["ticker", "day", "open", "close", "buy_rate", "sell_rate", "per_sale"]
    sim = backtest.simulate(rules.long_targets(wide, ["buy_and_hold", "sma_cross"], carry), RUN)
    e = backtest.run_stats(sim.filter("rule = 'sma_cross'"), ["ticker"]).select("ticker", "exposure")
    held = sim.filter("rule = 'buy_and_hold'").select("ticker", "day", "equity").join(e, "ticker")
    out = backtest.exposure_matched(held, F.col("exposure"), ["ticker"])
    return rounded(out.select("ticker", "day", "equity"), {"equity": 3})


@query("turnover_per_year", f"""
  WITH x AS (SELECT ticker, rule, held <> lag(held) OVER (PARTITION BY ticker, rule ORDER BY day) AS ch FROM all_sim)
  SELECT ticker, rule, {r('count(*) FILTER (ch) / (count(*) / 252)', 6, 'turnover_per_year')} FROM x GROUP BY ticker, rule""")
def _turnover(spark, sf):
    sim = backtest.simulate(_all_runs(spark, sf), RUN)
    return rounded(backtest.turnover_per_year(sim, RUN), {"turnover_per_year": 6})
