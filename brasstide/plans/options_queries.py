"""Option structures on every ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.functions import pricing
from brasstide.operators import analytics, options, signals
from brasstide.plans.market_sql import C
from brasstide.plans.shared import rounded
from brasstide.plans.signals_queries import signals_table
from brasstide.plans.sqltext import r
from brasstide.sources.derived import bars, table

QUERIES, SQL = {}, {}

# The checker has no error function: Abramowitz-Stegun's rational form would not reach 1e-9, so
# the normal distribution is integrated by Simpson's rule on 400 steps.
_CDF = ("(0.5 + sign({x}) * list_sum([(CASE WHEN j IN (0, 400) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * "
        "exp(-0.5 * power(abs({x}) * j / 400, 2)) FOR j IN range(0, 401)]) * abs({x}) / 1200 / sqrt(2 * pi()))")


def cdf(x: str) -> str:
    return _CDF.replace("{x}", f"({x})")


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


C.add("spots", """
  SELECT ticker, max_by(close, day) AS spot, stddev_samp(lr) * sqrt(252) AS sigma FROM (
    SELECT ticker, day, close, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS k,
      ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY day)) AS lr FROM bars)
  WHERE k <= 30 GROUP BY ticker HAVING count(lr) = 30""")
_ROWS = ", ".join(f"('{n}', {i}, '{k}', {s}, CAST({'NULL' if m is None else m} AS DOUBLE))"
                  for n, rows in options.STRUCTURES.items() for i, (k, s, m) in enumerate(rows))
C.add("leg_rows", f"""
  SELECT ticker, spot, sigma, structure, leg_no, kind, side, step, round_even(spot * mult / step, 0) * step AS strike,
    30 / 365.0 AS years, 0.065 AS rate FROM (
    SELECT *, CASE WHEN spot < 250 THEN 2.5 WHEN spot < 500 THEN 5 WHEN spot < 1000 THEN 10 WHEN spot < 2500 THEN 20
      WHEN spot < 5000 THEN 50 ELSE 100 END AS step FROM spots) s, (VALUES {_ROWS}) AS t(structure, leg_no, kind, side, mult)""")
C.add("leg_d", """
  SELECT *, (ln(spot / strike) + (rate + 0.5 * sigma * sigma) * years) / (sigma * sqrt(years)) AS d1,
    (ln(spot / strike) + (rate + 0.5 * sigma * sigma) * years) / (sigma * sqrt(years)) - sigma * sqrt(years) AS d2 FROM leg_rows""")
C.add("leg_n", f"SELECT *, {cdf('d1')} AS n1, {cdf('d2')} AS n2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) AS pd, "
      "exp(-rate * years) AS disc FROM leg_d")
C.add("leg_priced", """
  SELECT ticker, structure, leg_no, kind, side, spot, sigma, step, strike,
    round(CASE kind WHEN 'stock' THEN spot WHEN 'call' THEN spot * n1 - strike * disc * n2
      ELSE strike * disc * (1 - n2) - spot * (1 - n1) END, 4) AS premium,
    CASE kind WHEN 'stock' THEN 1.0 WHEN 'call' THEN n1 ELSE n1 - 1 END AS delta,
    CASE kind WHEN 'stock' THEN 0.0 ELSE pd / (spot * sigma * sqrt(years)) END AS gamma,
    CASE kind WHEN 'stock' THEN 0.0 WHEN 'call' THEN -spot * pd * sigma / (2 * sqrt(years)) - rate * strike * disc * n2
      ELSE -spot * pd * sigma / (2 * sqrt(years)) + rate * strike * disc * (1 - n2) END AS theta,
    CASE kind WHEN 'stock' THEN 0.0 ELSE spot * pd * sqrt(years) END AS vega FROM leg_n""")


def _spots(spark, sf):
    return analytics.historical_volatility(bars(spark, sf)).select("ticker", "spot", "sigma")


@query("option_legs", f"""
  SELECT ticker, structure, leg_no, kind, side, strike, step, {r('premium', 4, 'premium')} FROM leg_priced""")
def _legs(spark, sf):
    return rounded(options.legs(_spots(spark, sf)).select(*options.KEYS, "leg_no", "kind", "side", "strike", "step",
                                                          "premium"), {"premium": 4})


# A price and its sensitivities for every order: spot, strike and term from its own fields.
@query("option_greeks", f"""
  WITH q AS (SELECT o_orderkey, o_totalprice AS s, o_totalprice * (0.80131 + 0.050777 * (o_custkey % 9)) AS k,
      (o_orderkey % 4) / 4.0 AS t, 0.15 + 0.05 * (o_custkey % 5) AS v, o_orderpriority < '3' AS call FROM orders),
  d AS (SELECT *, CASE WHEN t > 0 THEN (ln(s / k) + (0.065 + 0.5 * v * v) * t) / (v * sqrt(t)) END AS d1 FROM q),
  n AS (SELECT *, {cdf('d1')} AS n1, {cdf('d1 - v * sqrt(t)')} AS n2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) AS pd FROM d)
  SELECT o_orderkey,
    {r('CASE WHEN t <= 0 THEN greatest(CASE WHEN call THEN s - k ELSE k - s END, 0) WHEN call THEN s * n1 - k * exp(-0.065 * t) * n2 ELSE k * exp(-0.065 * t) * (1 - n2) - s * (1 - n1) END', 3, 'value')},
    {r("CASE WHEN t <= 0 THEN CASE WHEN call AND s > k THEN 1 WHEN NOT call AND s < k THEN -1 ELSE 0 END WHEN call THEN n1 ELSE n1 - 1 END", 6, 'delta')},
    {r('CASE WHEN t <= 0 THEN 0 ELSE s * pd * sqrt(t) END', 3, 'vega')} FROM n""")
def _greeks(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("spot"),
        (F.col("o_totalprice") * (0.80131 + 0.050777 * (F.col("o_custkey") % 9))).alias("strike"),
        ((F.col("o_orderkey") % 4) / 4.0).alias("years"), F.lit(0.065).alias("rate"),
        (0.15 + 0.05 * (F.col("o_custkey") % 5)).alias("sigma"),
        F.when(F.col("o_orderpriority") < "3", "call").otherwise("put").alias("kind"))
    return rounded(pricing.option_figures(o).select("o_orderkey", "value", "delta", "vega"),
                   {"value": 3, "delta": 6, "vega": 3})


C.add("grid_points", """
  SELECT ticker, structure, price, lead(price) OVER w AS nextp, v, lead(v) OVER w AS nextv, price = max(price) OVER (PARTITION BY ticker, structure) AS last
  FROM (SELECT g.ticker, g.structure, g.price, sum(l.side * (CASE l.kind WHEN 'stock' THEN g.price
      WHEN 'call' THEN greatest(g.price - l.strike, 0) ELSE greatest(l.strike - g.price, 0) END - l.premium)) AS v
    FROM (SELECT DISTINCT ticker, structure, 0.0 AS price FROM leg_priced UNION SELECT ticker, structure, strike FROM leg_priced
          WHERE strike IS NOT NULL UNION SELECT ticker, structure, max(strike) * 2 + 1 FROM leg_priced GROUP BY 1, 2) g
    JOIN leg_priced l USING (ticker, structure) GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY ticker, structure ORDER BY price)""")
C.add("slopes", "SELECT ticker, structure, sum(CASE kind WHEN 'put' THEN 0 ELSE side END) AS slope FROM leg_priced GROUP BY 1, 2")
C.add("evens", """
  SELECT DISTINCT ticker, structure, round(CASE WHEN v = 0 THEN price WHEN NOT last AND v * nextv < 0
      THEN price + (nextp - price) * (-v) / (nextv - v)
      WHEN last AND slope <> 0 AND v * slope < 0 THEN price - v / slope END, 2) AS b
  FROM grid_points JOIN slopes USING (ticker, structure)""")


@query("option_extremes", f"""
  WITH x AS (SELECT ticker, structure, max(v) AS hi, min(v) AS lo FROM grid_points GROUP BY 1, 2)
  SELECT ticker, structure, {r('CASE WHEN slope <= 0 THEN hi END', 2, 'max_profit')}, {r('CASE WHEN slope >= 0 THEN lo END', 2, 'max_loss')},
    (SELECT count(b) FROM evens e WHERE e.ticker = x.ticker AND e.structure = x.structure) AS n_breakevens,
    (SELECT round(sum(b), 2) + 0.0 FROM evens e WHERE e.ticker = x.ticker AND e.structure = x.structure) AS sum_breakevens
  FROM x JOIN slopes USING (ticker, structure)""")
def _extremes(spark, sf):
    a = options.analyse(_spots(spark, sf))
    total = F.aggregate("breakevens", F.lit(0.0), lambda acc, x: acc + x)
    out = a.select(*options.KEYS, "max_profit", "max_loss", F.size("breakevens").cast("bigint").alias("n_breakevens"),
                   total.alias("sum_breakevens"))
    return rounded(out, {"max_profit": 2, "max_loss": 2, "sum_breakevens": 2})


@query("option_structures", f"""
  SELECT ticker, structure, {r("sum(CASE WHEN kind <> 'stock' THEN -side * premium * 100 ELSE 0 END)", 2, 'net_premium')},
    {r('sum(side * delta) * 100', 4, 'delta')}, {r('sum(side * gamma) * 100', 6, 'gamma')},
    {r('sum(side * theta) / 365 * 100', 4, 'theta_per_day')}, {r('sum(side * vega) / 100 * 100', 4, 'vega_per_point')}
  FROM leg_priced GROUP BY ticker, structure""")
def _structures(spark, sf):
    a = options.analyse(_spots(spark, sf), lot_size=100)
    out = a.select(*options.KEYS, "net_premium", "delta", "gamma", "theta_per_day", "vega_per_point")
    return rounded(out, {"net_premium": 2, "delta": 4, "gamma": 6, "theta_per_day": 4, "vega_per_point": 4})


@query("option_payoff_grid", """
  WITH e AS (SELECT DISTINCT ticker, structure, spot, spot * 0.7 AS lo, spot * 1.3 AS hi FROM leg_priced),
  p AS (SELECT ticker, structure, CASE WHEN j = 60 THEN hi ELSE lo + j * ((hi - lo) / 60) END AS price
        FROM e, (SELECT unnest(range(0, 61)) AS j) k
        UNION SELECT e.ticker, e.structure, strike FROM e JOIN leg_priced l USING (ticker, structure) WHERE strike BETWEEN lo AND hi
        UNION SELECT e.ticker, e.structure, b FROM e JOIN evens v USING (ticker, structure) WHERE b BETWEEN lo AND hi)
  SELECT ticker, structure, count(*) AS points FROM p GROUP BY ticker, structure""")
def _grid(spark, sf):
    g = options.payoff_grid(options.analyse(_spots(spark, sf)))
    return g.groupBy(*options.KEYS).agg(F.count(F.lit(1)).alias("points"))


@query("option_ideas", """
  WITH s AS (SELECT ticker, decision, regime FROM daily_signals QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1)
  SELECT ticker, decision AS signal, regime, unnest(CASE decision WHEN 'BUY' THEN ['bull_call_spread', 'long_call', 'covered_call']
      WHEN 'SELL' THEN ['bear_put_spread', 'long_put', 'protective_put'] ELSE ['iron_condor', 'covered_call', 'long_straddle'] END
    || CASE WHEN regime = 'volatile' AND decision <> 'HOLD' THEN ['long_straddle'] ELSE [] END) AS structure FROM s""")
def _ideas(spark, sf):
    ev = signals.evidence(signals_table(spark, sf)).select("ticker", "signal", "regime")
    return options.structures_for(ev)
