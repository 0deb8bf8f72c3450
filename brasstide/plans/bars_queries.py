"""Bar tables: reading, upkeep, calendar, returns and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.functions import markets
from brasstide.operators import analytics, rules
from brasstide.plans.market_sql import C, EXCHANGE
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import r
from brasstide.sources import maintenance
from brasstide.sources.derived import bars, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


@query("read_bars", """
  SELECT * FROM bars WHERE ticker IN ('P1', 'SPY') AND provider = 'synthetic'
    AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def _read(spark, sf):
    return maintenance.read_bars(bars(spark, sf), ["P1", "SPY"], "synthetic", "1996-01-01", "1998-12-31")


@query("clean_rows", """
  SELECT ticker, day, open, high, low, close, adj_close,
         CASE WHEN day_of_month = 9 THEN 0 ELSE volume END AS volume, provider
  FROM (SELECT *, day(day) AS day_of_month FROM bars) WHERE day_of_month NOT IN (13, 20)""")
def _clean(spark, sf):
    # Holes as a provider leaves them: a missing close, a NaN high, a missing volume.
    d = F.dayofmonth("day")
    raw = bars(spark, sf).withColumns({
        "close": F.when(d != 13, F.col("close")),
        "high": F.when(d == 20, F.lit(float("nan"))).otherwise(F.col("high")),
        "volume": F.when(d != 9, F.col("volume"))})
    return maintenance.clean_rows(raw)


def _incoming(df):
    return (df.filter(F.month("day") <= 2)
            .withColumns({"close": F.col("close") + 1.0, "provider": F.when(
                F.month("day") == 1, "synthetic").otherwise("other")}))


@query("upsert_same_provider", """
  SELECT ticker, day, open, high, low, CASE WHEN month(day) = 1 THEN close + 1 ELSE close END AS close,
         adj_close, volume, provider FROM bars""")
def _upsert(spark, sf):
    b = bars(spark, sf)
    return maintenance.upsert_same_provider(b, _incoming(b))


@query("merge_refetch", """
  SELECT ticker, day, open, high, low, close + CASE WHEN year(day) >= 1997 THEN 0.5 ELSE 0 END AS close,
         adj_close, volume, provider FROM bars WHERE year(day) <= 1998 OR year(day) >= 1997""")
def _refetch(spark, sf):
    b = bars(spark, sf)
    fresh = b.filter(F.year("day") >= 1997).withColumn("close", F.col("close") + 0.5)
    return maintenance.merge_refetch(b.filter(F.year("day") <= 1998), fresh)


_NOW = "TIMESTAMP '2024-01-29 18:43:00'"
_FETCH_SQL = """
  (SELECT event_type AS provider, user_id, CAST(ts AS DATE) AS start_day,
          CAST(ts AS DATE) + INTERVAL 20 DAY AS end_day, ts + INTERVAL 20 DAY AS fetched_at FROM events)"""


@query("covered_requests", f"""
  WITH f AS (SELECT concat('U', user_id, CASE WHEN event_type = 'view' THEN '.NS' ELSE '' END) AS ticker,
                    event_type AS provider, CAST(ts AS DATE) AS start_day,
                    CAST(CAST(ts AS DATE) + INTERVAL 20 DAY AS DATE) AS end_day,
                    ts + INTERVAL 20 DAY AS fetched_at FROM events),
       q AS (SELECT DISTINCT ticker, provider, start_day + 2 AS start_day, end_day - 1 AS end_day FROM f),
       t AS (SELECT *, {_NOW} - INTERVAL 240 HOUR AS stale,
                    CASE WHEN ticker LIKE '%.NS' THEN TIMESTAMP '2024-01-29 10:30:00'
                         ELSE TIMESTAMP '2024-01-26 21:30:00' END AS closed FROM q)
  SELECT ticker, provider, start_day, end_day FROM t WHERE EXISTS (
    SELECT 1 FROM f WHERE f.ticker = t.ticker AND f.provider = t.provider
      AND f.start_day <= t.start_day AND f.end_day >= t.end_day
      AND f.fetched_at >= CASE WHEN t.end_day >= CAST(closed AS DATE) THEN greatest(stale, closed)
                               ELSE stale END)""")
def _covered(spark, sf):
    e = table(spark, sf, "events")
    ticker = F.concat(F.lit("U"), F.col("user_id").cast("string"),
                      F.when(F.col("event_type") == "view", ".NS").otherwise(""))
    f = e.select(ticker.alias("ticker"), F.col("event_type").alias("provider"),
                 F.to_date("ts").alias("start_day"), F.date_add(F.to_date("ts"), 20).alias("end_day"),
                 (F.col("ts") + F.expr("INTERVAL 20 DAY")).alias("fetched_at"))
    q = f.select("ticker", "provider", F.date_add("start_day", 2).alias("start_day"),
                 F.date_sub("end_day", 1).alias("end_day")).distinct()
    return maintenance.covered(q, f, F.expr(_NOW), ttl_hours=240)


@query("load_report", """
  SELECT ticker, count(*) AS trading_days, min(day) AS first_day, max(day) AS last_day,
         coalesce(max(gap), 0) AS largest_gap_days, count(*) < 750 AS limited,
         round(count(*) / 252, 2) AS years,
         CASE WHEN coalesce(max(gap), 0) > 7 THEN concat('GAP of ', max(gap), ' days')
              WHEN count(*) < 750 THEN 'limited history' ELSE '' END AS note
  FROM (SELECT ticker, day, day - lag(day) OVER (PARTITION BY ticker ORDER BY day) AS gap FROM bars)
  GROUP BY ticker""")
def _report(spark, sf):
    return maintenance.load_report(bars(spark, sf))


@query("adjusted_prices", f"""
  SELECT ticker, day, {r('o', 6, 'open')}, {r('h', 6, 'high')}, {r('l', 6, 'low')}, {r('c', 6, 'close')}
  FROM adj_px""")
def _adjusted(spark, sf):
    out = rules.adjusted_prices(bars(spark, sf)).select("ticker", "day", "open", "high", "low", "close")
    return rounded(out, {c: 6 for c in ("open", "high", "low", "close")})


@query("market_of_ticker", """
  WITH s AS (SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN ' brk.b' WHEN 1 THEN 'sbin.ns'
               WHEN 2 THEN '^nsei' WHEN 3 THEN 'Dixon.BO ' ELSE 'nvda' END AS raw FROM supplier)
  SELECT s_suppkey, CASE WHEN raw = ' brk.b' THEN 'BRK-B' ELSE upper(trim(raw)) END AS ticker,
    CASE WHEN raw IN ('sbin.ns', '^nsei') THEN 'NSE' WHEN raw = 'Dixon.BO ' THEN 'BSE' ELSE 'US' END AS exchange,
    CASE WHEN raw IN (' brk.b', 'nvda') THEN 'USD' ELSE 'INR' END AS currency,
    CASE WHEN raw IN (' brk.b', 'nvda') THEN 'flat_bps' ELSE 'india_equity_delivery' END AS cost_model,
    raw IN (' brk.b', 'nvda') AS allows_short,
    CASE WHEN raw IN ('sbin.ns', '^nsei') THEN '^NSEI' WHEN raw = 'Dixon.BO ' THEN '^BSESN' ELSE 'SPY' END
      AS benchmark FROM s""")
def _market(spark, sf):
    k = F.col("s_nationkey") % 5
    raw = (F.when(k == 0, " brk.b").when(k == 1, "sbin.ns").when(k == 2, "^nsei")
           .when(k == 3, "Dixon.BO ").otherwise("nvda"))
    df = table(spark, sf, "supplier").select("s_suppkey", markets.normalize_ticker(raw).alias("ticker"))
    return markets.with_market(df).select("s_suppkey", "ticker", "exchange", "currency", "cost_model",
                                          "allows_short", "benchmark")


@query("completed_bars", f"""
  SELECT b.* FROM bars b WHERE NOT (day = DATE '1998-12-01' AND ({EXCHANGE}) = 'US')""")
def _completed(spark, sf):
    return maintenance.completed_bars(bars(spark, sf), F.expr("TIMESTAMP '1998-12-01 12:00:00'"))


@query("last_close", """
  WITH c AS (SELECT event_id, ts, d FROM events, (SELECT unnest(range(0, 4)) AS d) k)
  SELECT event_id, max(CAST(CAST(ts AS DATE) - CAST(d AS INT) AS TIMESTAMP) + INTERVAL 630 MINUTE) AS last_close
  FROM c WHERE CAST(CAST(ts AS DATE) - CAST(d AS INT) AS TIMESTAMP) + INTERVAL 630 MINUTE <= ts
    AND isodow(CAST(ts AS DATE) - CAST(d AS INT)) < 6 GROUP BY event_id""")
def _last_close(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", maintenance.last_close(F.col("ts").cast("timestamp"),
                                                       F.lit(630)).cast("timestamp_ntz").alias("last_close"))


@query("returns", f"""
  SELECT ticker, day, {r('adj_close / lag(adj_close) OVER w - 1', 9, 'simple_return')},
    {r('ln(adj_close / lag(adj_close) OVER w)', 9, 'log_return')} FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY day)""")
def _returns(spark, sf):
    out = analytics.returns(bars(spark, sf)).select("ticker", "day", "simple_return", "log_return")
    return rounded(out, {"simple_return": 9, "log_return": 9})


C.add("dd", """
  SELECT ticker, day, adj_close, adj_close / max(adj_close) OVER (PARTITION BY ticker ORDER BY day
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS fall FROM bars""")
C.add("troughs", "SELECT ticker, min(fall) AS f, min_by(day, (fall, day)) AS trough_day FROM dd GROUP BY ticker")
C.add("drawdowns", """
  SELECT t.ticker, any_value(f) AS max_drawdown, min_by(day, (-adj_close, day)) AS peak_day,
         any_value(trough_day) AS trough_day
  FROM troughs t JOIN dd d ON d.ticker = t.ticker AND d.day <= t.trough_day GROUP BY t.ticker""")


@query("max_drawdown", f"SELECT ticker, {r('max_drawdown', 8, 'max_drawdown')}, peak_day, trough_day FROM drawdowns")
def _drawdown(spark, sf):
    return rounded(analytics.max_drawdown(bars(spark, sf)), {"max_drawdown": 8})


C.add("paired", f"""
  SELECT a.ticker, a.adj_close / lag(a.adj_close) OVER w - 1 AS ra, b.adj_close / lag(b.adj_close) OVER w - 1 AS rb
  FROM (SELECT *, CASE {EXCHANGE} WHEN 'NSE' THEN '^NSEI' WHEN 'BSE' THEN '^BSESN' ELSE 'SPY' END AS bench FROM bars) a
  JOIN bars b ON b.ticker = a.bench AND b.day = a.day WHERE a.ticker <> a.bench
  WINDOW w AS (PARTITION BY a.ticker ORDER BY a.day)""")


@query("beta_and_correlation", f"""
  SELECT ticker, {r('covar_samp(ra, rb) / var_samp(rb)', 7, 'beta')}, {r('corr(ra, rb)', 7, 'correlation')},
         count(rb) AS overlapping_return_days FROM paired GROUP BY ticker""")
def _beta(spark, sf):
    b = bars(spark, sf)
    marked = markets.with_market(b).filter(F.col("ticker") != F.col("benchmark"))
    index = markets.benchmark_bars(b).withColumnRenamed("ticker", "benchmark")
    pairs = analytics.with_benchmark(marked, index)
    return rounded(analytics.beta_and_correlation(pairs), {"beta": 7, "correlation": 7})


_SUMMARY = {"total_return": 7, "annualised_return": 7, "annualised_volatility": 7, "best_day": 7,
            "worst_day": 7, "sharpe_ratio": 6, "max_drawdown": 7, "beta": 6, "correlation": 6}


@query("price_summary", f"""
  WITH x AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS q FROM bars),
  s AS (SELECT ticker, min(day) AS "start", max(day) AS "end", count(*) AS trading_days,
     max_by(adj_close, day) / min_by(adj_close, day) AS g, stddev_samp(q) * sqrt(252) AS vol,
     max(q) AS best, min(q) AS worst FROM x GROUP BY ticker HAVING count(*) >= 2),
  p AS (SELECT ticker, covar_samp(ra, rb) / var_samp(rb) AS b, corr(ra, rb) AS c, count(rb) AS n FROM paired GROUP BY ticker)
  SELECT s.ticker, {EXCHANGE.replace('ticker', 's.ticker')} AS exchange,
    CASE exchange WHEN 'NSE' THEN '^NSEI' WHEN 'BSE' THEN '^BSESN' ELSE 'SPY' END AS benchmark,
    "start", "end", trading_days, {r('g - 1', 7, 'total_return')},
    {r('power(g, 252.0 / (trading_days - 1)) - 1', 7, 'annualised_return')}, {r('vol', 7, 'annualised_volatility')},
    {r('best', 7, 'best_day')}, {r('worst', 7, 'worst_day')},
    {r('(power(g, 252.0 / (trading_days - 1)) - 1) / vol', 6, 'sharpe_ratio')},
    {r('d.max_drawdown', 7, 'max_drawdown')}, peak_day, trough_day, {r('b', 6, 'beta')},
    {r('c', 6, 'correlation')}, n AS overlapping_return_days
  FROM s JOIN drawdowns d USING (ticker) LEFT JOIN p USING (ticker)""")
def _summary(spark, sf):
    return rounded(analytics.summary(bars(spark, sf)), _SUMMARY)


@query("price_range", """
  SELECT ticker, DATE '1996-03-01' AS "start", DATE '1998-06-30' AS "end", count(*) AS trading_days,
    min(day) AS first_day, min_by(close, day) AS first_close, max(day) AS last_day,
    max_by(close, day) AS last_close, max(close) AS high, min_by(day, (-close, day)) AS high_day,
    min(close) AS low, min_by(day, (close, day)) AS low_day,
    round(max_by(close, day) - min_by(close, day), 4) + 0.0 AS change,
    round((max_by(close, day) - min_by(close, day)) / min_by(close, day) * 100, 4) + 0.0 AS change_pct,
    count(*) > 250 AS series_truncated
  FROM bars WHERE day BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' GROUP BY ticker""")
def _range(spark, sf):
    b = bars(spark, sf)
    req = b.select("ticker").distinct().withColumns({
        "start": F.lit("1996-03-01").cast("date"), "end": F.lit("1998-06-30").cast("date")})
    return rounded(analytics.price_range(b, req), {"change": 4, "change_pct": 4})


@query("recent_points", """
  SELECT ticker, day, close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) <= 250""")
def _points(spark, sf):
    return analytics.recent_points(bars(spark, sf)).select("ticker", "day", "close")


_CARDS = f"""
  SELECT ticker, {EXCHANGE} AS exchange, CASE {EXCHANGE} WHEN 'US' THEN '$' ELSE '₹' END AS currency_symbol,
    max(day) AS as_of, round(max(close) FILTER (k = 1), 2) AS price,
    round((max(close) FILTER (k = 1) / max(close) FILTER (k = 2) - 1) * 100, 2) + 0.0 AS change_pct,
    string_agg(printf('%.2f', close), ' ' ORDER BY day) AS sparkline
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS k FROM bars)
  WHERE k <= 60 GROUP BY ticker"""


@query("watchlist_cards", f"SELECT * EXCLUDE (sparkline), length(sparkline) AS spark_chars FROM ({_CARDS})")
def _cards(spark, sf):
    out = analytics.cards(bars(spark, sf)).withColumn("spark_chars", F.length("sparkline").cast("bigint"))
    return rounded(out.drop("sparkline"), {"change_pct": 2})


@query("market_strip", f"""
  SELECT ticker, exchange, CASE WHEN ticker LIKE '^%' OR ticker = 'SPY' THEN 'index' ELSE 'stock' END AS kind,
    currency_symbol, price, change_pct, as_of FROM ({_CARDS})""")
def _strip(spark, sf):
    return rounded(analytics.strip(analytics.cards(bars(spark, sf))), {"change_pct": 2})


@query("historical_volatility", f"""
  WITH k AS (SELECT ticker, day, close, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS k,
                    ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY day)) AS lr FROM bars)
  SELECT ticker, max(day) AS as_of, max_by(close, day) AS spot, {r('stddev_samp(lr) * sqrt(252)', 7, 'sigma')}
  FROM k WHERE k <= 30 GROUP BY ticker HAVING count(lr) = 30""")
def _hv(spark, sf):
    return rounded(analytics.historical_volatility(bars(spark, sf)), {"sigma": 7})


@query("view_freshness", f"""
  WITH v AS (SELECT ticker, max(day) AS as_of, max_by(close, day) AS close FROM bars GROUP BY ticker)
  SELECT concat('report:', ticker) AS key, as_of,
    CASE WHEN close > 100 THEN 'v2' ELSE 'v1' END AS code_version,
    close > 100 AND CAST(as_of AS TIMESTAMP) + INTERVAL 12 HOUR >= TIMESTAMP '2001-07-31 21:30:00' AS fresh FROM v""")
def _views(spark, sf):
    v = bars(spark, sf).groupBy("ticker").agg(F.max("day").alias("as_of"), F.max_by("close", "day").alias("close"))
    rows = maintenance.view_rows(v, F.concat(F.lit("report:"), F.col("ticker")), F.col("as_of"), "v2",
                                 F.col("as_of").cast("timestamp") + F.expr("INTERVAL 12 HOUR"))
    close = F.get_json_object("payload", "$.close").cast("double")
    rows = rows.withColumn("code_version", F.when(close > 100, F.col("code_version")).otherwise("v1"))
    out = maintenance.fresh_views(rows, "v2", F.expr("TIMESTAMP '2001-08-01 12:00:00'"), F.lit(21 * 60 + 30))
    return out.select("key", "as_of", "code_version", "fresh")


@query("session_union", """
  SELECT DISTINCT day, month(day) AS month FROM bars WHERE ticker IN ('SPY', '^NSEI')""")
def _union(spark, sf):
    b = bars(spark, sf)
    days = b.filter("ticker = 'SPY'").select("day").union(b.filter("ticker = '^NSEI'").select("day"))
    return days.dropDuplicates().withColumn("month", F.month("day"))
