"""Walk-forward signals, their evidence and their out-of-sample record."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import analytics, assessment, backtest, ensembles, rules, signals
from brasstide.plans.market_sql import C, EXCHANGE, RISK, STATS, simulate
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import r
from brasstide.sources.derived import bars, written

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


# -- shared tables: computed once per application, then scanned ---------------------------------

def traded(spark, sf, **options):
    """What `signals.rule_runs` makes of the bars; not stored: of a bar's runs only what is asked for leaves the task."""
    return signals.voting_runs(bars(spark, sf), **options)


def fit_runs(spark, sf):
    """The runs on refit rows."""
    return traded(spark, sf, drift=True, fields=("sharpe_long", "sharpe_short", "cusum"), due=0)


def vote_table(spark, sf):
    """Made from the bars: of the runs only the votes are kept."""
    return written(spark, sf, "votes", lambda: signals.vote_runs(traded(spark, sf, drift=True, refit_day=0)))


def votes_table(spark, sf):
    return signals.vote_rows(vote_table(spark, sf))


def day_table(spark, sf):
    """The signals, and of the same votes what the rules and the ensembles hold, the last day's votes, and the
    evaluated window, which is read from here and not stored again."""
    return written(spark, sf, "signals", lambda: signals.signals(signals.vote_runs(traded(
        spark, sf, refit_day=0, signal={**signals.TARGETS, **ensembles.POSITIONS, **signals.LATEST, **assessment.WINDOW}))))


def signals_table(spark, sf):
    return day_table(spark, sf).drop("targets", "ensembles", "votes", *assessment.WINDOW)


def last_votes(spark, sf):
    return signals.vote_rows(day_table(spark, sf).filter("votes IS NOT NULL").select("ticker", "day", "bar", "votes"))


def window_table(spark, sf):
    return assessment.window(day_table(spark, sf).drop("votes"))


# -- the same chain in SQL ---------------------------------------------------------------------

VOTERS = signals.VOTERS
_w = "(PARTITION BY ticker, rule ORDER BY day)"


def _last(n):
    return f"(PARTITION BY ticker, rule ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _list(values):
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


C.add("voter_runs", f"""
  SELECT * FROM (SELECT ticker, day, i, o, c, regime, {EXCHANGE} AS exchange, unnest({_list(VOTERS)}) AS rule,
    unnest([{', '.join(VOTERS)}]) AS target, unnest({_list([rules.CATALOGUE[k].warmup for k in VOTERS])}) AS warmup,
    unnest({_list([rules.CATALOGUE[k].style for k in VOTERS])}) AS style,
    row_number() OVER (PARTITION BY ticker, date_trunc('month', day) ORDER BY day) - 1 AS month_day FROM targets)
  WHERE NOT (rule = 'sma_cross_long_short' AND exchange <> 'US')""")
simulate("voter_sim", "voter_runs", "ticker, rule", 100000.0)
C.add("voter_ret", f"""
  SELECT ticker, rule, day, i, o, c, target, exchange, regime, warmup, style, month_day,
    coalesce(round(equity, 4) / lag(round(equity, 4)) OVER {_w} - 1, 0) AS q FROM voter_sim""")


def _sharpe(n):
    return (f"CASE WHEN stddev_samp(q) OVER {_last(n)} > 1e-9 THEN avg(q) OVER {_last(n)} "
            f"/ stddev_samp(q) OVER {_last(n)} * sqrt(252) ELSE 0 END")


C.add("voter_fit0", f"""
  SELECT *, i + 1 AS size, CASE WHEN i + 1 < 750 THEN 126 ELSE 504 END AS train,
    {_sharpe(126)} AS s126, {_sharpe(504)} AS s504,
    i >= 140 AND (i = 140 OR month_day = 0) AS due FROM voter_ret""")
assert signals.FIRST_BAR == 140
C.add("voter_fit1", """
  SELECT *, CASE WHEN size < 750 AND warmup > size / 3 THEN 'limited history'
                 WHEN warmup + train > size THEN 'warming up' END AS skip FROM voter_fit0""")
C.add("voter_fit", """
  SELECT *, CASE WHEN skip IS NULL THEN CASE WHEN size < 750 THEN s126 ELSE s504 END END AS sh FROM voter_fit1""")
C.add("voter_votes", f"""
  SELECT ticker, rule, day, i, o, c, target, exchange, regime, style, f.fon AS fitted_on, f.fi AS fit_bar,
    f.lim AS limited, f.train AS train_days, f.skip AS skipped, f.sh AS train_sharpe,
    CASE WHEN f.sh IS NOT NULL THEN greatest(f.sh, 0) END AS weight,
    CASE WHEN rule = 'sma_cross_long_short' AND exchange = 'US' THEN target ELSE 2 * target - 1 END AS vote,
    CASE WHEN regime IN ('trending_up', 'trending_down') AND style = 'reversion' THEN 0.5
         WHEN regime = 'ranging' AND style = 'trend' THEN 0.5 ELSE 1.0 END AS mult
  FROM (SELECT *, last_value(CASE WHEN due THEN struct_pack(fon := day, fi := i, lim := size < 750, train := train,
          skip := skip, sh := sh) END IGNORE NULLS) OVER (PARTITION BY ticker, rule ORDER BY day
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM voter_fit) WHERE i >= 140""")
C.add("daily_scores", """
  SELECT ticker, day, i, any_value(o) AS o, any_value(c) AS c, any_value(regime) AS regime,
    any_value(limited) AS limited, any_value(train_days) AS train_days, any_value(fitted_on) AS fitted_on,
    count(train_sharpe) AS eligible, count(*) FILTER (weight > 0) AS counted,
    count(*) FILTER (skipped IS NOT NULL) AS left_out, sum(weight * mult) AS den,
    round(CASE WHEN sum(weight * mult) > 0 THEN sum(weight * mult * vote) / sum(weight * mult) ELSE 0 END, 12) AS score
  FROM voter_votes GROUP BY ticker, day, i""")
_HOLD = ("coalesce(last_value(CASE WHEN score >= 0.25 THEN 1.0 WHEN score <= -0.25 THEN 0.0 END IGNORE NULLS) "
         "OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)")
C.add("daily_signals", f"""
  SELECT *, CASE WHEN score >= 0.25 THEN 'BUY' WHEN score <= -0.25 THEN 'SELL' ELSE 'HOLD' END AS decision,
    {_HOLD} AS position FROM daily_scores""")
C.add("assessed", """
  SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY ticker) AS lastday,
      lead(c, 20) OVER (PARTITION BY ticker ORDER BY day) / c - 1 AS ahead FROM daily_signals)
  WHERE day >= lastday - 1826 QUALIFY count(*) OVER (PARTITION BY ticker) >= 60""")


@query("rule_candidates", f"""
  SELECT ticker, {EXCHANGE} AS exchange, rule, reason IS NULL AS votes, reason FROM (
    SELECT ticker, rule, CASE WHEN rule = 'zscore_reversion' THEN 'restates another rule'
      WHEN rule = 'sma_cross_long_short' AND ({EXCHANGE}) <> 'US' THEN 'no overnight shorts on this market' END AS reason
    FROM (SELECT DISTINCT ticker FROM bars), (SELECT unnest({_list([k for k in rules.CATALOGUE if k != 'buy_and_hold'])}) AS rule))""")
def _candidates(spark, sf):
    return signals.candidates(bars(spark, sf).select("ticker").distinct())


@query("signal_fits", f"""
  SELECT ticker, rule, day AS fitted_on, i AS fit_bar, size < 750 AS limited, train AS train_days, skip AS skipped,
    {r('sh', 6, 'train_sharpe')}, {r('CASE WHEN sh IS NOT NULL THEN greatest(sh, 0) END', 6, 'weight')}
  FROM voter_fit WHERE due""")
def _fits(spark, sf):
    f = signals.fits(fit_runs(spark, sf)).drop("cusum", "drifting")
    return rounded(f, {"train_sharpe": 6, "weight": 6})


@query("signal_votes", f"""
  SELECT ticker, rule, day, vote, mult AS multiplier, {r('weight', 6, 'weight')} FROM voter_votes WHERE skipped IS NULL""")
def _votes(spark, sf):
    v = votes_table(spark, sf).filter("skipped is null").select("ticker", "rule", "day", "vote", "multiplier", "weight")
    return rounded(v, {"weight": 6})


@query("walk_forward_signals", f"""
  SELECT ticker, day, {r('score', 6, 'score')}, decision, position, regime, eligible, counted FROM daily_signals""")
def _signals(spark, sf):
    s = signals_table(spark, sf).select("ticker", "day", "score", "decision", "position", "regime", "eligible", "counted")
    return rounded(s, {"score": 6})


# Drift: the recent 12 five-day sums against the 88 before them, at each full-history refit.
C.add("fives", f"""
  SELECT ticker, rule, i, sum(q) OVER {_last(5)} AS five FROM voter_ret""")
C.add("drift_refits", "SELECT ticker, rule, i AS t, day FROM voter_fit WHERE due AND size >= 750 AND skip IS NULL")
C.add("drift_blocks", """
  SELECT d.ticker, d.rule, d.day, (d.t - b.i) // 5 AS back, b.five FROM drift_refits d
  JOIN fives b ON b.ticker = d.ticker AND b.rule = d.rule AND b.i <= d.t AND b.i > d.t - 500 AND (d.t - b.i) % 5 = 0""")
C.add("drift_z", """
  SELECT ticker, rule, day, list((five - m) / s ORDER BY back DESC) FILTER (back < 12) AS z FROM (
    SELECT *, avg(five) FILTER (back >= 12) OVER w AS m, stddev_samp(five) FILTER (back >= 12) OVER w AS s
    FROM drift_blocks WINDOW w AS (PARTITION BY ticker, rule, day)) WHERE s > 1e-15 GROUP BY ticker, rule, day""")


@query("strategy_drift", """
  WITH walk AS (SELECT ticker, rule, day, z, unnest(range(1, 13)) AS a FROM drift_z),
  sums AS (SELECT ticker, rule, day, a, b, list_sum([-x - 0.5 FOR x IN list_slice(z, a, b)]) AS s
           FROM walk, (SELECT unnest(range(1, 13)) AS b) k WHERE b >= a)
  SELECT ticker, rule, day AS fitted_on, round(greatest(max(s), 0), 3) + 0.0 AS cusum, greatest(max(s), 0) >= 4 AS drifting
  FROM sums GROUP BY ticker, rule, day""")
def _drift(spark, sf):
    f = signals.fits(fit_runs(spark, sf)).filter(F.col("cusum").isNotNull())
    return rounded(f.select("ticker", "rule", "fitted_on", "cusum", "drifting"), {"cusum": 3})


@query("drift_downweighted_signals")
def _down(spark, sf):
    s = signals.signals(vote_table(spark, sf), drift_downweight=True)
    return rounded(s.select("ticker", "day", "score", "decision", "position"), {"score": 6})


@query("signal_evidence", f"""
  SELECT s.ticker, s.day AS as_of, decision AS signal, {r('score', 4, 'score')},
    {r('least(abs(score) * round(train_days / 504, 4), counted / greatest(eligible, 1))', 4, 'confidence')},
    {r('abs(score) * round(train_days / 504, 4)', 4, 'confidence_uncapped')},
    concat(counted, ' of ', eligible, ' rules') AS coverage, {r('counted / greatest(eligible, 1)', 4, 'coverage_fraction')},
    s.regime, {r('t.adx', 4, 'adx')}, {r('t.rv', 5, 'volatility')}, s.i + 1 AS trading_days, limited, train_days,
    round(train_days / 504, 4) AS history_factor, fitted_on, left_out,
    concat_ws('; ', CASE WHEN eligible > 0 AND counted / eligible < 0.5 THEN 'Narrow vote' END,
      CASE WHEN limited THEN 'Limited history' END, CASE WHEN coalesce(den, 0) = 0 THEN 'No trusted rule' END) AS warnings
  FROM daily_signals s JOIN targets t USING (ticker, day)
  QUALIFY row_number() OVER (PARTITION BY s.ticker ORDER BY s.day DESC) = 1""")
def _evidence(spark, sf):
    e = signals.evidence(signals_table(spark, sf)).drop("plus_di", "minus_di", "slope", "volatility_rank")
    return rounded(e, {"score": 4, "confidence": 4, "confidence_uncapped": 4, "coverage_fraction": 4,
                       "adx": 4, "volatility": 5, "history_factor": 4})


C.add("last_votes", """
  SELECT *, round(CASE WHEN tot > 0 THEN eff / tot ELSE 0 END, 4) AS share FROM (
    SELECT *, sum(eff) OVER (PARTITION BY ticker) AS tot FROM (
      SELECT *, weight * mult AS eff, max(day) OVER (PARTITION BY ticker) AS ld FROM voter_votes)
    WHERE day = ld AND skipped IS NULL)""")


@query("signal_vote_shares", f"""
  SELECT ticker, day, row_number() OVER (PARTITION BY ticker ORDER BY share DESC, rule) AS rank, rule, style,
    CASE WHEN target > 0 THEN 'in' WHEN target < 0 THEN 'short' ELSE 'out' END AS stands, vote,
    {r('train_sharpe', 4, 'train_sharpe')}, {r('weight', 4, 'weight')}, mult AS regime_multiplier,
    {r('share', 4, 'share_of_vote')} FROM last_votes""")
def _shares(spark, sf):
    return rounded(signals.latest_votes(last_votes(spark, sf)), {"share_of_vote": 4, "train_sharpe": 4, "weight": 4})


@query("signal_switches", """
  SELECT ticker, day, CASE WHEN position > 0 THEN 'in' ELSE 'out' END AS action FROM (
    SELECT *, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY day), 0) AS was,
      max(day) OVER (PARTITION BY ticker) AS ld FROM daily_signals) WHERE position <> was AND day >= ld - 1096""")
def _switches(spark, sf):
    return signals.switches(signals_table(spark, sf))


C.add("own_runs", "SELECT ticker, day, i, o, c, unnest(['signal', 'buy_and_hold']) AS run, "
      "unnest([position, 1.0]) AS target FROM assessed")
simulate("own_sim", "own_runs", "ticker, run", 100000.0)
# Daily figures of the evaluation come from equity rounded to 4 decimals.
C.add("own_rounded", """
  SELECT * EXCLUDE (equity, ret, dd), round(equity, 4) AS equity,
    round(equity, 4) / lag(round(equity, 4)) OVER w - 1 AS ret,
    round(equity, 4) / max(round(equity, 4)) OVER (PARTITION BY ticker, run ORDER BY day
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd
  FROM own_sim WINDOW w AS (PARTITION BY ticker, run ORDER BY day)""")


@query("signal_risk", f"SELECT ticker, run, {RISK} FROM (SELECT ticker, run, {STATS} FROM own_rounded GROUP BY ticker, run)")
def _risk(spark, sf):
    m = assessment.risk(assessment.curves(window_table(spark, sf)))
    return rounded(m, {c: 4 for c in ("cagr", "max_drawdown", "sharpe", "sortino", "calmar", "time_in_market")})


@query("signal_curves", f"SELECT ticker, run, day, {r('equity', 2, 'equity')} FROM own_sim")
def _curves(spark, sf):
    return rounded(assessment.curves(window_table(spark, sf)).select("ticker", "run", "day", "equity"), {"equity": 2})


C.add("index_runs", f"""
  SELECT s.ticker, b.day, b.o, b.c, 1.0 AS target FROM (SELECT ticker, min(day) AS d0, CASE {EXCHANGE}
      WHEN 'NSE' THEN '^NSEI' WHEN 'BSE' THEN '^BSESN' ELSE 'SPY' END AS bench FROM assessed GROUP BY ticker) s
  JOIN adj_px b ON b.ticker = s.bench AND b.day >= s.d0""")
simulate("index_sim", "index_runs", "ticker", 100000.0, slip=0.0, costs="flat:0.0")


@query("index_benchmark", f"SELECT ticker, {RISK} FROM (SELECT ticker, {STATS} FROM index_sim GROUP BY ticker)")
def _index(spark, sf):
    starts, curve = assessment.index_starts(window_table(spark, sf)), ["benchmark", "day0"]
    each = backtest.risk_metrics(assessment.index_curve(starts, bars(spark, sf)), curve)
    m = starts.join(each, curve).drop(*curve)
    return rounded(m, {c: 4 for c in ("cagr", "max_drawdown", "sharpe", "sortino", "calmar", "time_in_market")})


C.add("oos", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) - 1 AS at, "
      "count(*) OVER (PARTITION BY ticker) AS m FROM assessed")
C.add("shifts", """
  SELECT ticker, k FROM (SELECT ticker, unnest(range(1, max(m))) AS k FROM oos GROUP BY ticker)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY (k * 48271) % 2147483647, k) <= 200""")
C.add("random_runs", """
  SELECT a.ticker, s.k AS shift, a.day, a.o, a.c, b.position AS target FROM oos a JOIN shifts s USING (ticker)
  JOIN oos b ON b.ticker = a.ticker AND b.at = (a.at - s.k + a.m) % a.m""")
simulate("random_sim", "random_runs", "ticker, shift", 100000.0)
C.add("random_each", f"SELECT ticker, shift, round(CASE WHEN vol > 0 THEN cagr / vol END, 6) AS ratio, "
      f"round(cagr, 6) AS cagr FROM (SELECT ticker, shift, {STATS} FROM random_sim GROUP BY ticker, shift)")
C.add("own_ratio", f"SELECT ticker, round(CASE WHEN vol > 0 THEN cagr / vol END, 6) AS own FROM "
      f"(SELECT ticker, {STATS} FROM own_sim WHERE run = 'signal' GROUP BY ticker)")
C.add("random_summary", "SELECT ticker, count(*) AS runs, " + ", ".join(
    f"round(quantile_cont({c}, {q}), 8) + 0.0 AS {n}_{s}" for c, n in (("cagr", "cagr"), ("ratio", "sharpe"))
    for q, s in ((0.05, "p5"), (0.5, "median"), (0.95, "p95")))
    + ", round(avg(CASE WHEN ratio IS NOT NULL AND own IS NOT NULL THEN CAST(ratio < own AS INT) END), 8) + 0.0 "
      "AS signal_sharpe_percentile FROM random_each JOIN own_ratio USING (ticker) GROUP BY ticker")


@query("random_retimings", "SELECT * FROM random_summary")
def _random(spark, sf):
    out = assessment.random_summary(assessment.run_figures(window_table(spark, sf)))
    cols = [c for c in out.columns if c not in ("ticker", "runs")]
    return rounded(out, {c: 8 for c in cols})


@query("hit_rate", """
  SELECT ticker, round(avg(CASE WHEN decision = 'BUY' THEN CAST(ahead > 0 AS INT) END) FILTER (ahead IS NOT NULL), 4) AS after_buy_up,
    count(*) FILTER (ahead IS NOT NULL AND decision = 'BUY') AS buy_days,
    round(avg(CAST(ahead > 0 AS INT)) FILTER (ahead IS NOT NULL), 4) AS base_rate_up,
    round(avg(CASE WHEN decision = 'SELL' THEN CAST(ahead < 0 AS INT) END) FILTER (ahead IS NOT NULL), 4) AS after_sell_down,
    count(*) FILTER (ahead IS NOT NULL AND decision = 'SELL') AS sell_days,
    round(avg(CAST(ahead < 0 AS INT)) FILTER (ahead IS NOT NULL), 4) AS base_rate_down FROM assessed GROUP BY ticker""")
def _hits(spark, sf):
    return assessment.hit_rate(window_table(spark, sf))


@query("decision_counts", "SELECT ticker, count(*) AS trading_days, count(*) FILTER (limited) AS limited_days, "
       + ", ".join(f"count(*) FILTER (decision = '{d}') AS {d.lower()}" for d in ("BUY", "SELL", "HOLD")) + ", "
       + ", ".join(f"count(*) FILTER (regime = '{x}') AS {x}" for x in
                   ("trending_up", "trending_down", "ranging", "transition", "volatile", "unknown"))
       + " FROM assessed GROUP BY ticker")
def _counts(spark, sf):
    return assessment.decision_counts(window_table(spark, sf))


@query("backtest_verdict", f"""
  WITH m AS (SELECT ticker, run, {RISK} FROM (SELECT ticker, run, {STATS} FROM own_rounded GROUP BY ticker, run)),
  s AS (SELECT * FROM m WHERE run = 'signal'), b AS (SELECT * FROM m WHERE run = 'buy_and_hold'),
  n AS (SELECT ticker, round(count(*) / 252, 2) AS years FROM assessed GROUP BY ticker)
  SELECT s.ticker, CASE WHEN s.cagr > b.cagr AND s.sharpe > b.sharpe AND z.signal_sharpe_percentile >= 0.95
                        THEN 'edge' ELSE 'no_edge' END AS verdict, years, s.cagr AS signal_cagr,
    b.cagr AS buy_and_hold_cagr, s.sharpe AS signal_sharpe, b.sharpe AS buy_and_hold_sharpe,
    s.max_drawdown AS signal_max_drawdown, b.max_drawdown AS buy_and_hold_max_drawdown,
    s.time_in_market, z.signal_sharpe_percentile AS random_percentile
  FROM s JOIN b USING (ticker) JOIN n USING (ticker) JOIN random_summary z USING (ticker)""")
def _verdict(spark, sf):
    v = assessment.verdict(assessment.verdict_inputs(window_table(spark, sf))).drop("statement")
    cols = [c for c in v.columns if c not in ("ticker", "verdict", "years")]
    return rounded(v, {c: 8 if c == "random_percentile" else 4 for c in cols})


@query("verdict_sentence")
def _sentence(spark, sf):
    return assessment.verdict(assessment.verdict_inputs(window_table(spark, sf))).select("ticker", "verdict", "statement")


@query("watchlist", """
  WITH k AS (SELECT ticker, day, close, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS k FROM bars)
  SELECT p.ticker, p.day AS as_of, round(p.close, 2) AS price, round((p.close / q.close - 1) * 100, 2) + 0.0 AS change_pct,
    s.decision AS signal, round(s.score, 4) + 0.0 AS score, concat(s.counted, ' of ', s.eligible, ' rules') AS coverage, s.regime
  FROM k p JOIN k q ON q.ticker = p.ticker AND q.k = 2 LEFT JOIN daily_signals s ON s.ticker = p.ticker AND s.day = p.day
  WHERE p.k = 1""")
def _watchlist(spark, sf):
    cards = analytics.cards(bars(spark, sf)).select("ticker", "as_of", "price", "change_pct")
    ev = signals.evidence(signals_table(spark, sf)).select("ticker", "signal", "score", "coverage", "regime")
    return rounded(cards.join(ev, "ticker", "left"), {"change_pct": 2, "score": 4})


@query("refit_day_spread")
def _refit_days(spark, sf):
    days = range(0, 20)
    runs = traded(spark, sf, fields=("target", "sharpe_long", "sharpe_short"), ended=assessment.schedule_figures(days))
    return assessment.refit_spread(runs, days)


@query("signal_report")
def _report(spark, sf):
    v = assessment.verdict(assessment.verdict_inputs(window_table(spark, sf)))
    ev = signals.evidence(signals_table(spark, sf)).select("ticker", "as_of", "signal", "score", "confidence",
                                                           "coverage", "regime", "warnings")
    marks = signals.switches(signals_table(spark, sf)).groupBy("ticker").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("day").cast("string"), "action"))), ", ")
        .alias("markers"))
    top = (signals.latest_votes(last_votes(spark, sf)).filter("rank <= 4").groupBy("ticker")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule"))),
                                         lambda x: x["rule"]), ", ").alias("heaviest_rules")))
    return (ev.join(v.select("ticker", "verdict", "statement"), "ticker", "left")
            .join(marks, "ticker", "left").join(top, "ticker", "left"))
