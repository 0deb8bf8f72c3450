"""Ensembles of the rules, how alike the rules are, and what adopting another would take."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from brasstide.operators import ensembles, signals
from brasstide.plans import signals_queries as base
from brasstide.plans.market_sql import C, RISK, STATS, simulate
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import r
from brasstide.sources.derived import written

QUERIES, SQL = {}, {}
VOTERS = sorted(signals.VOTERS)
PAIRS = list(combinations(VOTERS, 2))


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


def positions_table(spark, sf):
    return ensembles.ensemble_positions(base.day_table(spark, sf))


def position_rows(spark, sf):
    return positions_table(spark, sf).select("ticker", "day", F.inline("runs"))


_PRICED = ["open", "close", "buy_rate", "sell_rate", "per_sale"]


def _entry(name, value, target):
    return F.struct(value.alias(name), target.alias("target"))


def metric_rows(spark, sf):
    """Figures of every ensemble and of holding over the evaluated window."""
    def make():
        # The window holds its days' positions: they are named, not joined to it.
        days = base.window_table(spark, sf).withColumn("runs", ensembles.position_runs())
        said = F.transform("runs", lambda x: _entry("ensemble", x["ensemble"], x["position"]))
        held = F.array(_entry("ensemble", F.lit("buy_and_hold"), F.lit(1.0)))
        return ensembles.full_metrics(days.withColumn("runs", F.concat(said, held)), "ensemble")
    return written(spark, sf, "ensemble_metrics", make)


_UP = "(PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _mean(weight):
    return (f"round(CASE WHEN sum({weight}) > 0 THEN sum({weight} * vote) / sum({weight}) ELSE 0 END, 12)")


C.add("ensemble_scores", f"""
  SELECT ticker, day, i, count(*) FILTER (skipped IS NULL) AS n, {_mean('weight * mult')} AS regime,
    {_mean('weight')} AS performance, {_mean('CASE WHEN skipped IS NULL THEN 1.0 END')} AS equal,
    count(*) FILTER (skipped IS NULL AND target > 0) AS ins,
    max_by(target, (round(train_sharpe, 4), rule)) FILTER (skipped IS NULL) AS best
  FROM voter_votes GROUP BY ticker, day, i""")
C.add("ensemble_said", """
  SELECT ticker, day, i, unnest(['regime', 'performance', 'equal', 'majority', 'best_rule']) AS ensemble,
    unnest([CASE WHEN n > 0 THEN CASE WHEN regime >= 0.25 THEN 1.0 WHEN regime <= -0.25 THEN 0.0 END END,
            CASE WHEN n > 0 THEN CASE WHEN performance >= 0.25 THEN 1.0 WHEN performance <= -0.25 THEN 0.0 END END,
            CASE WHEN n > 0 THEN CASE WHEN equal >= 0.25 THEN 1.0 WHEN equal <= -0.25 THEN 0.0 END END,
            CASE WHEN n > 0 THEN CASE WHEN ins > n / 2 THEN 1.0 ELSE 0.0 END END,
            CASE WHEN n > 0 THEN CASE WHEN best > 0 THEN 1.0 ELSE 0.0 END END]) AS said FROM ensemble_scores""")
C.add("ensemble_days", """
  SELECT ticker, day, ensemble, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY ticker, ensemble ORDER BY day
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS position FROM ensemble_said""")


@query("ensemble_positions", "SELECT ticker, day, ensemble, position FROM ensemble_days")
def _positions(spark, sf):
    return position_rows(spark, sf).select("ticker", "day", "ensemble", "position")


C.add("ensemble_runs", """
  SELECT a.ticker, a.day, a.o, a.c, e.ensemble, e.position AS target FROM assessed a JOIN ensemble_days e USING (ticker, day)
  UNION ALL SELECT ticker, day, o, c, 'buy_and_hold', 1.0 FROM assessed""")
simulate("ens_net", "ensemble_runs", "ticker, ensemble", 100000.0)
simulate("ens_gross", "ensemble_runs", "ticker, ensemble", 100000.0, slip=0.0, costs="flat:0.0")


def _round_equity(name):
    C.add(f"{name}_r", f"""
      SELECT * EXCLUDE (equity, ret, dd), round(equity, 4) AS equity, round(equity, 4) / lag(round(equity, 4)) OVER w - 1 AS ret,
        round(equity, 4) / max(round(equity, 4)) OVER (PARTITION BY ticker, ensemble ORDER BY day
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd,
        held <> lag(held) OVER w AS ch FROM {name} WINDOW w AS (PARTITION BY ticker, ensemble ORDER BY day)""")


_round_equity("ens_net")
_round_equity("ens_gross")
C.add("ens_metrics", f"""
  SELECT n.ticker, n.ensemble, n.cagr, n.max_drawdown, n.sharpe, n.sortino, n.time_in_market AS exposure,
    turnover_per_year, round(g.cagr - n.cagr, 4) + 0.0 AS cost_drag
  FROM (SELECT ticker, ensemble, {RISK}, round(switched / (bars / 252), 2) AS turnover_per_year FROM (
      SELECT ticker, ensemble, count(*) FILTER (ch) AS switched, count(*) AS bars, {STATS} FROM ens_net_r GROUP BY ticker, ensemble)) n
  JOIN (SELECT ticker, ensemble, {RISK} FROM (SELECT ticker, ensemble, {STATS} FROM ens_gross_r GROUP BY ticker, ensemble)) g
  USING (ticker, ensemble)""")


@query("ensemble_metrics", "SELECT * FROM ens_metrics")
def _metrics(spark, sf):
    return rounded(metric_rows(spark, sf), {c: 4 for c in ("cagr", "max_drawdown", "sharpe", "sortino",
                                                          "exposure", "cost_drag")})


@query("ensemble_adoption", """
  WITH b AS (SELECT ticker, sharpe AS base FROM ens_metrics WHERE ensemble = 'regime'),
  x AS (SELECT m.ensemble, m.sharpe, b.base FROM ens_metrics m JOIN b USING (ticker) WHERE ensemble <> 'regime')
  SELECT ensemble, round(median(sharpe) - median(base), 6) + 0.0 AS median_sharpe_difference,
    count(*) FILTER (sharpe IS NOT NULL AND (base IS NULL OR sharpe > base)) AS wins, count(*) AS tickers,
    round(median(sharpe) - median(base), 6) >= 0.1 AND
      count(*) FILTER (sharpe IS NOT NULL AND (base IS NULL OR sharpe > base)) >= 2 * count(*) / 3 AS passes
  FROM x GROUP BY ensemble""")
def _adoption(spark, sf):
    return rounded(ensembles.adoption(metric_rows(spark, sf)), {"median_sharpe_difference": 6})


C.add("wide_ret", "SELECT ticker, day, i, " + ", ".join(
    f"max(q) FILTER (rule = '{k}') AS {k}" for k in VOTERS) + " FROM voter_ret GROUP BY ticker, day, i")


def _corr_rows(source, keys):
    items = ", ".join(
        f"struct_pack(a := '{a}', b := '{b}', v := CASE WHEN stddev_samp({a}) > 1e-12 AND stddev_samp({b}) > 1e-12 "
        f"THEN corr({a}, {b}) END)" for a, b in PAIRS)
    return f"SELECT {keys}, unnest([{items}]) AS e FROM {source} GROUP BY {keys}"


C.add("rule_corr", _corr_rows("wide_ret", "ticker"))


@query("rule_correlation", f"SELECT ticker, e.a AS rule_a, e.b AS rule_b, {r('e.v', 5, 'corr')} FROM rule_corr")
def _corr(spark, sf):
    wide = ensembles.wide_returns(base.traded(spark, sf, fields=("ret",)))
    return rounded(ensembles.correlations(wide, ["ticker"]), {"corr": 5})


@query("average_correlation", f"""
  SELECT e.a AS rule_a, e.b AS rule_b, {r('avg(e.v)', 6, 'corr')}, count(e.v) AS tickers,
    coalesce(avg(e.v) > 0.8, false) AS redundant FROM rule_corr GROUP BY 1, 2""")
def _average(spark, sf):
    wide = ensembles.wide_returns(base.traded(spark, sf, fields=("ret",)))
    return rounded(ensembles.average_correlation(ensembles.correlations(wide, ["ticker"])), {"corr": 6})


def cluster_table(spark, sf):
    def make():
        f = written(spark, sf, "fits", lambda: signals.fits(base.fit_runs(spark, sf)))
        pairs = ensembles.refit_correlations(ensembles.wide_returns(base.traded(spark, sf, fields=("ret",))), f)
        return ensembles.clusters(f, pairs)
    return written(spark, sf, "clusters", make)


@query("rule_clusters")
def _clusters(spark, sf):
    return cluster_table(spark, sf)


@query("variant_without_rule", f"""
  WITH s AS (SELECT ticker, day, {_mean('weight * mult')} AS score FROM voter_votes WHERE rule <> 'macd_cross' GROUP BY ticker, day)
  SELECT ticker, day, {r('score', 6, 'score')}, coalesce(last_value(CASE WHEN score >= 0.25 THEN 1.0 WHEN score <= -0.25
    THEN 0.0 END IGNORE NULLS) OVER {_UP}, 0.0) AS position FROM s""")
def _variant(spark, sf):
    v = ensembles.variant_positions(base.votes_table(spark, sf), exclude=("macd_cross",))
    return rounded(v.select("ticker", "day", "score", "position"), {"score": 6})


@query("variant_one_vote_per_cluster")
def _cluster_variant(spark, sf):
    v = ensembles.variant_positions(base.vote_table(spark, sf), leader_rows=cluster_table(spark, sf))
    return rounded(v.select("ticker", "day", "score", "position"), {"score": 6})


@query("position_agreement", f"""
  SELECT a.ticker, {r('avg(CAST((a.position > 0) = (b.position > 0) AS INT))', 6, 'agreement')}, count(*) AS days,
    count(*) FILTER (a.position <> b.position) AS changed
  FROM ensemble_days a JOIN ensemble_days b ON a.ticker = b.ticker AND a.day = b.day
    AND a.ensemble = 'regime' AND b.ensemble = 'equal' GROUP BY a.ticker""")
def _agreement(spark, sf):
    p = position_rows(spark, sf)
    out = ensembles.agreement(p.filter("ensemble = 'regime'"), p.filter("ensemble = 'equal'"))
    return rounded(out, {"agreement": 6})


C.add("rule_runs", """
  SELECT v.ticker, v.day, v.o, v.c, v.rule AS ensemble, v.target FROM voter_ret v JOIN assessed a USING (ticker, day)""")
simulate("rule_net", "rule_runs", "ticker, ensemble", 100000.0)
_round_equity("rule_net")


@query("best_rule_in_hindsight", f"""
  WITH m AS (SELECT ticker, ensemble AS rule, {RISK} FROM (SELECT ticker, ensemble, {STATS} FROM rule_net_r GROUP BY ticker, ensemble))
  SELECT ticker, rule, sharpe, cagr FROM m
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY coalesce(sharpe, -1e300) DESC, rule DESC) = 1""")
def _hindsight(spark, sf):
    # The window holds what each of its days' rules held, in the voters' order; some may not vote on every market.
    names = [k for k in signals.VOTERS if k != "sma_cross_long_short"]
    named = F.when(F.size("targets") == len(signals.VOTERS), F.array(*map(F.lit, signals.VOTERS))).otherwise(F.array(*map(F.lit, names)))
    runs = base.window_table(spark, sf).withColumn("runs", F.zip_with(named, "targets", lambda k, x: _entry("rule", k, x)))
    best = ensembles.best_in_hindsight(ensembles.full_metrics(runs, "rule"))
    return rounded(best, {"sharpe": 4, "cagr": 4})
