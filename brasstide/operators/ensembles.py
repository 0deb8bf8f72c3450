"""Other ways to combine the same rules, and how alike the rules are."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brasstide.functions.series import TRADING_DAYS
from brasstide.operators import backtest
from brasstide.operators.signals import BUY_AT, NOTIONAL, SELL_AT, VOTERS, between, carried, hold_between, mean_vote, total

ENSEMBLES = ("regime", "performance", "equal", "majority", "best_rule")
SIMILAR = 0.80


def _mean_vote(weight: Column) -> Column:
    den = F.sum(weight)
    return F.round(F.when(den > 0, F.sum(weight * F.col("vote")) / den).otherwise(0.0), 12)


def positions_of_votes(v, bars: pa.Table) -> pa.Array:
    """`ensemble_positions` of one ticker's votes (signals._Votes): an array per day, in the order of ENSEMBLES."""
    n = v.eligible.sum(axis=1)
    equal = np.where(v.eligible, 1.0, np.nan)
    scores = [mean_vote(w, v.vote)[0] for w in (v.weight * v.multiplier, v.weight, equal)]
    by_name = np.array(sorted(range(len(v.names)), key=lambda i: v.names[i], reverse=True))
    trust = np.round(np.where(v.eligible, v.sharpe[v.at], np.nan), 4)[:, by_name]
    # The highest, of equals the last by name; an eligible rule without a figure comes after all others.
    trust = np.where(np.isnan(trust), np.where(v.eligible[:, by_name], -np.inf, np.nan), trust)
    best = np.argmax(np.where(np.isnan(trust), -np.inf, trust), axis=1) if len(trust) else np.zeros(0, dtype=int)
    first = np.argmax(v.eligible[:, by_name], axis=1) if len(trust) else best
    best = by_name[np.where(v.eligible[:, by_name][np.arange(len(best)), best], best, first)]
    ins = (v.eligible & (v.target > 0)).sum(axis=1)
    said = [*map(between, scores), (ins > n / 2).astype(float), (v.target[np.arange(len(best)), best] > 0).astype(float)]
    held = np.column_stack([carried(np.where(n > 0, x, np.nan)) for x in said])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * len(ENSEMBLES)), pa.array(held.ravel()))


#: A column of days that hold every ensemble's position, for `signals.rule_runs`.
POSITIONS = {"ensembles": (T.ArrayType(T.DoubleType()), positions_of_votes)}


def position_runs(held: str = "ensembles") -> Column:
    """The day's ensembles by name."""
    return F.array(*[F.struct(F.lit(k).alias("ensemble"), F.col(held)[i].alias("position")) for i, k in enumerate(ENSEMBLES)])


def ensemble_positions(votes: DataFrame) -> DataFrame:
    """(ticker, day, bar, runs): the position of every way of combining, from the day's own votes.
    Votes of a pass that went on to the positions are named only."""
    if "ensembles" in votes.columns:
        return votes.select("ticker", "day", "bar", position_runs().alias("runs"))
    eligible = lambda x: x["skipped"].isNull()                                        # noqa: E731
    trusted = F.array_max(F.transform(F.filter("votes", eligible), lambda x: F.struct(
        F.round(x["train_sharpe"], 4).alias("s"), x["rule"].alias("rule"), x["target"].alias("target"))))
    weights = {"regime": lambda x: x["weight"] * x["multiplier"], "performance": lambda x: x["weight"],
               "equal": lambda x: F.when(eligible(x), 1.0)}
    # Each sum over a day's votes is taken once: the number of eligible votes is the weight of the equal ones.
    sums = votes.select(
        "ticker", "day", "bar", *[total("votes", w).alias(f"_den_{k}") for k, w in weights.items()],
        *[total("votes", lambda x, w=w: w(x) * x["vote"]).alias(f"_num_{k}") for k, w in weights.items()],
        total("votes", lambda x: (eligible(x) & (x["target"] > 0)).cast("int")).alias("_ins"), trusted["target"].alias("_best"))
    daily = sums.select("ticker", "day", "bar", F.col("_den_equal").alias("_n"), "_ins", "_best", *[F.round(F.when(
        F.col(f"_den_{k}") > 0, F.col(f"_num_{k}") / F.col(f"_den_{k}")).otherwise(0.0), 12).alias(k) for k in weights])
    voted = F.col("_n") > 0
    order = Window.partitionBy("ticker").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)

    def keep(said: Column) -> Column:
        return F.coalesce(F.last(F.when(voted, said), ignorenulls=True).over(so_far), F.lit(0.0))

    def by_score(name: str) -> Column:
        score = F.col(name)
        return keep(F.when(score >= BUY_AT, 1.0).when(score <= SELL_AT, 0.0))

    cols = {k: by_score(k) for k in ("regime", "performance", "equal")}
    cols["majority"] = keep((F.col("_ins") > F.col("_n") / 2).cast("double"))
    cols["best_rule"] = keep((F.col("_best") > 0).cast("double"))
    pairs = F.array(*[F.struct(F.lit(k).alias("ensemble"), e.alias("position")) for k, e in cols.items()])
    return daily.select("ticker", "day", "bar", pairs.alias("runs"))


def full_metrics(days: DataFrame, name: str) -> DataFrame:
    """Net figures of each run of each ticker and what costs took (gross less net CAGR).

    `days`: ticker, day, open, close, buy_rate, sell_rate, per_sale, and `runs`, an array of (name,
    target) structs; a ticker's days list the same runs in the same order. A ticker's days are bounded
    and read once for all its runs, net and gross; only a run's figures leave the task.
    """
    figures = ["cagr", "max_drawdown", "sharpe", "sortino", "time_in_market", "turnover_per_year", "gross"]

    def per_ticker(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("day", "ascending")], null_placement="at_start"))
        targets = pc.list_flatten(rows["targets"]).to_numpy().astype(float).reshape(len(rows), -1)
        open_, close, *rates = (pc.cast(rows[c], pa.float64()).to_numpy() for c in ("open", "close", "buy_rate", "sell_rate", "per_sale"))
        with np.errstate(all="ignore"):
            net = backtest.simulate_key(open_, close, targets, *rates, cash=NOTIONAL)
            gross = backtest.simulate_key(open_, close, targets, *(r * 0.0 for r in rates), cash=NOTIONAL, slippage_bps=0.0)
            found = backtest.risk_figures(np.round(net["equity"], 4), net["held"])
            found["turnover_per_year"] = (net["held"][1:] != net["held"][:-1]).sum(axis=0) / (len(rows) / TRADING_DAYS)
            found["gross"] = backtest.risk_figures(np.round(gross["equity"], 4), gross["held"])["cagr"]
        names = rows["names"][0].values
        return pa.table({"ticker": rows["ticker"].combine_chunks().take(pa.array(np.zeros(len(names), dtype=int))), name: names,
                         **{n: pa.array(found[n], pa.float64()) for n in figures}})

    rows = days.select("ticker", "day", "open", "close", "buy_rate", "sell_rate", "per_sale",
                       F.col(f"runs.{name}").alias("names"), F.col("runs.target").alias("targets"))
    m = rows.groupBy("ticker").applyInArrow(per_ticker, f"ticker string, {name} string, " + ", ".join(f"{n} double" for n in figures))
    m = m.withColumns(backtest.defined(*figures))
    return m.select(
        "ticker", name, *[F.round(n, 4).alias(n) for n in ("cagr", "max_drawdown", "sharpe", "sortino")],
        F.round("time_in_market", 4).alias("exposure"), F.round("turnover_per_year", 2).alias("turnover_per_year"),
        F.round(F.round("gross", 4) - F.round("cagr", 4), 4).alias("cost_drag"))


def wide_returns(runs: DataFrame, names=VOTERS) -> DataFrame:
    """One column of daily returns per rule, from the day's own runs: nothing is shuffled."""
    found = F.map_from_arrays(F.col("runs.rule"), F.col("runs.ret"))
    return runs.select("ticker", "day", "bar", found.alias("_r")).select(
        "ticker", "day", "bar", *[F.try_element_at("_r", F.lit(k)).alias(k) for k in names])


def _moments(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows beside each other (a column per rule), for every pair of columns over the rows where both are
    known: their number, the first one's mean, the sum of products of what they differ from their means."""
    k = known.astype(float)
    with np.errstate(all="ignore"):
        mean = np.where(known, x, 0.0).sum(axis=0) / k.sum(axis=0)
        off = np.where(known, x - mean, 0.0)
        n, shift = k.T @ k, off.T @ k
        return n, np.where(n > 0, mean[:, None] + shift / n, 0.0), np.where(n > 0, off.T @ off - shift * shift.T / n, 0.0)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """`_moments` of all rows from those of their parts."""
    n, mean, product = parts[0]
    for n2, mean2, product2 in parts[1:]:
        whole, apart = n + n2, mean2 - mean
        with np.errstate(all="ignore"):
            share = np.where(whole > 0, n2 / whole, 0.0)
        n, mean, product = whole, mean + apart * share, product + product2 + apart * apart.T * n * share
    return n, mean, product


def _corr(n: np.ndarray, product: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Correlations of pairs of columns; null where one of them never varies."""
    with np.errstate(all="ignore"):
        sd = np.sqrt(np.diag(product) / (np.diag(n) - 1))
        corr = (product / (n - 1) / (sd[:, None] * sd[None, :]))[pairs]
    flat = (np.diag(n) < 2) | (sd <= 1e-12)
    return pa.array(corr, pa.float64(), mask=flat[pairs[0]] | flat[pairs[1]] | (n[pairs] < 2))


def _matrix(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns beside each other, and where they are known (not null)."""
    columns = [rows[n].combine_chunks() for n in names]
    known = np.column_stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in columns])
    return np.column_stack([pc.cast(c, pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]), known


def _pair_rows(found: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """A row per pair from `corr`, the correlations of `pairs` in order."""
    entries = F.array(*[F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.col("corr")[i].alias("corr"))
                        for i, (a, b) in enumerate(pairs)])
    return found.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def _pairs_of(names) -> tuple[list[tuple[str, str]], tuple[np.ndarray, np.ndarray]]:
    """Every pair of names in order of name, and the places of both in `names`."""
    pairs, place = list(combinations(sorted(names), 2)), {n: i for i, n in enumerate(names)}
    return pairs, tuple(np.array([place[p[k]] for p in pairs], dtype=int) for k in (0, 1))


def correlations(wide: DataFrame, keys: list[str], names=VOTERS) -> DataFrame:
    """Correlation of every pair of rules per key. Null where a rule never varies.

    Each batch of rows is reduced where it is to the moments of its keys, a row per key of the batch; only
    those are shuffled and merged.
    """
    names = list(names)
    pairs, at = _pairs_of(names)
    by = [wide.schema[k] for k in keys]
    held = T.StructType([*by, T.StructField("moments", T.ArrayType(T.DoubleType()))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            x, known = _matrix(rows, names)
            numbered = rows.select(keys).append_column("_at", pa.array(np.arange(len(rows))))
            groups = numbered.group_by(keys, use_threads=False).aggregate([("_at", "list")])
            found = [np.concatenate([m.ravel() for m in _moments(x[g], known[g])]) for g in (
                np.array(g, dtype=int) for g in groups["_at_list"].to_pylist())]
            made = pa.array([m.tolist() for m in found], pa.list_(pa.float64()))
            yield from groups.select(keys).append_column("moments", made).to_batches()

    def merge(rows: pa.Table) -> pa.Table:
        parts = [np.array(m).reshape(3, len(names), len(names)) for m in rows["moments"].to_pylist()]
        n, _, product = _merged([tuple(p) for p in parts])
        return rows.select(keys).slice(0, 1).append_column("corr", pa.array([_corr(n, product, at).to_pylist()], pa.list_(pa.float64())))

    schema = T.StructType([*by, T.StructField("corr", T.ArrayType(T.DoubleType()))])
    found = wide.select(*keys, *names).mapInArrow(reduce, held).groupBy(*keys).applyInArrow(merge, schema)
    return _pair_rows(found, keys, pairs)


def average_correlation(pair_rows: DataFrame) -> DataFrame:
    """Averaged over tickers, redundant pairs marked."""
    return pair_rows.groupBy("rule_a", "rule_b").agg(
        F.avg("corr").alias("corr"), F.count("corr").alias("tickers")).withColumn(
        "redundant", F.coalesce(F.col("corr") > SIMILAR, F.lit(False)))


def refit_correlations(wide: DataFrame, fit_rows: DataFrame, names=VOTERS) -> DataFrame:
    """Pair correlations over each refit's own training window.

    A ticker's bars are bounded and meet its refits in one task, where a window is a slice of the rows in
    order: no row is repeated for the windows it is in.
    """
    names = list(names)
    pairs, at = _pairs_of(names)
    refits = fit_rows.select("ticker", "fitted_on", "fit_bar", "train_days").distinct().filter(
        F.col("ticker").isNotNull() & F.col("fit_bar").isNotNull() & F.col("train_days").isNotNull())
    rows = wide.filter(F.col("ticker").isNotNull() & F.col("bar").isNotNull()).select("ticker", "bar", *names)
    schema = T.StructType([refits.schema["ticker"], refits.schema["fitted_on"], T.StructField("corr", T.ArrayType(T.DoubleType()))])

    def per_ticker(bars: pa.Table, fits: pa.Table) -> pa.Table:
        bars = bars.take(pc.sort_indices(bars, sort_keys=[("bar", "ascending")])) if len(bars) else bars
        x, known = _matrix(bars, names)
        bar, last = bars["bar"].to_numpy(), fits["fit_bar"].to_numpy()
        first, until = (np.searchsorted(bar, v, side="right") for v in (last - fits["train_days"].to_numpy(), last))
        windows: dict = {}
        for day, a, b in zip(fits["fitted_on"].to_pylist(), first, until):
            if b > a:
                windows.setdefault(day, []).append(np.arange(a, b))
        found = []
        for spans in windows.values():
            own = slice(spans[0][0], spans[0][-1] + 1) if len(spans) == 1 else np.concatenate(spans)
            n, _, product = _moments(x[own], known[own])
            found.append(_corr(n, product, at).to_pylist())
        ticker = fits["ticker"].combine_chunks().take(pa.array(np.zeros(len(windows), dtype=int)))
        return pa.table({"ticker": ticker, "fitted_on": pa.array(list(windows), fits.schema.field("fitted_on").type),
                         "corr": pa.array(found, pa.list_(pa.float64()))})

    found = rows.groupBy("ticker").cogroup(refits.groupBy("ticker")).applyInArrow(per_ticker, schema)
    return _pair_rows(found, ["ticker", "fitted_on"], pairs)


def clusters(fit_rows: DataFrame, pair_rows: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Each eligible rule's cluster leader at each refit.

    In descending order of training Sharpe a rule joins the first leader it is correlated with
    above `threshold`, else leads. At most one entry per rule and refit, folded as an array.
    """
    eligible = fit_rows.filter(F.col("skipped").isNull())
    ranked = eligible.groupBy("ticker", "fitted_on").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.round("train_sharpe", 4)).alias("s"), "rule"))),
        lambda x: x["rule"]).alias("_order"))
    close = pair_rows.filter(F.col("corr") > threshold).groupBy("ticker", "fitted_on").agg(
        F.array_union(F.collect_set(F.concat_ws("|", "rule_a", "rule_b")),
                      F.collect_set(F.concat_ws("|", "rule_b", "rule_a"))).alias("_close"))
    df = ranked.join(close, ["ticker", "fitted_on"], "left").withColumn(
        "_close", F.coalesce("_close", F.array().cast("array<string>")))

    def near(a, b):
        return F.array_contains(F.col("_close"), F.concat_ws("|", a, b))

    leaders = F.aggregate("_order", F.array().cast("array<string>"), lambda acc, k: F.when(
        F.exists(acc, lambda x: near(x, k)), acc).otherwise(F.concat(acc, F.array(k))))
    df = df.withColumn("_leaders", leaders)
    return df.select("ticker", "fitted_on", F.explode("_order").alias("rule"), "_leaders", "_close").select(
        "ticker", "fitted_on", "rule", F.when(
            F.array_contains("_leaders", F.col("rule")), F.col("rule")).otherwise(
            F.element_at(F.filter("_leaders", lambda x: near(x, F.col("rule"))), 1)).alias("leader"))


def variant_positions(vote_rows: DataFrame, exclude=(), leader_rows: DataFrame | None = None) -> DataFrame:
    """The regime-weighted signal without some rules, and with one vote per cluster.

    `vote_rows` has a row per vote, or as `signals.vote_runs` a row per day with its `votes`: there the rules of a
    day share a fit, whose leaders meet the day once.
    """
    if "votes" in vote_rows.columns:
        daily = _variant_scores(vote_rows, exclude, leader_rows)
    else:
        rows = vote_rows.filter(~F.col("rule").isin(*exclude)) if exclude else vote_rows
        weight = F.col("weight")
        if leader_rows is not None:
            rows = rows.join(leader_rows, ["ticker", "fitted_on", "rule"], "left")
            weight = F.when(F.col("leader") == F.col("rule"), weight).otherwise(0.0)
        daily = rows.groupBy("ticker", "day", "bar").agg(
            _mean_vote(weight * F.col("multiplier")).alias("score"))
    w = Window.partitionBy("ticker").orderBy("day")
    return daily.withColumn("position", hold_between(F.col("score"), w))


def _variant_scores(votes: DataFrame, exclude, leader_rows: DataFrame | None) -> DataFrame:
    # Only what is counted goes to the leaders of its fit: a vote that weighs nothing, or is null, adds nothing.
    weight = F.transform("votes", lambda x: x["weight"] * x["multiplier"])
    rows = votes.select("ticker", "day", "bar", F.col("votes")[0]["fitted_on"].alias("fitted_on"), F.filter(F.arrays_zip(
        F.col("votes.rule").alias("rule"), weight.alias("weight"), F.col("votes.vote").alias("vote")),
        lambda x: (x["weight"] > 0) & ~x["rule"].isin(*exclude) if exclude else x["weight"] > 0).alias("votes"))
    if leader_rows is not None:
        led = leader_rows.filter(F.col("leader") == F.col("rule")).groupBy("ticker", "fitted_on").agg(F.collect_set("rule").alias("_led"))
        rows = rows.join(led, ["ticker", "fitted_on"], "left").withColumn(
            "votes", F.filter("votes", lambda x: F.coalesce(F.array_contains("_led", x["rule"]), F.lit(False))))
    den = total("votes", lambda x: x["weight"])
    rows = rows.select("ticker", "day", "bar", den.alias("_den"), total("votes", lambda x: x["weight"] * x["vote"]).alias("_num"))
    score = F.round(F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0), 12)
    return rows.select("ticker", "day", "bar", score.alias("score"))


def agreement(a: DataFrame, b: DataFrame, keys=("ticker",)) -> DataFrame:
    """Share of days on which two position series are both in or both out."""
    left = a.select(*keys, "day", F.col("position").alias("_a"))
    right = b.select(*keys, "day", F.col("position").alias("_b"))
    same = ((F.col("_a") > 0) == (F.col("_b") > 0)).cast("double")
    return left.join(right, [*keys, "day"]).groupBy(*keys).agg(
        F.avg(same).alias("agreement"), F.count(F.lit(1)).alias("days"),
        F.sum((F.col("_a") != F.col("_b")).cast("bigint")).alias("changed"))


def best_in_hindsight(rule_metrics: DataFrame) -> DataFrame:
    """The rule with the best Sharpe over the very window it is judged on."""
    best = F.max_by(F.struct("rule", "sharpe", "cagr"),
                    F.struct(F.coalesce("sharpe", F.lit(float("-inf"))).alias("s"), "rule"))
    return rule_metrics.groupBy("ticker").agg(best.alias("_b")).select("ticker", "_b.*")


def adoption(metrics: DataFrame, base: str = "regime", margin: float = 0.10,
             wins_share: float = 2 / 3) -> DataFrame:
    """Does an alternative replace the base: higher median Sharpe by `margin`, and higher
    on at least `wins_share` of the tickers."""
    by = metrics.groupBy("ticker").agg(F.max(F.when(
        F.col("ensemble") == base, F.col("sharpe"))).alias("_base"))
    df = metrics.filter(F.col("ensemble") != base).join(by, "ticker")
    # A missing base figure loses to any reported one.
    win = F.col("sharpe").isNotNull() & (F.col("_base").isNull() | (F.col("sharpe") > F.col("_base")))
    out = df.groupBy("ensemble").agg(
        F.percentile("sharpe", 0.5).alias("_m"), F.percentile("_base", 0.5).alias("_mb"),
        F.sum(win.cast("bigint")).alias("wins"), F.count(F.lit(1)).alias("tickers"))
    diff = F.round(F.col("_m") - F.col("_mb"), 6)
    return out.select("ensemble", diff.alias("median_sharpe_difference"), "wins", "tickers",
                      ((diff >= margin) & (F.col("wins") >= wins_share * F.col("tickers"))).alias("passes"))
