"""Walk-forward signals: rules vote, weighted by their own past, refitted monthly.

    targets   one row per (ticker, day): what each rule holds
    runs      the rules traded alone, net of costs, beside each other in an array of the day
    fits      at each refit row, each rule's trailing Sharpe, weight, drift
    votes     the fit in force, again an array of the day
    signals   one row per (ticker, day): score, decision, position

Trailing sums are differences of running sums, so a 504-row window costs the same as a
5-row one. All stages are keyed by ticker, and what a day's rules share is held once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brasstide.functions.markets import with_market, with_market_costs
from brasstide.functions.series import TRADING_DAYS
from brasstide.operators import backtest, regime, rules

# Windows, thresholds and the regime-fit multipliers.
FULL_HISTORY = 750
TRAIN, SHORT_TRAIN = 504, 126
BUY_AT, SELL_AT = 0.25, -0.25
NOTIONAL = 100_000.0
MIN_COVERAGE = 0.5
FIT = {("trending_up", "trend"): 1.0, ("trending_up", "reversion"): 0.5,
       ("trending_down", "trend"): 1.0, ("trending_down", "reversion"): 0.5,
       ("ranging", "trend"): 0.5, ("ranging", "reversion"): 1.0}
RECENT, BLOCK, ALLOWANCE, THRESHOLD, MIN_HISTORY, DOWNWEIGHT = 60, 5, 0.5, 4.0, 120, 0.5
ROOT = TRADING_DAYS ** 0.5

VOTERS = [k for k in rules.CATALOGUE if k != "buy_and_hold" and k not in rules.RESTATED]
FIRST_BAR = min(rules.CATALOGUE[k].warmup for k in VOTERS) + SHORT_TRAIN - 1
RUN = ["ticker", "rule"]
# Facts of the bar, not of the rule: carried with every row so that nothing is joined back.
DAILY = ["open", "close", "exchange", "buy_rate", "sell_rate", "per_sale", "regime", *regime.MEASURES]


def _choose(values: dict[str, object], key: Column) -> Column:
    out = None
    for name, value in values.items():
        hit = key == name
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def candidates(tickers: DataFrame) -> DataFrame:
    """Which rules may vote on each ticker's market, and why the others may not."""
    names = [k for k in rules.CATALOGUE if k != "buy_and_hold"]
    df = with_market(tickers).withColumn("rule", F.explode(F.array(*map(F.lit, names))))
    reason = F.when(F.col("rule").isin(*rules.RESTATED), "restates another rule").when(
        (F.col("rule") == "sma_cross_long_short") & ~F.col("allows_short"),
        "no overnight shorts on this market")
    return df.select("ticker", "exchange", "rule", reason.isNull().alias("votes"),
                     reason.alias("reason"))


def rule_targets(bars: DataFrame, names=None, with_regime: bool = True) -> DataFrame:
    """Wide targets on adjusted prices, with market and cost columns and the bar number."""
    names = list(names or VOTERS)
    wide = rules.wide_targets(rules.adjusted_prices(bars), rules.default_rules(names),
                              carry=lambda f: [*(regime.request(f) if with_regime else []), "_b", "_i"])
    # The rows are in the order of these windows already; a month begins where the row before is of another.
    w, month = Window.partitionBy("ticker").orderBy("_b", "_i"), F.trunc("day", "month")
    wide = wide.withColumn("_begins", F.when(~month.eqNullSafe(F.lag(month).over(w)), F.col("_i")))
    begun = F.last("_begins", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    wide = wide.withColumns({"bar": F.col("_i"), "month_day": F.col("_i") - F.coalesce(begun, F.lit(0))}).drop("_b", "_i", "_begins")
    return with_market_costs(with_market(wide))


#: What a run is known by; the trailing figures of a row are made from the rows up to it.
FIGURES = ("target", "held", "equity", "ret", "sharpe_long", "sharpe_short", "cusum")


def _trade(bars: pa.Table, names: list[str], wanted: set[str], rows: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The wanted figures of one ticker's runs over its ordered bars: a row per bar, a column per rule. The
    drift statistic is made for the chosen `rows` only."""
    targets = np.column_stack([_doubles(bars, k) for k in names])
    columns = {"target": targets}
    if wanted <= {"target"}:
        return columns
    with np.errstate(all="ignore"):
        sim = backtest.simulate_key(*(_doubles(bars, c) for c in ("open", "close")), targets,
                                    *(_doubles(bars, c) for c in ("buy_rate", "sell_rate", "per_sale")), cash=NOTIONAL)
        equity = np.round(sim["equity"], 4)
        ret = np.zeros_like(equity)
        ret[1:] = equity[1:] / equity[:-1] - 1.0
    columns |= {"held": sim["held"], "equity": equity, "ret": ret}
    total = np.cumsum(ret, axis=0)
    if wanted & {"sharpe_long", "sharpe_short"}:
        square = np.cumsum(ret * ret, axis=0)
        columns |= {"sharpe_long": _window_sharpe(total, square, TRAIN), "sharpe_short": _window_sharpe(total, square, SHORT_TRAIN)}
    if "cusum" in wanted:
        columns["cusum"] = _cusum(total, bars["bar"].to_numpy(), rows)
    return columns


def _refits(bars: pa.Table, refit_day: int) -> np.ndarray:
    """Rows where weights are set."""
    bar, month_day = (bars[c].to_numpy() for c in ("bar", "month_day"))
    return (bar >= FIRST_BAR) & ((bar == FIRST_BAR) | (month_day == refit_day))


def _ordered(bars: pa.Table, names: list[str]) -> tuple[pa.Table, list[str]]:
    """One ticker's bars in order, and the rules that may vote on it."""
    bars = bars.take(pc.sort_indices(bars, sort_keys=[("bar", "ascending")]))
    return bars, [k for k in names if k != "sma_cross_long_short" or bars["allows_short"][0].as_py()]


def _traded(bars: pa.Table, names: list[str], kept: list[str], fields: list[str], due: int | None = None) -> pa.Table:
    """One ticker's bars in order, each with the rules' runs beside each other; with `due` those of that refit day.

    A run is its rule traded alone over the whole history: net return per bar from the equity curve
    rounded to 4 decimals, and its trailing figures.
    """
    bars, names = _ordered(bars, names)
    chosen = None if due is None else _refits(bars, due)
    columns = _trade(bars, names, set(fields), chosen)
    if due is not None:
        bars, columns = bars.take(pa.array(np.nonzero(chosen)[0])), {n: c[chosen] for n, c in columns.items()}
    return bars.select(kept).append_column("runs", _beside({"rule": _named(names, len(bars)), **{n: columns[n] for n in fields}}, len(bars)))


def _ended(bars: pa.Table, names: list[str], kept: list[str], fields: Iterable[str], function: Callable, types: pa.Schema) -> pa.Table:
    bars, names = _ordered(bars, names)
    columns = _trade(bars, names, set(fields))
    pdf = bars.select(kept).to_pandas()
    made = function(pdf.assign(rule=[names] * len(pdf), **{n: list(columns[n]) for n in fields}))
    return pa.Table.from_pandas(made, schema=types, preserve_index=False)


class _Votes:
    """The votes of one ticker's ordered bars from the first signal on, from its runs: a row per bar, a column per rule."""

    def __init__(self, bars: pa.Table, names: list[str], drift: bool, refit_day: int):
        bar, k = bars["bar"].to_numpy(), len(names)
        size, due = bar + 1, _refits(bars, refit_day)
        runs = _trade(bars, names, {"sharpe_long", "sharpe_short", *(["cusum"] if drift else [])}, due)
        fitted = np.maximum.accumulate(np.where(due, np.arange(len(bar)), -1))
        self.names, self.rows = names, np.nonzero(bar >= FIRST_BAR)[0]
        self.at = fitted[self.rows]                        # the row of the fit in force
        self.limited = size < FULL_HISTORY
        self.train = np.where(self.limited, SHORT_TRAIN, TRAIN)
        warm, limited = np.array([rules.CATALOGUE[n].warmup for n in names]), self.limited[:, None]
        few, early = limited & (warm > size[:, None] / 3), warm + self.train[:, None] > size[:, None]
        self.skipped = np.where(few, 0, np.where(early, 1, -1))
        self.sharpe = np.where(self.skipped >= 0, np.nan, np.where(limited, runs["sharpe_short"], runs["sharpe_long"]))
        self.cusum = np.where((self.skipped >= 0) | limited, np.nan, runs["cusum"]) if drift else None
        self.styles = [rules.CATALOGUE[n].style for n in names]
        mult, regimes = np.ones((len(bar), k)), bars["regime"].to_numpy()
        for (label, kind), value in FIT.items():
            mult[np.ix_(regimes == label, [s == kind for s in self.styles])] = value
        target = runs["target"]
        own = np.array([n == "sma_cross_long_short" for n in names]) & bars["allows_short"][0].as_py()
        self.target, self.multiplier = target[self.rows], mult[self.rows]
        self.vote = np.where(own, target, 2.0 * target - 1.0)[self.rows]
        self.weight = np.maximum(self.sharpe, 0.0)[self.at] + 0.0
        self.eligible = self.skipped[self.at] < 0


    def beside(self, bars: pa.Table, rows: np.ndarray) -> pa.Array:
        """A list per chosen row of its votes, as `vote_runs` has them."""
        k, at = len(self.names), self.at[rows]

        def of_day(values) -> pa.Array:
            return pa.chunked_array(values).combine_chunks().take(pa.array(np.repeat(at, k)))

        skipped = self.skipped[at].ravel()
        columns = {"rule": _named(self.names, len(rows)), "target": self.target[rows], "fitted_on": of_day(bars["day"]),
                   "fit_bar": of_day(bars["bar"]), "limited": np.repeat(self.limited[at], k),
                   "train_days": np.repeat(self.train[at], k).astype(np.int32),
                   "skipped": pa.array(["limited history", "warming up"]).take(pa.array(skipped, mask=skipped < 0)),
                   "train_sharpe": self.sharpe[at], "weight": self.weight[rows]}
        if self.cusum is not None:
            columns |= {"cusum": self.cusum[at], "drifting": (self.cusum >= THRESHOLD)[at]}
        columns |= {"style": _named(self.styles, len(rows)), "multiplier": self.multiplier[rows], "vote": self.vote[rows]}
        return _beside(columns, len(rows))


def _vote_type(day: T.DataType, bar: T.DataType, drift: bool) -> T.ArrayType:
    double, flag, text = T.DoubleType(), T.BooleanType(), T.StringType()
    vote = {"rule": text, "target": double, "fitted_on": day, "fit_bar": bar, "limited": flag, "train_days": T.IntegerType(),
            "skipped": text, "train_sharpe": double, "weight": double, **({"cusum": double, "drifting": flag} if drift else {}),
            "style": text, "multiplier": double, "vote": double}
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in vote.items()]))


def _voted(bars: pa.Table, names: list[str], kept: list[str], drift: bool, refit_day: int) -> pa.Table:
    """`vote_runs` of one ticker's bars."""
    bars, names = _ordered(bars, names)
    v = _Votes(bars, names, drift, refit_day)
    return bars.select(kept).take(pa.array(v.rows)).append_column("votes", v.beside(bars, np.arange(len(v.rows))))


def _latest(v: _Votes, bars: pa.Table) -> pa.Array:
    """The votes of the last day; null on the days before."""
    day = bars["day"].combine_chunks().take(pa.array(v.rows))
    last = np.nonzero(pc.equal(day, day[-1]).to_numpy(zero_copy_only=False))[0] if len(day) and day[-1].is_valid else np.zeros(0, dtype=int)
    votes = v.beside(bars, last)
    return pa.concat_arrays([pa.nulls(len(day) - len(last), votes.type), votes])


#: Columns of days for `rule_runs` with `signal`: what the rules held, and the last day's votes.
TARGETS = {"targets": (T.ArrayType(T.DoubleType()), lambda v, bars: _lists(v.target))}
LATEST = {"votes": (_vote_type(T.DateType(), T.IntegerType(), False), _latest)}


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def carried(said: np.ndarray) -> np.ndarray:
    """What was said last, row by row, where NaN says nothing; 0 at first."""
    last = np.maximum.accumulate(np.where(np.isnan(said), -1, np.arange(len(said))))
    return np.where(last >= 0, said[last], 0.0)


def between(score: np.ndarray) -> np.ndarray:
    """What a score says: in at BUY, out at SELL, otherwise nothing (NaN)."""
    return np.where(score >= BUY_AT, 1.0, np.where(score <= SELL_AT, 0.0, np.nan))


def mean_vote(weight: np.ndarray, vote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of each row's votes on 12 decimals, and the weight behind it; NaN weighs nothing."""
    w = np.nan_to_num(weight)
    den = w.sum(axis=1)
    with np.errstate(all="ignore"):
        return np.round(np.where(den > 0, (w * vote).sum(axis=1) / den, 0.0), 12) + 0.0, den


#: A signal's own columns beside those of its bar (DAILY), as they follow these.
SIGNAL = {"limited": "boolean", "train_days": "int", "fitted_on": "date", "eligible": "bigint", "counted": "bigint",
          "left_out": "bigint", "score": "double", "decision": "string", "position": "double"}


def _signalled(bars: pa.Table, names: list[str], kept: list[str], refit_day: int, more: dict) -> pa.Table:
    """`signals` of the votes of one ticker's bars, with the columns of `more` made from the same votes."""
    bars, names = _ordered(bars, names)
    v = _Votes(bars, names, False, refit_day)
    score, den = mean_vote(v.weight * v.multiplier, v.vote)
    said = between(score)
    at = pa.array(v.at)
    columns = {"limited": v.limited[v.at], "train_days": v.train[v.at].astype(np.int32), "fitted_on": bars["day"].combine_chunks().take(at),
               "eligible": (~np.isnan(v.sharpe[v.at])).sum(axis=1), "counted": (v.weight > 0).sum(axis=1), "left_out": (~v.eligible).sum(axis=1),
               "score": score, "decision": pa.array(["HOLD", "BUY", "SELL"]).take(pa.array(np.where(said == 1, 1, np.where(said == 0, 2, 0)))),
               "position": carried(said), **{n: make(v, bars) for n, (_, make) in more.items()}}
    out = bars.select(kept).take(pa.array(v.rows))
    for name, values in {"_den": den, **columns}.items():
        values = values if isinstance(values, pa.Array) else pa.array(values)
        out = out.add_column(3, name, values) if name == "_den" else out.append_column(name, values)
    return out


def _named(names: list[str], rows: int) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), rows)))


def _beside(columns: dict[str, np.ndarray | pa.Array], rows: int) -> pa.Array:
    """A list per row of structs of the columns, which have as many entries for every row; NaN is null."""
    fields = [c if isinstance(c, pa.Array) else pa.array(c.ravel(), from_pandas=True) for c in columns.values()]
    items = pa.StructArray.from_arrays(fields, names=list(columns))
    k = len(items) // rows if rows else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), items)


def _doubles(table: pa.Table, name: str) -> np.ndarray:
    return pc.cast(table[name], pa.float64()).to_numpy()


def rule_runs(wide: DataFrame, names=None, drift: bool = True, refit_day: int | None = None, fields: Iterable[str] | None = None,
              due: int | None = None, signal: dict | None = None, ended: tuple[Callable, str] | None = None) -> DataFrame:
    """One row per bar, `runs` holding each rule traded alone with its trailing figures.

    A ticker's bars are bounded and read once for all rules, so each ticker is one Arrow table; a
    bar's prices, costs and regime leave the task once, not once per rule. Of the runs, the figures named in
    `fields` leave it (without, all); with `due`, only the rows on which weights are set by that refit day.
    With a `refit_day` the same task goes on to the votes: the rows are those of `vote_runs`, and no run leaves
    it. With `signal` it goes on to the signals, and no vote leaves it either: `signal` names further columns
    of the day and for each its type and what makes it of the ticker's votes. With `ended`, a function and the
    schema of its rows, only what it makes of a ticker's ordered bars and runs (pandas) leaves the task.
    """
    names = list(names or VOTERS)
    kept = ["ticker", "day", "bar", "month_day", "allows_short", *[c for c in DAILY if c in wide.columns]]
    rows = wide.select(*kept, *names)
    double = T.DoubleType()

    def schema(*added: T.StructField) -> T.StructType:
        return T.StructType([rows.schema[c] for c in kept] + list(added))

    if signal is not None:
        kept = [c for c in kept if c not in ("month_day", "allows_short")]
        made = [*T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in SIGNAL.items())), *[T.StructField(n, t) for n, (t, _) in signal.items()]]
        whole = schema(*made).fields
        whole = T.StructType([*whole[:3], T.StructField("_den", double), *whole[3:]])
        return rows.groupBy("ticker").applyInArrow(lambda bars: _signalled(bars, names, kept, refit_day or 0, signal), whole)
    if refit_day is not None:
        kept.remove("month_day")
        made = T.StructField("votes", _vote_type(rows.schema["day"].dataType, rows.schema["bar"].dataType, drift))
        return rows.groupBy("ticker").applyInArrow(lambda bars: _voted(bars, names, kept, drift, refit_day), schema(made))
    if ended is not None:
        function, types = ended[0], to_arrow_schema(T.StructType.fromDDL(ended[1]))
        return rows.groupBy("ticker").applyInArrow(lambda bars: _ended(bars, names, kept, fields, function, types), ended[1])
    held = [n for n in FIGURES if n in (FIGURES if fields is None else set(fields)) and (drift or n != "cusum")]
    run = T.StructType([T.StructField("rule", T.StringType()), *(T.StructField(n, double) for n in held)])
    return rows.groupBy("ticker").applyInArrow(lambda bars: _traded(bars, names, kept, held, due), schema(T.StructField("runs", T.ArrayType(run))))


def run_rows(runs: DataFrame) -> DataFrame:
    """One row per bar and rule."""
    return runs.select(*[c for c in runs.columns if c != "runs"], F.inline("runs"))


def _window_sharpe(total: np.ndarray, square: np.ndarray, n: int) -> np.ndarray:
    """Daily Sharpe over the last n rows from running sums; no variation gives 0."""
    s, q = total - _before(total, n), square - _before(square, n)
    variance = (q - s * s / n) / (n - 1)
    with np.errstate(all="ignore"):
        return np.where(variance > 1e-18, s / n / np.sqrt(variance) * ROOT, 0.0)


def _before(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.zeros((min(n, len(x)), *x.shape[1:])), x[:max(0, len(x) - n)]])


def _cusum(total: np.ndarray, bar: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The drift statistic at each of the chosen `rows` (without, all), NaN where the history is too short or
    does not vary. `total` has a row per bar and, for runs beside each other, a column per run."""
    out = np.full(total.shape, np.nan)
    if len(bar) == 0 or bar.max() + 1 < MIN_HISTORY + RECENT:
        return out
    whole = (bar >= BLOCK - 1).reshape(-1, *[1] * (total.ndim - 1))
    five = np.where(whole, total - _before(total, BLOCK), np.nan)
    recent, history = RECENT // BLOCK, (TRAIN - RECENT) // BLOCK
    # Blocks of 5 returns ending at a bar are rows 5 apart: one phase of the bar number.
    for phase in range(BLOCK):
        at = np.nonzero(bar % BLOCK == phase)[0]
        chosen = slice(None) if rows is None else np.nonzero(rows[at])[0]
        if not len(at[chosen]):
            continue
        padded = np.concatenate([np.full((recent + history - 1, *total.shape[1:]), np.nan), five[at]])
        spans = np.lib.stride_tricks.sliding_window_view(padded, recent + history, axis=0)[chosen]
        at = at[chosen]
        past, known = spans[..., :history], ~np.isnan(spans[..., :history])
        n = known.sum(axis=-1)
        with np.errstate(all="ignore"):
            mean = np.where(known, past, 0.0).sum(axis=-1) / n
            sd = np.sqrt((np.where(known, past - mean[..., None], 0.0) ** 2).sum(axis=-1) / (n - 1))
            now, worst = np.zeros(n.shape), np.zeros(n.shape)
            for j in range(history, history + recent):
                step = now - (spans[..., j] - mean) / sd - ALLOWANCE
                now, worst = np.maximum(0.0, step), np.maximum(worst, step)
            old = (bar[at] + 1 >= MIN_HISTORY + RECENT).reshape(-1, *[1] * (total.ndim - 1))
            fit = old & (n > 1) & (sd > 1e-15)
        out[at] = np.where(fit, worst, np.nan)
    return out


def _trailed(runs: pa.Table, drift: bool) -> pa.Table:
    """One ticker's rows by rule and day, with trailing figures."""
    parts = []
    for rule in pc.unique(runs["rule"]):
        one = runs.filter(pc.equal(runs["rule"], rule) if rule.is_valid else pc.is_null(runs["rule"]))
        one = one.take(pc.sort_indices(one, sort_keys=[("day", "ascending")], null_placement="at_start"))
        ret = one["ret"].to_numpy()
        total, square = np.cumsum(ret), np.cumsum(ret * ret)
        one = one.append_column("sharpe_long", pa.array(_window_sharpe(total, square, TRAIN)))
        one = one.append_column("sharpe_short", pa.array(_window_sharpe(total, square, SHORT_TRAIN)))
        if drift:
            one = one.append_column("cusum", pa.array(_cusum(total, one["bar"].to_numpy()), from_pandas=True))
        parts.append(one)
    return pa.concat_tables(parts)


def with_trailing(returns: DataFrame, drift: bool = True) -> DataFrame:
    """Per bar and rule: Sharpe over both training windows and the drift statistic.

    Rows must carry the bar number of their ticker. A ticker's bars are bounded, so each is one
    Arrow table; a long window costs one pass over the rows of a rule.
    """
    added = ["sharpe_long", "sharpe_short", *(["cusum"] if drift else [])]
    schema = T.StructType(returns.schema.fields + [T.StructField(n, T.DoubleType()) for n in added])
    return returns.groupBy("ticker").applyInArrow(lambda table: _trailed(table, drift), schema)


def _due(refit_day: int) -> Column:
    """Rows where weights are set."""
    return (F.col("bar") >= FIRST_BAR) & ((F.col("bar") == FIRST_BAR) | (F.col("month_day") == refit_day))


def _fit_columns(run: Column | None = None, drift: bool = True) -> dict[str, Column]:
    """The fit made on a row, of the run in its columns or of one of its `runs`.

    Everything is decided from the bars up to the row: a short history trains on fewer bars
    and leaves out rules whose warm-up is more than a third of it.
    """
    of = F.col if run is None else lambda name: run[name]
    size = F.col("bar") + 1
    warm = _choose({k: rules.CATALOGUE[k].warmup for k in VOTERS}, of("rule"))
    limited = size < FULL_HISTORY
    train = F.when(limited, SHORT_TRAIN).otherwise(TRAIN)
    skipped = F.when(limited & (warm > size / 3), "limited history").when(
        warm + train > size, "warming up")
    sharpe = F.when(skipped.isNull(), F.when(limited, of("sharpe_short"))
                    .otherwise(of("sharpe_long")))
    cols = {"fitted_on": F.col("day"), "fit_bar": F.col("bar"), "limited": limited,
            "train_days": train, "skipped": skipped, "train_sharpe": sharpe,
            "weight": F.greatest(sharpe, F.lit(0.0)) + F.lit(0.0)}
    cols["weight"] = F.when(sharpe.isNotNull(), cols["weight"])
    if drift:
        cusum = F.when(skipped.isNull() & ~limited, of("cusum"))
        cols |= {"cusum": cusum, "drifting": F.coalesce(cusum >= THRESHOLD, F.lit(False))}
    return cols


def fits(runs: DataFrame, refit_day: int = 0) -> DataFrame:
    """One row per (ticker, refit, rule): training Sharpe, weight, drift, or why it is skipped.
    Only the refit rows' runs are unfolded."""
    rows = run_rows(runs.filter(_due(refit_day)))
    return rows.select(*RUN, *[e.alias(n) for n, e in _fit_columns(drift="cusum" in rows.columns).items()])


def _has(runs: DataFrame, name: str) -> bool:
    return name in runs.schema["runs"].dataType.elementType.names


def vote_runs(runs: DataFrame, refit_day: int = 0) -> DataFrame:
    """One row per (ticker, day) from the first signal on; `votes` holds each rule's fit in force,
    vote and regime multiplier. Needs the `regime` label on every row.

    The rules of a ticker are refitted on the same days, so their fits travel along the days together.
    Runs made with a refit day have been fitted and have voted in their own pass: nothing is shuffled.
    """
    if "decision" in runs.columns:                        # gone on to the signals
        return runs
    if "votes" in runs.columns:
        return runs.select("ticker", "day", "bar", "allows_short", *DAILY, "votes")
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    drift = _has(runs, "cusum")
    fit = F.transform("runs", lambda run: F.struct(*[e.alias(n) for n, e in _fit_columns(run, drift).items()]))
    names = list(_fit_columns(drift=drift))
    # A row takes only its rules and targets to its ticker's days, and its fits where it is a refit.
    df = runs.select("ticker", "day", "bar", "allows_short", *DAILY, F.arrays_zip("runs.rule", "runs.target").alias("runs"),
                     F.when(_due(refit_day), fit).alias("_fit"))
    df = df.withColumn("_fit", F.last("_fit", ignorenulls=True).over(w)).filter(F.col("bar") >= FIRST_BAR)
    styles = {k: rules.CATALOGUE[k].style for k in VOTERS}

    def vote(run: Column, fitted: Column) -> Column:
        style, mult = _choose(styles, run["rule"]), F.lit(1.0)
        for (label, kind), value in FIT.items():
            if value != 1.0:
                mult = F.when((F.col("regime") == label) & (style == kind), value).otherwise(mult)
        own = F.col("allows_short") & (run["rule"] == "sma_cross_long_short")
        said = F.when(own, run["target"]).otherwise(2.0 * run["target"] - 1.0)
        return F.struct(run["rule"].alias("rule"), run["target"].alias("target"), *[fitted[n].alias(n) for n in names],
                        style.alias("style"), mult.alias("multiplier"), said.alias("vote"))

    return df.select("ticker", "day", "bar", "allows_short", *DAILY, F.zip_with("runs", "_fit", vote).alias("votes"))


def vote_rows(votes: DataFrame) -> DataFrame:
    """One row per (ticker, day, rule)."""
    return votes.select(*[c for c in votes.columns if c != "votes"], F.inline("votes"))


def total(votes: str, value) -> Column:
    """The sum of `value(vote)` over a day's votes; what is null adds nothing."""
    return F.aggregate(votes, F.lit(0.0), lambda acc, x: acc + F.coalesce(value(x).cast("double"), F.lit(0.0)))


def positions_of_schedules(bars: pd.DataFrame, refit_days: list[int]) -> np.ndarray:
    """The signal's positions over one ticker's ordered bars, a column per refit day: `vote_runs` and
    `signals` beside each other. Before the first signal a position is 0."""
    names, size = list(bars["rule"].iloc[0]), bars["bar"].to_numpy() + 1
    target, long, short = (np.array(bars[c].tolist(), dtype=float) for c in ("target", "sharpe_long", "sharpe_short"))
    warm, limited = np.array([rules.CATALOGUE[k].warmup for k in names]), (size < FULL_HISTORY)[:, None]
    skipped = (limited & (warm > size[:, None] / 3)) | (warm + np.where(limited, SHORT_TRAIN, TRAIN) > size[:, None])
    weight = np.where(skipped, 0.0, np.maximum(np.where(limited, short, long), 0.0))
    regimes, mult = bars["regime"].to_numpy(), np.ones_like(target)
    for (label, kind), value in FIT.items():
        mult[np.ix_(regimes == label, [rules.CATALOGUE[k].style == kind for k in names])] = value
    own = np.array([k == "sma_cross_long_short" for k in names]) & bars["allows_short"].to_numpy(bool)[:, None]
    vote = np.where(own, target, 2.0 * target - 1.0)
    rows, month_day, out = np.arange(len(bars)), bars["month_day"].to_numpy(), []
    for day in refit_days:
        due = (size > FIRST_BAR) & ((size == FIRST_BAR + 1) | (month_day == day))
        fitted = np.maximum.accumulate(np.where(due, rows, -1))
        w = np.where(fitted[:, None] >= 0, weight[fitted], 0.0) * mult
        out.append(carried(np.where(fitted < 0, np.nan, between(mean_vote(w, vote)[0]))))
    return np.column_stack(out)


def hold_between(score: Column, w) -> Column:
    """In at BUY, out at SELL, otherwise as before (out at first)."""
    said = F.when(score >= BUY_AT, 1.0).when(score <= SELL_AT, 0.0)
    return F.coalesce(F.last(said, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def signals(votes: DataFrame, drift_downweight: bool = False) -> DataFrame:
    """Score, decision and position per ticker and day, each from its own row's votes.
    Votes of a pass that went on to the signals have been counted there."""
    if "decision" in votes.columns:
        return votes
    def weight(x: Column) -> Column:
        plain = x["weight"] * x["multiplier"]
        return plain * F.when(F.coalesce(x["drifting"], F.lit(False)), DOWNWEIGHT).otherwise(1.0) if drift_downweight else plain

    def count(test) -> Column:
        return total("votes", lambda x: test(x).cast("int")).cast("bigint")

    first = F.element_at("votes", 1)
    daily = votes.select(
        "ticker", "day", "bar", total("votes", lambda x: weight(x) * x["vote"]).alias("_num"), total("votes", weight).alias("_den"),
        *DAILY, *[first[c].alias(c) for c in ("limited", "train_days", "fitted_on")],
        count(lambda x: x["train_sharpe"].isNotNull()).alias("eligible"), count(lambda x: x["weight"] > 0).alias("counted"),
        count(lambda x: x["skipped"].isNotNull()).alias("left_out"))
    # Thresholds are compared on 12 decimals, so the order of summation cannot decide a tie.
    score = F.round(F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0), 12)
    w = Window.partitionBy("ticker").orderBy("day")
    daily = daily.withColumn("score", score)
    decision = F.when(F.col("score") >= BUY_AT, "BUY").when(
        F.col("score") <= SELL_AT, "SELL").otherwise("HOLD")
    return daily.withColumns({"decision": decision,
                              "position": hold_between(F.col("score"), w)}).drop("_num")


def walk_forward(bars: DataFrame, regime_rule: str = "slope", refit_day: int = 0,
                 drift_downweight: bool = False) -> tuple[DataFrame, DataFrame]:
    """(votes, signals) of all tickers; the signals carry the day's prices and costs."""
    v = vote_runs(voting_runs(bars, regime_rule, drift_downweight, refit_day))
    return v, signals(v, drift_downweight)


def voting_runs(bars: DataFrame, regime_rule: str = "slope", drift: bool = False, refit_day: int | None = None, **options) -> DataFrame:
    """Every voter's runs with trailing figures and the regime label, or what `rule_runs` goes on to from them."""
    wide = rule_targets(bars).withColumn("regime", regime.classify(regime_rule))
    return rule_runs(wide, drift=drift, refit_day=refit_day, **options)


def evidence(signal_rows: DataFrame) -> DataFrame:
    """The last day's signal per ticker with coverage, confidence and warnings."""
    latest = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    last = (signal_rows.withColumn("_k", F.row_number().over(latest)).filter("_k = 1").drop("_k"))
    coverage = F.when(F.col("eligible") > 0, F.col("counted") / F.col("eligible")).otherwise(0.0)
    history = F.round(F.least(F.lit(1.0), F.col("train_days") / TRAIN), 4)
    raw = F.abs("score") * history
    warn = F.concat_ws("; ",
        F.when((F.col("eligible") > 0) & (coverage < MIN_COVERAGE), "Narrow vote"),
        F.when(F.col("limited"), "Limited history"),
        F.when(F.coalesce("_den", F.lit(0.0)) == 0, "No trusted rule"))
    return last.select(
        "ticker", F.col("day").alias("as_of"), F.col("decision").alias("signal"),
        F.round("score", 4).alias("score"),
        F.round(F.least(raw, coverage), 4).alias("confidence"),
        F.round(raw, 4).alias("confidence_uncapped"),
        F.format_string("%d of %d rules", "counted", "eligible").alias("coverage"),
        F.round(coverage, 4).alias("coverage_fraction"), "regime", *regime.MEASURES,
        (F.col("bar") + 1).alias("trading_days"), "limited", "train_days",
        history.alias("history_factor"), "fitted_on", "left_out", warn.alias("warnings"))


def latest_votes(vote_rows: DataFrame) -> DataFrame:
    """Every eligible rule's share of the last day's vote, heaviest first."""
    last = vote_rows.withColumn("_d", F.max("day").over(Window.partitionBy("ticker")))
    last = last.filter((F.col("day") == F.col("_d")) & F.col("skipped").isNull())
    eff = F.col("weight") * F.col("multiplier")
    total = F.sum(eff).over(Window.partitionBy("ticker"))
    share = F.round(F.when(total > 0, eff / total).otherwise(0.0), 4)
    order = Window.partitionBy("ticker").orderBy(share.desc(), "rule")
    place = F.when(F.col("target") > 0, "in").when(F.col("target") < 0, "short").otherwise("out")
    out = last.withColumns({"share_of_vote": share, "stands": place})
    return out.withColumn("rank", F.row_number().over(
        Window.partitionBy("ticker").orderBy(F.desc("share_of_vote"), "rule"))).select(
        "ticker", "day", "rank", "rule", "style", "stands", "vote",
        F.round("train_sharpe", 4).alias("train_sharpe"), F.round("weight", 4).alias("weight"),
        F.col("multiplier").alias("regime_multiplier"), "share_of_vote")


def switches(signal_rows: DataFrame, years: int = 3, keys=("ticker",)) -> DataFrame:
    """The days the position changed, within the last `years`."""
    w = Window.partitionBy(*keys).orderBy("day")
    whole = Window.partitionBy(*keys)
    df = signal_rows.withColumns({"_was": F.coalesce(F.lag("position").over(w), F.lit(0.0)),
                                  "_last": F.max("day").over(whole)})
    since = F.date_sub("_last", round(365.25 * years))
    return df.filter((F.col("position") != F.col("_was")) & (F.col("day") >= since)).select(
        *keys, "day", F.when(F.col("position") > 0, "in").otherwise("out").alias("action"))
