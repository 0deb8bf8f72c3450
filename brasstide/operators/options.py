"""Option structures for every underlying at once: legs, payoff, breakevens, sensitivities.

One row per leg; a structure has at most four, so per-structure arrays of kinks are tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brasstide.functions.pricing import option_figures

# Assumptions, strike bands and the structures' legs (kind, side, strike as a
# multiple of spot; a stock leg has no strike).
RATE, DAYS, POINTS = 0.065, 30, 61
STRIKE_BANDS = ((250, 2.5), (500, 5.0), (1000, 10.0), (2500, 20.0), (5000, 50.0))
TOP_STEP = 100.0
STRUCTURES = {
    "long_call": [("call", 1, 1.0)],
    "long_put": [("put", 1, 1.0)],
    "covered_call": [("stock", 1, None), ("call", -1, 1.05)],
    "protective_put": [("stock", 1, None), ("put", 1, 0.95)],
    "bull_call_spread": [("call", 1, 1.0), ("call", -1, 1.05)],
    "bear_put_spread": [("put", 1, 1.0), ("put", -1, 0.95)],
    "long_straddle": [("call", 1, 1.0), ("put", 1, 1.0)],
    "iron_condor": [("put", 1, 0.90), ("put", -1, 0.95), ("call", -1, 1.05), ("call", 1, 1.10)],
}
FOR_SIGNAL = {"BUY": ("bull_call_spread", "long_call", "covered_call"),
              "SELL": ("bear_put_spread", "long_put", "protective_put"),
              "HOLD": ("iron_condor", "covered_call", "long_straddle")}
KEYS = ["ticker", "structure"]


def strike_step(spot: Column) -> Column:
    out = None
    for limit, step in STRIKE_BANDS:
        out = F.when(spot < limit, step) if out is None else out.when(spot < limit, step)
    return out.otherwise(TOP_STEP)


def legs(underlyings: DataFrame, days: int = DAYS, rate: float = RATE) -> DataFrame:
    """Every structure's priced legs. `underlyings`: ticker, spot, sigma."""
    table = F.array(*[F.struct(
        F.lit(name).alias("structure"), F.lit(no).alias("leg_no"), F.lit(kind).alias("kind"),
        F.lit(side).alias("side"), F.lit(mult).cast("double").alias("mult"))
        for name, rows in STRUCTURES.items() for no, (kind, side, mult) in enumerate(rows)])
    df = underlyings.filter((F.col("spot") > 0) & (F.col("sigma") > 0)).withColumns({
        "step": strike_step(F.col("spot")), "years": F.lit(days / 365.0), "rate": F.lit(rate)})
    df = df.withColumn("_l", F.explode(table)).select(*df.columns, "_l.*")
    df = df.withColumn("strike", F.rint(F.col("spot") * F.col("mult") / F.col("step")) * F.col("step"))
    df = option_figures(df)
    stock = F.col("kind") == "stock"
    return df.withColumns({
        "premium": F.when(stock, F.round("spot", 4)).otherwise(F.round("value", 4)),
        "delta": F.when(stock, 1.0).otherwise(F.col("delta")),
        **{g: F.when(stock, 0.0).otherwise(F.col(g)) for g in ("gamma", "theta", "vega")}}
    ).drop("value", "mult")


def _leg_payoff(leg: Column, price: Column) -> Column:
    zero = F.lit(0.0)
    worth = (F.when(leg["kind"] == "stock", price)
             .when(leg["kind"] == "call", F.greatest(price - leg["strike"], zero))
             .otherwise(F.greatest(leg["strike"] - price, zero)))
    return leg["side"] * (worth - leg["premium"])


def payoff(leg_array: Column, price: Column) -> Column:
    """Profit per share at expiry of an array of legs, premiums included."""
    return F.aggregate(leg_array, F.lit(0.0), lambda acc, x: acc + _leg_payoff(x, price))


def structures(leg_rows: DataFrame) -> DataFrame:
    """One row per structure with its legs as a short array and the sums over them."""
    option = F.col("kind") != "stock"
    return leg_rows.groupBy(*KEYS, "spot", "sigma", "step").agg(
        F.sort_array(F.collect_list(F.struct("leg_no", "kind", "side", "strike", "premium"))).alias("legs"),
        F.sum(F.when(option, -F.col("side") * F.col("premium")).otherwise(0.0)).alias("net_premium"),
        *[F.sum(F.col("side") * F.col(g)).alias(g) for g in ("delta", "gamma", "theta", "vega")])


def extremes(df: DataFrame) -> DataFrame:
    """Exact maximum profit and loss (null: unbounded) and breakevens, from the kinks."""
    strikes = F.array_sort(F.array_distinct(F.filter(
        F.transform("legs", lambda x: x["strike"]), lambda x: x.isNotNull())))
    df = df.withColumn("strikes", strikes)
    top = F.coalesce(F.element_at("strikes", -1), F.lit(0.0)) * 2 + 1.0
    df = df.withColumn("_grid", F.concat(F.array(F.lit(0.0)), F.col("strikes"), F.array(top)))
    df = df.withColumn("_vals", F.transform("_grid", lambda p: payoff(F.col("legs"), p)))
    end = F.element_at("_grid", -1)
    slope = payoff(F.col("legs"), end + 1.0) - F.element_at("_vals", -1)
    df = df.withColumn("_slope", F.when(F.abs(slope) < 1e-9, 0.0).otherwise(slope))
    n = F.size("_grid")
    crossings = F.transform(F.sequence(F.lit(1), n - 1), lambda i: _crossing(
        F.element_at("_grid", i), F.element_at("_grid", i + 1),
        F.element_at("_vals", i), F.element_at("_vals", i + 1)))
    last = F.element_at("_vals", -1)
    beyond = F.when(last == 0, end).when((F.col("_slope") != 0) & (last * F.col("_slope") < 0),
                                         end - last / F.col("_slope"))
    found = F.filter(F.concat(crossings, F.array(beyond)), lambda x: x.isNotNull())
    return df.withColumns({
        "max_profit": F.when(F.col("_slope") <= 0, F.array_max("_vals")),
        "max_loss": F.when(F.col("_slope") >= 0, F.array_min("_vals")),
        "breakevens": F.array_sort(F.array_distinct(F.transform(found, lambda x: F.round(x, 2))))
    }).drop("_grid", "_vals", "_slope")


def _crossing(a, b, va, vb) -> Column:
    return F.when(va == 0, a).when(va * vb < 0, a + (b - a) * (-va) / (vb - va))


def analyse(underlyings: DataFrame, lot_size: int = 1, days: int = DAYS) -> DataFrame:
    """The roll-up of every structure on every underlying, in money per lot."""
    df = extremes(structures(legs(underlyings, days)))

    def money(c):
        return F.round(F.col(c) * lot_size, 2)

    return df.withColumns({
        "net_premium": money("net_premium"), "max_profit": money("max_profit"),
        "max_loss": money("max_loss"), "delta": F.round(F.col("delta") * lot_size, 4),
        "gamma": F.round(F.col("gamma") * lot_size, 6),
        "theta_per_day": F.round(F.col("theta") / 365 * lot_size, 4),
        "vega_per_point": F.round(F.col("vega") / 100 * lot_size, 4)}).drop("theta", "vega")


def payoff_grid(analysed: DataFrame, points: int = POINTS, lot_size: int = 1) -> DataFrame:
    """Profit at expiry over 70-130 % of spot, with every kink and breakeven on the grid."""
    lo, hi = F.col("spot") * 0.7, F.col("spot") * 1.3
    even = F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                       lambda i: F.when(i == points - 1, hi).otherwise(lo + i * ((hi - lo) / (points - 1))))
    exact = F.filter(F.concat("strikes", "breakevens"), lambda x: (x >= lo) & (x <= hi))
    return (analysed.select(*KEYS, "legs", F.explode(F.array_distinct(F.concat(even, exact))).alias("_p"))
            .select(*KEYS, F.round("_p", 2).alias("price"),
                    F.round(payoff(F.col("legs"), F.col("_p")) * lot_size, 2).alias("profit")))


def structures_for(signal_rows: DataFrame) -> DataFrame:
    """Which structures express each ticker's signal; a volatile regime adds the straddle."""
    pick = None
    for signal, names in FOR_SIGNAL.items():
        value = F.array(*map(F.lit, names))
        pick = F.when(F.col("signal") == signal, value) if pick is None else pick.when(F.col("signal") == signal, value)
    pick = pick.otherwise(F.array(*map(F.lit, FOR_SIGNAL["HOLD"])))
    pick = F.when(F.col("regime") == "volatile", F.array_union(pick, F.array(F.lit("long_straddle")))).otherwise(pick)
    return signal_rows.withColumn("structure", F.explode(pick))
