"""Ticker spelling, market attributes and trading costs as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The markets' attributes and default benchmarks.
# exchange: currency, symbol, cost model, overnight shorts, session close (UTC minutes), benchmark
MARKETS = {
    "US": ("USD", "$", "flat_bps", True, 21 * 60 + 30, "SPY"),
    "NSE": ("INR", "₹", "india_equity_delivery", False, 10 * 60 + 30, "^NSEI"),
    "BSE": ("INR", "₹", "india_equity_delivery", False, 10 * 60 + 30, "^BSESN"),
}
INDEX_EXCHANGE = {"^NSEI": "NSE", "^NSEBANK": "NSE", "^BSESN": "BSE", "^CNXIT": "NSE"}


def normalize_ticker(raw: Column) -> Column:
    """Upper case and trimmed; a one-letter suffix is a share class, written with a dash."""
    symbol = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(symbol.startswith("^"), symbol).otherwise(
        F.regexp_replace(symbol, r"^(.*)\.(.)$", "$1-$2"))


def exchange_of(ticker: Column) -> Column:
    # A share class is one letter, so its spelling decides no listing: no pattern is matched here.
    symbol = F.upper(F.trim(F.coalesce(ticker, F.lit(""))))
    out = F.when(symbol.endswith(".NS"), "NSE").when(symbol.endswith(".BO"), "BSE")
    for index, exchange in INDEX_EXCHANGE.items():
        out = out.when(symbol == index, exchange)
    return out.otherwise("US")


def _attribute(exchange: Column, position: int) -> Column:
    out = None
    for name, values in MARKETS.items():
        out = (F.when(exchange == name, F.lit(values[position])) if out is None
               else out.when(exchange == name, F.lit(values[position])))
    return out


def with_market(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    df = df.withColumn("exchange", exchange_of(F.col(ticker)))
    names = ("currency", "currency_symbol", "cost_model", "allows_short", "close_minute",
             "benchmark")
    return df.withColumns({n: _attribute(F.col("exchange"), i) for i, n in enumerate(names)})


def benchmark_bars(bars: DataFrame) -> DataFrame:
    """The bars of the markets' benchmark indices: a constant predicate that reaches the scan."""
    return bars.filter(F.col("ticker").isin(*sorted({values[5] for values in MARKETS.values()})))


@dataclass(frozen=True)
class LegCosts:
    """What a buy and a sale of one unit of notional cost, plus a fixed sum per sale."""

    buy_rate: float
    sell_rate: float
    per_sale: float = 0.0


def flat_costs(bps: float = 5.0) -> LegCosts:
    return LegCosts(bps / 1e4, bps / 1e4)


# Published equity-delivery charges.
@dataclass(frozen=True)
class DeliveryRates:
    brokerage: float = 0.0
    brokerage_cap: float | None = None
    transaction_tax: float = 0.001
    exchange: float = 0.0000307
    regulator: float = 0.000001
    stamp_on_buys: float = 0.00015
    service_tax: float = 0.18
    depository_per_sale: float = 15.34


def delivery_costs(rates: DeliveryRates = DeliveryRates()) -> LegCosts:
    """The delivery schedule as rates. A capped brokerage is not a rate: see backtest.capped."""
    taxed = rates.brokerage + rates.exchange + rates.regulator
    common = taxed * (1 + rates.service_tax) + rates.transaction_tax
    return LegCosts(common + rates.stamp_on_buys, common, rates.depository_per_sale)


def delivery_items(side: Column, notional: Column, rates: DeliveryRates = DeliveryRates()) -> dict:
    """Itemised charges of one leg, as columns."""
    amount = F.abs(notional)
    brokerage = amount * rates.brokerage
    if rates.brokerage_cap is not None:
        brokerage = F.least(brokerage, F.lit(rates.brokerage_cap))
    exchange, regulator = amount * rates.exchange, amount * rates.regulator
    return {
        "brokerage": brokerage,
        "stt": amount * rates.transaction_tax,
        "exchange_fee": exchange,
        "sebi": regulator,
        "stamp_duty": F.when(side == "buy", amount * rates.stamp_on_buys).otherwise(0.0),
        "gst": (brokerage + exchange + regulator) * rates.service_tax,
        "dp_charge": F.when((side == "sell") & (amount > 0),
                            F.lit(rates.depository_per_sale)).otherwise(0.0),
    }


def with_market_costs(df: DataFrame, flat_bps: float = 5.0) -> DataFrame:
    """Per-row cost columns from `cost_model`."""
    flat, delivery = flat_costs(flat_bps), delivery_costs()
    indian = F.col("cost_model") == "india_equity_delivery"

    def pick(name):
        return F.when(indian, F.lit(getattr(delivery, name))).otherwise(
            F.lit(getattr(flat, name)))

    return df.withColumns({n: pick(n) for n in ("buy_rate", "sell_rate", "per_sale")})


def with_costs(df: DataFrame, costs: LegCosts) -> DataFrame:
    return df.withColumns({"buy_rate": F.lit(costs.buy_rate), "sell_rate": F.lit(costs.sell_rate),
                           "per_sale": F.lit(costs.per_sale)})
