"""Black-Scholes value and sensitivities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


# Rational approximation of the normal distribution function (Hart 1968), 15 digits.
_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
          221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
          637.333633378831, 793.826512519948, 440.413735824752)


def _polynomial(x: Column, factors) -> Column:
    value = F.lit(factors[0])
    for f in factors[1:]:
        value = value * x + F.lit(f)
    return value


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, as a column expression: it stays in generated code."""
    a = F.abs(x)
    bell = F.exp(-0.5 * a * a)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, bell * _polynomial(a, _ABOVE) / _polynomial(a, _BELOW)).otherwise(
        bell / fraction / 2.506628274631)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def d1(spot: Column, strike: Column, years: Column, rate: Column, sigma: Column) -> Column:
    return (F.log(spot / strike) + (rate + 0.5 * sigma * sigma) * years) / (sigma * F.sqrt(years))


def option_figures(df, spot="spot", strike="strike", years="years", rate="rate", sigma="sigma",
                   kind="kind"):
    """Add value, delta, gamma, theta (a year) and vega (per 1.00) to rows of options.

    Expired or without volatility: intrinsic value, delta by moneyness, nothing else.
    """
    s, k, t, r, v = (F.col(c).cast("double") for c in (spot, strike, years, rate, sigma))
    call, dead = F.col(kind) == "call", (F.col(years) <= 0) | (F.col(sigma) <= 0)
    a = F.when(~dead, d1(s, k, t, r, v))
    df = df.withColumn("_d1", a)
    df = df.withColumns({"_n1": normal_cdf(F.col("_d1")),
                         "_n2": normal_cdf(F.col("_d1") - v * F.sqrt(t))})
    disc, n1, n2 = F.exp(-r * t), F.col("_n1"), F.col("_n2")
    intrinsic = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    # A put is the call less the forward; its delta one lower.
    as_call = s * n1 - k * disc * n2
    value = F.when(dead, intrinsic).otherwise(F.when(call, as_call).otherwise(
        k * disc * (1 - n2) - s * (1 - n1)))
    in_money = F.when(call, s > k).otherwise(s < k)
    delta = F.when(dead, F.when(in_money, F.when(call, 1.0).otherwise(-1.0)).otherwise(0.0)).otherwise(
        F.when(call, n1).otherwise(n1 - 1))
    density = normal_pdf(F.col("_d1"))
    gamma = F.when(dead, 0.0).otherwise(density / (s * v * F.sqrt(t)))
    decay = -s * density * v / (2.0 * F.sqrt(t))
    theta = F.when(dead, 0.0).otherwise(F.when(call, decay - r * k * disc * n2).otherwise(
        decay + r * k * disc * (1 - n2)))
    vega = F.when(dead, 0.0).otherwise(s * density * F.sqrt(t))
    return df.withColumns({"value": value, "delta": delta, "gamma": gamma, "theta": theta,
                           "vega": vega}).drop("_d1", "_n1", "_n2")
