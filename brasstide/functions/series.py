"""Window expressions over ordered rows of one key. Undefined (warm-up) values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

TRADING_DAYS = 252


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key at the session's shuffle width, whatever the input's size.

    For plans that multiply rows after the shuffle (rules, re-timings): adaptive coalescing
    sizes partitions by the bytes before the expansion and would leave too few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def rows(keys, order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def true_range(high: str, low: str, close: str, w: WindowSpec) -> Column:
    previous = F.lag(close).over(w)
    h, lo = F.col(high), F.col(low)
    return F.greatest(h - lo, F.abs(h - previous), F.abs(lo - previous))


def held_state(entry: str, exit_: str, out: str, w: WindowSpec) -> tuple[dict, dict]:
    """Two column sets for an enter/exit position (1 in, 0 out).

    Entry alone sets it, exit alone clears it, both on one row flip it; so the state is
    the last set or clear, flipped once per coincidence since. Apply the first dict, then
    the second.
    """
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e, x = F.col(entry).cast("int"), F.col(exit_).cast("int")
    flips = {f"_f_{out}": F.sum(e * x).over(so_far)}
    anchor = F.last(F.when(F.col(entry) != F.col(exit_),
                           (e + F.col(f"_f_{out}")) % 2), ignorenulls=True).over(so_far)
    return flips, {out: ((F.coalesce(anchor, F.lit(0)) + F.col(f"_f_{out}")) % 2).cast("double")}
