"""Keeping keyed tables up to date without MERGE: joins and ranks that return the new table.

Callers write the result with dynamic partition overwrite; nothing here updates in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.functions.markets import with_market

PRICES = ["open", "high", "low", "close", "adj_close"]


def read_bars(bars: DataFrame, tickers: list[str], provider: str, start, end) -> DataFrame:
    """One provider's rows of a range; every predicate reaches the scan."""
    return bars.filter(F.col("ticker").isin(tickers) & (F.col("provider") == provider)
                       & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def clean_rows(raw: DataFrame) -> DataFrame:
    """Drop rows with any missing or NaN price (holidays); a missing volume is 0."""
    ok = None
    for c in PRICES:
        good = F.col(c).isNotNull() & ~F.isnan(c)
        ok = good if ok is None else ok & good
    return raw.filter(ok).withColumn("volume", F.coalesce("volume", F.lit(0)))


def upsert_same_provider(stored: DataFrame, incoming: DataFrame, keys=("ticker", "day"),
                         provider: str = "provider") -> DataFrame:
    """Incoming rows replace stored ones on the key, but never another provider's row."""
    cols = stored.columns
    new = incoming.select(*keys, F.struct(*cols).alias("_new"))
    old = stored.select(*keys, F.struct(*cols).alias("_old"))
    keep_old = F.col("_old").isNotNull() & (
        F.col("_new").isNull() | (F.col(f"_old.{provider}") != F.col(f"_new.{provider}")))
    return (old.join(new, list(keys), "full_outer")
            .select(F.when(keep_old, F.col("_old")).otherwise(F.col("_new")).alias("_r")).select("_r.*"))


def merge_refetch(cached: DataFrame, fresh: DataFrame, keys=("ticker", "day")) -> DataFrame:
    """A fetched row wins; a cached row the fetch did not return is kept."""
    cols = cached.columns
    a = cached.select(*keys, F.struct(*cols).alias("_c"))
    b = fresh.select(*keys, F.struct(*cols).alias("_f"))
    return (a.join(b, list(keys), "full_outer")
            .select(F.coalesce("_f", "_c").alias("_r")).select("_r.*"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The winning row per key. The rank is limited before the shuffle, so copies of a hot
    key collapse where they are read."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def replace_partition(stored: DataFrame, incoming: DataFrame, part: str) -> DataFrame:
    """All rows of the incoming partitions are replaced (a company's facts, a filing's chunks)."""
    touched = incoming.select(part).distinct()
    return stored.join(touched, part, "left_anti").unionByName(incoming)


def pending(catalogue: DataFrame, stored: DataFrame, key: str = "accession") -> DataFrame:
    """What a resumed load still has to do."""
    return catalogue.join(stored.select(key).distinct(), key, "left_anti")


def last_close(now: Column, close_minute: Column) -> Column:
    """The latest weekday session close at or before `now` (UTC)."""
    today = F.to_date(now)

    def close_on(day):
        return day.cast("timestamp") + F.make_dt_interval(mins=close_minute)

    day = F.when(close_on(today) <= now, today).otherwise(F.date_sub(today, 1))
    weekday = F.weekday(day)                     # Monday is 0
    return close_on(F.when(weekday > 4, F.date_sub(day, weekday - 4)).otherwise(day))


def completed_bars(bars: DataFrame, now: Column) -> DataFrame:
    """Without the bar of a session that is still open at `now`."""
    minute = F.hour(now) * 60 + F.minute(now)
    df = with_market(bars)
    open_now = (F.col("day") == F.to_date(now)) & (minute < F.col("close_minute"))
    return df.filter(~open_now).select(*bars.columns)


def covered(requests: DataFrame, fetches: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Requests some fetch of the same ticker and provider already answers.

    A range reaching the last completed session needs a fetch made after that session closed.
    """
    r = with_market(requests).withColumn("_close", last_close(now, F.col("close_minute")))
    stale = now - F.make_dt_interval(hours=F.lit(ttl_hours))
    r = r.withColumn("_cutoff", F.when(
        F.col("end_day") >= F.to_date("_close"), F.greatest(stale, F.col("_close"))).otherwise(stale))
    # Only the newest fetch of a range can matter.
    f = fetches.groupBy("ticker", "provider", "start_day", "end_day").agg(
        F.max("fetched_at").alias("fetched_at")).alias("f")
    hit = ((F.col("r.ticker") == F.col("f.ticker")) & (F.col("r.provider") == F.col("f.provider"))
           & (F.col("f.start_day") <= F.col("r.start_day")) & (F.col("f.end_day") >= F.col("r.end_day"))
           & (F.col("f.fetched_at") >= F.col("r._cutoff")))
    return r.alias("r").join(f, hit, "left_semi").select(*requests.columns)


def load_report(bars: DataFrame, full_history: int = 750, max_gap: int = 7) -> DataFrame:
    """Rows, range, largest calendar gap and a note per ticker."""
    w = Window.partitionBy("ticker").orderBy("day")
    gaps = bars.withColumn("_g", F.datediff("day", F.lag("day").over(w)))
    out = gaps.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("trading_days"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"), F.coalesce(F.max("_g"), F.lit(0)).alias("largest_gap_days"))
    limited = F.col("trading_days") < full_history
    return out.withColumns({
        "limited": limited, "years": F.round(F.col("trading_days") / 252, 2),
        "note": F.when(F.col("largest_gap_days") > max_gap,
                       F.format_string("GAP of %d days", "largest_gap_days"))
        .when(limited, "limited history").otherwise("")})


def view_rows(df: DataFrame, key: Column, as_of: Column, code_version: str, computed_at: Column
              ) -> DataFrame:
    """Rows of the precomputed-view table: the payload as JSON with its version."""
    return df.select(key.alias("key"), as_of.alias("as_of"), F.lit(code_version).alias("code_version"),
                     F.to_json(F.struct(*df.columns)).alias("payload"),
                     computed_at.alias("computed_at"))


def fresh_views(views: DataFrame, code_version: str, now: Column, close_minute: Column) -> DataFrame:
    """Each stored view and whether it may be served: same code, no session closed since."""
    return views.withColumn("fresh", (F.col("code_version") == code_version)
                            & (F.col("computed_at") >= last_close(now, close_minute)))
