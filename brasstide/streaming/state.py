"""Stateful jobs whose state ends: admissions, daily caps and rule positions, decided in event-time order.

Rows wait in state until the watermark has passed them, so micro-batches may bring them in any order
within the delay and each job gives what its batch form gives. A timer wakes a key when its first
waiting row is due, and once more when nothing it holds can matter any longer: then its state is removed.
Rows that come later than the delay are dropped by the engine, as they are by its windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

_BACKEND = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def keep_in_rocksdb(spark: SparkSession) -> None:
    """Jobs of this module need a state store with lists, maps and timers, which only this one has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _BACKEND)


class Ordered(StatefulProcessor):
    """Holds rows back until the watermark passes them and hands them to `decide`, oldest first.

    Subclasses name the columns (`us`, microseconds, first) and their types, keep their own state, and
    say in `ends` when it may go, in microseconds, or None for never.
    """
    columns: list[str] = []
    kinds = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.start(handle)

    def start(self, handle) -> None: ...

    def decide(self, key: tuple, rows: list[tuple]) -> pd.DataFrame: ...

    def ends(self) -> int | None: ...

    def forget(self) -> None: ...

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(pdf[self.columns].itertuples(index=False, name=None)))
                least = int(pdf["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(r for r in rows if r[0] <= watermark)
        if due:
            rest = [r for r in rows if r[0] > watermark]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
            else:
                self.waiting.clear()
            yield self.decide(key, due)
            rows = rest
        if not rows:
            end = self.ends()
            if end is not None and end <= watermark:
                self.forget()
            elif end is not None:
                self.handle.registerTimer(-(-end // 1000))


def with_micros(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)


def sliding_log(log: deque, us: int, limit: int, window_us: int) -> tuple[bool, int, float]:
    """One request against the log of admitted times, which a denied one leaves as it is: allowed,
    what remains, and seconds until the oldest entry leaves."""
    while log and log[0] <= us - window_us:
        log.popleft()
    ok = len(log) < limit
    if ok:
        log.append(us)
    return ok, limit - len(log), ((log[0] + window_us - us) if log else window_us) / 1e6


class SlidingLog(Ordered):
    columns, kinds = ["us", "request_id"], "us bigint, request_id bigint"

    def __init__(self, limit: int, window: float):
        self.limit, self.window_us = limit, round(window * 1e6)

    def start(self, handle):
        self.log = handle.getListState("log", "us bigint")

    def _held(self) -> deque:
        return deque(r[0] for r in self.log.get()) if self.log.exists() else deque()

    def decide(self, key, rows):
        log = self._held()
        out = [(key[0], request, us / 1e6, *sliding_log(log, us, self.limit, self.window_us)) for us, request in rows]
        if log:
            self.log.put([(us,) for us in log])
        else:
            self.log.clear()
        return pd.DataFrame(out, columns=["key", "request_id", "t", "allowed", "remaining", "reset"])

    def ends(self):
        log = self._held()
        return log[-1] + self.window_us if log else None

    def forget(self):
        self.log.clear()


def admissions_stream(requests: DataFrame, limit: int, window: float, delay: str = "1 hour") -> DataFrame:
    """Sliding-log admission of (key, request_id, ts): `limit` requests in any `window` seconds.

    State of a key: the rows not yet due and at most `limit` times; gone a window after the last.
    """
    keep_in_rocksdb(requests.sparkSession)
    rows = with_micros(requests.select("key", "request_id", "ts"), delay)
    return rows.groupBy("key").transformWithStateInPandas(
        SlidingLog(limit, window), "key bigint, request_id bigint, t double, allowed boolean, remaining int, reset double", "Append", "EventTime")


# Fixed value: the pools of a day are dealt into so many keys of state.
SLICES = 64


class DailyCaps(Ordered):
    """State of one (slice of the pools, day): requests each key of a pool has had. A key of state costs
    its timers and calls however few rows it has, so a day's many small pools share one."""
    columns, kinds = ["us", "request_id", "key", "pool", "pooled"], "us bigint, request_id bigint, key bigint, pool bigint, pooled boolean"

    def __init__(self, per_key: int | None, per_pool: int | None):
        self.per_key, self.per_pool = per_key, per_pool

    def start(self, handle):
        self.used = handle.getListState("used", "pool bigint, pooled boolean, key bigint, n int")
        self.total = handle.getValueState("total", "day_end bigint")

    def decide(self, key, rows):
        counts, totals, out = {}, {}, []
        for pool, pooled, who, n in (self.used.get() if self.used.exists() else ()):
            counts[pool, pooled, who] = n
            totals[pool, pooled] = totals.get((pool, pooled), 0) + n
        for _, request, who, *pool in rows:
            pool = tuple(pool)
            used, total = counts.get((*pool, who), 0), totals.get(pool, 0)
            ok = (self.per_key is None or used < self.per_key) and (self.per_pool is None or total < self.per_pool)
            counts[*pool, who], totals[pool] = used + ok, total + ok
            out.append((pool[0] if pool[1] else None, key[1], request, bool(ok)))
        self.used.put([(*k, int(n)) for k, n in counts.items()])
        self.total.update(((rows[0][0] // DAY_US + 1) * DAY_US,))
        found = pd.DataFrame(out, columns=["pool", "day", "request_id", "admitted"])
        return found.astype({"pool": "Int64"})

    def ends(self):
        return self.total.get()[0] if self.total.exists() else None

    def forget(self):
        self.used.clear()
        self.total.clear()


def daily_caps_stream(requests: DataFrame, per_key: int | None, per_pool: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Requests (pool, key, request_id, ts) under two daily caps, all or nothing: one is admitted while both
    its key and its pool have room that UTC day, and a refused one counts for neither.

    A key without a pool of its own is its pool. State of a day goes when the watermark passes
    midnight; no request of that day is answered after that.
    """
    keep_in_rocksdb(requests.sparkSession)
    rows = with_micros(requests.select("pool", "key", "request_id", "ts"), delay).withColumns({
        "day": F.to_date("ts"), "slice": F.pmod(F.xxhash64("pool"), F.lit(SLICES)),
        "pooled": F.col("pool").isNotNull(), "pool": F.coalesce("pool", F.lit(0))})
    return rows.groupBy("slice", "day").transformWithStateInPandas(
        DailyCaps(per_key, per_pool), "pool bigint, day date, request_id bigint, admitted boolean", "Append", "EventTime")


def daily_caps(requests: DataFrame, per_key: int | None, per_pool: int | None = None) -> DataFrame:
    """Batch form. What the pool refuses would not have filled its key: the requests admitted are the first
    `per_pool` of a pool's day among those that are the first `per_key` of their key's."""
    first = Window.partitionBy("day", "pool", "key").orderBy("ts", "request_id")
    rows = requests.withColumn("day", F.to_date("ts"))
    rows = rows.withColumn("_own", F.row_number().over(first) <= (per_key if per_key is not None else 2 ** 31 - 1))
    together = Window.partitionBy("day", "pool").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum(F.col("_own").cast("int")).over(together)
    room = F.lit(True) if per_pool is None else place <= per_pool
    return rows.select("pool", "day", "request_id", (F.col("_own") & room).alias("admitted"))


class RuleState(Ordered):
    """Positions of one ticker: held since an entry, the best close since, and a lower CUSUM."""
    columns = ["us", "seq", "close", "enter", "leave", "atr", "z"]
    kinds = "us bigint, seq bigint, close double, enter boolean, leave boolean, atr double, z double"

    def __init__(self, multiple: float, allowance: float, idle: float | None):
        self.multiple, self.allowance = multiple, allowance
        self.idle_us = None if idle is None else round(idle * 1e6)

    def start(self, handle):
        self.now = handle.getValueState("now", "held boolean, best double, low double, worst double, us bigint")

    def decide(self, key, rows):
        held, best, low, worst, _ = self.now.get() if self.now.exists() else (False, None, 0.0, 0.0, 0)
        out = []
        for us, seq, close, enter, leave, atr, z in rows:
            held = not bool(leave) if held else bool(enter)
            if best is None:
                best = close if enter and atr is not None and atr == atr else None
            else:
                best = max(best, close)
                best = None if atr is not None and close < best - self.multiple * atr else best
            if z is not None and z == z:
                low = max(0.0, low - z - self.allowance)
                worst = max(worst, low)
            out.append((key[0], seq, float(held), float(best is not None), best, low, worst))
        self.now.update((held, best, low, worst, rows[-1][0]))
        return pd.DataFrame(out, columns=["ticker", "seq", "held", "trailing", "best", "low", "worst"])

    def ends(self):
        return self.now.get()[4] + self.idle_us if self.idle_us is not None and self.now.exists() else None

    def forget(self):
        self.now.clear()


_RULES = "ticker string, seq bigint, held double, trailing double, best double, low double, worst double"


def rule_states_stream(bars: DataFrame, multiple: float = 3.0, allowance: float = 0.5, delay: str = "1 hour",
                       idle: float | None = None) -> DataFrame:
    """Per bar (ticker, ts, seq, close, enter, leave, atr, z) what the rules that remember hold.

    `held`: 1 from an `enter` bar to a `leave` bar; `trailing`: 1 from an `enter` bar until the close falls
    `multiple` ATRs below `best`, the highest close since; `low`, `worst`: the lower CUSUM of z after
    `allowance` and its largest value. A null never enters, leaves or moves anything. State is one
    row a ticker, kept `idle` seconds after its last bar (None: always).
    """
    keep_in_rocksdb(bars.sparkSession)
    rows = with_micros(bars.select("ticker", "ts", *[c for c in RuleState.columns if c != "us"]), delay)
    return rows.groupBy("ticker").transformWithStateInPandas(RuleState(multiple, allowance, idle), _RULES, "Append", "EventTime")
