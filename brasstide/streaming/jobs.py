"""Event-time jobs: daily bars, request counts and limits, incremental indicators.

Every job takes a streaming DataFrame and returns one (or a foreachBatch writer), so sources and
sinks are the caller's. State is kept per key and bounded by the rule it implements.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState

from brasstide.functions.markets import with_market
from brasstide.streaming.state import sliding_log


def daily_bars(ticks: DataFrame, delay: str = "1 hour", key: str = "ticker") -> DataFrame:
    """Ticks (ticker, ts, seq, price) to daily bars, each emitted once its day is complete."""
    at = F.struct("ts", "seq")
    return (ticks.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), key).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select(key, F.to_date(F.col("window.start")).alias("day"), "open", "high", "low", "close", "volume"))


def request_counts(requests: DataFrame, delay: str = "1 minute", length: str = "60 seconds",
                   slide: str = "10 seconds") -> DataFrame:
    return (requests.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "key")
            .agg(F.count(F.lit(1)).alias("requests"))
            .select("key", F.col("window.start").alias("start"), "requests"))


def activity_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    return (events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("events"))
            .select("user_id", F.col("s.start").alias("start"), "events"))


def first_seen(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Repeats of a key within the watermark are dropped (refetched bars, repeated headlines)."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def with_market_columns(bars: DataFrame) -> DataFrame:
    """Stream enriched with its ticker's market."""
    return with_market(bars)


def _islands(requests: DataFrame, window: float) -> DataFrame:
    """Runs of requests with no gap of a whole window: the log is empty at their start, so they are
    decided independently. Found from one row per (key, window-long slice), so a busy key sends
    slices, not requests."""
    sliced = requests.withColumn("_slice", F.floor(F.col("t") / window))
    ends = sliced.groupBy("key", "_slice").agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    w = Window.partitionBy("key").orderBy("_slice")
    gap = F.coalesce(F.col("_a") - F.lag("_z").over(w) >= window, F.lit(True))
    ends = ends.withColumn("_new", gap.cast("int"))
    ends = ends.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return sliced.join(ends.select("key", "_slice", "island"), ["key", "_slice"]).drop("_slice")


def admissions(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """Batch form over (key, t seconds, request_id): allowed, remaining and seconds to reset.

    Islands are spread over tasks and read there in order as a stream of Arrow batches; only the
    current island's log (at most `limit` times) is held between batches.
    """
    schema = "key bigint, request_id bigint, t double, allowed boolean, remaining int, reset double"
    df = (_islands(requests, window).select("key", "island", "request_id", "t")
          .repartition("key", "island").sortWithinPartitions("key", "island", "t", "request_id"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, last, rows = deque(), None, []
        for pdf in batches:
            for key, island, request, t in pdf.itertuples(index=False, name=None):
                if (key, island) != last:
                    log, last = deque(), (key, island)
                rows.append((key, request, t, *sliding_log(log, round(t * 1e6), limit, round(window * 1e6))))
            yield pd.DataFrame(rows, columns=["key", "request_id", "t", "allowed", "remaining", "reset"])
            rows = []

    return df.mapInPandas(decide, schema)


def ema_stream(ticks: DataFrame, n: int) -> DataFrame:
    """EMA per ticker with its level as state; equals the batch scan over the same rows."""
    alpha = 2.0 / (n + 1)
    schema = "ticker string, seq bigint, ema double"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for price in rows["price"]:
            level = price if seen == 0 else level + alpha * (price - level)
            seen += 1
            out.append(level if seen >= n else None)
        state.update((float(level), int(seen)))
        yield rows[["ticker", "seq"]].assign(ema=pd.Series(out, index=rows.index, dtype="float64"))

    return ticks.groupBy("ticker").applyInPandasWithState(
        step, schema, "level double, seen int", "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything now available into parquet files and read them back."""
    spark: SparkSession = stream.sparkSession
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
