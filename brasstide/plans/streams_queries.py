"""The streaming jobs run over the supplied events, and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brasstide.operators.features import Features
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import Ctes, r
from brasstide.session import shared_folder
from brasstide.sources.derived import table, written
from brasstide.streaming import jobs, state, tables

QUERIES, SQL = {}, {}
C = Ctes()


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


def _place(spark, name):
    return f"{shared_folder(spark)}/brasstide/streams/{name}-{uuid.uuid4().hex}"


def events_stream(spark, sf):
    """The events as a stream of files ordered by time."""
    stored = written(spark, sf, "events_by_time", lambda: table(spark, sf, "events").withColumn(
        "ts", F.col("ts").cast("timestamp")).repartitionByRange("ts"))
    return spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])


def ticks(spark, sf):
    return events_stream(spark, sf).select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("seq"),
                                           F.col("value").alias("price"))


@query("stream_daily_bars", """
  SELECT event_type AS ticker, CAST(ts AS DATE) AS day, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    max_by(value, (ts, event_id)) AS close, count(*) AS volume FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _bars(spark, sf):
    return jobs.run_to_table(jobs.daily_bars(ticks(spark, sf)), _place(spark, "bars"))


@query("stream_enriched_bars", """
  SELECT event_type AS ticker, CAST(ts AS DATE) AS day, count(*) AS volume, 'US' AS exchange, 'USD' AS currency FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _enriched(spark, sf):
    s = jobs.with_market_columns(jobs.daily_bars(ticks(spark, sf))).select("ticker", "day", "volume", "exchange", "currency")
    return jobs.run_to_table(s, _place(spark, "enriched"))


@query("stream_late_corrections", """
  SELECT event_type AS ticker, CAST(ts AS DATE) AS day, max_by(value, (ts, event_id)) AS close, max(ts) AS at FROM events GROUP BY 1, 2""")
def _corrections(spark, sf):
    place = _place(spark, "merge")
    rows = ticks(spark, sf).select("ticker", F.to_date("ts").alias("day"), F.col("price").alias("close"), F.col("ts").alias("at"), "seq")
    merge = tables.TableMerge(place, ["ticker", "day"], ["at", "seq"])
    _into(rows, merge, place)
    return merge.table(spark).select("ticker", "day", "close", F.col("at").cast("timestamp_ntz").alias("at"))


def _into(rows, writer, place):
    q = (rows.writeStream.foreachBatch(writer).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


@query("stream_views_on_close", f"""
  WITH b AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS day, max_by(value, (ts, event_id)) AS close FROM events
    WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2)
  SELECT ticker, day AS as_of, 'v1' AS version, {r('avg(close) OVER w', 6, 'mean')}, min(close) OVER w AS low, max(close) OVER w AS high, count(*) OVER w AS bars
  FROM b WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _views(spark, sf):
    place = _place(spark, "views")
    store = tables.ViewStore(place, tables.trailing_views, "v1")
    _into(jobs.daily_bars(ticks(spark, sf)), store, place)
    return rounded(store.views(spark).select("ticker", "as_of", "version", "mean", "low", "high", "bars"), {"mean": 6})


@query("stream_request_counts", """
  WITH w AS (SELECT user_id AS key, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND * k AS start FROM events, (SELECT unnest(range(0, 6)) AS k))
  SELECT key, start, count(*) AS requests FROM w WHERE start + INTERVAL 60 SECOND <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY 1, 2""")
def _counts(spark, sf):
    s = jobs.request_counts(events_stream(spark, sf).select("ts", F.col("user_id").alias("key")))
    return jobs.run_to_table(s, _place(spark, "counts")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, s
  HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _sessions(spark, sf):
    s = jobs.activity_sessions(events_stream(spark, sf), "6 hours", "1 hour")
    return jobs.run_to_table(s, _place(spark, "sessions")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_seen", "SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events")
def _dedup(spark, sf):
    rows = events_stream(spark, sf).select("event_type", "ts", F.to_date("ts").alias("day"))
    out = jobs.run_to_table(jobs.first_seen(rows, ["event_type", "day"], "2 days"), _place(spark, "dedup"))
    return out.select("event_type", "day")


def _requests(df):
    return df.select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"),
                     (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


# Admission in SQL, one request of every user at a time; the log is the last two admitted times.
C.raw("walk", """ord AS MATERIALIZED (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (/*recursive*/
  SELECT key, event_id, t, n, true AS allowed, t AS a, CAST(NULL AS DOUBLE) AS b FROM ord WHERE n = 1
  UNION ALL
  SELECT o.key, o.event_id, o.t, o.n, NOT (coalesce(w.a > o.t - 43200, false) AND coalesce(w.b > o.t - 43200, false)),
    CASE WHEN NOT (coalesce(w.a > o.t - 43200, false) AND coalesce(w.b > o.t - 43200, false)) THEN o.t ELSE w.a END,
    CASE WHEN NOT (coalesce(w.a > o.t - 43200, false) AND coalesce(w.b > o.t - 43200, false)) THEN w.a ELSE w.b END
  FROM walk w JOIN ord o ON o.key = w.key AND o.n = w.n + 1)""")


@query("sliding_log_admissions", "SELECT key, event_id AS request_id, allowed FROM walk")
def _admit(spark, sf):
    return jobs.admissions(_requests(table(spark, sf, "events")), 2, 43200.0).select("key", "request_id", "allowed")


# Rows that the watermark has passed at the end of the stream.
_PASSED = "epoch_us({ts}) <= ((SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000) * 1000"


@query("stream_admissions", f"SELECT key, event_id AS request_id, allowed FROM walk JOIN events USING (event_id) WHERE {_PASSED.format(ts='events.ts')}")
def _admit_stream(spark, sf):
    req = events_stream(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    return jobs.run_to_table(state.admissions_stream(req, 2, 43200.0), _place(spark, "admit")).select("key", "request_id", "allowed")


def _pooled(df):
    """Users in pools: every tenth shares one, the others are their own."""
    return df.select(F.when(F.col("user_id") % 10 == 0, F.lit(-1)).otherwise(F.col("user_id")).cast("bigint").alias("pool"),
                     F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))


C.add("own_caps", """
  SELECT event_id AS request_id, ts, CAST(ts AS DATE) AS day, CASE WHEN user_id % 10 = 0 THEN -1 ELSE user_id END AS pool,
    row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) <= 2 AS own FROM events""")
C.add("caps", """
  SELECT request_id, ts, own AND sum(CAST(own AS INT)) OVER (PARTITION BY day, pool ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 5
    AS admitted FROM own_caps""")


@query("stream_daily_caps", f"SELECT request_id, admitted FROM caps WHERE {_PASSED.format(ts='caps.ts')}")
def _caps(spark, sf):
    s = state.daily_caps_stream(_pooled(events_stream(spark, sf)), 2, 5)
    return jobs.run_to_table(s, _place(spark, "caps")).select("request_id", "admitted")


@query("pooled_daily_caps", "SELECT request_id, admitted FROM caps")
def _caps_batch(spark, sf):
    return state.daily_caps(_pooled(table(spark, sf, "events")), 2, 5).select("request_id", "admitted")


# Rules over the events of a user: enter above 60, leave below 40, an ATR of a tenth of the value, z as distance from 50.
C.raw("states", """rows_of AS MATERIALIZED (SELECT user_id, event_id AS seq, ts, value AS c, value > 60 AS e, value < 40 AS l, value / 10 AS a, (value - 50) / 30 AS z,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
states AS (/*recursive*/
  SELECT user_id, seq, ts, n, e AS held, CASE WHEN e THEN c END AS best, greatest(0.0, -z - 0.5) AS low, greatest(0.0, -z - 0.5) AS worst FROM rows_of WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.seq, o.ts, o.n, CASE WHEN s.held THEN NOT o.l ELSE o.e END,
    CASE WHEN s.best IS NULL THEN CASE WHEN o.e THEN o.c END WHEN o.c < greatest(s.best, o.c) - 3.0 * o.a THEN NULL ELSE greatest(s.best, o.c) END,
    greatest(0.0, s.low - o.z - 0.5), greatest(s.worst, s.low - o.z - 0.5)
  FROM states s JOIN rows_of o ON o.user_id = s.user_id AND o.n = s.n + 1)""")


@query("stream_rule_states", f"""
  SELECT CAST(user_id AS VARCHAR) AS ticker, seq, CAST(held AS INT)::DOUBLE AS held, CAST(best IS NOT NULL AS INT)::DOUBLE AS trailing, best,
    {r('low', 6, 'low')}, {r('worst', 6, 'worst')} FROM states WHERE {_PASSED.format(ts='states.ts')}""")
def _rule_states(spark, sf):
    v = F.col("value")
    bars = events_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("ticker"), "ts", F.col("event_id").alias("seq"), v.alias("close"), (v > 60).alias("enter"),
        (v < 40).alias("leave"), (v / 10).alias("atr"), ((v - 50) / 30).alias("z"))
    return rounded(jobs.run_to_table(state.rule_states_stream(bars), _place(spark, "rules")), {"low": 6, "worst": 6})


C.add("seqs", "SELECT event_type AS ticker, event_id AS seq, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events")
_EMA = f"""
  SELECT a.ticker, a.seq, CASE WHEN a.i >= 11 THEN {r('sum(CASE WHEN b.i = 0 THEN 1.0 ELSE 2.0 / 13 END * power(11.0 / 13, a.i - b.i) * b.price)', 6, 'x').removesuffix(' AS x')} END AS ema
  FROM seqs a JOIN seqs b ON a.ticker = b.ticker AND b.i <= a.i AND b.i > a.i - 400 GROUP BY a.ticker, a.seq, a.i"""


@query("stream_ema", _EMA)
def _ema(spark, sf):
    out = jobs.run_to_table(jobs.ema_stream(ticks(spark, sf), 12), _place(spark, "ema"))
    return rounded(out, {"ema": 6})


@query("tick_ema", _EMA)
def _tick_ema(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.struct("ts", "event_id").alias("day"),
                                          F.col("event_id").alias("seq"), F.col("value").alias("price"))
    f = Features()
    name = f.ema("price", 12)
    return rounded(f.apply(t).select("ticker", "seq", F.col(name).alias("ema")), {"ema": 6})
