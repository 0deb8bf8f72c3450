"""Conversation windows, pages, traces and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import chat
from brasstide.plans.sqltext import Ctes
from brasstide.sources.derived import table

QUERIES, SQL = {}, {}
C = Ctes()


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


def messages(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"))


C.add("messages", "SELECT conv_id, conv_id * 100 + turn AS id, role, text AS content FROM conversations")


@query("memory_window", """
  WITH m AS (SELECT * FROM messages WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) <= 10),
  c AS (SELECT conv_id, id, role, CASE WHEN length(content) <= 2000 THEN length(content)
          ELSE length(regexp_replace(substr(content, 1, 2000 - 13), '\\s+$', '')) + 13 END AS n FROM m WHERE trim(content) <> ''),
  t AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM c)
  SELECT conv_id, id, role, n AS chars FROM t WHERE t <= 8000""")
def _memory(spark, sf):
    return chat.memory_window(messages(spark, sf)).select("conv_id", "id", "role", F.length("content").cast("bigint").alias("chars"))


@query("history_page", """
  SELECT conv_id, id, CASE WHEN count(*) OVER p = 2 THEN max(id) OVER p END AS next_cursor FROM (
    SELECT * FROM messages WHERE id > conv_id * 100 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY id) <= 2) WINDOW p AS (PARTITION BY conv_id)""")
def _page(spark, sf):
    return chat.history_page(messages(spark, sf), F.col("conv_id") * 100, 2).select("conv_id", "id", "next_cursor")


@query("recent_threads", """
  WITH t AS (SELECT user_id AS owner, CAST(ts AS DATE) AS conv_day, max(ts) AS updated_at, max(event_id) AS conv_id FROM events GROUP BY 1, 2)
  SELECT owner, conv_id, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, conv_id DESC) AS rank FROM t
  QUALIFY row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, conv_id DESC) <= 20""")
def _threads(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("owner"), F.to_date("ts").alias("d")).agg(
        F.max("ts").alias("updated_at"), F.max("event_id").alias("conv_id"))
    return chat.recent_threads(t, 20).select("owner", "conv_id", F.col("rank").cast("bigint").alias("rank"))


@query("conversation_titles", """
  SELECT conv_id, CASE WHEN length(l) <= 60 THEN l ELSE rtrim(substr(l, 1, 59)) || '…' END AS title FROM (
    SELECT conv_id, string_split(trim(min_by(content, id)), chr(10))[1] AS l FROM messages WHERE role = 'user' GROUP BY conv_id)""")
def _titles(spark, sf):
    first = messages(spark, sf).filter("role = 'user'").groupBy("conv_id").agg(F.min_by("content", "id").alias("t"))
    return first.select("conv_id", chat.title(F.col("t")).alias("title"))


@query("question_answers", """
  SELECT a.conv_id, a.id AS answer_id, max(q.id) AS question_id FROM messages a JOIN messages q ON q.conv_id = a.conv_id AND q.id < a.id
    AND q.role = 'user' WHERE a.role = 'assistant' GROUP BY a.conv_id, a.id""")
def _qa(spark, sf):
    return chat.question_answers(messages(spark, sf)).select("conv_id", "answer_id", "question_id")


@query("trace_export", """
  WITH t AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM messages WHERE id >= 1000)
  SELECT conv_id, turn, min(id) AS question_id, count(*) AS steps, string_agg(role, ' ' ORDER BY id) AS roles FROM t WHERE turn > 0 GROUP BY conv_id, turn""")
def _traces(spark, sf):
    return chat.traces(messages(spark, sf), F.lit(1000), F.lit(2 ** 60))


@query("retrieved_chunks", """
  SELECT event_id AS step_id, event_type AS query, k AS rank, concat('c', event_id + k) AS chunk_id FROM events, (SELECT unnest([1, 2]) AS k)""")
def _hits(spark, sf):
    e = table(spark, sf, "events")
    hit = lambda k: F.struct(F.concat(F.lit("c"), (F.col("event_id") + k).cast("string")).alias("chunk_id"), F.lit(0.5).alias("score"))
    steps = e.select(F.col("event_id").alias("step_id"), F.to_json(F.struct(F.col("event_type").alias("query"))).alias("arguments"),
                     F.to_json(F.struct(F.array(hit(1), hit(2)).alias("results"))).alias("result"))
    return chat.retrieved_chunks(steps).select("step_id", "query", "rank", "chunk_id")


def _requests(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"), F.col("event_type").alias("scope"),
                                             F.col("user_id").alias("key"), F.length("props").alias("tokens"))


@query("daily_usage", "SELECT CAST(ts AS DATE) AS day, event_type AS scope, user_id AS key, count(*) AS questions, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2, 3")
def _usage(spark, sf):
    return chat.daily_usage(_requests(spark, sf))


@query("daily_caps", "SELECT event_id AS request_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def _caps(spark, sf):
    return chat.daily_caps(_requests(spark, sf), 2).select("request_id", "admitted")


@query("activity_sessions", """
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
  SELECT user_id, count(*) AS events, min(ts) AS "start" FROM s GROUP BY user_id, s""")
def _sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return chat.sessions(e, gap="6 hours").select("user_id", "events", F.col("start").cast("timestamp_ntz").alias("start"))
