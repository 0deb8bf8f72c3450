"""Conversation tables: what a model is shown again, pages of history, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The memory window.
WINDOW, MAX_MESSAGE, MAX_TOTAL, CLIPPED = 10, 2000, 8000, " …[truncated]"


def clip(text: Column, limit: int = MAX_MESSAGE) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(
        F.substring(text, 1, limit - len(CLIPPED)), r"\s+$", ""), F.lit(CLIPPED)))


def memory_window(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """The last user and assistant messages of every conversation, clipped, the oldest dropped while
    over the character budget. The rank limit is applied before the shuffle, so a conversation of
    any length sends at most `window` rows per task."""
    w = Window.partitionBy("conv_id").orderBy(F.col("id").desc())
    df = messages.filter(F.col("role").isin("user", "assistant"))
    df = df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= window)
    df = df.filter(F.trim("content") != "").withColumn("content", clip(F.col("content")))
    kept = F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_t", kept).filter(F.col("_t") <= MAX_TOTAL).drop("_k", "_t")


def history_page(messages: DataFrame, cursor: Column, size: int) -> DataFrame:
    """The page after `cursor` of every conversation; next_cursor only when the page is full."""
    w = Window.partitionBy("conv_id").orderBy("id")
    df = messages.filter(F.col("id") > cursor).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= size)
    last = F.max("id").over(Window.partitionBy("conv_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return df.withColumn("next_cursor", F.when(n == size, last)).drop("_k")


def recent_threads(conversations: DataFrame, size: int) -> DataFrame:
    """Each owner's most recently updated conversations."""
    w = Window.partitionBy("owner").orderBy(F.col("updated_at").desc(), F.col("conv_id").desc())
    return conversations.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def title(first_message: Column, limit: int = 60) -> Column:
    line = F.element_at(F.split(F.trim(first_message), "\n"), 1)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…")))


def question_answers(messages: DataFrame) -> DataFrame:
    """Each assistant message with the latest user message before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    q = F.when(F.col("role") == "user", F.struct("id", "content"))
    df = messages.withColumn("_q", F.last(q, ignorenulls=True).over(w))
    return df.filter((F.col("role") == "assistant") & F.col("_q").isNotNull()).select(
        "conv_id", F.col("_q.id").alias("question_id"), F.col("id").alias("answer_id"),
        F.col("_q.content").alias("question"), F.col("content").alias("answer"))


def traces(messages: DataFrame, since: Column, until: Column) -> DataFrame:
    """Exported turns: one row per question with the roles that followed it, in order."""
    w = Window.partitionBy("conv_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    df = messages.filter(F.col("id").between(since, until))
    df = df.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(w)).filter("turn > 0")
    return df.groupBy("conv_id", "turn").agg(
        F.min("id").alias("question_id"), F.count(F.lit(1)).alias("steps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "role"))), lambda x: x["role"]), " ").alias("roles"))


def retrieved_chunks(steps: DataFrame) -> DataFrame:
    """One row per hit of a search step: query, rank, chunk."""
    schema = "struct<results:array<struct<chunk_id:string,score:double>>>"
    args = "struct<query:string,company:string,section:string>"
    df = steps.withColumns({"_r": F.from_json("result", schema), "_a": F.from_json("arguments", args)})
    return df.select("step_id", "_a.query", "_a.section", F.posexplode("_r.results").alias("_n", "_h")).select(
        "step_id", "query", "section", (F.col("_n") + 1).alias("rank"), "_h.chunk_id", "_h.score")


def daily_usage(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.to_date("at").alias("day"), "scope", "key").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("tokens").alias("tokens"))


def daily_caps(requests: DataFrame, cap: int) -> DataFrame:
    """The first `cap` requests of each (UTC day, key) are admitted."""
    # The rank limit keeps `cap` rows per key before the shuffle; the rest are simply not in it.
    w = Window.partitionBy(F.to_date("at"), "key").orderBy("at", "request_id")
    first = (requests.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap)
             .select("request_id", F.lit(True).alias("_in")))
    return requests.join(first, "request_id", "left").withColumn(
        "admitted", F.coalesce("_in", F.lit(False))).drop("_in")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Activity sessions: events closer than `gap` belong together."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
