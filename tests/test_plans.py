"""What the plans look like, and that every query has a stable contract."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from brasstide.operators import chat, features, retrieval
from brasstide.plans import catalog
from brasstide.sources.derived import bars, table


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_bar_predicates_reach_the_scan(spark, sf):
    df = catalog.queries()["read_bars"](spark, sf)
    text = plan(df)
    assert "PushedFilters" in text and "In(ticker" in text and "GreaterThanOrEqual(day" in text


def test_indicators_use_one_exchange(spark, sf):
    b = bars(spark, sf)
    text = plan(features.indicators(b, ["sma20", "ema26", "macd", "rsi14", "atr14"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert "provider" not in plan(features.indicators(b, ["sma20"]).select("ticker", "sma20"))


def test_rank_limits_before_the_shuffle(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("id"), "role", F.col("text").alias("content"))
    assert "WindowGroupLimit" in plan(chat.memory_window(m))
    v = table(spark, sf, "embeddings")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    text = plan(retrieval.exact_topk(q, v, 5))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "sharpe_ratio" in df.columns
