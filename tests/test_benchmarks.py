"""Prices against their market's index: what the plans must not hold."""

import datetime as dt

from pyspark.sql import functions as F

from brasstide.functions import markets
from brasstide.operators import analytics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_sent_to_the_prices(spark):
    rows = spark.createDataFrame([(t, dt.date(2020, 1, d), 10.0 + d) for t in "AB" for d in range(1, 9)], "ticker string, day date, adj_close double")
    marked = markets.with_market(rows)
    index = rows.filter("ticker = 'A'").withColumnRenamed("ticker", "benchmark").withColumn("benchmark", F.lit("SPY"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = analytics.with_benchmark(marked, index)
        assert "SortMergeJoin" not in plan(pairs) and "BroadcastHashJoin" in plan(pairs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exchanges_are_told_without_patterns(spark):
    names = ["a.ns ", "X.BO", "BRK.B", "^nsei", "^BSESN", "^X.NS", "X.NS.B", "A.N.S", "NS", None]
    df = spark.createDataFrame([(n,) for n in names], "ticker string").select(markets.exchange_of(F.col("ticker")).alias("x"))
    assert [r.x for r in df.collect()] == ["NSE", "BSE", "US", "NSE", "BSE", "NSE", "US", "US", "US", "US"]
    assert "regexp" not in plan(df)
