import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brasstide.llm import mixing


def test_shares_reach_their_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"))
    got = Counter(r.source for r in mixing.mix(df, {"big": 1.0, "mid": 2.0}).collect())
    assert got[None] == 0 and abs(got["big"] - 10_000) < 400 and abs(got["mid"] - 20_000) < 600
    even = Counter(r.source for r in mixing.mix(df, temper=0.0, total=9000).collect())
    assert all(abs(even[s] - 3000) < 300 for s in ("big", "mid", None))


@pytest.mark.parametrize("rate", [0.3, 5.0, 47.5])
def test_counts_follow_a_poisson_distribution(spark, rate):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    got = Counter(r.doc_id for r in mixing.mix(df, total=int(rate * n)).select("doc_id").collect())
    counts = [got.get(i, 0) for i in range(n)]
    mean = sum(counts) / n
    var = sum((c - mean) ** 2 for c in counts) / n
    assert abs(mean - rate) < 5 * math.sqrt(rate / n) and abs(var / rate - 1) < 0.15


def test_reruns_and_partitionings_agree(spark, documents):
    a = mixing.mix(documents).select("mix_key", "doc_id", "mix_copies").collect()
    b = mixing.mix(documents.repartition(9)).select("mix_key", "doc_id", "mix_copies").collect()
    assert sorted(a) == sorted(b) and [r.mix_key for r in a] == sorted(r.mix_key for r in a)


def test_odd_rows(odd, nothing):
    got = mixing.mix(odd, temper=1.0, total=200)
    assert set(odd.columns) <= set(got.columns) and dict(got.dtypes)["mix_copy"] == "int"
    rows = got.collect()
    by_id = Counter((r.doc_id, r.text) for r in rows)
    n = Counter((r.doc_id, r.text) for r in odd.collect())
    for key, copies in by_id.items():
        assert copies == n[key] * next(r.mix_copies for r in rows if (r.doc_id, r.text) == key)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(odd, weights={}).count() == 0
