import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasstide.operators.rules import trailing_stop
from brasstide.streaming import jobs, state, tables

START = dt.datetime(2024, 3, 4, 20, 0)
AT = "ts timestamp"


def streamed(spark, path, batches, schema):
    """A file stream that takes one list of rows a micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{n}")
        (file,) = (path / "in" / str(n)).glob("part-*.parquet")
        (path / "rows").mkdir(exist_ok=True)
        file.rename(path / "rows" / f"{n:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows")


def out_of_order(rows, size, reach, seed=5):
    """Batches whose rows come up to `reach` seconds after later ones."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[-1] + dt.timedelta(seconds=rng.uniform(0, reach)))
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def requests(n, hours, keys, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(keys), i, START + dt.timedelta(seconds=round(rng.uniform(0, hours * 3600), 3))) for i in range(n)]


def rows_left(spark, path, name):
    return (spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", name).load()).count()


def test_admissions_in_any_order_equal_the_batch_form(spark, tmp_path):
    rows = requests(300, 5, 6)
    last = max(r[-1] for r in rows)
    fence = (99, 10 ** 6, last + dt.timedelta(days=2))  # moves the watermark past all windows
    schema = "key bigint, request_id bigint, ts timestamp"
    s = state.admissions_stream(streamed(spark, tmp_path, [*out_of_order(rows, 60, 1500), [fence]], schema), 4, 3600.0, "30 minutes")
    got = {r.request_id: (r.allowed, r.remaining) for r in jobs.run_to_table(s, str(tmp_path)).collect()}
    flat = spark.createDataFrame(rows, schema).withColumn("t", F.unix_micros("ts") / 1e6)
    want = {r.request_id: (r.allowed, r.remaining) for r in jobs.admissions(flat, 4, 3600.0).collect()}
    assert got == want and 0 < sum(a for a, _ in got.values()) < 300
    assert rows_left(spark, tmp_path, "log") == 0
    assert rows_left(spark, tmp_path, "waiting") == 1  # the fence itself


def test_caps_are_all_or_nothing_and_go_at_midnight(spark, tmp_path):
    rows = [(-1 if k < 5 else k, k, i, t) for k, i, t in requests(250, 30, 9)]
    last = max(r[-1] for r in rows)
    fence = (77, 77, 10 ** 6, last + dt.timedelta(days=3))
    too_late = (5, 5, 10 ** 6 + 1, START)
    schema = "pool bigint, key bigint, request_id bigint, ts timestamp"
    s = state.daily_caps_stream(streamed(spark, tmp_path, [*out_of_order(rows, 70, 1500), [fence], [too_late], [(78, 78, 10 ** 6 + 2, fence[-1])]], schema),
                                6, 20, "30 minutes")
    got = {r.request_id: r.admitted for r in jobs.run_to_table(s, str(tmp_path)).collect()}
    want = {r.request_id: r.admitted for r in state.daily_caps(spark.createDataFrame(rows, schema), 6, 20).collect()}
    used, total, loop = {}, {}, {}
    for pool, key, i, t in sorted(rows, key=lambda r: (r[3], r[2])):
        a, b = (key, t.date()), (pool, t.date())
        loop[i] = used.get(a, 0) < 6 and total.get(b, 0) < 20
        if loop[i]:
            used[a], total[b] = used.get(a, 0) + 1, total.get(b, 0) + 1
    assert want == loop
    assert 10 ** 6 + 1 not in got
    assert got == want and len(set(want.values())) == 2
    assert rows_left(spark, tmp_path, "total") == 0 and rows_left(spark, tmp_path, "used") == 0


def test_rule_states_equal_their_rules(spark, tmp_path):
    rng = np.random.default_rng(8)
    bars, want = [], {}
    for name in ("A", "B"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
        trend = np.where(np.arange(120) < 10, np.nan, np.convolve(close, np.ones(10) / 10)[:120])
        atr = np.where(np.arange(120) < 14, np.nan, 0.015 * close)
        z = rng.normal(-0.1, 1, 120)
        enter, leave = close > trend, close < trend - 0.01 * close
        held, low, worst, inside = [], [], [], False
        for t in range(120):
            inside = not leave[t] if inside else bool(enter[t])
            held.append(float(inside))
            low.append(max(0.0, (low[-1] if low else 0.0) - z[t] - 0.5))
            worst.append(max(worst[-1] if worst else 0.0, low[-1]))
        stop = trailing_stop(close, trend, atr, 2.0)
        for t in range(120):
            bars.append((name, t, float(close[t]), bool(enter[t]), bool(leave[t]), None if np.isnan(atr[t]) else float(atr[t]), float(z[t]),
                         START + dt.timedelta(minutes=t)))
            want[name, t] = (held[t], float(stop[t]), low[t], worst[t])
    schema = "ticker string, seq bigint, close double, enter boolean, leave boolean, atr double, z double, ts timestamp"
    fence = ("Z", 0, 1.0, False, False, None, None, START + dt.timedelta(days=9))
    s = state.rule_states_stream(streamed(spark, tmp_path, [*out_of_order(bars, 50, 900), [fence]], schema), 2.0, delay="20 minutes", idle=86_400.0)
    got = {(r.ticker, r.seq): (r.held, r.trailing, r.low, r.worst) for r in jobs.run_to_table(s, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert rows_left(spark, tmp_path, "now") == 0


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("part-*.parquet")}


def test_merge_rewrites_only_its_days_and_sets_late_rows_apart(spark, tmp_path):
    schema = "ticker string, day date, close double, at timestamp, seq bigint"
    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]

    def row(d, close, hour, seq, ticker="A"):
        return ticker, day[d], close, dt.datetime(2024, 1, d + 1, hour), seq

    merge = tables.TableMerge(str(tmp_path), ["ticker", "day"], ["at", "seq"], delay="30 hours")
    merge(spark.createDataFrame([row(0, 1.0, 10, 1), row(0, 5.0, 9, 2, "B"), row(1, 2.0, 10, 3)], schema), 0)
    first = files(tmp_path / "table" / "day=2024-01-01")
    batch = spark.createDataFrame([row(1, 2.5, 11, 4), row(1, 1.5, 9, 5), row(2, 3.0, 12, 6)], schema)
    merge(batch, 1)
    assert files(tmp_path / "table" / "day=2024-01-01") == first
    merge(spark.createDataFrame([row(0, 9.0, 23, 7), row(2, 4.0, 13, 8)], schema), 2)  # 1 January is 37 hours back
    merge(spark.createDataFrame([row(0, 9.0, 23, 7), row(2, 4.0, 13, 8)], schema), 2)  # the same batch again
    got = sorted((r.ticker, r.day, r.close) for r in merge.table(spark).collect())
    assert got == [("A", day[0], 1.0), ("A", day[1], 2.5), ("A", day[2], 4.0), ("B", day[0], 5.0)]
    assert [(r.close, r.batch) for r in merge.late(spark).collect()] == [(9.0, 2)]


def test_views_have_one_row_a_key_after_a_replay(spark, tmp_path):
    bars = [("A", dt.date(2024, 1, d), float(d)) for d in range(1, 9)]
    store = tables.ViewStore(str(tmp_path), tables.trailing_views, "v1")
    for n, rows in enumerate((bars[:3], bars[3:6], bars[3:6], bars[6:])):
        store(spark.createDataFrame(rows, "ticker string, day date, close double"), n if n < 2 else n - 1)
    newer = tables.ViewStore(str(tmp_path), tables.trailing_views, "v2")
    newer(spark.createDataFrame(bars[7:], "ticker string, day date, close double"), 3)
    got = sorted((r.version, r.as_of.day, r["mean"], r.bars) for r in store.views(spark).collect())
    want = [("v1", d, sum(range(max(1, d - 4), d + 1)) / min(5, d), min(5, d)) for d in range(1, 9)]
    assert got == [*want, ("v2", 8, 6.0, 5)]
    store(spark.createDataFrame([], "ticker string, day date, close double"), 9)


def test_small_pools_of_a_day_share_a_key_of_state(spark, tmp_path):
    rows = [(k, k, k, START + dt.timedelta(seconds=k)) for k in range(400)] + [(None, 1, 900, START), (0, 1, 901, START)]
    schema = "pool bigint, key bigint, request_id bigint, ts timestamp"
    fence = (77, 77, 10 ** 6, START + dt.timedelta(hours=2))
    s = state.daily_caps_stream(streamed(spark, tmp_path, [rows, [fence]], schema), 1, 1, "30 minutes")
    got = {r.request_id: (r.pool, r.admitted) for r in jobs.run_to_table(s, str(tmp_path)).collect()}
    want = {r.request_id: (r.pool, r.admitted) for r in state.daily_caps(spark.createDataFrame(rows, schema), 1, 1).collect()}
    assert got == want and len(got) == 402 and got[900] == (None, True)
    assert 0 < rows_left(spark, tmp_path, "total") <= state.SLICES
