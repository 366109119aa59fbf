"""Streams with state: restarts, silence, late rows, and batches whose work doesn't grow."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestone.operators import events as ev
from tapestone.streaming import signals as st

START = pd.Timestamp("2024-01-01")


def run(spark, folder, schema, frames, make, sink=None):
    """Each frame is a file and a run of its own, from the checkpoint of the run before."""
    folder = str(folder)
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        writer = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{folder}/out")
        with st.rocksdb(spark):
            q = writer.start()
        q.awaitTermination()
    return None if sink else spark.read.parquet(f"{folder}/out")


BARS = "symbol string, bar long, ts timestamp, open double, high double, low double, close double, volume double"


def walk(n, seed=0, symbol="a"):
    r = np.random.default_rng(seed)
    close = 100 + np.cumsum(r.normal(size=n))
    open_ = np.r_[100.0, close[:-1]]
    high, low = np.maximum(open_, close) + r.exponential(0.8, n), np.minimum(open_, close) - r.exponential(0.8, n)
    return pd.DataFrame({"symbol": symbol, "bar": np.arange(n), "ts": START + pd.to_timedelta(np.arange(n), "h"), "open": open_, "high": high, "low": low, "close": close, "volume": 1.0})


@pytest.mark.parametrize("cuts", [(), (5,), (7, 31, 32, 120)])
def test_carried_state_is_the_batch_at_any_cut(spark, tmp_path, cuts):
    bars = walk(200)
    again = [bars.iloc[max(a - 3, 0) : b] for a, b in zip((0, *cuts), (*cuts, len(bars)))]  # each run sends three old bars again
    got = run(spark, tmp_path, BARS, again, st.incremental_sweeps).toPandas().sort_values(["direction", "bar"]).reset_index(drop=True)
    from tapestone.functions import indicators as ind

    rows = ev.sweep_rows(ev.sweep_flags(ind.add_sweep_inputs(spark.createDataFrame(bars, BARS))))
    want = rows.select("bar", "direction", "level", "depth").toPandas().sort_values(["direction", "bar"]).reset_index(drop=True)
    assert len(want) > 5 and got[["bar", "direction"]].equals(want[["bar", "direction"]])
    assert np.allclose(got[["level", "depth"]], want[["level", "depth"]])
    ema = bars["close"].ewm(span=50, adjust=False).mean()
    assert np.allclose(got["ema"], ema[got["bar"]])
    taken = {(r["direction"], r["bar"]) for r in ev.deduplicated_sweeps(rows, 4).collect()}
    assert {(d, b) for d, b, t in zip(got["direction"], got["bar"], got["taken"]) if t} == taken
    for _, side in got.groupby("direction"):
        assert (side["anchor"] == side.groupby((side["bar"].diff() != 1).cumsum())["bar"].transform("first")).all()


WAITING = "symbol string, bar long, ts timestamp, high double, low double, close double, sweep_long boolean, sweep_short boolean"


def waiting(symbol, bars, closes, sweeps=()):
    return pd.DataFrame({"symbol": symbol, "bar": bars, "ts": [START + pd.Timedelta(hours=b) for b in bars], "high": 10.0, "low": 8.0, "close": closes, "sweep_long": [b in sweeps for b in bars], "sweep_short": False})


def test_a_silent_series_expires_by_its_timer(spark, tmp_path):
    first = pd.concat([waiting("still", [0, 1], [9.0, 9.0], {1}), waiting("alive", [0, 1, 2], [9.0, 9.0, 11.0], {0, 2})])
    later = waiting("alive", [3, 4, 20], [9.0, 9.0, 9.0])
    make = lambda b: st.pending_confirmations(b, patience="3 hours 30 minutes")
    out = run(spark, tmp_path / "a", WAITING, [first], make)
    assert [tuple(r) for r in out.collect()] == [("alive", 0, "long", "confirmed", 2)]
    out = run(spark, tmp_path / "a", WAITING, [later], make)
    assert sorted(tuple(r) for r in out.collect()) == [("alive", 0, "long", "confirmed", 2), ("alive", 2, "long", "expired", None), ("still", 1, "long", "expired", None)]


def test_a_close_beyond_the_patience_confirms_nothing(spark, tmp_path):
    rows = waiting("a", [0, 1, 9], [9.0, 9.0, 99.0], {1})  # the third bar by count would confirm
    out = run(spark, tmp_path, WAITING, [rows], lambda b: st.pending_confirmations(b, max_wait=20, patience="3 hours"))
    assert [tuple(r)[3:] for r in out.collect()] == [("expired", None)]


TICKS = "symbol string, ts timestamp, seq long, price double, volume double"


def ticks(rows):
    return pd.DataFrame([("a", START + pd.Timedelta(minutes=m), i, float(p), 1.0) for m, i, p in rows], columns=["symbol", "ts", "seq", "price", "volume"])


def test_late_ticks_come_aside_once_and_mend_their_windows(spark, tmp_path):
    one = ticks([(5, 1, 10), (5, 1, 10), (50, 2, 12), (70, 3, 11), (135, 4, 9)])
    two = ticks([(30, 5, 99), (80, 6, 13), (200, 7, 8), (75, 3, 11)])  # 80 and 75 are for windows closed by then
    three = ticks([(125, 8, 1), (400, 9, 5)])  # late for the third
    out = run(spark, tmp_path, TICKS, [one, two, three], lambda t: st.bars_and_late(t, "1 hour", "10 minutes"))
    late = out.filter("late")
    assert sorted(r["seq"] for r in late.collect()) == [3, 5, 6, 8]
    bars = out.filter("not late").select("symbol", "ts", "open", "high", "low", "close", "volume")
    by_hour = {r["ts"].hour: tuple(r)[2:] for r in bars.collect()}
    assert by_hour == {0: (10.0, 12.0, 10.0, 12.0, 2.0), 1: (11.0, 11.0, 11.0, 11.0, 1.0), 2: (9.0, 9.0, 9.0, 9.0, 1.0), 3: (8.0, 8.0, 8.0, 8.0, 1.0)}
    stored = spark.createDataFrame(pd.concat([one, two, three]).drop_duplicates("seq"), TICKS)
    repairs = st.window_repairs(stored, late.filter("seq <> 8"), "1 hour")
    assert {r["ts"].hour for r in repairs.collect()} == {0, 1}
    mended = {r["ts"].hour: tuple(r)[2:] for r in st.with_repairs(bars, repairs).collect()}
    assert mended[0] == (10.0, 99.0, 10.0, 12.0, 3.0) and mended[1] == (11.0, 13.0, 11.0, 13.0, 2.0) and mended[2] == by_hour[2]


def job_of(folder, span="3 hours"):
    def plan(t):
        bars = t.groupBy("symbol", F.window("ts", "1 hour").start.alias("ts")).agg(F.max("price").alias("price"))
        rows = bars.filter("price > 100").withColumn("lifecycle_state", F.when(F.col("price") > 200, "shadow").otherwise("live"))
        return rows.withColumn("event_id", F.xxhash64("symbol", "ts"))

    return st.span_job(plan, *[f"{folder}/{n}" for n in ("lake", "signals", "shadow", "marks")], span, "1 hour")


def test_bounded_job_sends_once_and_leaves_old_days_unread(spark, tmp_path):
    sink = job_of(tmp_path)
    day = 24 * 60
    frames = [ticks([(10, 1, 150), (70, 2, 50)]), ticks([(75, 3, 250), (130, 4, 300)]), ticks([(5 * day, 5, 120)])]
    for i, f in enumerate(frames):
        sink(spark.createDataFrame(f, TICKS), i)
        sink(spark.createDataFrame(f, TICKS), i)  # a batch that is run again
    hours = lambda n: sorted(int(r["epoch"] - START.timestamp()) // 3600 for r in spark.read.parquet(f"{tmp_path}/{n}").select(F.unix_timestamp("ts").alias("epoch")).collect())
    # the second hour reached 250 before it closed, the third closed when the next came, the last is open
    assert hours("signals") == [0] and hours("shadow") == [1, 2]
    for root, _, names in os.walk(f"{tmp_path}/lake/day=2024-01-01"):
        for n in names:
            if n.endswith(".parquet"):
                os.chmod(f"{root}/{n}", 0o644)
                open(f"{root}/{n}", "wb").write(b"unreadable")
    # batches of later days don't open the old day's files
    for i, m in enumerate((5 * day + 70, 5 * day + 130), 3):
        sink(spark.createDataFrame(ticks([(m, 10 + i, 50)]), TICKS), i)
    assert hours("signals") == [0, 120]


def test_late_tick_in_a_batch_of_its_own_is_judged_again(spark, tmp_path):
    sink = job_of(tmp_path)
    for i, f in enumerate([ticks([(10, 1, 50), (70, 2, 50), (130, 3, 50)]), ticks([(20, 4, 150)])]):
        sink(spark.createDataFrame(f, TICKS), i)
    assert [r["ts"].hour for r in spark.read.parquet(f"{tmp_path}/signals").collect()] == [0]


def test_filter_goes_on_where_it_stopped(spark, tmp_path):
    r = np.random.default_rng(1)
    x = np.r_[r.normal(-1, 0.5, 40), r.normal(1, 0.5, 40)]
    rows = pd.DataFrame({"symbol": "a", "bar": np.arange(80), "x": x})
    rows.loc[10, "x"] = np.nan
    out = run(spark, tmp_path, "symbol string, bar long, x double", [rows[:33], rows[30:]], lambda d: st.streaming_states(d, (-1.0, 1.0), (0.5, 0.7), 0.9))
    p, want = np.array([0.5, 0.5]), []
    for v in rows["x"]:
        like = np.ones(2) if np.isnan(v) else np.exp(-0.5 * ((v - np.array([-1.0, 1.0])) / [0.5, 0.7]) ** 2) / [0.5, 0.7]
        p = p @ np.array([[0.9, 0.1], [0.1, 0.9]]) * like
        p = p / p.sum()
        want.append((int(p.argmax()), round(float(p.max()), 9)))
    got = [(r["state"], round(r["confidence"], 9)) for r in out.orderBy("bar").collect()]
    assert got == want
