"""The stream of bars and late ticks holds a window at a time, however many ticks a batch has, and is a plain loop's result."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapestone.streaming import signals as st

START = pd.Timestamp("2024-01-01")
TICKS = "symbol string, ts timestamp, seq long, price double, volume double"
HOUR = 3_600_000_000


class Caught:
    """Stands for a DataFrame and keeps the processors."""

    def __init__(self):
        self.processors = []

    def __getattr__(self, name):
        return lambda *a, **k: self

    def transformWithStateInPandas(self, processor, *rest):
        self.processors.append(processor)
        return self


class Held(dict):
    """A value or map state in memory, and the handle that gives it out."""

    getValueState = getMapState = lambda self, *a: Held()
    exists = lambda self: "v" in self
    get = lambda self: self["v"]
    update = lambda self, v: self.__setitem__("v", v)
    updateValue = lambda self, k, v: self.__setitem__(k, v)
    removeKey = lambda self, k: self.pop(k, None)
    iterator = lambda self: iter(self.items())


def test_a_batch_of_one_series_passes_in_chunks(spark):
    caught = Caught()
    st.bars_and_late(caught, "1 hour", "10 minutes")
    n, size, n_chunks = 0, 10_000, 40

    def chunks():
        for i in range(n_chunks):
            seq = np.arange(i * size, (i + 1) * size)
            yield pd.DataFrame({"symbol": "a", "at": seq * 1_000_000, "seq": seq, "price": 1.0, "volume": 1.0})

    first = caught.processors[0]
    first.init(Held())
    tracemalloc.start()
    for part in first.handleInputRows(("a",), chunks(), None):
        n += len(part)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 15 and n >= 100  # MB; one chunk is 0.4 MB, all ticks are 16 and as tuples more than 100


def test_late_ticks_of_one_window_pass_in_chunks(spark):
    caught = Caught()
    st.bars_and_late(caught, "1 hour", "10 minutes")
    n, size, n_chunks = 0, 10_000, 40
    chunks = (pd.DataFrame({"symbol": "a", "start": 0, "kind": "late", "at": 1, "seq": np.arange(i * size, (i + 1) * size), "price": 1.0, "volume": 1.0}) for i in range(n_chunks))
    second = caught.processors[1]
    second.init(Held())
    tracemalloc.start()
    for part in second.handleInputRows(("a", 0), chunks, None):
        n += int(part["late"].sum())
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 15 and n == n_chunks * size


def loop(batches):
    """Late seqs and bars by the definition, a batch after the other."""
    latest, ticks, late, closed = {}, {}, [], {}
    for batch in batches:
        bound = {s: m - 600_000_000 for s, m in latest.items()}
        for r in batch.itertuples():
            if pd.isna(r.ts):
                continue
            at = r.ts.value // 1000
            start = at // HOUR * HOUR
            if r.symbol in bound and start + HOUR <= bound[r.symbol]:
                late.append((r.symbol, r.seq))
                continue
            ticks.setdefault((r.symbol, start), {})[r.seq] = (at, r.seq, r.price, r.volume)
            latest[r.symbol] = max(at, latest.get(r.symbol, at))
        for (s, start), held in list(ticks.items()):
            if start + HOUR <= latest[s] - 600_000_000:
                rows = sorted(held.values())
                prices = [r[2] for r in rows]
                closed[s, start // 1_000_000] = (prices[0], max(prices), min(prices), prices[-1], sum(r[3] for r in rows))
                del ticks[s, start]
    return sorted(late), closed


def test_stream_is_the_loop(spark, tmp_path):
    r = np.random.default_rng(3)
    batches = []
    for i in range(3):
        n = 400
        ts = START + pd.to_timedelta(np.r_[r.integers(0, 600, n // 8), r.integers(i * 600, i * 600 + 700, n - n // 8)], "m")
        f = pd.DataFrame({"symbol": r.choice(["a", "b", "c"], n), "ts": ts, "seq": 2**60 + i * n + np.arange(n), "price": r.normal(100, 5, n).round(2), "volume": 1.0})
        f = pd.concat([f, f.iloc[::7]], ignore_index=True)  # ticks sent twice
        f.loc[f.index[3], "ts"] = pd.NaT
        batches.append(f)
    folder = str(tmp_path)
    for f in batches:
        spark.createDataFrame(f, TICKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = st.bars_and_late(spark.readStream.schema(TICKS).parquet(f"{folder}/in"), "1 hour", "10 minutes")
        with st.rocksdb(spark):
            q = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        q.awaitTermination()
    got, (late, closed) = spark.read.parquet(f"{folder}/out"), loop(batches)
    assert sorted((x["symbol"], x["seq"]) for x in got.filter("late").collect()) == late and len(late) > 20
    bars = got.filter("not late").select("symbol", F.unix_timestamp("ts").alias("epoch"), "open", "high", "low", "close", "volume").collect()
    assert len(bars) == len(closed) and {tuple(x)[:2]: tuple(x)[2:] for x in bars} == closed
