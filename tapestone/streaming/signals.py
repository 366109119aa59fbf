"""Streams of bars: incremental sweeps, confirmations that expire, the regime filter, late bars, and the job that sends signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.folders import saved
from ..sources.bars import resample_ticks
from ..sources.lake import append_guarded, pending_events, stored, track_outcomes

SWEEPS = "symbol string, bar long, direction string, level double, depth double, taken boolean, anchor long, ema double"
CONFIRMED = "symbol string, bar long, direction string, status string, at long"
BARS_AND_LATE = "symbol string, late boolean, at long, seq long, price double, open double, high double, low double, close double, volume double"
PASSED = "symbol string, start long, kind string, at long, seq long, price double, volume double"
STATES = "symbol string, bar long, state long, confidence double"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which all functions here on ``transformWithStateInPandas`` need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def incremental_sweeps(bars: DataFrame, lookback: int = 20, period: int = 14, min_wick: float = 0.3, max_depth: float = 3.0, cooldown: int = 4, span: int = 50) -> DataFrame:
    """Sweeps of a stream of closed bars (symbol, bar, open, high, low, close), each new bar judged once.

    ``ema`` (of ``span`` bars) is carried from bar to bar, ``anchor`` is the first bar of the run of consecutive sweeps of
    one side, and ``taken`` tells the runs' first bars that are over ``cooldown`` bars after the last one taken. A bar
    seen before is left out. The state is a map of slots in which a new bar replaces the oldest, so that a batch
    writes its own bars only, one row of carried numbers, and one row for each side.
    """
    keep = max(lookback, period)

    class Sweeps(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.ring = handle.getMapState("ring", "slot int", "bar long, high double, low double, tr double")
            self.carry = handle.getValueState("carry", "n long, bar long, close double, ema double")
            self.sides = handle.getMapState("sides", "side string", "anchor long, last long, taken long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            n, seen, close, ema = self.carry.get() if self.carry.exists() else (0, -1, np.nan, np.nan)
            new = pd.concat(list(rows)).sort_values("bar").drop_duplicates("bar", keep="last")
            new = new[new["bar"] > seen].astype({c: "float64" for c in ("open", "high", "low", "close")}).reset_index(drop=True)
            if not len(new):
                return
            prior = new["close"].shift(1)
            prior.iloc[0] = close
            new["tr"] = np.fmax(new["high"] - new["low"], np.fmax((new["high"] - prior).abs(), (new["low"] - prior).abs()))
            emas = []
            for c in new["close"]:
                ema = c if n == 0 and not emas else ema + 2 / (span + 1) * (c - ema)
                emas.append(ema)
            held = sorted(tuple(r) for r in self.ring.values())
            ring = pd.DataFrame(held, columns=["bar", "high", "low", "tr"])
            both = pd.concat([ring, new[["bar", "high", "low", "tr"]]], ignore_index=True) if len(ring) else new
            own = slice(len(ring), None)
            past = lambda s: s.shift(1).rolling(lookback)
            new["atr"] = both["tr"].rolling(period).mean().to_numpy()[own]
            new["floor"], new["roof"] = past(both["low"]).min().to_numpy()[own], past(both["high"]).max().to_numpy()[own]
            new["ema"] = emas
            atr, size = new["atr"].replace(0.0, np.nan), (new["high"] - new["low"]).replace(0.0, np.nan)
            judged = {
                "long": ("floor", (new["floor"] - new["low"]) / atr, new["close"] > new["floor"], (new[["open", "close"]].min(axis=1) - new["low"]) / size),
                "short": ("roof", (new["high"] - new["roof"]) / atr, new["close"] < new["roof"], (new["high"] - new[["open", "close"]].max(axis=1)) / size),
            }
            out = []
            for side, (level, depth, back, wick) in judged.items():
                hit = (depth > 0) & (depth <= max_depth) & back & (wick >= min_wick)
                if not hit.any():
                    continue
                anchor, last, taken = self.sides.getValue((side,)) if self.sides.containsKey((side,)) else (-1, -2, -1)
                for bar, lv, dp, e in zip(new["bar"][hit], new[level][hit], depth[hit], new["ema"][hit], strict=True):
                    fresh = last < 0 or bar - last > 1
                    anchor, last = (int(bar) if fresh else anchor), int(bar)
                    take = fresh and (taken < 0 or bar - taken > cooldown)
                    taken = int(bar) if take else taken
                    out.append((key[0], int(bar), side, float(lv), float(dp), bool(take), anchor, float(e)))
                self.sides.updateValue((side,), (anchor, last, taken))
            total = n + len(new)
            for i, r in enumerate(new.tail(keep).itertuples(), max(n, total - keep)):
                self.ring.updateValue((i % keep,), (int(r.bar), float(r.high), float(r.low), float(r.tr)))
            self.carry.update((total, int(new["bar"].iloc[-1]), float(new["close"].iloc[-1]), float(ema)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SWEEPS.split(", ")])

        def close(self) -> None:
            pass

    return bars.groupBy("symbol").transformWithStateInPandas(Sweeps(), SWEEPS, "Append", "None")


def pending_confirmations(bars: DataFrame, max_wait: int = 8, patience: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """A stream of bars with sweep flags (sweep_long, sweep_short) to their fate: confirmed at the first close beyond the sweep's range, or expired after ``max_wait`` bars without one.

    With ``patience`` (bars need ``ts``) a sweep also expires, ``at`` null, when event time passes its own by that much:
    by a timer on the stream's watermark, so that a series that falls silent leaves nothing behind; bars that come
    later than that confirm nothing. Rows of the state are one for each waiting sweep, written when it comes and when
    it goes.
    """
    timed = patience is not None
    if timed:
        wait = int(pd.Timedelta(patience).total_seconds() * 1000)
        bars = bars.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))

    class Waiting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "bar long")
            self.waiting = handle.getMapState("waiting", "bar long, side string", "high double, low double, deadline long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            seen = self.seen.get()[0] if self.seen.exists() else -1
            new = pd.concat(list(rows)).sort_values("bar").drop_duplicates("bar", keep="last")
            before = {tuple(k): tuple(v) for k, v in self.waiting.iterator()}
            now, out = dict(sorted(before.items())), []
            for row in new[new["bar"] > seen].itertuples():
                for (bar, side), (high, low, deadline) in list(now.items()):
                    if timed and row.ms > deadline:
                        fate = ("expired", None)
                    elif row.close > high if side == "long" else row.close < low:
                        fate = ("confirmed", int(row.bar))
                    elif row.bar - bar >= max_wait:
                        fate = ("expired", int(row.bar))
                    else:
                        continue
                    out.append((key[0], bar, side, *fate))
                    del now[bar, side]
                for side in ("long", "short"):
                    if getattr(row, f"sweep_{side}"):
                        now[int(row.bar), side] = (float(row.high), float(row.low), int(row.ms) + wait if timed else 0)
                seen = int(row.bar)
            for k in before.keys() - now.keys():
                self.waiting.removeKey(k)
            for k in now.keys() - before.keys():
                self.waiting.updateValue(k, now[k])
                if timed:
                    self.handle.registerTimer(now[k][2])
            self.seen.update((seen,))
            yield _fates(out)

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            at = expiredTimerInfo.getExpiryTimeInMs()
            gone = sorted(tuple(k) for k, v in self.waiting.iterator() if v[2] <= at)
            for k in gone:
                self.waiting.removeKey(k)
            yield _fates([(key[0], bar, side, "expired", None) for bar, side in gone])

        def close(self) -> None:
            pass

    def _fates(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CONFIRMED.split(", ")]).astype({"at": "Int64"})

    return bars.groupBy("symbol").transformWithStateInPandas(Waiting(), CONFIRMED, "Append", "EventTime" if timed else "None")


def bars_and_late(ticks: DataFrame, rule: str, lateness: str) -> DataFrame:
    """Closed bars of a stream of ticks (symbol, ts, seq, price, volume), and beside them the ticks that came too late for theirs (``late``).

    A series' window closes when one of its ticks lies ``lateness`` beyond its end; a tick for a window that earlier
    batches have closed is a late row, all others count, once for each ``seq``. Two steps keep state. The first, by
    series, passes ticks on chunk by chunk and holds how far the series has come and the starts of its open windows; it
    marks late ticks, and adds a row for each window that is over. The second, by series and window, holds an open
    window's ticks, one row each. So a task holds one window's ticks at a time, however many a batch has. Split the
    output by ``late``; ``window_repairs`` mends the bars.
    """
    width, delay = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (rule, lateness))
    passed, columns = ([c.split()[0] for c in x.split(", ")] for x in (PASSED, BARS_AND_LATE))
    held = ["seq", "at", "price", "volume"]

    class Fronts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.front = handle.getValueState("front", "latest long")
            self.open = handle.getMapState("open", "start long", "width long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            before = self.front.get()[0] if self.front.exists() else None
            latest, starts = before, set()
            for part in rows:
                part = part.astype({"at": "int64", "seq": "int64", "price": "float64", "volume": "float64"})
                start = part["at"] // width * width
                late = start + width <= before - delay if before is not None else start != start
                yield part.assign(symbol=key[0], start=start, kind=np.where(late, "late", "tick"))[passed]
                if not late.all():
                    newest = int(part["at"][~late].max())
                    latest = newest if latest is None else max(latest, newest)
                    starts.update(start[~late].unique().tolist())
            if not starts:
                return
            waiting = {k[0] for k in self.open.keys()}
            over = {x for x in waiting | starts if x + width <= latest - delay}
            if over:  # without nulls, with which a chunk's long columns would come as doubles
                yield pd.DataFrame({"symbol": key[0], "start": sorted(over), "kind": "over", "at": 0, "seq": 0, "price": 0.0, "volume": 0.0})[passed]
            for x in waiting & over:
                self.open.removeKey((x,))
            for x in starts - waiting - over:
                self.open.updateValue((x,), (width,))
            self.front.update((latest,))

        def close(self) -> None:
            pass

    class Windows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.ticks = handle.getMapState("ticks", "seq long", "at long, price double, volume double")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            parts, over = [], False
            for part in rows:
                late = part[part["kind"] == "late"]
                if len(late):
                    yield late.assign(late=True).reindex(columns=columns).astype({"at": "Int64", "seq": "Int64"})
                over |= bool((part["kind"] == "over").any())
                parts.append(part.loc[part["kind"] == "tick", held].astype({"seq": "int64", "at": "int64"}))
            t = pd.concat(parts, ignore_index=True).drop_duplicates("seq", keep="last")
            if not over:
                for seq, *v in t.itertuples(index=False):
                    self.ticks.updateValue((seq,), tuple(v))
                return
            kept = [(*k, *v) for k, v in self.ticks.iterator()]
            self.ticks.clear()
            if kept:
                t = pd.concat([pd.DataFrame(kept, columns=held), t], ignore_index=True).drop_duplicates("seq", keep="last")
            t = t.sort_values(["at", "seq"]).assign(at=key[1])
            b = t.groupby("at").agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), volume=("volume", "sum")).reset_index()
            yield b.assign(symbol=key[0], late=False).reindex(columns=columns).astype({"seq": "Int64"})

        def close(self) -> None:
            pass

    rows = ticks.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "price", "volume").filter("at is not null")
    marked = rows.groupBy("symbol").transformWithStateInPandas(Fronts(), PASSED, "Append", "None")
    out = marked.groupBy("symbol", "start").transformWithStateInPandas(Windows(), BARS_AND_LATE, "Append", "None")
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def window_repairs(ticks: DataFrame, late: DataFrame, rule: str) -> DataFrame:
    """Bars of just those windows that ``late`` rows fall into, from all stored ``ticks``; a tick stored twice counts once."""
    start = F.window(F.col("ts").cast("timestamp"), rule).start
    hurt = late.select("symbol", start.alias("_start")).distinct()
    touched = ticks.withColumn("_start", start).join(hurt, ["symbol", "_start"], "left_semi")
    return resample_ticks(touched.dropDuplicates(["symbol", "seq"]).drop("_start"), rule)


def with_repairs(stored_bars: DataFrame, repairs: DataFrame) -> DataFrame:
    """The bars with the repaired ones in the place of theirs."""
    return stored_bars.join(repairs, ["symbol", "ts"], "left_anti").unionByName(repairs)


def streaming_states(rows: DataFrame, means: tuple[float, ...], sigmas: tuple[float, ...], stay: float = 0.95) -> DataFrame:
    """The regime filter on a stream of (symbol, bar, x): one posterior for each new bar; the state is the log posterior."""
    k = len(means)
    mu, sd = np.array(means), np.array(sigmas)
    trans = np.full((k, k), np.log((1 - stay) / max(k - 1, 1)))
    np.fill_diagonal(trans, np.log(stay))

    class Filter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.posterior = handle.getValueState("posterior", "bar long, alpha array<double>")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            seen, alpha = self.posterior.get() if self.posterior.exists() else (-1, np.full(k, -np.log(k)))
            new = pd.concat(list(rows)).sort_values("bar").drop_duplicates("bar", keep="last")
            new, alpha, out = new[new["bar"] > seen], np.array(alpha, float), []
            density = -0.5 * ((new["x"].to_numpy(float)[:, None] - mu) / sd) ** 2 - np.log(sd)
            density = np.where(np.isnan(density), 0.0, density)
            for bar, d in zip(new["bar"], density, strict=True):
                alpha = np.logaddexp.reduce(alpha[:, None] + trans, axis=0) + d
                alpha = alpha - np.logaddexp.reduce(alpha)
                out.append((key[0], int(bar), int(alpha.argmax()), float(np.exp(alpha.max()))))
            if len(new):
                self.posterior.update((int(new["bar"].max()), alpha.tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

        def close(self) -> None:
            pass

    return rows.groupBy("symbol").transformWithStateInPandas(Filter(), STATES, "Append", "None")


def latest_candles(candles: DataFrame, rule: str, lateness: str) -> DataFrame:
    """Bars of a stream of candle messages (symbol, ts, seq, open, high, low, close, volume): of one time the message with the greatest ``seq`` stands, and it is emitted once its time has passed by ``lateness``."""
    last = F.max_by(F.struct("open", "high", "low", "close", "volume"), "seq")
    held = candles.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", rule).alias("w")).agg(last.alias("b"))
    return held.select("symbol", F.col("w.start").alias("ts"), "b.*")


def repaired(stored_bars: DataFrame, recomputed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The recomputed bars, and those among them that late rows have changed or added: the batch run's correction of what a stream has emitted."""
    values = ("open", "high", "low", "close", "volume")
    old = stored_bars.select("symbol", "ts", F.struct(*values).alias("_old"))
    joined = recomputed.join(old, ["symbol", "ts"], "left")
    return recomputed, joined.filter(~F.col("_old").eqNullSafe(F.struct(*values))).drop("_old")


def signal_job(plan: Callable[[DataFrame], DataFrame], lake: str, signals: str, shadow: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new rows go to the table ``lake``, ``plan`` runs over the whole lake as a batch, and its events that were not sent yet go out.

    ``plan`` gives event_id, lifecycle_state and what a signal needs. Live events go to ``signals``, shadow ones to
    ``shadow``; others are dropped. A batch that is run again sends nothing twice.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{lake}/batch={batch_id}")
        events = plan(spark.read.parquet(lake).drop("batch"))
        for state, path in (("live", signals), ("shadow", shadow)):
            append_guarded(events.filter(F.col("lifecycle_state") == state), path, ["event_id"], known="skip")

    return run


def span_job(plan: Callable[[DataFrame], DataFrame], lake: str, signals: str, shadow: str, marks: str, span: str, rule: str) -> Callable[[DataFrame, int], None]:
    """``signal_job`` with work bounded by ``span``: a ``foreachBatch`` function for ticks (symbol, ts, ...) whose batches read the same however long the lake is.

    New rows go to the table ``lake`` by day. Of each series in the batch, ``plan`` sees the ticks from ``span`` before the
    first bar (of length ``rule``) that the batch changes or closes; its events (event_id, symbol, ts of the bar,
    lifecycle_state, ...) from that bar on are kept, but none at the series' last bar, which is still open. How far each
    series is judged is stored under ``marks`` for each batch, so that a batch that is run again does the same. The id
    must be a function of the event's series and time, since sinks are by day and known ids are looked for there.
    ``span`` has to hold the longest pattern's bars, gaps included.
    """
    length = F.expr(f"interval {span}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = saved(batch, "batch")
        rows.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(lake)
        bar = F.window(F.col("ts").cast("timestamp"), rule).start
        fresh = rows.groupBy("symbol").agg(F.min(bar).alias("_lo"), F.max(bar).alias("_hi"))
        old = stored(spark, f"{marks}/batch={batch_id - 1}")
        if old is None:
            old = spark.createDataFrame([], "symbol string, open_bar timestamp")
        reach = fresh.join(old, "symbol", "full").select("symbol", "_lo", F.least("_lo", "open_bar").alias("_since"), F.greatest("_hi", "open_bar").alias("open_bar"))
        reach = saved(reach, "reach")
        asked = reach.filter(F.col("_lo").isNotNull())
        # a series that was silent reads around its last bar and around the new ones, not what lies between
        spans = F.array(F.struct((F.col("_since") - length).alias("a"), F.col("_since").alias("b")), F.struct((F.col("_lo") - length).alias("a"), F.col("open_bar").alias("b")))
        days = asked.select(F.explode(spans).alias("s")).select(F.explode(F.sequence(F.to_date("s.a"), F.to_date(F.col("s.b") + F.expr(f"interval {rule}")))).alias("day")).distinct()
        wanted = [r[0] for r in days.collect()]  # the days of a batch and a span
        schema = f"{rows.schema.simpleString()[7:-1]},day:date,batch:bigint".replace(":", " ")
        seen = spark.read.schema(schema).parquet(lake).filter(F.col("day").isin(wanted)).drop("day", "batch")
        near = seen.join(asked.select("symbol", "_since"), "symbol").filter(F.col("ts") >= F.col("_since") - length).drop("_since")
        events = plan(near).join(asked.select("symbol", "_since", F.col("open_bar").alias("_open")), "symbol").filter((F.col("ts") >= F.col("_since")) & (F.col("ts") < F.col("_open"))).drop("_since", "_open")
        events = saved(events.withColumn("day", F.to_date("ts")), "events")
        for state, path in (("live", signals), ("shadow", shadow)):
            append_guarded(events.filter(F.col("lifecycle_state") == state), path, ["event_id"], ["day"], known="skip")
        reach.select("symbol", "open_bar").write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return run


def outcome_job(events: str, lake: str, outcomes: str, horizon: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for closed bars (symbol, bar, ts, ...): they go to the table ``lake``, and outcomes of the table ``events`` whose window has closed to ``outcomes`` (see ``track_outcomes``).

    Only bars from a series' first pending entry on are read. Meant for ``availableNow`` runs at intervals; a batch that
    is run again adds nothing twice.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{lake}/batch={batch_id}")
        known = stored(spark, events)
        if known is None:
            return
        first = pending_events(known, stored(spark, outcomes)).groupBy("symbol").agg(F.min("entry_bar").alias("_first"))
        bars = spark.read.parquet(lake).drop("batch").join(first, "symbol").filter(F.col("bar") >= F.col("_first")).drop("_first")
        track_outcomes(known, outcomes, saved(bars, "pending-bars"), horizon)

    return run


def sent(spark, signals: str, shadow: str) -> DataFrame:
    """All rows of both sinks, with ``sink``."""
    parts = [(stored(spark, p), n) for p, n in ((signals, "signals"), (shadow, "shadow"))]
    parts = [df.withColumn("sink", F.lit(n)) for df, n in parts if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
